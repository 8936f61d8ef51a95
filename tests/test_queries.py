"""Every registered query of the library against its DuckDB oracle, on the smallest tables."""

import os

import duckdb
import pytest

from quaystat.registry import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{DATA}/{f}')")
    return c


def rows(df, cols):
    df = df[cols].astype(object)
    return sorted(map(str, df.where(df.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_oracle(spark, con, name):
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert rows(got, cols) == rows(want, cols)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)


def test_incremental_skip_reads_all_versions_of_the_orders(spark, con):
    """The name stands for the job over the orders' versions; that over the customers' keys has a name of its own."""
    got = QUERIES["incremental_skip"](spark, DATA)
    assert sorted(got.columns) == ["o_custkey", "version"] and "FROM orders" in ORACLES["incremental_skip"]
    assert sorted(QUERIES["incremental_skip_keys"](spark, DATA).columns) == ["c_custkey", "version"]
