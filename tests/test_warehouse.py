"""The one-pass build and the profiles on small tables."""

import json

import pytest
from pyspark.sql import functions as F

from quaystat.operators import build, profiles, warehouse

DATA = "/root/testdata/sf0.001"
MODEL = build.Model("D", "per", ("gem", "prov"), ("a", "b", "c"), (("m1", "EUR"), ("m2", "COUNT")))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def facts(spark, cells):
    raw = spark.createDataFrame([("D", k, c if isinstance(c, str) or c is None else json.dumps(c)) for k, c in enumerate(cells)] + [("E", 99, '{"m1": "1"}')], "dataset_id string, row_id int, raw string")
    dates = spark.createDataFrame([("2000JJ00", 11, "year", 2000)], "period_code string, date_key long, period_type string, calendar_year long")
    places = spark.createDataFrame([("GM1", 21, "One", "municipality"), ("PV1", 22, "Prov", "province")], "geography_code string, geography_key long, geography_name string, geography_type string")
    cats = spark.createDataFrame([("a", "x", "Ex"), ("a", "UNKNOWN", "Unknown a"), ("b", "y", "Why")], "dimension_code string, category_code string, category_name string")
    return build.facts(raw, MODEL, dates, places, cats)


def test_facts(spark):
    rows = facts(spark, [{"per": "2000JJ00", "gem": "GM1", "a": "x", "b": "y", "m1": "1.50", "m2": None}, {"per": "?", "prov": "PV1", "a": "other", "b": "other", "m1": "x", "m2": "."}, {"m1": "n/a"}, {"a": "x"}, "no json", None, {"per": None, "gem": "GM9", "a": None, "m2": "7"}]).collect()
    got = {(r.row_id, r.measure_code): r for r in rows}
    assert set(got) == {("0", "m1"), ("0", "m2"), ("1", "m1"), ("1", "m2"), ("2", "m1"), ("6", "m2")}
    r = got["0", "m1"]
    assert (r.date_key, r.calendar_year, r.geography_key, r.geography_code, float(r.value), r.status, r.is_missing) == (11, 2000, 21, "GM1", 1.5, "reported", False)
    assert [c.category_code for c in r.categories] == ["x", "y"]
    assert (got["0", "m2"].status, got["0", "m2"].is_missing, got["0", "m2"].value) == ("missing", True, None)
    r = got["1", "m1"]
    assert (r.date_key, r.geography_key, r.status, r.is_suppressed, r.is_missing, r.value, r.value_text) == (-1, 22, "suppressed", True, True, None, "x")
    assert [c.category_name for c in r.categories] == ["Unknown a"]
    assert got["1", "m2"].status == "missing" and got["2", "m1"].value is None and got["2", "m1"].value_text == "n/a" and got["2", "m1"].categories == []
    r = got["6", "m2"]
    assert (r.geography_key, r.geography_code, float(r.value)) == (-1, None, 7.0) and [c.category_code for c in r.categories] == ["UNKNOWN"]
    assert len({r.record_hash for r in rows}) == len(rows)


def test_the_build_shuffles_no_row(spark):
    f = warehouse._facts(spark, DATA)
    for df in (f, build.bridge(f)):
        plan = plan_of(df)
        assert "BroadcastHashJoin" in plan and plan.count("Exchange") == plan.count("BroadcastExchange") and "SortMergeJoin" not in plan


def test_bridge_has_the_facts_members(spark):
    f = facts(spark, [{"a": "x", "b": "y", "m1": "1", "m2": "2"}])
    links = build.bridge(f).collect()
    assert len(links) == 4 and {r.observation_key for r in links} == {r.observation_key for r in f.collect()} and len({r.category_key for r in links}) == 2


def test_footers_are_read_and_no_rows(spark, tmp_path):
    df = spark.range(100).select("id", F.when(F.col("id") % 3 == 0, F.col("id") / 7).alias("d"), F.lit("t").alias("s"), F.array("id").alias("l"), (F.col("id") > 5).alias("b"), F.lit(None).cast("int").alias("n"))
    df.write.parquet(str(tmp_path / "t"))
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    assert "PushedAggregation: [COUNT(*), COUNT(id)" in plan_of(profiles.footer_counts(own.read.parquet(str(tmp_path / "t")), ["id", "d"]))
    p = profiles.footer_profile(spark, str(tmp_path / "t"))
    got = {r["column"]: tuple(r)[1:] for r in p.collect()}
    exact = df.agg(F.count("*"), F.min("d"), F.max("d"), F.count("d")).first()
    assert got["id"] == (100, 0, "0", "99") and got["s"] == (100, 0, None, None) and got["l"] == (100, None, None, None)
    assert got["d"] == (exact[0], exact[0] - exact[3], str(exact[1]), str(exact[2])) and got["b"] == (100, 0, "false", "true") and got["n"] == (100, 100, None, None)


def test_rollup_modes(spark):
    with pytest.raises(ValueError):
        profiles.fact_rollup(spark.range(1), spark.range(1), "wild")


def test_rollup_query_reads_every_fact(spark):
    """Each depth that looks at facts has all of each data set, in the code and in its SQL; no row is numbered or left out."""
    got = warehouse.fact_rollup_modes(spark, DATA)
    rows = lambda name: spark.read.parquet(f"{DATA}/{name}.parquet").count()
    seen = {(r.profile_depth, r.dataset_code): r.n for r in got.filter("profile_depth <> 'metadata_only'").groupBy("profile_depth", "dataset_code").agg(F.sum("fact_rows").alias("n")).collect()}
    depths = {d for d, _ in seen}
    assert depths and seen == {(d, s): n for d in depths for s, n in (("ORDERS", rows("orders")), ("LINEITEM", 2 * rows("lineitem")))}
    assert "Window" not in plan_of(got) and "Limit" not in plan_of(got) and "row_number" not in warehouse.ORACLES["fact_rollup_modes"]


def test_rollup_query_knows_no_year_of_facts_without_date(spark, tmp_path):
    for name in ("customer", "lineitem", "nation", "region", "orders"):
        df = spark.read.parquet(f"{DATA}/{name}.parquet")
        df = df.withColumn("o_orderdate", F.lit(None).cast(df.schema["o_orderdate"].dataType)) if name == "orders" else df
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    got = warehouse.fact_rollup_modes(spark, str(tmp_path)).select("profile_depth", "dataset_code", "min_year", "max_year").collect()
    assert {(r.min_year, r.max_year) for r in got if r.dataset_code == "ORDERS" and r.profile_depth != "metadata_only"} == {(None, None)}
    assert {(r.min_year, r.max_year) for r in got if r.profile_depth == "metadata_only"} == {(0, 0)} and all(r.min_year for r in got if r.dataset_code == "LINEITEM" and r.profile_depth == "fact_profiled")


def test_sampled_rollup_takes_the_first_rows_of_each_data_set(spark):
    cells = [(s, "m", k, 2000 + k, "municipality", "year", float(k), False) for s in ("A", "B") for k in range(9, -1, -1)]
    f = spark.createDataFrame(cells, "dataset_code string, measure_code string, observation_key long, calendar_year long, geography_type string, period_type string, value double, is_missing boolean")
    got = profiles.fact_rollup(f, None, "sampled", 3).collect()
    assert sorted((r.dataset_code, r.min_year, r.max_year, r.fact_rows, r.max_value, r.profile_depth) for r in got) == [(s, 2000, 2002, 3, 2.0, "sample_profiled") for s in ("A", "B")]


def test_qualification_falls_back_for_large_data_sets(spark):
    cells = [("A", "m", 2000 + k % 3, "municipality", "year", 1.0, False) for k in range(6)] + [("B", "m", 2000, None, "", 1.0, False), ("B", "m", 2001, "", None, 1.0, False), ("B", "n", 2001, "province", "quarter", None, False), ("C", "m", 2000, "municipality", "year", 1.0, True)]
    f = spark.createDataFrame(cells, "dataset_code string, measure_code string, calendar_year long, geography_type string, period_type string, value double, is_missing boolean")
    ind = spark.createDataFrame([("A", "m", "sum"), ("B", "m", "none"), ("B", "n", "sum"), ("C", "m", "sum")], "dataset_code string, measure_code string, default_aggregation string")
    stored = spark.createDataFrame([("a", "m", [1990], ["country"], ["national_year"])], "dataset_code string, measure_code string, available_years array<long>, geography_types array<string>, grains array<string>")
    got = {(r.dataset_code, r.measure_code): r for r in profiles.qualify(f, ind, stored, 3).collect()}
    assert set(got) == {("A", "m"), ("B", "m")}
    a, b = got["A", "m"], got["B", "m"]
    assert (a.profile_source, a.populated_rows, a.available_years, a.grains, a.supports_ranking, a.supports_comparison, a.executable_candidate) == ("by_measure", 6, [1990], ["national_year"], False, True, True)
    assert (b.profile_source, b.available_years, b.grains, b.executable_candidate, b.non_executable_reasons) == ("by_dataset", [2000, 2001], ["national_year"], False, ["missing_safe_aggregation"])
    assert {r.profile_source for r in profiles.qualify(f, ind, stored, 100).collect()} == {"by_dataset"}


def test_levels(spark):
    s = "domain_id string, dataset_code string, geography_types array<string>"
    g = spark.createDataFrame([("d", "1", ["province", "municipality"]), ("d", "2", [])], s)
    d = spark.createDataFrame([("d", "1", ["landsdeel", "province"]), ("d", "3", None)], s)
    c = spark.createDataFrame([("d", "4", ["unknown", "neighborhood"]), ("d", "2", [])], s)
    got = {r.dataset_code: (r.geography_types, r.grains) for r in profiles.resolved_levels(g, d, c).collect()}
    assert got == {
        "1": (["municipality", "province", "landsdeel"], ["municipality_year", "province_year", "landsdeel_year"]), "2": (["country"], ["country_year"]),
        "3": (["country"], ["country_year"]), "4": (["unknown", "neighborhood"], ["neighborhood_year", "unknown_year"]),
    }


def test_first_rows_of_groups(spark):
    rows = [("a", (k * 7919) % 5_000, k % 3) for k in range(5_000)] + [("b", k, 0) for k in range(7)] + [("c", 5, k) for k in range(300)] + [(None, k // 2, k) for k in range(500)] + [("d", None, k) for k in range(4)] + [("d", k, 0) for k in range(400)]
    df = spark.createDataFrame(rows, "g string, k long, m int")
    got = profiles.first_rows(df, "g", ["k", "m"], 10)
    want = [r for g in ("a", "b", "c", None, "d") for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))[:10]]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    near = got._jdf.queryExecution().optimizedPlan().toString()
    assert near.index("Window [row_number") < near.index("least__")  # rows behind the bound are left out before they are sorted
