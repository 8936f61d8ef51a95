"""Versions, merges, failed and repeated loads; a stream into a table; trees by pointer doubling."""

import random

import pytest
from pyspark.sql import functions as F

from quaystat.operators.hierarchy import ancestors
from quaystat.operators.versioned import VersionedTable

SCHEMA = "k long, name string, n long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture
def table(spark, tmp_path):
    return VersionedTable(spark, str(tmp_path / "t"), ("k",), SCHEMA, 4)


def test_merge_replaces_by_key(spark, table):
    assert table.version() == 0 and table.read().count() == 0
    table.merge(frame(spark, [(k, "a", 1) for k in range(20)] + [(None, "null", 1)]))
    table.merge(frame(spark, [(3, "b", 2), (3, "a", 9), (50, None, None), (None, "null", 2)]))
    want = {k: (k, "a", 1) for k in range(20)} | {3: (3, "b", 2), 50: (50, None, None), None: (None, "null", 2)}
    assert rows(table.read()) == sorted(want.values(), key=str)
    assert rows(table.read(1)) == sorted([(k, "a", 1) for k in range(20)] + [(None, "null", 1)], key=str)


def test_only_touched_partitions_are_written(spark, table):
    table.merge(frame(spark, [(k, "a", 1) for k in range(200)]))
    before = {e.part: e.folder for e in table.entries()}
    table.merge(frame(spark, [(7, "b", 1)]))
    after = {e.part: e.folder for e in table.entries()}
    assert len(before) == 4 and sum(before[p] != after[p] for p in before) == 1


def test_a_failed_write_leaves_the_old_version(spark, table):
    table.merge(frame(spark, [(1, "a", 1)]))
    with pytest.raises(Exception):
        table.merge(frame(spark, [(1, "b", 2), (2, "c", 3)]).withColumn("n", F.when(F.col("k") == 2, F.raise_error(F.lit("lost")).cast("long")).otherwise(F.col("n"))))
    assert table.version() == 1 and rows(table.read()) == [(1, "a", 1)]
    spark.createDataFrame([(0, "half", None)], "part int, folder string, load string").write.parquet(f"{table.path}/versions/2")
    import os

    os.remove(f"{table.path}/versions/2/_SUCCESS")  # as if the writer of the list was lost
    assert table.version() == 1 and rows(table.read()) == [(1, "a", 1)]


def test_two_writers_of_a_version(spark, table):
    table.merge(frame(spark, [(1, "a", 1)]))
    table._commit(1, "", [], [], "other")
    with pytest.raises(Exception):
        table._commit(1, "", [], [], "mine")
    assert table.loads() == {"other"} and rows(table.read()) == [(1, "a", 1)]


def test_a_load_is_done_once(spark, table):
    more = frame(spark, [(1, "a", 5), (2, "b", 7)])
    for _ in range(2):
        table.merge(more, load="chunk-1", how={"n": "sum"})
    assert table.version() == 1
    table.merge(more, load="chunk-2", how={"n": "sum"})
    assert rows(table.read()) == [(1, "a", 10), (2, "b", 14)] and table.loads() == {"chunk-1", "chunk-2"}


def test_deletes_and_patches(spark, table):
    table.merge(frame(spark, [(k, "a", k) for k in range(30)]))
    table.merge(frame(spark, [(4, "a", 0), (5, "a", 0)]), delete=F.col("n") == 0)
    table.delete(F.col("k") >= 20)
    table.patch({"name": F.lit("patched")}, F.col("k") < 3)
    assert rows(table.read()) == sorted(((k, "patched" if k < 3 else "a", k) for k in range(20) if k not in (4, 5)), key=str)
    v = table.version()
    assert table.delete(F.col("k") > 1000) == v and table.patch({"n": F.lit(0)}, F.lit(False)) == v
    table.delete(F.lit(True))
    assert table.read().count() == 0
    table.merge(frame(spark, []))
    assert table.read().count() == 0


def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path):
    src, state = str(tmp_path / "src"), str(tmp_path / "state")
    table = VersionedTable(spark, str(tmp_path / "t"), ("k",), SCHEMA, 3)
    frame(spark, [(1, "a", 1), (2, "a", 2)]).write.parquet(src)

    def run(checkpoint):
        stream = spark.readStream.schema(SCHEMA).parquet(src)
        stream.writeStream.foreachBatch(table.sink({"n": "sum"})).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()

    run(state)
    run(state)
    assert rows(table.read()) == [(1, "a", 1), (2, "a", 2)]
    frame(spark, [(2, "b", 10), (3, "c", 3)]).write.mode("append").parquet(src)
    run(state)
    assert rows(table.read()) == [(1, "a", 1), (2, "b", 12), (3, "c", 3)]
    run(str(tmp_path / "lost"))  # the stream's own notes are lost: batch 0 comes again, with all files
    assert rows(table.read()) == [(1, "a", 1), (2, "b", 12), (3, "c", 3)]


# Trees


def brute_path(parent, k):
    out = [k]
    while parent.get(out[-1]) in parent and parent[out[-1]] not in out:
        out.append(parent[out[-1]])
    return out[::-1]


def check_tree(spark, parent):
    df = spark.createDataFrame([(k, p, f"t{k}") for k, p in parent.items()], "id long, parent long, title string")
    got = {r.id: r for r in ancestors(df).collect()}
    assert set(got) == set(parent)
    for k in parent:
        want = brute_path(parent, k)
        assert got[k].path == want and got[k].titles == [f"t{x}" for x in want] and got[k].root == want[0] and got[k].depth == len(want)
        assert got[k].is_loop == (parent[want[0]] in parent)


def test_chain_of_a_thousand(spark):
    check_tree(spark, {k: k - 1 if k else None for k in range(1000)})


def test_loops_orphans_and_random_parents(spark):
    check_tree(spark, {1: 2, 2: 3, 3: 1, 4: 1, 5: 4, 6: 6, 7: 99, 8: 7, 9: None, 10: 9})
    rng = random.Random(1)
    check_tree(spark, {k: rng.choice([None, *range(300)]) if rng.random() < 0.1 else rng.randrange(300) for k in range(300)})


def test_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, None, "a"), (2, 1, "b"), (2, 1, "b"), (None, 1, "x"), (3, 2, None)], "id long, parent long, title string")
    assert sorted((r.id, r.path, r.titles) for r in ancestors(df).collect()) == [(1, [1], ["a"]), (2, [1, 2], ["a", "b"]), (3, [1, 2, 3], ["a", "b", None])]
    assert ancestors(df.limit(0)).count() == 0
