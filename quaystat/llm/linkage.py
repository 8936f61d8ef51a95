"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaystat.llm.common import written

MAX_ROUNDS = 60
#: Of more than MANY edges, a node with more than one in HOT of them gets its minimum by broadcast (HOT rows at most):
#: its edges stay where they are instead of meeting in one task.
MANY, HOT = 1 << 20, 512


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, root) for every node of edges (a, b); root: the smallest node that can be reached.

    Large-star and small-star steps in turn, written to the shared folder after each round, until the edges are stars
    round their roots. Empty edges give no rows; loops, repeated and reversed edges do no harm.
    """

    def lowest(e: DataFrame, bound: int | None) -> DataFrame:
        """(a, b, m): m is the smallest of a and its neighbours."""
        own = F.least(F.min("b").over(Window.partitionBy("a")), F.col("a"))
        if bound is None:
            return e.select("a", "b", own.alias("m"))
        hot = e.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("hot"), F.count("*").alias("c")).filter(F.col("c") > bound)
        near = e.join(F.broadcast(hot.select("a", "hot")), "a", "left")
        return near.filter("hot is null").select("a", "b", own.alias("m")).unionByName(near.filter("hot is not null").withColumnRenamed("hot", "m"))

    def step(e: DataFrame, bound: int | None) -> DataFrame:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = lowest(both, bound).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        small = lowest(large.filter("a > b"), bound)
        ties = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a").alias("a"), F.col("m").alias("b"))))
        return small.select(ties.alias("t")).select("t.a", "t.b").filter("a <> b").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.max(F.xxhash64("b", "a"))).first())

    e = written(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), name)
    before = state(e)
    for _ in range(MAX_ROUNDS):
        if not before[0]:
            break
        e = written(step(e, 2 * before[0] // HOT if before[0] > MANY else None), name)
        now = state(e)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    nodes = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return nodes.unionByName(nodes.select(F.col("root").alias("node"), "root").distinct())
