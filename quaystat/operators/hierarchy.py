"""Trees given by parents: paths from the root, for any depth, by pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystat.store import written

MAX_ROUNDS = 64


def ancestors(nodes: DataFrame, id_col: str = "id", parent_col: str = "parent", title_col: str = "title") -> DataFrame:
    """(id_col, path, titles, root, depth, is_loop): ids and titles from the root to each node.

    A round doubles the length of every path that has not ended: a chain of n takes log2(n) + 1 rounds of one join. A path ends at a node
    without a parent, at one whose parent is not there (an orphan is its own root), or where it would come back to a node that it has; is_loop tells
    the last. Of rows that share an id the one of smallest parent and title stays; rows with a null id are left out. Each round's table is written, so a lost
    executor costs no earlier round.
    """
    one = nodes.filter(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(F.struct(F.col(parent_col).alias("p"), F.col(title_col).alias("t"))).alias("n"))
    known = one.select(F.col("id").alias("known"))
    state = one.join(known, F.col("n.p") == F.col("known"), "left").select("id", F.array("id").alias("path"), F.array("n.t").alias("titles"), F.col("known").alias("next"), F.lit(False).alias("is_loop"))
    state = written(state, "paths")
    for _ in range(MAX_ROUNDS):
        if state.filter("next is not null").isEmpty():
            break
        up = state.select(F.col("id").alias("u_id"), F.col("path").alias("u_path"), F.col("titles").alias("u_titles"), F.col("next").alias("u_next"), F.col("is_loop").alias("u_loop"))
        again = F.get(F.array_intersect("u_path", "path"), F.lit(0))
        new = F.when(again.isNull(), F.size("u_path")).otherwise(F.array_position("u_path", again).cast("int") - 1)
        more = state.filter("next is not null").join(up, F.col("next") == F.col("u_id")).withColumns({"again": again, "new": new})
        more = more.select(
            "id", F.concat("path", F.slice("u_path", F.lit(1), F.col("new"))).alias("path"), F.concat("titles", F.slice("u_titles", F.lit(1), F.col("new"))).alias("titles"),
            F.when(F.col("again").isNull(), F.col("u_next")).alias("next"), (F.col("again").isNotNull() | F.col("u_loop")).alias("is_loop"),
        )
        state = written(state.filter("next is null").unionByName(more), "paths")
    else:
        raise RuntimeError(f"paths have not ended after {MAX_ROUNDS} rounds")
    down = F.reverse("path")
    return state.select(F.col("id").alias(id_col), down.alias("path"), F.reverse("titles").alias("titles"), F.get(down, F.lit(0)).alias("root"), F.size("path").alias("depth"), "is_loop")
