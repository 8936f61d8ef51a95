"""Near-duplicate documents by 64-bit fingerprints and BK-trees.

Fingerprints that differ in at most RADIUS bits agree in all but RADIUS of `blocks` runs of bits, so every
choice of the other runs is a table, and a pair to be found shares the key of some table. A key's fingerprints form
one BK-tree: a child hangs at its parent by their Hamming distance, and a search follows only the edges within RADIUS of
the distance to the parent. The trees of many keys lie together in a shard; a key with very many
fingerprints has several trees of bounded size, each of which gets all searches of that key. No tree is ever
sent to all tasks: all trees together grow with the data.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystat.llm.common import ship, written
from quaystat.llm.linkage import components

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints in one tree at most, and entries that one shard has on average.
TREE, SHARD = 8192, 1 << 16
#: Shingle hashes whose bits are counted together, and pairs (search, node) that are compared together.
PART, FRONT = 1 << 16, 1 << 20
_U = np.uint64


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """The signed 64-bit fingerprint: a bit is 1 if over half of the shingles' hashes have it; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    row, ends, at = b" ".join(words), [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    k = min(k, len(words))
    starts = [0, *(e + 1 for e in ends[: len(words) - k])]
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for lo in range(0, len(starts), PART):
        h = np.array([digest(row[a:b], SEED) for a, b in zip(starts[lo : lo + PART], ends[lo + k - 1 :])], _U)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(starts), bitorder="little").view(np.int64)[0])


def fingerprints(df: DataFrame, id_col: str, text_col: str, k: int = SHINGLE) -> DataFrame:
    """(id, fp) for each row; no shuffle."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint(t.as_py(), k) for t in b.column(1)], pa.int64())], ["id", "fp"])

    return df.select(id_col, text_col).mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, fp long")


def masks(blocks: int, radius: int = RADIUS) -> list[int]:
    """A mask of bits for each table: the runs that must agree."""
    bound = [64 * i // blocks for i in range(blocks + 1)]
    run = [(1 << b) - (1 << a) for a, b in zip(bound, bound[1:])]
    return [sum(run[i] for i in kept) for kept in combinations(range(blocks), blocks - radius)]


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """BK-trees of fingerprints, one for each value of `tree`, as arrays.

    Nodes are the places 0..n-1 of `fps`. `keys` has 65 * parent + distance for every child, sorted; `child` is the child there.
    """

    def __init__(self, fps: np.ndarray, tree: np.ndarray):
        self.fps = fps.astype(_U)
        self.names, root, group = np.unique(tree, return_index=True, return_inverse=True)
        self.roots = root
        todo = np.setdiff1d(np.arange(len(fps)), root)
        parent, keys, child = root[group[todo]], [], []
        while len(todo):
            key = parent * 65 + distance(self.fps[todo], self.fps[parent])
            new, first, group = np.unique(key, return_index=True, return_inverse=True)
            keys.append(new)
            child.append(todo[first])
            rest = np.ones(len(todo), bool)
            rest[first] = False
            parent, todo = todo[first][group][rest], todo[rest]
        self.keys = np.concatenate([np.zeros(0, np.int64), *keys])
        self.child = np.concatenate([np.zeros(0, np.int64), *child])
        order = np.argsort(self.keys)
        self.keys, self.child = self.keys[order], self.child[order]

    def near(self, fps: np.ndarray, tree: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (place in the searches, node) that differ in at most radius bits, a batch at a time."""
        if not len(self.names):
            return
        at = np.minimum(np.searchsorted(self.names, tree), len(self.names) - 1)
        search = np.flatnonzero(self.names[at] == tree)
        stack, fps = [(search, self.roots[at[search]])], fps.astype(_U)
        while stack:
            q, node = stack.pop()
            if len(q) > FRONT:
                stack += [(q[i : i + FRONT], node[i : i + FRONT]) for i in range(0, len(q), FRONT)]
                continue
            d = distance(fps[q], self.fps[node])
            hit = d <= radius
            if hit.any():
                yield q[hit], node[hit]
            lo = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0))
            n = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), side="right") - lo
            if total := int(n.sum()):
                place = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(total)
                stack.append((np.repeat(q, n), self.child[place]))


def joined(low: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """low[i], a smaller or equal place of the same component, after linking a[k] with b[k]: every tree of it is flat."""
    while True:
        x, y = low[a], low[b]
        open_ = x != y
        if not open_.any():
            return low
        a, b, x, y = a[open_], b[open_], x[open_], y[open_]
        low = low.copy()
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(low, up := low[low]):
            low = up


def _links(group: pa.Table) -> pa.Table:
    """A forest of links among the fingerprints of a shard. side: 0 in the tree and searched for, 1 in the tree, 2 searched for."""
    fp, key, side = group["fp"].to_numpy(), group["key"].to_numpy(), group["side"].to_numpy()
    values, place = np.unique(fp, return_inverse=True)
    tree, ask = side < 2, side != 1
    forest, node = Forest(fp[tree], key[tree]), place[tree]
    asked, low = place[ask], np.arange(len(values))
    for q, n in forest.near(fp[ask], key[ask]):
        low = joined(low, asked[q], node[n])
    linked = np.flatnonzero(low != np.arange(len(values)))
    return pa.table({"a": pa.array(values[linked], pa.int64()), "b": pa.array(values[low[linked]], pa.int64())})


def links(fps: DataFrame, blocks: int | None = None, tree: int = TREE, shard: int = SHARD) -> DataFrame:
    """(a, b): links that connect what the links within RADIUS bits of the distinct longs fp connect.

    blocks: runs of bits; by itself as many as leave some sixteen random fingerprints a key.
    """
    ship(fps.sparkSession)
    n = fps.count()
    if blocks is None:
        blocks = next((b for b in (4, 5, 6, 7) if n >> (64 * (b - RADIUS) // b) < 16), 8)
    table = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)) for m in masks(blocks)]))
    entry = fps.select("fp", table.alias("t", "v")).select("fp", F.xxhash64("t", "v").alias("key"))
    full = entry.groupBy("key").agg(F.count("*").alias("c")).filter("c > 1")  # alone under its key: nothing to find
    entry = entry.join(full, "key").withColumn("nb", F.ceil(F.col("c") / tree).cast("int")).drop("c")
    own = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("nb")).cast("int")
    entry = entry.select("fp", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    i, j = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(i == j, 0).when(F.col("own") == i, 1).otherwise(2)
    entry = entry.select("fp", F.xxhash64("key", i, j).alias("key"), side.alias("side"))
    shards = max(1, len(masks(blocks)) * n // shard)
    entry = entry.withColumn("shard", F.pmod(F.xxhash64("key", F.lit(2)), F.lit(shards)))
    return entry.groupBy("shard").applyInArrow(_links, "a long, b long")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, blocks: int | None = None, tree: int = TREE) -> DataFrame:
    """(id_col, fingerprint, component_id) for each input row.

    Equal fingerprints are one node. Null and empty texts and texts without words have fingerprint zero and link like any
    other. A row with a null id has its fingerprint, links nothing and gets a null component. Rows that
    share an id link only by their own texts: each names the smallest id reachable from that text. Repeated rows each keep their
    row. Very long texts are read whole. Other columns are left out. An empty table gives no rows.
    """
    rows = written(fingerprints(df, id_col, text_col, k), "simhash-rows")
    nodes = written(rows.filter("id is not null").groupBy("fp").agg(F.min("id").alias("rep"), F.count("*").alias("c")), "simhash-nodes")
    linked = components(links(nodes.select("fp"), blocks, tree), "simhash-links").withColumnRenamed("node", "fp")
    named = nodes.join(linked, "fp", "left").filter("root is not null or c > 1")  # all others stand for themselves
    root = F.coalesce("root", "fp")
    low = named.groupBy(root.alias("root")).agg(F.min("rep").alias("component"))
    named = written(named.select("fp", root.alias("root")).join(low, "root").select("fp", "component"), "simhash-names")
    comp = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(named, "fp", "left").select(F.col("id").alias(id_col), text.alias("fingerprint"), comp.alias("component_id"))
