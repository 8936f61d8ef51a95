"""Near-duplicate documents by MinHash with tensored banding.

Two small collections of sub-keys are computed for each set of shingles, and a table's key combines
one sub-key of either collection. `side` x `side` tables thus cost 2 * `side` * `rows` hash functions
instead of 2 * `side` * `side` * `rows`. Sets that share a table key form loose groups; inside a loose group
all links are confirmed on the full sets, in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystat.llm.common import KEY, ship, text_key, without, written
from quaystat.llm.linkage import components
from quaystat.llm.words import Words, chunks, mix, ranges

SHINGLE = 5
#: Sub-keys in each of the two collections, and MinHash values in each sub-key.
SIDE, ROWS = 12, 3
#: Sets that are compared in one task; larger groups go as pairs of blocks to several tasks.
BLOCK = 1024
_U = np.uint64


def _factors(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(8_051_973)
    return rng.integers(0, 2**64, n, dtype=_U, endpoint=False) | _U(1), rng.integers(0, 2**64, n, dtype=_U, endpoint=False)


def shingle_sets(texts: list[str | None], k: int = SHINGLE) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the k-word shingles of each lower-cased text; of fewer words the whole run."""
    for lo, hi in chunks(texts):
        w = Words([(t or "").encode("utf-8", "surrogatepass").lower() for t in texts[lo:hi]])
        n = np.where(w.counts >= k, w.counts - k + 1, np.minimum(w.counts, 1))
        long = np.repeat(np.minimum(w.counts, k), n)
        h = w.runs(ranges(w.first[:-1], n), long)
        at = np.concatenate([[0], np.cumsum(n)])
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            yield np.unique(h[a:b])


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else b""


def sub_keys(sets: list[np.ndarray], side: int = SIDE, rows: int = ROWS) -> np.ndarray:
    """2 * side sub-keys for each non-empty set: the first half is one collection, the second the other."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, at = np.concatenate(sets), np.concatenate([[0], np.cumsum(n)[:-1]])
    a, b = _factors(2 * side * rows)
    keys = np.zeros((len(sets), 2 * side), _U)
    for j in range(2 * side):
        for r in range(rows):
            low = np.minimum.reduceat(flat * a[j * rows + r] + b[j * rows + r], at)
            keys[:, j] = mix(keys[:, j] * _U(0x9E3779B97F4A7C15) + low)
    return keys.view(np.int64)


def signatures(df: DataFrame, id_col: str, text_col: str, k: int, side: int, rows: int) -> DataFrame:
    """(id, text key, n, skey, subs) for each row; no shuffle."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for lo, hi in chunks(texts):
                sets = list(shingle_sets(texts[lo:hi], k))
                full = [s for s in sets if len(s)]
                subs = iter(sub_keys(full, side, rows).tolist() if full else ())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(batch.column(c).slice(lo, hi - lo) for c in ("id", *KEY)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([set_key(s) for s in sets], pa.binary()),
                        pa.array([next(subs) if len(s) else [] for s in sets], pa.list_(pa.int64())),
                    ],
                    ["id", *KEY, "n", "skey", "subs"],
                )

    kind = df.schema[id_col].dataType.simpleString()
    cols = df.select(F.col(id_col).alias("id"), text_col, *text_key(df[text_col]))
    return cols.mapInArrow(run, f"id {kind}, {KEY[0]} long, {KEY[1]} long, n long, skey binary, subs array<long>")


def confirmed(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among the sets (100 * common >= percent * union)."""
    m = len(sets)
    n = np.fromiter(map(len, sets), np.int64, m)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(m), n)
    seen = np.bincount(column)
    shared = seen > 1
    number = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], number[column[keep]]
    common = np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = 4096
    for lo in range(0, int(shared.sum()), width):
        a, b = np.searchsorted(column, (lo, lo + width))
        x = np.zeros((m, min(width, int(shared.sum()) - lo)), np.float32)
        x[row[a:b], column[a:b] - lo] = 1
        common += x @ x.T
    linked = 100 * common >= percent * (n[:, None] + n[None, :] - common)
    edges, todo = [], np.ones(m, bool)
    for i in range(m):
        if todo[i]:
            todo[i], front = False, [i]
            while front:
                j = front.pop()
                new = np.flatnonzero(linked[j] & todo)
                todo[new] = False
                front += new.tolist()
                edges += [(j, x) for x in new.tolist()]
    return edges


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, percent: int = 85, side: int = SIDE, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for each input row.

    Equal sets are one node. A row with a null id keeps its row with n_shingles, but links nothing and
    gets a null component; it is kept. A null text, an empty text and a text without words have 0 shingles, are
    their own component and kept. Rows that share an id are the same document: they name the same component if
    their texts agree. Repeated rows each keep their row. Very long texts are read whole.
    """
    named = _classes(df, id_col, text_col, k, percent, side, rows, block)
    return named.select(F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def _classes(df: DataFrame, id_col: str, text_col: str, k: int, percent: int, side: int, rows: int, block: int) -> DataFrame:
    """The rows of classes(), with the text key; the id is called id."""
    ship(df.sparkSession)
    sigs = written(signatures(df, id_col, text_col, k, side, rows), "near-signatures")
    nodes = sigs.filter((F.col("n") > 0) & F.col("id").isNotNull()).groupBy("skey").agg(F.min("id").alias("rep"), F.first("subs").alias("subs"))

    # Sub-keys that two sets share: only these can be part of a shared table key.
    entry = nodes.select("skey", F.posexplode("subs").alias("pos", "sub"))
    live = entry.groupBy("pos", "sub").agg(F.count("*").alias("c")).filter("c > 1").select("pos", "sub")
    per_node = entry.join(live, ["pos", "sub"]).groupBy("skey").agg(F.collect_list(F.struct("pos", "sub")).alias("s"))
    left = F.filter("s", lambda x: x["pos"] < side)
    right = F.filter("s", lambda x: x["pos"] >= side)
    tables = per_node.select("skey", F.explode(left).alias("l"), right.alias("r")).select("skey", "l", F.explode("r").alias("r"))
    tables = written(tables.select("skey", F.xxhash64("l.pos", "l.sub", "r.pos", "r.sub").alias("key")), "near-tables")
    hubs = tables.groupBy("key").agg(F.min("skey").alias("b"), F.count("*").alias("c")).filter("c > 1").drop("c")
    loose = written(components(tables.join(hubs, "key").select(F.col("skey").alias("a"), "b"), "near-loose"), "near-groups")

    blocks = loose.groupBy("root").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("nb"))
    member = loose.join(blocks, "root").join(nodes.select(F.col("skey").alias("node"), "rep"), "node")
    own = F.pmod(F.xxhash64("node"), F.col("nb")).cast("int")
    member = member.select("node", "root", "rep", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("other"))
    member = member.select("node", "root", "rep", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    text = df.select(df[id_col].alias("rep"), df[text_col].alias("text"))
    got = member.join(text, "rep").select("node", "root", "i", "j", "text")

    def check(group: pa.Table) -> pa.Table:
        sets = {}
        for key, s in zip(group["node"].to_pylist(), shingle_sets(group["text"].to_pylist(), k)):
            if key not in sets and set_key(s) == key:
                sets[key] = s
        keys = list(sets)
        edges = confirmed([sets[x] for x in keys], percent) if len(keys) > 1 else []
        return pa.table({"a": pa.array([keys[a] for a, _ in edges], pa.binary()), "b": pa.array([keys[b] for _, b in edges], pa.binary())})

    links = got.groupBy("root", "i", "j").applyInArrow(check, "a binary, b binary")
    linked = components(links, "near-links").withColumnRenamed("node", "skey")
    named = nodes.select("skey", "rep").join(linked, "skey", "left")
    root = F.coalesce("root", "skey")
    name = named.groupBy(root.alias("root")).agg(F.min("rep").alias("component"))
    named = written(named.select("skey", root.alias("root")).join(name, "root").select("skey", "component"), "near-names")
    out = sigs.drop("subs").join(named, "skey", "left")
    comp = F.when(F.col("id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id")))
    return out.select("id", *KEY, F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(True)).alias("kept"))


def drop_copies(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """The rows that classes() keeps, with all their columns.

    A row goes by its id and text: of rows that share an id each stays or goes by its own text. Rows with a null id, a null or
    empty text or one without words stay; of an id's repeated rows all stay or all go. An empty table stays empty.
    """
    found = _classes(df, id_col, text_col, SHINGLE, percent, SIDE, ROWS, BLOCK)
    return without(df, found.filter(~F.col("kept")).select(F.col("id").alias(id_col), *KEY), id_col, text_col)


def oracle_sql(k: int = SHINGLE, percent: int = 85) -> str:
    """DuckDB SQL of classes() over the table documents: all pairs that share a shingle, and who can be reached."""
    return rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[p:p + {k - 1}], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {k - 2}, 2))) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= {percent} * (x.n + y.n - c)),
sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
reach AS (SELECT DISTINCT a, a AS b FROM sym UNION SELECT reach.a, sym.b FROM reach JOIN sym ON reach.b = sym.a),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(component_id, doc_id) = doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low USING (doc_id)
"""
