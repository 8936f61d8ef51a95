"""Hard negatives of anchors by product quantisation with stored residual norms.

Vectors are whole numbers. Their entries are cut into groups of SUB; a group becomes the number of its codeword, and the
norm of what the codeword misses is stored beside it. For an anchor the sum of looked-up products with codewords differs from
the true score by at most the sum of (anchor's norm x missed norm) of the groups. Rows which that bound rules out
are dropped; all others are scored exactly, in whole numbers. Rows and anchors meet in pairs of
blocks, each of which returns a few rows for an anchor, and the best of those are the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystat.llm.common import free_name, ship, written
from quaystat.llm.vectors import matrix, one_length, quantised

SCALE = 256
#: Entries of a group, codewords of a group, rows that codewords are fitted on, rounds of that.
SUB, WORDS, SAMPLE, ROUNDS = 2, 256, 4096, 12
#: Rows and anchors of a block; anchors that are looked up together; pairs that are scored exactly together.
ROW_BLOCK, ANCHOR_BLOCK, CHUNK, PAIRS = 4096, 1024, 64, 1 << 17
#: Entries of this size or more would let scores exceed a long.
LIMIT = 1 << 26
_INF = np.inf


def groups(d: int) -> list[tuple[int, int]]:
    return [(a, min(a + SUB, d)) for a in range(0, d, SUB)]


def fit(x: np.ndarray) -> list[np.ndarray]:
    """Codewords, whole numbers, for each group of entries, by k-means of the sample's rows."""
    rng, out = np.random.default_rng(13), []
    for a, b in groups(x.shape[1]):
        part = x[:, a:b].astype(np.float64)
        seen = np.unique(part, axis=0)
        words = seen if len(seen) <= WORDS else seen[rng.choice(len(seen), WORDS, replace=False)]
        for _ in range(ROUNDS if len(seen) > WORDS else 0):
            own = nearest(part, words)
            n = np.bincount(own, minlength=len(words))
            sums = np.stack([np.bincount(own, part[:, j], len(words)) for j in range(b - a)], 1)
            words = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], words)
        out.append(np.rint(words))
    return out


def nearest(x: np.ndarray, words: np.ndarray) -> np.ndarray:
    return ((words * words).sum(1) - 2 * x @ words.T).argmin(1)


def encode(x: np.ndarray, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Codes and missed norms, rounded up, of each row and group."""
    code, norm = np.zeros((len(x), len(books)), np.uint8), np.zeros((len(x), len(books)), np.float32)
    for g, ((a, b), words) in enumerate(zip(groups(x.shape[1]), books)):
        part = x[:, a:b].astype(np.float64)
        code[:, g] = own = nearest(part, words)
        norm[:, g] = np.nextafter(np.sqrt(((part - words[own]) ** 2).sum(1)).astype(np.float32), np.float32(_INF))
    return code, norm


class Block:
    """The rows of one side of a pair of blocks."""

    def __init__(self, t: pa.Table):
        t = t.combine_chunks()
        self.uid, self.id, self.label = (t[c].to_numpy() for c in ("uid", "id", "label"))
        self.order = np.unique(self.id, return_inverse=True)[1]
        self.x = np.frombuffer(b"".join(t["x"].to_pylist()), np.int32).reshape(t.num_rows, -1).astype(np.int64)
        if "code" in t.column_names:
            self.code = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(t.num_rows, -1).T.copy()
            self.norm = np.frombuffer(b"".join(t["norm"].to_pylist()), np.float32).reshape(t.num_rows, -1).astype(np.float64)


def bounds(q: np.ndarray, rows: Block, books: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest possible score of each anchor with each row."""
    est, norms = np.zeros((len(q), len(rows.id))), np.zeros((len(q), len(books)))
    for g, ((a, b), words) in enumerate(zip(groups(q.shape[1]), books)):
        part = q[:, a:b].astype(np.float64)
        est += np.take(part @ words.T, rows.code[g], axis=1)
        norms[:, g] = np.sqrt((part * part).sum(1))
    miss = norms @ rows.norm.T * (1 + 1e-9) + 0.5  # the products are whole numbers, all else rounding
    return est - miss, est + miss


def scores(q: np.ndarray, x: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    out = np.zeros(len(a), np.int64)
    for lo in range(0, len(a), PAIRS):
        s = slice(lo, lo + PAIRS)
        out[s] = np.einsum("ij,ij->i", q[a[s]], x[r[s]])
    return out


def at_least(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each row; minus infinity where there are fewer."""
    return np.partition(values, -k, axis=1)[:, -k] if values.shape[1] >= k else np.full(len(values), -_INF)


def first(a: np.ndarray, r: np.ndarray, s: np.ndarray, rows: Block, k: int) -> np.ndarray:
    """Places of the k best pairs of each anchor: by falling score, then id."""
    order = np.lexsort((rows.uid[r], rows.order[r], -s, a))
    a = a[order]
    start = np.searchsorted(a, a)
    return order[np.arange(len(a)) - start < k]


def mine(
    df: DataFrame, anchor: Column, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95,
    row_block: int = ROW_BLOCK, anchor_block: int = ANCHOR_BLOCK, sample: int = SAMPLE,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchor: which rows are anchors, a condition on df. A positive is one of an anchor's best other rows of its label; its negatives are
    the best rows of other labels whose score is low to high percent of the positive's. Higher scores come first, then smaller ids.

    Rows with a null id, label or vector, an empty vector, or a null, non-finite or very large entry (2**26 after scaling) take no part; of
    vectors of several lengths only those of the commonest do (the longer of equals). Rows that share an id are
    rows of their own: each is an anchor if it is one, and may be the other's positive or negative. Positives without negatives give no
    rows; so does an empty table. Other columns are left out.
    """
    spark = df.sparkSession
    ship(spark)
    flag, group = free_name(df, "is_anchor"), free_name(df, "of_label")
    own = df.withColumns({flag: F.coalesce(anchor, F.lit(False)), group: F.col(label_col)}).filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    rows = quantised(own.select(id_col, flag, group, vec_col), id_col, vec_col, SCALE, keep=(flag, group), limit=LIMIT)
    rows = rows.select(F.monotonically_increasing_id().alias("uid"), "id", F.col(group).alias("label"), F.col(flag).alias("anchor"), "x")
    rows, d = one_length(rows, "negatives-rows")
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"anchor_id {kind}, positive_id {kind}, rank int, negative_id {kind}, positive_score long, negative_score long"
    if not d:
        return spark.createDataFrame([], schema)
    books = fit(matrix(rows.orderBy(F.xxhash64("id", "uid")).limit(sample).select("x").toArrow()["x"].combine_chunks()))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = matrix(b.column("x"))
                got = (x.astype(np.int32), *encode(x, books))
                yield pa.RecordBatch.from_arrays([*b.columns[:4], *(pa.array([r.tobytes() for r in m], pa.binary()) for m in got)], [*b.schema.names[:4], "x", "code", "norm"])

    label = df.schema[label_col].dataType.simpleString()
    rows = written(rows.mapInArrow(code, f"uid long, id {kind}, label {label}, anchor boolean, x binary, code binary, norm binary"), "negatives-codes")
    anchors = rows.filter("anchor").select("uid", "id", "label", "x")

    # Positives: rows meet the anchors of their label, in blocks of both.
    of = rows.groupBy("label").agg(F.ceil(F.count("*") / row_block).alias("nr"), F.ceil(F.count_if("anchor") / anchor_block).alias("na")).filter("na > 0")
    left = pairs(anchors.join(of, "label"), "na", "nr", ["label"])
    right = pairs(rows.drop("anchor").join(of, "label"), "nr", "na", ["label"])

    def best(a: pa.Table, r: pa.Table) -> pa.Table:
        out, a, r = [], Block(a) if a.num_rows else None, Block(r) if r.num_rows else None
        for lo in range(0, len(a.id) if a and r else 0, CHUNK):
            q, uid = a.x[lo : lo + CHUNK], a.uid[lo : lo + CHUNK]
            least, most = bounds(q, r, books)
            self_ = uid[:, None] == r.uid[None, :]
            least[self_] = most[self_] = -_INF
            i, j = np.nonzero((most >= at_least(least, positives)[:, None]) & ~self_)
            s = scores(q, r.x, i, j)
            k = first(i, j, s, r, positives)
            out.append((uid[i[k]], r.uid[j[k]], r.id[j[k]], s[k]))
        return table(out, [("auid", pa.int64()), ("puid", pa.int64()), ("positive_id", ids), ("score", pa.int64())])

    ids = pa.array([], rows.select("id").limit(0).toArrow()["id"].type).type
    found = left.groupBy("label", "i", "j").cogroup(right.groupBy("label", "i", "j")).applyInArrow(best, f"auid long, puid long, positive_id {kind}, score long")
    rank = F.row_number().over(Window.partitionBy("auid").orderBy(F.desc("score"), "positive_id", "puid"))
    found = found.withColumn("rank", rank).filter(F.col("rank") <= positives).groupBy("auid").agg(F.collect_list(F.struct("puid", "positive_id", "score")).alias("p"))
    wanted = written(anchors.join(found.withColumnRenamed("auid", "uid"), "uid"), "negatives-positives")

    # Negatives: all rows meet all anchors, in blocks of both, and return the best of each window.
    count = rows.select(F.ceil(F.count("*") / row_block).alias("nr"), F.ceil(F.count_if("anchor") / anchor_block).alias("na")).first()
    nr, na = count["nr"], max(count["na"], 1)
    left = pairs(wanted.withColumns({"nr": F.lit(nr), "na": F.lit(na)}), "na", "nr", [])
    right = pairs(rows.drop("anchor").withColumns({"nr": F.lit(nr), "na": F.lit(na)}), "nr", "na", [])

    def windows(a: pa.Table, r: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if a.num_rows and r.num_rows:
            want, a, r = a["p"].to_pylist(), Block(a), Block(r)
            slot = [[w[k] if k < len(w) else None for w in want] for k in range(positives)]
            for lo in range(0, len(a.id), CHUNK):
                s = slice(lo, lo + CHUNK)
                q = a.x[s]
                least, most = bounds(q, r, books)
                other = a.label[s, None] != r.label[None, :]
                for p in (x[s] for x in slot):
                    have = np.array([x is not None for x in p])
                    p = [x or {"puid": -1, "positive_id": None, "score": 0} for x in p]
                    score = np.array([x["score"] for x in p], np.int64)
                    floor, cap = -(-low * score // 100), high * score // 100
                    may = other & (least <= cap[:, None]) & (most >= floor[:, None]) & have[:, None]
                    sure = np.where(may & (most <= cap[:, None]) & (least >= floor[:, None]), least, -_INF)
                    i, j = np.nonzero(may & (most >= at_least(sure, negatives)[:, None]))
                    n = scores(q, r.x, i, j)
                    inside = (n >= floor[i]) & (n <= cap[i])
                    i, j, n = i[inside], j[inside], n[inside]
                    k = first(i, j, n, r, negatives)
                    i, j, n = i[k], j[k], n[k]
                    pick = [p[x] for x in i.tolist()]
                    out.append((a.uid[s][i], a.id[s][i], np.array([x["puid"] for x in pick], np.int64), [x["positive_id"] for x in pick], score[i], r.uid[j], r.id[j], n))
        long = pa.int64()
        return table(out, [("auid", long), ("anchor_id", ids), ("puid", long), ("positive_id", ids), ("positive_score", long), ("nuid", long), ("negative_id", ids), ("negative_score", long)])

    got = left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(windows, f"auid long, anchor_id {kind}, puid long, positive_id {kind}, positive_score long, nuid long, negative_id {kind}, negative_score long")
    rank = F.row_number().over(Window.partitionBy("auid", "puid").orderBy(F.desc("negative_score"), "negative_id", "nuid"))
    return got.withColumn("rank", rank).filter(F.col("rank") <= negatives).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def pairs(side: DataFrame, own: str, other: str, keys: list[str]) -> DataFrame:
    """The rows of a side, each with its block among `own` blocks and every block of the `other` side: i is the anchors' block, j the rows'."""
    block = F.pmod(F.xxhash64("uid"), F.col(own)).alias("i" if own == "na" else "j")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)).alias("i" if other == "na" else "j")
    keep = [F.col(c).alias(c) for c in side.columns if c not in ("nr", "na")]  # names of its own: both sides come from one table
    return side.select(*keep, block, every)


def table(parts: list[tuple], columns: list[tuple[str, pa.DataType]]) -> pa.Table:
    whole = [np.concatenate(c) if c else [] for c in zip(*parts)] or [[]] * len(columns)
    return pa.table({n: pa.array(v, t) for (n, t), v in zip(columns, whole)})


def oracle_sql() -> str:
    """DuckDB SQL of the query over the table embeddings."""
    return """
WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score FROM r a JOIN r b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
w AS (SELECT p.*, other_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)::INT AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM w WHERE rank <= 3
"""
