"""Benchmark decontamination by winnowing.

Of every SPAN - K + 1 consecutive hashes of K words the smallest is kept (all, if it is there more than
once), so that two texts with SPAN equal words in a row keep an equal fingerprint inside them. Fingerprints
of documents and benchmark are joined and each hit is extended word by word. An item of fewer than SPAN words
is looked up whole, by the hashes of all runs of its length.

Items whose words round a fingerprint are equal meet documents as one row. A fingerprint with more than its share of all
hits is split: its hits are dealt to several keys, each of which gets the benchmark's rows of that fingerprint.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystat.llm.common import KEY, ship, text_key, without, written
from quaystat.llm.words import Words, chunks, ranges

SPAN, K = 13, 8
#: Bits of the filter that the executors get: a fixed 16 MB whatever the size of the benchmark. It only
#: spares shuffles; what it lets through is joined on the fingerprint itself.
FILTER_BITS = 1 << 27
#: A fingerprint with over 1/SHARES of all hits is split into parts of about that size; fewer than SHARES fingerprints can be.
SHARES = 4096
#: Hits of a part at least; fewer don't make a task long.
PART_HITS = 1024

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def _words(texts: list[str | None]) -> Words:
    return Words([(t or "").encode("utf-8", "surrogatepass").translate(_LETTERS) for t in texts])


def winnow(w: Words, span: int = SPAN, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the kept runs of k words, over all texts of w."""
    start, n = w.grams(k)
    h = w.runs(start, k)
    width = span - k + 1
    low = h.copy()
    for s in range(1, width):
        np.minimum(low[:-s], h[s:], out=low[:-s])
    first = np.concatenate([[0], np.cumsum(n)])
    window = ranges(first[:-1], np.maximum(n - width + 1, 0))
    kept = np.zeros(len(h), bool)
    for s in range(width):
        kept[window + s] |= h[window + s] == low[window]
    return start[kept], h[kept]


def _context(w: Words, text: int, start: int, span: int, k: int) -> tuple[int, bytes]:
    """Words round a kept run, as far as a span that holds it can reach, and where in them it begins."""
    lo, hi = max(int(w.first[text]), start - (span - k)), min(int(w.first[text + 1]), start + span)
    return start - lo, w.text(lo, hi)


_HIT = pa.struct([("fp", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("off", pa.int32()), ("whole", pa.bool_()), ("ctx", pa.binary())])
_HIT_SQL = "array<struct<fp:long,n:int,pos:int,off:int,whole:boolean,ctx:binary>>"


def _find(texts: list[str | None], span: int, k: int, short: tuple[int, ...] | None, bits: np.ndarray | None) -> Iterator[tuple[int, list[dict]]]:
    """Of each text the number of words and its fingerprints.

    short: lengths of short items to look for, or None for a benchmark text, which gives its whole run if
    it is short itself; the hashes of whole short runs are inverted. bits: filter that hashes must pass.
    """
    w = _words(texts)
    found: list[list[dict]] = [[] for _ in texts]

    def add(start: np.ndarray, h: np.ndarray, n: int, whole: bool) -> None:
        if bits is not None:
            at = h & np.uint64(FILTER_BITS - 1)
            ok = bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8) & 1
            start, h = start[ok == 1], h[ok == 1]
        text = np.searchsorted(w.first, start, side="right") - 1
        for s, x, t in zip(start.tolist(), h.view(np.int64).tolist(), text.tolist()):
            off, ctx = (0, w.text(s, s + n)) if whole else _context(w, t, s, span, k)
            found[t].append({"fp": x, "n": n, "pos": s - int(w.first[t]), "off": off, "whole": whole, "ctx": ctx})

    add(*winnow(w, span, k), k, False)
    if short is None:
        for n in range(1, span):
            start = w.first[:-1][w.counts == n]
            add(start, ~w.runs(start, n), n, True)
    else:
        for n in short:
            start, _ = w.grams(n)
            add(start, ~w.runs(start, n), n, True)
    yield from zip(w.counts.tolist(), found)


def fingerprints(df: DataFrame, id_col: str, text_col: str, span: int, k: int, short=None, bits=None) -> DataFrame:
    """(id, text key, n_words, hits) for each row; no shuffle. short, bits: see _find; bits is a broadcast."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if bits is None else np.frombuffer(bits.value, np.uint8)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in chunks(texts):
                n, hits = zip(*_find(texts[lo:hi], span, k, short, table))
                own = [b.column(c).slice(lo, hi - lo) for c in ("id", *KEY)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n, pa.int64()), pa.array(hits, pa.list_(_HIT))], ["id", *KEY, "n_words", "hits"])

    cols = df.select(F.col(id_col).alias("id"), text_col, *text_key(df[text_col]))
    return cols.mapInArrow(run, f"id {df.schema[id_col].dataType.simpleString()}, {KEY[0]} long, {KEY[1]} long, n_words long, hits {_HIT_SQL}")


def filter_bits(prints: DataFrame) -> bytes:
    """A filter of FILTER_BITS bits over the column fp: at most FILTER_BITS / 64 rows reach the driver."""
    at = F.col("fp").bitwiseAND(F.lit(FILTER_BITS - 1))
    bit = F.expr(f"shiftleft(1L, cast((fp & {FILTER_BITS - 1}L) & 63 as int))")
    rows = prints.groupBy((F.shiftright(at, 6)).alias("w")).agg(F.bit_or(bit).alias("v")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.int64)
    out[rows["w"].to_numpy()] = rows["v"].to_numpy()
    return out.tobytes()


def extend(a: list[bytes], i: int, b: list[bytes], j: int, n: int, span: int) -> tuple[int, int] | None:
    """How far words agree to the left and right of equal runs a[i:i+n], b[j:j+n]; None if under span words."""
    if a[i : i + n] != b[j : j + n]:
        return None
    left = 0
    while left < min(i, j) and a[i - left - 1] == b[j - left - 1]:
        left += 1
    right, most = 0, min(len(a) - i, len(b) - j) - n
    while right < most and a[i + n + right] == b[j + n + right]:
        right += 1
    return (left, right) if left + n + right >= span else None


def contamination(df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", span: int = SPAN, k: int = K, percent: int = 5) -> DataFrame:
    """(id_col, n_words, n_hit, n_items, items_sha256, contaminated) for each document row.

    Null and empty texts have no words: such a document is clean, such an item matches nothing. An item
    with a null id is left out; items that share an id count once and match with either text. Null and repeated document ids
    and repeated rows each keep their row. Very long texts are read whole. With an empty benchmark all
    documents are clean.
    """
    found = _contamination(df, bench, id_col, text_col, item_col, item_text_col, span, k, percent)
    return found.select(F.col("id").alias(id_col), "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _bench_prints(bench: DataFrame, item_col: str, item_text_col: str, span: int, k: int) -> DataFrame:
    """(fp, n, whole, ioff, ictx, items): each fingerprint of the benchmark with the words round it, once for all items that have both."""
    prints = fingerprints(bench.filter(bench[item_col].isNotNull()), item_col, item_text_col, span, k)
    prints = prints.select(F.col("id").cast("string").alias("item"), F.explode("hits").alias("h"))
    prints = prints.select("item", "h.fp", "h.n", "h.whole", F.col("h.off").alias("ioff"), F.col("h.ctx").alias("ictx"))
    return written(prints.groupBy("fp", "n", "whole", "ioff", "ictx").agg(F.sort_array(F.collect_set("item")).alias("items")), "bench-prints")


def _meet(hits: DataFrame, prints: DataFrame, shares: int = SHARES, least: int = PART_HITS) -> DataFrame:
    """Hits of documents beside the benchmark's rows of the same fingerprint; a fingerprint with over 1/shares of all hits is split."""
    key = ["fp", "n", "whole"]
    total = hits.count()
    size = max(least, -(-total // shares))
    parts = hits.groupBy(*key).count().filter(F.col("count") > size).select(*key, F.ceil(F.col("count") / size).cast("int").alias("parts"))
    parts = F.broadcast(written(parts, "common-prints"))  # fewer than shares rows
    one = F.coalesce("parts", F.lit(1))
    left = hits.join(parts, key, "left").withColumn("part", F.pmod(F.xxhash64("rid", "pos"), one).cast("int")).drop("parts")
    right = prints.join(parts, key, "left").withColumn("part", F.explode(F.sequence(F.lit(0), one - 1))).drop("parts")
    return left.join(right, [*key, "part"])


def _contamination(df: DataFrame, bench: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, span: int, k: int, percent: int) -> DataFrame:
    """The rows of contamination(), with the text key; the id is called id."""
    spark = df.sparkSession
    prints = _bench_prints(bench, item_col, item_text_col, span, k)
    short = tuple(sorted(r[0] for r in prints.filter("whole").select("n").distinct().collect()))  # under span lengths
    bits = spark.sparkContext.broadcast(filter_bits(prints))
    docs = fingerprints(df, id_col, text_col, span, k, short, bits)
    docs = written(docs.select(F.monotonically_increasing_id().alias("rid"), "*"), "document-prints")
    hit = _meet(docs.select("rid", F.explode("hits").alias("h")).select("rid", "h.*"), prints)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[tuple, tuple[int, int] | None] = {}
            rows, los, his = [], [], []
            for i, (n, whole, pos, *pair) in enumerate(zip(*(b.column(c).to_pylist() for c in ("n", "whole", "pos", "off", "ctx", "ioff", "ictx")))):
                key = (n, whole, *pair)
                if key not in known:
                    off, ctx, ioff, ictx = pair
                    known[key] = ((0, 0) if ctx == ictx else None) if whole else extend(ctx.split(), off, ictx.split(), ioff, n, span)
                if got := known[key]:
                    rows.append(i)
                    los.append(pos - got[0])
                    his.append(pos + n + got[1])
            took = b.select(["rid", "items"]).take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([took.column(0), took.column(1), pa.array(los, pa.int32()), pa.array(his, pa.int32())], ["rid", "items", "lo", "hi"])

    spans = hit.mapInArrow(check, "rid long, items array<string>, lo int, hi int")
    spans = spans.groupBy("rid", "lo", "hi").agg(F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    per = spans.groupBy("rid").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("s"), F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    covered = F.aggregate(
        "s",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["hi"] - F.greatest(x["lo"], a["end"]))).alias("n"), F.greatest(x["hi"], a["end"]).alias("end")),
        lambda a: a["n"].cast("long"),
    )
    per = per.select("rid", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items"))
    zero = F.lit(0).cast("long")
    out = docs.select("rid", "id", *KEY, "n_words").join(per, "rid", "left").select("id", *KEY, "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items", F.lit("")).alias("items"))
    bad = (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words"))
    return out.select("id", *KEY, "n_words", "n_hit", "n_items", F.sha2("items", 256).alias("items_sha256"), bad.alias("contaminated"))


def drop_contaminated(df: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows that are not contaminated, with all their columns.

    A row goes by its id and text: of rows that share an id each stays or goes by its own text. Rows with a null id stay, as
    do null and empty texts. With an empty benchmark all rows stay.
    """
    found = _contamination(df, bench, id_col, text_col, item_col, item_text_col, SPAN, K, 5)
    return without(df, found.filter("contaminated").select(F.col("id").alias(id_col), *KEY), id_col, text_col)


def oracle_sql(span: int = SPAN, percent: int = 5) -> str:
    """DuckDB SQL of contamination() over the tables documents and benchmark."""
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
i AS (SELECT item_id, w, least({span}, len(w)) AS n FROM (SELECT item_id, {words} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM i)),
dw AS (SELECT r, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
hit AS (SELECT r, item_id, n, p FROM dw JOIN iw USING (n, g)),
cover AS (SELECT r, count(DISTINCT p + j) AS n_hit FROM hit, (SELECT unnest(range(0, {span})) AS j) WHERE j < n GROUP BY r),
item AS (SELECT r, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS t FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 100 * coalesce(n_hit, 0) >= {percent} * len(w) AS contaminated
FROM d LEFT JOIN cover USING (r) LEFT JOIN item USING (r)
"""
