"""Removal of word windows that an earlier document has, by super-k-mer partitioning.

The minimiser of a window is the smallest hash among its runs of M words. Consecutive windows of a
document whose minimiser is the same run travel as one packed string to the bucket of that hash, where
all windows are sorted and equal ones found; equal windows always meet, having equal minimisers.
Equal strings of one batch of documents travel once, so that a passage of a third of all documents
brings a bucket one string for each batch; the other places where it stands stay with their batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystat.llm.bitfilter import bits
from quaystat.llm.common import ship, written
from quaystat.llm.words import Words, chunks, ranges

WINDOW, M = 13, 3
#: Bytes of text for each bucket; the number of buckets follows from the size of the input.
BUCKET_BYTES = 4 << 20
#: Characters of text that are dealt out together.
BATCH_CHARS = 2 << 20

_ROW = "kind int, batch long, head int, doc long, tag int, lo int, hi int, mins array<long>"
_SCHEMA = pa.schema([("kind", pa.int32()), ("batch", pa.int64()), ("head", pa.int32()), ("doc", pa.int64()), ("tag", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32()), ("mins", pa.list_(pa.int64()))])
#: Kinds of rows that leave the buckets: a span to remove, a further place of a string, the smallest documents of a string's windows.
SPAN, PLACE, MINS = 0, 1, 2


def super_kmers(w: Words, window: int = WINDOW, m: int = M) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, last window's first word, minimiser) of each run of windows with one minimiser."""
    n = np.maximum(w.counts - window + 1, 0)
    win = ranges(w.first[:-1], n)
    if not len(win):
        return win, win, win, win.astype(np.uint64)
    all_starts = np.arange(max(0, len(w.hashes) - m + 1))
    h = w.runs(all_starts, m)  # runs across two texts are never inside a window
    low = h[win].copy()
    for s in range(1, window - m + 1):
        np.minimum(low, h[win + s], out=low)
    place = np.empty(len(win), np.int64)
    for s in range(window - m, -1, -1):
        same = h[win + s] == low
        place[same] = win[same] + s
    text = np.repeat(np.arange(len(n)), n)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])]))
    last = np.concatenate([new[1:], [len(win)]]) - 1
    return text[new], win[new], win[last], low[new]


def _pack(*parts: np.ndarray | bytes) -> bytes:
    raw = [p if isinstance(p, bytes) else p.tobytes() for p in parts]
    return zstandard.compress(np.array([len(r) for r in raw], np.int64).tobytes() + b"".join(raw), 3)


def _unpack(blob: bytes, *kinds: type) -> list[np.ndarray]:
    raw = memoryview(zstandard.decompress(blob))
    at = len(kinds) * 8
    out = []
    for size, kind in zip(np.frombuffer(raw[:at], np.int64).tolist(), kinds):
        out.append(bytes(raw[at : at + size]) if kind is bytes else np.frombuffer(raw[at : at + size], kind))
        at += size
    return out


def _dealt(doc: np.ndarray, tag: np.ndarray, texts: list[str], batch: int, buckets: int, window: int, m: int) -> Iterator[tuple[int, bytes]]:
    """(key, blob): a blob of strings for each bucket that gets any, and one with the batch's further places."""
    first: dict[bytes, int] = {}
    strings: list[bytes] = []
    head_doc, head_tag, head_pos, bucket, more = [], [], [], [], []
    for lo, hi in chunks(texts):
        w = Words([t.encode("utf-8", "surrogatepass") for t in texts[lo:hi]])
        text, start, last, low = super_kmers(w, window, m)
        pos = start - w.first[text]
        to = (low % np.uint64(buckets)).tolist()
        docs, tags = doc[lo:hi][text].tolist(), tag[lo:hi][text].tolist()
        for a, b, d, g, p, k in zip(w.starts[start].tolist(), w.ends[last + window - 1].tolist(), docs, tags, pos.tolist(), to):
            s = w.buffer[a:b]
            i = first.setdefault(s, len(strings))
            if i == len(strings):
                strings.append(s)
                head_doc.append(d)
                head_tag.append(g)
                head_pos.append(p)
                bucket.append(k)
            elif d < head_doc[i]:
                more.append((i, head_doc[i], head_tag[i], head_pos[i]))
                head_doc[i], head_tag[i], head_pos[i] = d, g, p
            else:
                more.append((i, d, g, p))
    if not strings:
        return
    repeated = np.zeros(len(strings), np.uint8)
    if more:
        i, d, g, p = (np.array(x) for x in zip(*more))
        repeated[i] = 1
        yield -1 - batch, _pack(i.astype(np.int32), d.astype(np.int64), g.astype(np.int32), p.astype(np.int32))
    to = np.array(bucket)
    order = np.argsort(to, kind="stable")
    d, g, p = np.array(head_doc, np.int64), np.array(head_tag, np.int32), np.array(head_pos, np.int32)
    ends = np.append(np.flatnonzero(np.diff(to[order])) + 1, len(order))
    for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
        i = order[a:b]
        yield int(to[i[0]]), _pack(i.astype(np.int32), d[i], g[i], p[i], repeated[i], b"\n".join([strings[x] for x in i.tolist()]))


def _spans(flag: np.ndarray, start: np.ndarray, pos: np.ndarray, n: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of flagged windows as (string, first word, word after the last); strings have n windows from `start` on."""
    row = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(flag)
    if not len(at):
        return at, at, at
    r = row[at]
    new = np.concatenate([[True], (at[1:] != at[:-1] + 1) | (r[1:] != r[:-1])])
    a, b = at[new], at[np.concatenate([new[1:], [True]])]
    r = row[a]
    return r, pos[r] + a - start[r], pos[r] + b - start[r] + window


def _bucket(blobs: list[tuple[int, bytes]], window: int) -> Iterator[pa.Table]:
    parts = [(batch, *_unpack(x, np.int32, np.int64, np.int32, np.int32, np.uint8, bytes)) for batch, x in blobs]
    batch = np.concatenate([np.full(len(x[1]), x[0], np.int64) for x in parts])
    head, doc, tag, pos, repeated = (np.concatenate([x[k] for x in parts]) for k in range(1, 6))
    strings = [s for x in parts for s in x[6].split(b"\n")]
    del parts
    counts, hashes, begins, ends = [], [], [], []
    step = 1 << 12  # strings that are hashed together
    for lo in range(0, len(strings), step):
        w = Words(strings[lo : lo + step])
        counts.append(w.counts - window + 1)
        at = ranges(w.first[:-1], counts[-1])
        hashes.append(w.runs(at, window))
        own = np.repeat(w.starts[w.first[:-1]], counts[-1])
        begins.append((w.starts[at] - own).astype(np.int32))
        ends.append((w.ends[at + window - 1] - own).astype(np.int32))
    n, h, begin, end = (np.concatenate(x) for x in (counts, hashes, begins, ends))
    start = np.concatenate([[0], np.cumsum(n)[:-1]])
    owner, which = np.repeat(doc, n), np.repeat(np.arange(len(n)), n)
    order = np.lexsort((owner, h))
    same = h[order][1:] == h[order][:-1]
    group = np.concatenate([same, [False]]) | np.concatenate([[False], same])
    low = owner.copy()
    seen: dict[bytes, int] = {}
    twice = order[group]
    for lo in range(0, len(twice), 1 << 16):
        i = twice[lo : lo + (1 << 16)]
        words = [strings[s][a:b] for s, a, b in zip(which[i].tolist(), begin[i].tolist(), end[i].tolist())]
        low[i] = [seen.setdefault(x, d) for x, d in zip(words, owner[i].tolist())]  # by document, so the first is the smallest
    row, lo, hi = _spans(low < owner, start, pos, n, window)
    k = len(row)
    none = pa.nulls(k, pa.list_(pa.int64()))
    yield pa.Table.from_arrays([pa.array(np.full(k, SPAN, np.int32)), pa.array(batch[row]), pa.array(head[row]), pa.array(doc[row]), pa.array(tag[row]), pa.array(lo.astype(np.int32)), pa.array(hi.astype(np.int32)), none], schema=_SCHEMA)
    rep = np.flatnonzero(repeated)
    mins = [low[a : a + c] for a, c in zip(start[rep].tolist(), n[rep].tolist())]
    k = len(rep)
    yield pa.Table.from_arrays([pa.array(np.full(k, MINS, np.int32)), pa.array(batch[rep]), pa.array(head[rep]), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int32()), pa.array(mins, pa.list_(pa.int64()))], schema=_SCHEMA)


def _tagged(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, tag, text): rows that share an id are told apart by 32 bits of their text's hash."""
    text = F.coalesce(df[text_col], F.lit(""))
    return df.select(df[id_col].cast("long").alias("doc"), F.hash(text).alias("tag"), text.alias("text"))


def removed_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, m: int = M, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(doc, tag, spans): word ranges of a document that windows of documents with smaller ids cover."""
    ship(df.sparkSession)
    src = _tagged(df, id_col, text_col).filter("doc is not null")
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-size // bucket_bytes))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        batch = task << 24
        for b in batches:
            doc, tag, texts = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
            chars = np.cumsum(pc.utf8_length(texts).to_numpy())
            cut = [0, *(np.flatnonzero(np.diff(chars // BATCH_CHARS)) + 1).tolist(), len(chars)]
            for lo, hi in zip(cut[:-1], cut[1:]):
                out = list(_dealt(doc[lo:hi], tag[lo:hi], texts.slice(lo, hi - lo).to_pylist(), batch, buckets, window, m))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([batch] * len(out), pa.int64()), pa.array([x[1] for x in out], pa.binary())], ["key", "batch", "blob"])
                batch += 1

    def meet(group: pa.Table) -> pa.Table:
        if group["key"][0].as_py() >= 0:
            return pa.concat_tables(_bucket(list(zip(group["batch"].to_pylist(), group["blob"].to_pylist())), window))
        out = []
        for batch, blob in zip(group["batch"].to_pylist(), group["blob"].to_pylist()):
            head, doc, tag, pos = _unpack(blob, np.int32, np.int64, np.int32, np.int32)
            k = len(head)
            out.append(pa.Table.from_arrays([pa.array(np.full(k, PLACE, np.int32)), pa.array(np.full(k, batch)), pa.array(head), pa.array(doc), pa.array(tag), pa.array(pos), pa.nulls(k, pa.int32()), pa.nulls(k, pa.list_(pa.int64()))], schema=_SCHEMA))
        return pa.concat_tables(out)

    met = written(src.mapInArrow(deal, "key long, batch long, blob binary").groupBy("key").applyInArrow(meet, _ROW), "super-k-mers")
    place = met.filter(F.col("kind") == PLACE).select("batch", "head", "doc", "tag", "lo")
    mins = met.filter(F.col("kind") == MINS).select("batch", "head", "mins")
    # Only windows that stand in a smaller document; neighbours are merged with the rest below.
    later = place.join(mins, ["batch", "head"]).select("doc", "tag", "lo", F.filter(F.sequence(F.lit(0), F.size("mins") - 1), lambda i: F.get("mins", i) < F.col("doc")).alias("at"))
    later = later.filter(F.size("at") > 0).select("doc", "tag", F.transform("at", lambda i: F.struct((F.col("lo") + i).alias("lo"), (F.col("lo") + i + window).alias("hi"))).alias("s"))
    direct = met.filter(F.col("kind") == SPAN).select("doc", "tag", F.array(F.struct("lo", "hi")).alias("s"))
    return direct.unionByName(later).groupBy("doc", "tag").agg(F.flatten(F.collect_list("s")).alias("spans"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, m: int = M) -> DataFrame:
    """(id_col, n_words, n_removed, kept_text) for each input row.

    kept_text: the words that stay, joined by one space. Ids are whole numbers. A row with a null id is
    no source and loses nothing; a null or empty text has 0 words. Rows that share an id don't remove words from each
    other, repeated rows give equal results. Very long texts are read whole.
    """
    spans = removed_spans(df, id_col, text_col, window, m)
    spans = written(spans.select(F.col("doc").alias("d"), F.col("tag").alias("t"), F.transform("spans", lambda s: s["lo"]).alias("lo"), F.transform("spans", lambda s: s["hi"]).alias("hi")), "word-spans")
    docs = _tagged(df, id_col, text_col)
    may = F.coalesce(bits(spans, "d")(F.col("doc")), F.lit(False))  # texts that lose nothing stay where they are
    got = docs.filter(may).join(spans, (F.col("doc") == F.col("d")) & (F.col("tag") == F.col("t")), "left").select("doc", "text", "lo", "hi")
    none = F.lit(None).cast("array<int>")
    got = got.unionByName(docs.filter(~may).select("doc", "text", none.alias("lo"), none.alias("hi")))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, 500):
                n, gone, kept = [], [], []
                part = b.slice(lo, 500)
                for k, t in enumerate(part.column(1).to_pylist()):
                    words = t.encode("utf-8", "surrogatepass").split()
                    n.append(len(words))
                    if part.column(2)[k].is_valid:
                        step = np.zeros(len(words) + 1, np.int64)
                        np.add.at(step, part.column(2)[k].values.to_numpy(), 1)
                        np.add.at(step, part.column(3)[k].values.to_numpy(), -1)
                        words = [words[i] for i in np.flatnonzero(np.cumsum(step[:-1]) == 0).tolist()]
                    gone.append(n[-1] - len(words))
                    kept.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], [id_col, "n_words", "n_removed", "kept_text"])

    return got.mapInArrow(keep, f"`{id_col}` long, n_words long, n_removed long, kept_text string")


def oracle_sql(window: int = WINDOW) -> str:
    """DuckDB SQL of the query over the table documents."""
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT r, doc_id, p, array_to_string(w[p:p + {window - 1}], ' ') AS g FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - {window - 2})) AS p FROM d)),
low AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT r, p + j AS i FROM (SELECT r, p FROM win JOIN low USING (g) WHERE doc_id > m), (SELECT unnest(range(0, {window})) AS j)),
kept AS (SELECT r, string_agg(x, ' ' ORDER BY i) AS t FROM (SELECT r, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r) LEFT JOIN (SELECT r, count(*) AS n FROM gone GROUP BY r) USING (r)
"""
