"""Token ids as directly addressable codes.

A segment holds the ids of consecutive documents. Level 0 has the low byte of every id and a bitmap that
says which ids go on; level 1 has the next byte of those, and so on. A rank directory over each bitmap
(set bits before every block of 512) leads from an id to its place on the next level, so that any token
can be read alone. Segments are rows of a Parquet table: they lie in any store that Spark can write, are
found by their place in the token stream, and a lost task is simply written again.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quaystat.llm.common import new_path, ship

#: A segment is closed when it has so many tokens; one document is never split.
SEGMENT_TOKENS = 1 << 19
#: Words kept per worker with their ids; emptied when full.
CACHE_WORDS = 800_000
MARKS = b".,;:!?|"
#: Every special token begins so.
SPECIAL = b"<|"
#: The last piece of a run of letters ends so.
WORD_END = "</w>"
BLOCK_BITS = 512
#: Places that go to a segment in one list.
LIST_PLACES = 1 << 16

LEVELS = "array<struct<chunks:binary,more:binary,rank:binary>>"


def encode_levels(ids: np.ndarray) -> list[dict[str, bytes]]:
    """ids: unsigned 32-bit integers."""
    ids, levels = ids.astype(np.uint32), []
    while True:
        more = ids > 255
        bits = np.packbits(more, bitorder="little")
        blocks = np.add.reduceat(more, np.arange(0, len(more), BLOCK_BITS), dtype=np.uint32) if len(more) else np.zeros(0, np.uint32)
        rank = np.concatenate([[0], np.cumsum(blocks)[:-1]]).astype("<u4") if len(more) else blocks.astype("<u4")
        levels.append({"chunks": (ids & 255).astype(np.uint8).tobytes(), "more": bits.tobytes(), "rank": rank.tobytes()})
        if not more.any():
            return levels
        ids = ids[more] >> 8


def decode_levels(levels: list[dict[str, bytes]]) -> np.ndarray:
    """All ids of a segment, from the last level up."""
    above = np.zeros(0, np.uint32)
    for level in reversed(levels):
        ids = np.frombuffer(level["chunks"], np.uint8).astype(np.uint32)
        more = np.unpackbits(np.frombuffer(level["more"], np.uint8), count=len(ids), bitorder="little").astype(bool)
        ids[more] |= above << np.uint32(8)
        above = ids
    return above


def access(levels: list[dict[str, bytes]], i: int) -> int:
    """The id at place i: one chunk, one bit and one rank on each level that it has."""
    out, shift = 0, 0
    for level in levels:
        if not 0 <= i < len(level["chunks"]):
            raise IndexError(i)
        out |= level["chunks"][i] << shift
        if not level["more"][i >> 3] >> (i & 7) & 1:
            return out
        block = i // BLOCK_BITS
        before = np.frombuffer(level["more"], np.uint8, count=(i >> 3) - block * BLOCK_BITS // 8, offset=block * BLOCK_BITS // 8)
        part = level["more"][i >> 3] & ((1 << (i & 7)) - 1)
        i = int(np.frombuffer(level["rank"], "<u4")[block]) + int(np.bitwise_count(before).sum()) + part.bit_count()
        shift += 8
    raise ValueError("broken code")


class WordCoder:
    """Encodes texts by a tokenizer that never joins across ASCII white space: each new word once.

    Strings of special tokens in a text give their ids, as the library does by itself; with special_as_text they
    are ordinary text.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        #: Whether an id ends a run of letters.
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for p, i in vocabulary.items() if p.endswith(WORD_END)]] = True

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        raw = [t.encode() for t in texts]
        # The tokenizer lower-cases; what may hold a special token stays as it is.
        words = [(t if SPECIAL in t else t.lower()).split() for t in raw]
        known = self.known
        if len(known) > CACHE_WORDS:
            known.clear()
        new = set().union(*words).difference(known)
        # Marks after a last letter or digit are tokens of their own: so fewer words are new. Not so behind a letter
        # that lower-casing gives a combining mark.
        marked = {}
        for w in [w for w in new if w[-1] in MARKS and SPECIAL not in w]:
            c = w.rstrip(MARKS)
            if c[-1:].isalnum() or c and c.decode().lower()[-1].isalpha():
                marked[w] = c
        fresh = {*new.difference(marked), *marked.values(), *(w[len(c) :] for w, c in marked.items())}.difference(known)
        letters, other = [], []
        for c in fresh:
            t = c.decode()
            (letters if t.isalpha() and (t.isascii() or t.lower().isalpha()) else other).append(c)
        self._learn_letters(letters)
        self._learn(other)
        for w, c in marked.items():
            known[w] = known[c] + known[w[len(c) :]]
        out = [b"".join(map(known.__getitem__, w)) for w in words]
        for w in {*new, *fresh}:
            if len(w) > 64:
                known.pop(w, None)
        return out

    def _learn(self, words: list[bytes]) -> None:
        for lo in range(0, len(words), 20_000):
            part = words[lo : lo + 20_000]
            for c, e in zip(part, self.tokenizer.encode_batch_fast([c.decode() for c in part], add_special_tokens=False)):
                self.known[c] = array("I", e.ids).tobytes()

    def _learn_letters(self, words: list[bytes]) -> None:
        """Words of letters alone, many in one text: each ends with the one id of it that ends a run."""
        for lo in range(0, len(words), 25_600):
            part = words[lo : lo + 25_600]
            texts = [b" ".join(part[k : k + 256]).decode() for k in range(0, len(part), 256)]
            ids = np.concatenate([np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)])
            at = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(at) != len(part):
                self._learn(part)
                continue
            flat = ids.tobytes()
            self.known.update(zip(part, [flat[a:b] for a, b in zip([0, *at[:-1]], at)]))


_CODERS: dict[str, WordCoder] = {}


def _coder(path: str) -> WordCoder:
    if path not in _CODERS:
        _CODERS[path] = WordCoder(path)
    return _CODERS[path]


def write_codes(df: DataFrame, tokenizer_path: str, out: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes all documents in ascending id order to the table `out`.

    Shards are ranges of ids, segments are numbered inside a shard, `start` counts tokens inside the
    shard. Null ids come first; equal ids are ordered by text, repeated rows stay repeated. A null text
    is empty: its code is the end id alone. A very long document makes one long segment.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, coder, segment, start = TaskContext.get().partitionId(), _coder(tokenizer_path), 0, 0
        end = np.array([end_id], "<u4").tobytes()
        ids: list[Any] = []
        codes: list[bytes] = []

        def close() -> pa.RecordBatch:
            flat = np.frombuffer(b"".join(codes), "<u4")
            row = {"shard": shard, "segment": segment, "start": start, "n_tokens": len(flat), "ids": ids, "lengths": [len(c) // 4 for c in codes], "levels": encode_levels(flat)}
            return pa.RecordBatch.from_pylist([row], schema)

        size = 0
        for b in batches:
            schema = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(b.schema.field(0).type)), ("lengths", pa.list_(pa.int64())), ("levels", pa.list_(pa.struct([("chunks", pa.binary()), ("more", pa.binary()), ("rank", pa.binary())])))])
            keys, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for lo in range(0, len(keys), 500):
                for key, code in zip(keys[lo : lo + 500], coder.encode([t or "" for t in texts[lo : lo + 500]])):
                    ids.append(key)
                    codes.append(code + end)
                    size += len(code) // 4 + 1
                    if size >= SEGMENT_TOKENS:
                        yield close()
                        segment, start, size, ids, codes = segment + 1, start + size, 0, [], []
        if ids:
            yield close()

    src = df.select(df[id_col].alias("id"), df[text_col].alias("text")).repartitionByRange("id").sortWithinPartitions("id", "text")
    kind = df.schema[id_col].dataType.simpleString()
    codes = src.mapInArrow(run, f"shard int, segment int, start long, n_tokens long, ids array<{kind}>, lengths array<long>, levels {LEVELS}")
    # Not compressed: what is stored is what access() reads.
    codes.write.option("compression", "none").parquet(out)


def read_codes(df: DataFrame) -> DataFrame:
    """The table with `start` counted over all shards. One number for each shard meets in one task."""
    each = df.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return df.join(each.select("shard", F.coalesce(before, F.lit(0)).alias("base")), "shard").withColumn("start", F.col("start") + F.col("base")).drop("base")


def decode(codes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, start, n_tokens, ids_crc32) of each document, from the codes."""
    ship(codes.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                start, lengths, levels = b.column(0)[k].as_py(), b.column(2)[k].as_py(), b.column(3)[k].as_py()
                raw = memoryview(decode_levels(levels).astype("<u4").tobytes())
                at = np.concatenate([[0], np.cumsum(lengths)]).tolist()
                crc = [zlib.crc32(raw[4 * x : 4 * y]) for x, y in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([b.column(1)[k].values, pa.array([start + x for x in at[:-1]], pa.int64()), pa.array(lengths, pa.int64()), pa.array(crc, pa.int64())], [id_col, "start", "n_tokens", "ids_crc32"])

    kind = codes.schema["ids"].dataType.elementType.simpleString()
    return codes.select("start", "ids", "lengths", "levels").mapInArrow(run, f"`{id_col}` {kind}, start long, n_tokens long, ids_crc32 long")


def tokens_at(codes: DataFrame, places: DataFrame, place_col: str = "place") -> DataFrame:
    """(place_col, token) for places of the token stream; reads the segments hit, decodes no block.

    A place is matched to its segment through buckets of SEGMENT_TOKENS places, an equi-join without the codes. The
    distinct places of a segment then go to it in lists of at most LIST_PLACES, so that a segment travels once for each list.
    Null places and places outside the stream give no row; repeated places repeat.
    """
    ship(codes.sparkSession)
    width, own = F.lit(SEGMENT_TOKENS), ["shard", "segment"]
    seg = codes.filter("n_tokens > 0").select(*own, "start", "n_tokens", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("start") + F.col("n_tokens") - 1) / width))).alias("bucket"))
    at = places.select(F.col(place_col).cast("long").alias("place")).filter("place is not null")
    hit = seg.join(at.distinct().withColumn("bucket", F.floor(F.col("place") / width)), "bucket").filter("place >= start and place < start + n_tokens")
    hit = hit.select(*own, "place", (F.col("place") - F.col("start")).alias("i"))
    lists = hit.groupBy(*own, F.floor(F.col("i") / LIST_PLACES).alias("part")).agg(F.collect_list("place").alias("places"), F.collect_list("i").alias("at"))
    met = lists.join(codes.select(*own, "levels"), own).select("places", "at", "levels")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                levels = b.column(2)[k].as_py()
                got = [access(levels, i) for i in b.column(1)[k].as_py()]
                yield pa.RecordBatch.from_arrays([b.column(0)[k].values, pa.array(got, pa.int64())], ["place", "token"])

    found = met.mapInArrow(run, "place long, token long")
    return at.join(found, "place").select(F.col("place").alias(place_col), "token")


def round_trip(df: DataFrame, tokenizer_path: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the codes to the shared folder, reads them back and decodes them."""
    spark = df.sparkSession
    path = new_path(spark, "token-codes")
    write_codes(df, tokenizer_path, path, end_id, id_col, text_col)
    return decode(read_codes(spark.read.parquet(path)), id_col)
