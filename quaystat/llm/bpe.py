"""Byte-level BPE with a segment tree over the byte positions of a piece.

A leaf holds the rank of the pair that starts at its live position; an inner node holds the smallest
rank below it, and of equal ranks the leftmost. A merge takes the root, joins the two tokens and
updates three leaves (left neighbour, itself, dead right partner), each in log n steps.

Short pieces (nearly all) keep their trees as rows of one array, so that one numpy call does the same
step of many trees; a long piece has a tree of its own.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quaystat.llm.common import ship

NONE = 1 << 40  # above every rank
#: Pieces and chunks kept per worker with their codes; a table is emptied when full, so memory is bounded.
CACHE_PIECES = 350_000
#: Characters of text whose new pieces are merged together.
CHUNK_CHARS = 1 << 20
#: Leaves of the array trees; a longer piece gets its own tree.
SIZES = (4, 8, 16, 32, 64)
_SPACE_AFTER_SPACE = re.compile(r"\s ").search
_LAST = np.iinfo(np.int64).max


class ByteBpe:
    """Encodes and decodes by the ranks of a tiktoken file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks = ranks
        self.words = {v: k for k, v in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.single = [ranks[bytes([i])] for i in range(256)]
        self.pairs: dict[tuple[int, int], int] = {}
        for word, rank in ranks.items():
            for cut in range(1, len(word)):
                a, b = ranks.get(word[:cut]), ranks.get(word[cut:])
                if a is not None and b is not None:
                    self.pairs[a, b] = rank
        keys = np.array([a << 32 | b for a, b in self.pairs], np.int64)
        order = np.argsort(keys)
        self.pair_keys = np.append(keys[order], _LAST)
        self.pair_ranks = np.append(np.array(list(self.pairs.values()), np.int64)[order], 0)
        self.leaf_ids = np.array(self.single, np.int64)
        self.cache: dict[str, tuple[bytes, bytes]] = {}
        self.coded: dict[str, bytes] = {}
        self.decoded: dict[str, bytes] = {}

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBpe:
        with open(path, "rb") as f:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, pattern)

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece: always merges the leftmost pair of smallest rank."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        n = len(piece)
        tok = [self.single[b] for b in piece]
        if n < 2:
            return tok
        pairs = self.pairs.get
        size = 1 << (n - 1).bit_length()
        tree = [NONE] * (2 * size)
        where = [0] * (2 * size)
        for i in range(n - 1):
            tree[size + i] = pairs((tok[i], tok[i + 1]), NONE)
        where[size:] = range(size)
        for k in range(size - 1, 0, -1):
            c = 2 * k if tree[2 * k] <= tree[2 * k + 1] else 2 * k + 1
            tree[k], where[k] = tree[c], where[c]
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))

        def put(i: int, rank: int) -> None:
            k = size + i
            tree[k] = rank
            k >>= 1
            while k:
                c = 2 * k
                if tree[c + 1] < tree[c]:
                    c += 1
                tree[k], where[k] = tree[c], where[c]
                k >>= 1

        while tree[1] < NONE:
            i = where[1]
            j = after[i]
            tok[i] = tree[1]
            k = after[i] = after[j]
            tok[j] = -1
            if k < n:
                before[k] = i
            put(j, NONE)
            put(i, pairs((tok[i], tok[k]), NONE) if k < n else NONE)
            if (h := before[i]) >= 0:
                put(h, pairs((tok[h], tok[i]), NONE))
        return [t for t in tok if t >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """encode_piece() of each, many trees at a time."""
        out: list[list[int] | None] = [None] * len(pieces)
        groups: dict[int, list[int]] = {}
        for k, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[k] = [whole]
            elif 2 <= len(p) <= SIZES[-1]:
                groups.setdefault(next(s for s in SIZES if len(p) <= s), []).append(k)
            else:
                out[k] = self.encode_piece(p)
        for size, members in groups.items():
            for at in range(0, len(members), 1 << 16):
                part = members[at : at + (1 << 16)]
                for k, ids in zip(part, self._merge([pieces[k] for k in part], size)):
                    out[k] = ids
        return out

    def _rank(self, a: np.ndarray, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Leaf values (rank, then place) of the pairs; _LAST where there is no such pair."""
        key = a << 32 | b
        k = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys[k] == key, self.pair_ranks[k] << 6 | at, _LAST)

    def _merge(self, pieces: list[bytes], size: int) -> list[list[int]]:
        n = len(pieces)
        raw = np.frombuffer(b"".join(p.ljust(size, b"\0") for p in pieces), np.uint8).reshape(n, size)
        long = np.fromiter(map(len, pieces), np.int64, n)
        at = np.arange(size)
        tok = self.leaf_ids[raw]
        tok[at >= long[:, None]] = -1
        after, before = np.tile(at + 1, (n, 1)), np.tile(at - 1, (n, 1))
        tree = np.full((n, 2 * size), _LAST)
        pair = (at[1:] < long[:, None]).ravel()
        first = self._rank(tok[:, :-1].ravel()[pair], tok[:, 1:].ravel()[pair], np.tile(at[:-1], n)[pair])
        leaves = np.full(n * (size - 1), _LAST)
        leaves[pair] = first
        tree[:, size : 2 * size - 1] = leaves.reshape(n, size - 1)
        k = size
        while k > 1:
            tree[:, k // 2 : k] = np.minimum(tree[:, k : 2 * k : 2], tree[:, k + 1 : 2 * k : 2])
            k //= 2
        tok, after, before, flat = tok.ravel(), after.ravel(), before.ravel(), tree.ravel()
        live = np.flatnonzero(tree[:, 1] < _LAST)
        while live.size:
            root, base, top = flat[live * 2 * size + 1], live * size, live * 2 * size
            i = root & 63
            j = after[base + i]
            k = after[base + j]
            tok[base + i], tok[base + j], after[base + i] = root >> 6, -1, k
            more = k < long[live]
            before[(base + k)[more]] = i[more]
            h = before[base + i]
            back = h >= 0
            flat[top + size + j] = _LAST
            value = np.full(live.size, _LAST)
            value[more] = self._rank((root >> 6)[more], tok[(base + k)[more]], i[more])
            flat[top + size + i] = value
            flat[(top + size + h)[back]] = self._rank(tok[(base + h)[back]], (root >> 6)[back], h[back])
            rows = np.concatenate([top, top, top[back]])
            node = np.concatenate([i, j, h[back]]) + size >> 1
            while node[0]:
                flat[rows + node] = np.minimum(flat[rows + 2 * node], flat[rows + 2 * node + 1])
                node >>= 1
            live = live[flat[top + 1] < _LAST]
        tok = tok.reshape(n, size)
        kept = tok >= 0
        ends, ids = np.cumsum(kept.sum(1)).tolist(), tok[kept].tolist()
        return [ids[a:b] for a, b in zip([0, *ends], ends)]

    def ids(self, text: str) -> list[int]:
        return [x for ids in self.encode_pieces([p.encode() for p in self.find(text)]) for x in ids]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.words.__getitem__, ids))

    def _keys(self, text: str) -> list[str]:
        """Chunks that no piece crosses: each but the first stands for itself after one space.

        The pattern always cuts before a space that follows a character other than white space; a text
        with a space after white space is one chunk.
        """
        if _SPACE_AFTER_SPACE(text):
            return [text + " "]
        keys = text.split(" ")
        keys[0] += " "
        return keys

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Of each text n_tokens, sha256 of the ids, sha256 of the bytes that these ids decode to."""
        out, at = [], 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and chars < CHUNK_CHARS:
                chars += len(texts[end])
                end += 1
            if len(self.coded) >= CACHE_PIECES:
                self.coded.clear()
                self.decoded.clear()
            if len(self.cache) >= CACHE_PIECES:
                self.cache.clear()
            found = [self._keys(t) for t in texts[at:end]]
            new = list(set().union(*found).difference(self.coded))
            split = [self.find(k[:-1] if k[-1:] == " " else " " + k) for k in new]
            pieces = list(set().union(*split).difference(self.cache))
            for p, ids in zip(pieces, self.encode_pieces([p.encode() for p in pieces])):
                self.cache[p] = b" ".join([b"%d" % x for x in ids]), self.decode(ids)
            for k, ps in zip(new, split):
                got = [self.cache[p] for p in ps]
                self.coded[k], self.decoded[k] = b" ".join([x[0] for x in got]), b"".join([x[1] for x in got])
            coded, decoded = self.coded.__getitem__, self.decoded.__getitem__
            for keys in found:
                ids = b" ".join(map(coded, keys)).strip()
                out.append((ids.count(b" ") + bool(ids), hashlib.sha256(ids).hexdigest(), hashlib.sha256(b"".join(map(decoded, keys))).hexdigest()))
            for k in new:
                if len(k) > 64:
                    del self.coded[k], self.decoded[k]
            for p in pieces:
                if len(p) > 64:
                    del self.cache[p]
            at = end
        return out


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def _loaded(path: str, pattern: str) -> ByteBpe:
    """One coder for each worker process, kept from task to task."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBpe.load(path, pattern)
    return _LOADED[path, pattern]


def vocabulary(name: str = "byte_bpe_50k.tiktoken") -> tuple[str, str]:
    """The path of a public rank file and the pattern that splits its texts."""
    import public_tokenizers

    return public_tokenizers.path(name), public_tokenizers.PATTERN


def encode_digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: (id_col, n_tokens, ids_sha256, decoded_sha256); no shuffle.

    A null text counts as empty (0 tokens, digests of nothing). Null ids, repeated ids and repeated
    rows are passed on as they are; other columns are not read.
    """
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(path, pattern)
        for b in batches:
            got = coder.digests([t or "" for t in b.column(1).to_pylist()])
            n, a, d = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(d, pa.string())], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_ids(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids array<int>): the ids themselves, for a sink. A null text gives an empty array."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([coder.ids(t.as_py() or "") for t in b.column(1)], pa.list_(pa.int32()))], [id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode_ids(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id_col, bytes binary): the exact bytes that the ids stand for. Null ids give no bytes."""
    ship(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _loaded(path, pattern)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([coder.decode(x.as_py() or []) for x in b.column(1)], pa.binary())], [id_col, "bytes"])

    return df.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, bytes binary")
