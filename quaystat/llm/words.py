"""Words and hashes of word runs for a chunk of texts at a time, as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes of text that are turned into arrays together; a longer text is a chunk of its own.
CHUNK_BYTES = 1 << 19
_U = np.uint64
_TABLE = np.random.default_rng(20_240_601).integers(0, 2**64, 256, dtype=_U, endpoint=False)
_BYTE, _WORD = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95  # odd multipliers


class _Powers:
    """Powers of an odd number and of its inverse, modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base = base
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, b in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                f = np.full(size, b, _U)
                f[0] = 1
                setattr(self, name, np.multiply.accumulate(f))
        return self.up, self.down


_BYTE_POWERS, _WORD_POWERS = _Powers(_BYTE), _Powers(_WORD)


def mix(x: np.ndarray) -> np.ndarray:
    """The finishing steps of splitmix64."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def chunks(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of the list that hold about CHUNK_BYTES each."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and size < CHUNK_BYTES:
            size += len(texts[end] or "")
            end += 1
        yield at, end
        at = end


class Words:
    """The words of some texts in one row: hashes, and where each text begins.

    texts: bytes whose words are separated by ASCII white space.
    """

    def __init__(self, texts: list[bytes]):
        split = [t.split() for t in texts]
        self.counts = np.fromiter(map(len, split), np.int64, len(split))
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.joined = [b" ".join(w) for w in split]
        self.buffer = b" ".join([t for t in self.joined if t]) + b" "
        raw = np.frombuffer(self.buffer, np.uint8)
        self.ends = np.flatnonzero(raw == 32) if self.first[-1] else np.zeros(0, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1] + 1]) if len(self.ends) else self.ends
        up, down = _BYTE_POWERS.get(len(raw) + 1)
        sums = np.zeros(len(raw) + 1, _U)
        np.cumsum(_TABLE[raw] * up[: len(raw)], out=sums[1:])
        self.hashes = mix((sums[self.ends] - sums[self.starts]) * down[self.starts])
        up, _ = _WORD_POWERS.get(len(self.hashes) + 1)
        self.sums = np.zeros(len(self.hashes) + 1, _U)
        np.cumsum(self.hashes * up[: len(self.hashes)], out=self.sums[1:])

    def runs(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        """Hashes of the word runs that start there; equal words and length give equal hashes."""
        _, down = _WORD_POWERS.get(len(self.hashes) + 1)
        n = np.asarray(length).astype(_U)
        return mix((self.sums[start + length] - self.sums[start]) * down[start] + n * _U(0xA0761D6478BD642F))

    def grams(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of all runs of k words inside a text, and how many each text has."""
        n = np.maximum(self.counts - k + 1, 0)
        return ranges(self.first[:-1], n), n

    def text(self, start: int, end: int) -> bytes:
        """Words start..end-1 joined by one space."""
        return self.buffer[self.starts[start] : self.ends[end - 1]] if end > start else b""


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (n[0] of them), start[1], ..."""
    total = int(n.sum())
    if not total:
        return np.zeros(0, np.int64)
    n, start = n[n > 0], start[n > 0]
    step = np.ones(total, np.int64)
    step[0] = start[0]
    step[np.cumsum(n)[:-1]] = start[1:] - (start[:-1] + n[:-1] - 1)
    return np.cumsum(step)
