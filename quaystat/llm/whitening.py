"""Whitening of vectors by the leading eigenvectors of their covariance, found by LOBPCG.

The driver holds only blocks of `dimensions` rows: the iterate, its residuals and the last directions. What the covariance does
to a block is summed over the centred rows in one job, so the matrix itself is never formed. Rayleigh-Ritz on the three
blocks gives the next iterate, until the residuals of all wanted pairs, taken from a product with the rows and not carried along,
are at the level of rounding.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quaystat.llm.common import ship, written
from quaystat.llm.vectors import matrix, one_length, quantised, total

COMPONENTS = 16
#: Columns of the iterate beyond the wanted ones; they speed convergence where eigenvalues lie close together.
GUARD = 8
MAX_ROUNDS = 500
SCALE, SHIFT = 64, 1_000_000


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exactly: longs, or Python's whole numbers where longs could overflow."""
    if n * (1 + int(np.abs(x).max(initial=0))) + max(map(abs, sums)) < 1 << 62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def squares(c: np.ndarray) -> list[int | None]:
    """Row sums of squares, exactly; None if it is no long."""
    top = int(np.abs(c).max(initial=0))
    if top * top * c.shape[1] < 1 << 63:
        c = c.astype(np.int64)
        return (c * c).sum(1).tolist()
    return [s if s < 1 << 63 else None for s in (sum(v * v for v in map(int, r)) for r in c)]


def orthonormal(*blocks: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the blocks' columns; the first block, orthonormal itself, stays as it is."""
    basis = blocks[0]
    for b in blocks[1:]:
        for _ in range(2):  # once more for the digits that the first pass cancels
            b = b - basis @ (basis.T @ b)
            size = np.linalg.norm(b, axis=0)
            b = b[:, size > 0] / size[size > 0]
            u, s, _ = np.linalg.svd(b, full_matrices=False)
            b = u[:, s > 1e-10 * max(1.0, s.max(initial=0))]
        basis = np.hstack([basis, b[:, : basis.shape[0] - basis.shape[1]]])
    return basis


def lobpcg(product: Callable[[np.ndarray], np.ndarray], d: int, k: int, guard: int = GUARD, rounds: int = MAX_ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest eigenvalues of a symmetric operator, unit eigenvectors, and the largest residual over the first eigenvalue.

    product(block) applies the operator to the columns of a block.
    """
    m = min(d, k + guard)
    x = np.linalg.qr(np.random.default_rng(12).standard_normal((d, m)))[0]
    basis, p, best, since = x, x[:, :0], np.inf, 0
    for _ in range(rounds):
        ab = product(basis)
        g = basis.T @ ab
        e, y = np.linalg.eigh((g + g.T) / 2)
        e, y = e[::-1][:m], y[:, ::-1][:, :m]
        if basis.shape[1] > m:
            p = basis[:, m:] @ y[m:]
        x, ax = basis @ y, ab @ y
        r = ax - x * e
        worst = float(np.linalg.norm(r[:, :k], axis=0).max(initial=0)) / max(float(e[0]), np.finfo(float).tiny)
        since = 0 if worst < best / 2 else since + 1
        best = min(best, worst)
        if worst <= 2e-14 * np.sqrt(d) or worst < 1e-11 and since >= 4:
            return e[:k], x[:, :k], worst
        x = np.linalg.qr(x)[0]
        basis = orthonormal(x, r, p)
    raise RuntimeError(f"residuals of {best:.1e} after {rounds} rounds")


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = COMPONENTS, guard: int = GUARD) -> DataFrame:
    """(id_col, component, n, deviation, whitened, explained, identity_error) for each row and each of the first k components.

    Vectors that are null or empty or hold a null or non-finite entry, or one too large for a long, take no part; of vectors
    of several lengths only those of the commonest take part (the longer one of equals). Equal vectors count
    once in the fit and each keep their rows, as do repeated and null ids. Components without variance (eigenvalues that are zero but
    for rounding) are left out: fewer than k come back, none if all vectors are equal. deviation is null where it exceeds a long.
    An empty table gives no rows.
    """
    ship(df.sparkSession)
    rows, d = one_length(quantised(df, id_col, vec_col, SCALE, SHIFT), "whitening-rows")
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fit = written(rows.select("x").distinct(), "whitening-fit")

    n = fit.count()
    if not n:
        return df.sparkSession.createDataFrame([], schema)
    halves = total(fit, lambda x: np.concatenate([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)]), np.zeros(2 * d, np.int64)).tolist()
    sums = [(a << 32) + b for a, b in zip(halves[:d], halves[d:])]

    def rows_of(x: np.ndarray) -> np.ndarray:
        return (centred(x, n, sums) / n).astype(np.float64)

    def product(block: np.ndarray) -> np.ndarray:
        def fold(x: np.ndarray) -> np.ndarray:
            c = rows_of(x)
            return (c.T @ (c @ block)).ravel()

        return total(fit, fold, np.zeros(block.size)).reshape(block.shape) / n

    trace = float(total(fit, lambda x: np.array([(rows_of(x) ** 2).sum()]), np.zeros(1))[0]) / n
    e, v, _ = lobpcg(product, d, min(k, d), guard)
    rank = int((e > max(d, n) * np.finfo(float).eps * max(trace, 0)).sum())
    if not rank:
        return df.sparkSession.createDataFrame([], schema)
    e, v = e[:rank], v[:, :rank]
    v = v * np.sign(v[np.abs(v).argmax(0), np.arange(rank)])
    scaled = v / np.sqrt(e)

    def gram(x: np.ndarray) -> np.ndarray:
        w = rows_of(x) @ scaled
        return (w.T @ w).ravel()

    error = float(np.abs(total(fit, gram, np.zeros(rank * rank)).reshape(rank, rank) / n - np.eye(rank)).max())
    explained = e / trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = centred(matrix(b.column("x")), n, sums)
            w = (c / n).astype(np.float64) @ scaled
            rep = np.repeat(np.arange(len(c)), rank)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("id").take(pa.array(rep)),
                    pa.array(np.tile(np.arange(1, rank + 1, dtype=np.int32), len(c))),
                    pa.array(np.full(len(rep), n, np.int64)),
                    pa.array(squares(c), pa.int64()).take(pa.array(rep)),
                    pa.array(w.ravel()),
                    pa.array(np.tile(explained, len(c))),
                    pa.array(np.full(len(rep), error)),
                ],
                [id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema)
