"""Vectors as whole numbers, and sums of arrays over all rows of a table."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystat.llm.common import ship, written

#: Partial sums that reach the driver at most, whatever the number of partitions.
FAN = 64


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1) if len(flat) else np.zeros((len(column), 0), np.int64)


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: int, shift: int = 0, keep: tuple[str, ...] = (), limit: int = 1 << 62) -> DataFrame:
    """(id, *keep, x): x is floor(scale * entry) + shift as longs; no shuffle.

    Rows whose vector is null or empty, or holds a null or non-finite entry or one that scale takes to limit or more, are left out.
    """
    ship(df.sparkSession)
    kinds = [df.schema[c].dataType.simpleString() for c in (id_col, *keep)]
    names = ["id", *keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(b.column("x").is_valid())
            x = b.column("x")
            at = x.offsets.to_numpy() - x.offsets[0].as_py() if len(x) else np.zeros(1, np.int64)
            c = np.floor(scale * x.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            odd = np.concatenate([[0], np.cumsum(~(np.abs(c) < limit))])  # also for NaN
            good = pa.array((odd[at[1:]] == odd[at[:-1]]) & (at[1:] > at[:-1]))
            whole = np.where(np.abs(c) < limit, c, 0).astype(np.int64) + shift
            lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(whole, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), lists], [*names, "x"]).filter(good)

    schema = ", ".join(f"`{n}` {k}" for n, k in zip([*names, "x"], [*kinds, "array<long>"]))
    cols = [F.col(id_col).alias("id"), *keep, F.col(vec_col).cast("array<double>").alias("x")]
    return df.select(*cols).mapInArrow(run, schema)


def one_length(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """The rows, written, whose x has the commonest length (the longer one of equals), and that length; 0 without rows."""
    rows = written(rows, name)
    d = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    return (rows.filter(F.size("x") == d["d"]), d["d"]) if d else (rows, 0)


def total(rows: DataFrame, fold: Callable[[np.ndarray], np.ndarray], zero: np.ndarray) -> np.ndarray:
    """Sum of fold(matrix of the x of a batch) over all batches: a row for each task, those added in FAN groups, and these here."""
    ship(rows.sparkSession)
    kind = zero.dtype

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = zero.copy()
        for b in batches:
            if b.num_rows:
                out += fold(matrix(b.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out.tobytes()], pa.binary())], ["part", "sums"])

    def add(group: pa.Table) -> pa.Table:
        out = zero.copy()
        for s in group.sort_by("part")["sums"]:
            out += np.frombuffer(s.as_py(), kind)
        return pa.table({"sums": pa.array([out.tobytes()], pa.binary())})

    parts = rows.select("x").mapInArrow(run, "part int, sums binary")
    out = zero.copy()
    for r in parts.groupBy((F.col("part") % FAN).alias("g")).applyInArrow(add, "sums binary").collect():
        out += np.frombuffer(r["sums"], kind)
    return out
