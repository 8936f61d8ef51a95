"""A filter of bounded size that spares shuffles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystat.llm.common import written

#: 64-bit words of the largest filter, 4 MB, and of the smallest; bits for each value until the largest is reached.
MOST_WORDS, LEAST_WORDS, BITS = 1 << 19, 1 << 10, 32


def bits(values: DataFrame, column: str) -> Callable[[Column], Column]:
    """A test that is true for every value of the column of longs, and for few others while they are few.

    The filter is one array of longs from a scalar subquery. Its size follows the number of values, as it goes with every task that
    tests: bits are set in the largest filter first, counted, and folded. With more than some ten million values it lets
    all pass, which costs a shuffle and changes no result.
    """
    h = F.xxhash64(F.col(column))
    words = written(values.groupBy(_word(h, MOST_WORDS).alias("w")).agg(F.bit_or(_bit(h)).alias("v")), "filter-words")
    n = words.agg(F.coalesce(F.sum(F.bit_count("v")), F.lit(0))).first()[0]
    size = LEAST_WORDS
    while size < MOST_WORDS and 64 * size < BITS * n:
        size *= 2
    small = words.groupBy(F.col("w").bitwiseAND(F.lit(size - 1)).alias("w")).agg(F.bit_or("v").alias("v"))
    dense = values.sparkSession.range(size).withColumnRenamed("id", "w").join(small, "w", "left").select("w", F.coalesce("v", F.lit(0)).alias("v"))
    dense = written(dense, "filter").agg(F.transform(F.sort_array(F.collect_list(F.struct("w", "v"))), lambda x: x["v"]).alias("f"))
    filled = dense.scalar()
    return lambda c: F.get(filled, _word(F.xxhash64(c), size).cast("int")).bitwiseAND(_bit(F.xxhash64(c))) != 0


def _word(h: Column, size: int) -> Column:
    return F.shiftright(h, 6).bitwiseAND(F.lit(size - 1))


def _bit(h: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
