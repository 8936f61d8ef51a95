"""Category filters on facts: by a map of categories on the fact itself, and by an index of bitmaps.

The map is one array of (dimension_code, category_code, category_name) a row: whether a fact has a wanted member in every filtered
dimension is then a predicate on the row, without a bridge, a join or a count. The index has a bitmap of fact numbers for each member
and 32768 numbers: members of a dimension are or-ed, dimensions and-ed, and a fact is tested for its bit.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Filters = dict[str, tuple[str, ...]]


def member(dimension: str | Column, code: Column, name: Column) -> Column:
    return F.struct((F.lit(dimension) if isinstance(dimension, str) else dimension).alias("dimension_code"), code.alias("category_code"), name.alias("category_name"))


def category_map(bridge: DataFrame, key: str = "observation_key") -> DataFrame:
    """(key, categories) of a bridge: one shuffle, for facts that were loaded without their map."""
    code = F.col("category_code") if "category_code" in bridge.columns else F.lit(None).cast("string")
    return bridge.groupBy(key).agg(F.collect_list(member(F.col("dimension_code"), code, F.col("category_name"))).alias("categories"))


def holds(filters: Filters, categories: str = "categories") -> Column:
    """Every filtered dimension has a member whose code or name is wanted; dimensions are compared without case."""
    out = F.lit(True)
    for d, values in filters.items():
        wanted = lambda c, d=d.lower(), v=list(values): (F.lower(c["dimension_code"]) == d) & (F.trim(F.coalesce(c["category_code"], F.lit(""))).isin(*v) | c["category_name"].isin(*v))
        out = out & _exists(categories, wanted)
    return out


def _exists(categories: str, test) -> Column:
    return F.coalesce(F.exists(categories, lambda c: F.coalesce(test(c), F.lit(False))), F.lit(False))


def has_all(totals: Column, categories: str = "categories") -> Column:
    """The fact has every member of an array of members, each by its code or name."""

    def same(t: Column) -> Column:
        own = lambda c: F.trim(F.coalesce(c["category_code"], F.lit(""))) == t["category_code"]
        return _exists(categories, lambda c: (F.lower(c["dimension_code"]) == t["dimension_code"]) & (F.coalesce(own(c), F.lit(False)) | (c["category_name"] == t["category_name"])))

    return F.forall(totals, lambda t: same(t))


@dataclass(frozen=True)
class BitmapIndex:
    """(dimension, category_name, category_code, bucket, bitmap) of the facts' numbers.

    Numbers should be dense, as row numbers are: a bitmap takes four kilobytes however few of its numbers occur.
    """

    spark: SparkSession
    path: str
    number: str = "observation_key"

    @staticmethod
    def build(bridge: DataFrame, path: str, number: str = "observation_key") -> BitmapIndex:
        """Writes the index of a bridge: one aggregate with a partial step, by dimension for reads of some only."""
        code = F.col("category_code") if "category_code" in bridge.columns else F.lit(None).cast("string")
        n = F.col(number)
        rows = bridge.select(F.lower("dimension_code").alias("dimension"), "category_name", code.alias("category_code"), F.bitmap_bucket_number(n).alias("bucket"), F.bitmap_bit_position(n).alias("bit"))
        rows = rows.groupBy("dimension", "category_name", "category_code", "bucket").agg(F.bitmap_construct_agg("bit").alias("bitmap"))
        rows.write.partitionBy("dimension").parquet(path)
        return BitmapIndex(bridge.sparkSession, path, number)

    def rows(self) -> DataFrame:
        return self.spark.read.schema("category_name string, category_code string, bucket long, bitmap binary, dimension string").parquet(self.path)

    def contracts(self, contracts: dict[str, Filters]) -> DataFrame:
        """(contract, bucket, bitmap): the facts that have a wanted member in every dimension of a contract."""
        wanted = [(c, d.lower(), v) for c, f in contracts.items() for d, values in f.items() for v in values]
        need = self.spark.createDataFrame([(c, len({d.lower() for d in f})) for c, f in contracts.items()], "contract string, need long")
        want = self.spark.createDataFrame(wanted, "contract string, dimension string, wanted string")
        known = F.col("dimension").isin(*sorted({d for _, d, _ in wanted}))
        hit = self.rows().filter(known).join(F.broadcast(want), ["dimension"]).filter((F.col("category_name") == F.col("wanted")) | (F.trim("category_code") == F.col("wanted")))
        one = hit.groupBy("contract", "dimension", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
        both = one.groupBy("contract", "bucket").agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count("*").alias("have"))
        return both.join(F.broadcast(need), (both["contract"] == need["contract"]) & (F.col("have") == F.col("need"))).select(both["contract"], "bucket", "bitmap")

    def within(self, fact: DataFrame, filters: Filters) -> DataFrame:
        """The facts whose bit is set. The lists of a plan's filters are short, so they go as literals; bitmaps meet facts by bucket."""
        if not filters:
            return fact
        rows = self.contracts({"plan": filters}).select(F.col("bucket").alias("bucket__"), F.col("bitmap").alias("bitmap__"))
        out = fact.join(rows, F.bitmap_bucket_number(F.col(self.number)) == F.col("bucket__"))
        return out.filter(bit_is_set(F.col("bitmap__"), F.bitmap_bit_position(F.col(self.number)))).select(*(fact[c] for c in fact.columns))


def bit_is_set(bitmap: Column, bit: Column) -> Column:
    byte = F.conv(F.hex(F.substring(bitmap, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(F.lit(1)) == 1


def total_members(dims: DataFrame, dataset: str, free_of: tuple[str, ...]) -> DataFrame:
    """The best total of each dimension of a dataset but those: code T first, then the name total alone, at its end, or in it, then the shortest."""
    code, name = F.nullif(F.trim(F.coalesce("category_code", F.lit(""))), F.lit("")), F.lower("category_name")
    order = [
        F.when(F.upper(F.coalesce(code, F.lit(""))).startswith("T"), 0).otherwise(1),
        F.when(name.isin("totaal", "total"), 0).when(name.endswith(" totaal") | name.endswith(" total"), 1).otherwise(2),
        F.length("category_name"),
        F.col("category_name"),
    ]
    own = dims.filter(F.col("dataset_code").isin(dataset, dataset.upper(), dataset.lower()) & F.col("is_total"))
    if free_of:
        own = own.filter(~F.lower("dimension_code").isin(*(d.lower() for d in free_of)))
    best = F.min_by(F.struct(code.alias("category_code"), "category_name"), F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order))))
    return own.groupBy(F.lower("dimension_code").alias("dimension_code")).agg(best.alias("m")).select("dimension_code", "m.category_code", "m.category_name")
