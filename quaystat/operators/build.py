"""The gold build in one pass: raw rows to facts with their keys and category map, and the bridge from those.

A raw row has all its cells, so facts are made row by row: its JSON becomes a map once, its dimensions are looked up in tables that are
broadcast, and its measures are exploded. No row is shuffled. The bridge is the exploded category map.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystat.functions import rules
from quaystat.store import written

UNKNOWN = "UNKNOWN"
#: A dimension of more rows than this is joined as Spark sees fit and not broadcast by name.
SMALL = 200_000


@dataclass(frozen=True)
class Model:
    """What the properties of a raw data set are: its period, its places in order of preference, its categories and its measures (code, unit)."""

    dataset_id: str
    period: str
    places: tuple[str, ...]
    categories: tuple[str, ...]
    measures: tuple[tuple[str, str], ...]


def small(df: DataFrame, name: str) -> DataFrame:
    """A dimension, written; for broadcast if it is small enough."""
    df = written(df, name)
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def facts(raw: DataFrame, model: Model, dates: DataFrame, places: DataFrame, categories: DataFrame) -> DataFrame:
    """A row for each raw row and measure that it has a cell of, be it empty.

    dates: period_code, date_key, period_type, calendar_year. places: geography_code, geography_key, geography_name, geography_type. categories:
    dimension_code, category_code, category_name, with a member UNKNOWN of any dimension. What the tables lack gets the key -1, or the
    dimension's UNKNOWN member; a dimension without that member leaves such a category out. Cells `.`, empty and null are missing, `x` and the like
    suppressed; text that is no number gives a null value and keeps its text. Raw rows that are no JSON have no measures and give no facts.
    """
    cells = raw.select("dataset_id", F.col("row_id").cast("string").alias("row_id"), F.from_json("raw", "map<string,string>").alias("m")).filter(F.col("dataset_id") == model.dataset_id)
    get = lambda k: F.element_at("m", F.lit(k))
    cells = cells.withColumns({"p_code": get(model.period), "g_code": F.coalesce(*(get(p) for p in model.places), F.lit(None))})
    cells = cells.join(small(dates, "dates"), F.col("p_code") == F.col("period_code"), "left").join(small(places, "places"), F.col("g_code") == F.col("geography_code"), "left")
    members = written(categories, "categories")
    known = {(r.dimension_code): F.struct(F.lit(r.dimension_code).alias("dimension_code"), F.lit(UNKNOWN).alias("category_code"), F.lit(r.category_name).alias("category_name")) for r in members.filter(F.col("dimension_code").isin(*model.categories) & (F.col("category_code") == UNKNOWN)).collect()}
    found = []
    for k, d in enumerate(model.categories):
        own = members.filter((F.col("dimension_code") == d) & (F.col("category_code") != UNKNOWN)).select(F.col("category_code").alias(f"c{k}"), F.struct("dimension_code", "category_code", "category_name").alias(f"category{k}"))
        cells = cells.join(small(own, "members"), get(d) == F.col(f"c{k}"), "left")
        member = F.coalesce(f"category{k}", known[d]) if d in known else F.col(f"category{k}")
        found.append(F.when(F.map_contains_key("m", d), member))
    cells = cells.withColumn("categories", F.array_compact(F.array(*found)) if found else F.array().cast("array<struct<dimension_code:string,category_code:string,category_name:string>>"))
    pairs = F.transform("categories", lambda c: F.concat(c["dimension_code"], F.lit("="), c["category_code"]))
    one = lambda code, unit: F.when(F.map_contains_key("m", code), F.struct(F.lit(code).alias("measure_code"), F.lit(unit).alias("unit_code"), rules.stable_key(F.lit("measure"), F.lit(model.dataset_id), F.lit(code)).alias("measure_key"), get(code).alias("text")))
    cells = cells.withColumn("cell", F.explode(F.array_compact(F.array(*(one(*m) for m in model.measures)))))
    number = F.col("cell.text").try_cast("decimal(18,2)")
    missing, suppressed, status = rules.missing_flags(number, F.col("cell.text"))
    minus = F.lit(-1).cast("long")
    out = cells.select(
        "dataset_id", "row_id", F.coalesce("date_key", minus).alias("date_key"), "calendar_year", "period_type", F.coalesce("geography_key", minus).alias("geography_key"), F.when(F.col("geography_key").isNotNull(), F.col("g_code")).alias("geography_code"), "geography_name", "geography_type",
        "categories", rules.combination_hash(pairs).alias("category_hash"), "cell.measure_code", "cell.unit_code", "cell.measure_key", F.when(~suppressed, number).alias("value"), F.col("cell.text").alias("value_text"), missing.alias("is_missing"), suppressed.alias("is_suppressed"), status.alias("status"),
    )
    record = rules.stable_hash(*(F.col(c) for c in ("dataset_id", "measure_key", "date_key", "geography_key", "category_hash", "row_id", "value", "value_text", "status")))
    return out.withColumns({"record_hash": record, "observation_key": F.conv(F.substring(record, 1, 15), 16, 10).cast("long")})


def bridge(facts: DataFrame) -> DataFrame:
    """(observation_key, category_key, dimension_code, category_code, category_name): the members of each fact."""
    out = facts.select("observation_key", "dataset_id", F.explode("categories").alias("c"))
    key = rules.stable_key(F.lit("category"), F.col("dataset_id"), F.col("c.dimension_code"), F.col("c.category_code"))
    return out.select("observation_key", key.alias("category_key"), "c.dimension_code", "c.category_code", "c.category_name")
