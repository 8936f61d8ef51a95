"""Structured query plans: a record, its guards, and its compilation to a DataFrame."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystat.plans.categories import BitmapIndex

SHAPES = {"ranking", "comparison", "trend", "trend_by_geography", "category_breakdown", "metric_comparison", "share_of_total", "compare_to_average", "multi_metric_rank", "change_rank"}
OPERATORS = {"lt": Column.__lt__, "lte": Column.__le__, "gt": Column.__gt__, "gte": Column.__ge__}
PARENTHESIS = r"\s*\([^)]*\)\s*$"


class PlanError(ValueError):
    """The plan can't be executed."""


@dataclass(frozen=True)
class Plan:
    shape: str
    measure: str
    second_measure: str | None = None
    geography_type: str | None = "municipality"
    geographies: tuple[str, ...] = ()
    excluded: tuple[str, ...] = ()
    year: int | None = None
    year_from: int | None = None
    year_to: int | None = None
    filters: dict[str, tuple[str, ...]] = field(default_factory=dict)
    having: tuple[str, float] | None = None
    dimension: str | None = None
    qualifier: tuple[str, str] | None = None
    descending: bool = True
    limit: int | None = None

    def clamped(self) -> int:
        """Result rows: 10 by default, 1 to 50."""
        return max(1, min(10 if self.limit is None else self.limit, 50))


def validate(plan: Plan, measures: set[str]) -> None:
    """Guards in order: shape, measure, second measure, years, grouping."""
    if plan.shape not in SHAPES:
        raise PlanError(f"unknown shape {plan.shape}")
    for m in (plan.measure, plan.second_measure):
        if m is not None and m not in measures:
            raise PlanError(f"measure {m} is not enabled")
    if plan.shape in ("metric_comparison", "share_of_total", "multi_metric_rank") and not plan.second_measure:
        raise PlanError(f"{plan.shape} needs a second measure")
    if plan.shape == "change_rank" and (plan.year_from is None or plan.year_to is None):
        raise PlanError("change_rank needs both years")
    if plan.shape == "category_breakdown" and not plan.dimension:
        raise PlanError("category_breakdown needs a dimension")


def _names(names: tuple[str, ...]) -> list[str]:
    return [n.lower() for n in names]


def named(col: Column, names: tuple[str, ...]) -> Column:
    """Name equality without case, also after a bracketed end is taken off both."""
    c, want = F.lower(col), _names(names)
    return c.isin(want) | F.regexp_replace(c, PARENTHESIS, "").isin([re.sub(PARENTHESIS, "", n) for n in want])


def filtered(fact: DataFrame, bridge: DataFrame, filters: dict[str, tuple[str, ...]]) -> DataFrame:
    """Facts that have a wanted category in every filtered dimension: relational division by counting."""
    if not filters:
        return fact
    wanted = [(F.lower("dimension_code") == d.lower()) & F.col("category_name").isin(list(v)) for d, v in filters.items()]
    any_of = wanted[0]
    for w in wanted[1:]:
        any_of = any_of | w
    keys = bridge.filter(any_of).groupBy("observation_key").agg(F.countDistinct(F.lower("dimension_code")).alias("n")).filter(F.col("n") == len(filters))
    return fact.join(keys.select("observation_key"), "observation_key", "left_semi")


with_categories = filtered


def _base(plan: Plan, fact: DataFrame, measures: list[str], years: bool = True) -> DataFrame:
    out = fact.filter(F.col("value").isNotNull() & ~F.col("is_missing") & F.col("measure_code").isin(measures))
    if plan.geography_type:
        out = out.filter(F.col("geography_type") == plan.geography_type)
    out = out.filter(~(F.coalesce(F.col("geography_code") == "GM0000", F.lit(False)) | F.coalesce(F.contains(F.lower("geography_name"), F.lit("niet in te delen")), F.lit(False))))
    if plan.year is not None:
        out = out.filter(F.col("calendar_year") == plan.year)
    if years and plan.year_from is not None:
        out = out.filter(F.col("calendar_year") >= plan.year_from)
    if years and plan.year_to is not None:
        out = out.filter(F.col("calendar_year") <= plan.year_to)
    return out


def _cell(df: DataFrame, *by: str) -> DataFrame:
    """One value for each cell: the largest scaled value, as the collapse of unfiltered categories."""
    scaled = F.col("value") * F.coalesce("scale_factor", F.lit(1))
    return df.groupBy(*by).agg(F.max(scaled).cast("double").alias("value"), F.max("value").cast("double").alias("raw_value"), F.max("unit_code").alias("unit_code"))


def _share(n: Column, d: Column, digits: int, factor: int = 1) -> Column:
    return F.round(F.try_divide(n, d) * factor, digits)


def compile_plan(plan: Plan, fact: DataFrame, bridge: DataFrame, index: BitmapIndex | None = None) -> DataFrame:
    """The DataFrame of a valid plan. Every order is total, every top-k is a limit on it.

    index: bitmaps of the bridge; category filters are then bits of the facts' numbers and not a count over the bridge.
    """

    def with_categories(df: DataFrame, bridge: DataFrame, filters: dict[str, tuple[str, ...]]) -> DataFrame:
        return index.within(df, filters) if index else filtered(df, bridge, filters)

    place = ["geography_name", "geography_code", "geography_type", "calendar_year"]
    base = with_categories(_base(plan, fact, [plan.measure]), bridge, plan.filters)
    if plan.shape == "ranking":
        if plan.excluded:
            base = base.filter(~F.coalesce(named(F.col("geography_name"), plan.excluded), F.lit(False)))
        out = _cell(base, *place)
        if plan.having:
            out = out.filter(OPERATORS[plan.having[0]](F.col("value"), F.lit(plan.having[1])))
        order = F.desc_nulls_last("value") if plan.descending else F.asc_nulls_last("value")
        return out.orderBy(order, "geography_code", "calendar_year").limit(plan.clamped())
    if plan.shape == "comparison":
        if plan.geographies:
            base = base.filter(named(F.col("geography_name"), plan.geographies))
        return _cell(base, *place).orderBy("geography_name", "calendar_year").limit(plan.clamped())
    if plan.shape in ("trend", "trend_by_geography"):
        if plan.geographies:
            base = base.filter(named(F.col("geography_name"), plan.geographies))
        by = ["calendar_year"] if plan.shape == "trend" else place
        return _cell(base.filter(F.col("calendar_year").isNotNull()), *by).orderBy(*by).limit(plan.clamped())
    if plan.shape == "category_breakdown":
        cats = bridge.filter((F.lower("dimension_code") == plan.dimension.lower()) & ~F.col("category_name").startswith("Unknown"))
        if plan.qualifier:  # a second dimension must have one value
            base = with_categories(base, bridge, {plan.qualifier[0]: (plan.qualifier[1],)})
        out = _cell(base.join(cats, "observation_key"), "geography_name", "calendar_year", "dimension_code", "category_name")
        return out.orderBy("geography_name", "calendar_year", "category_name").limit(plan.clamped())
    if plan.shape == "metric_comparison":
        both = with_categories(_base(plan, fact, [plan.measure, plan.second_measure]), bridge, plan.filters)
        if plan.geographies:
            both = both.filter(named(F.col("geography_name"), plan.geographies))
        return _cell(both, "measure_code", *place).orderBy("geography_name", "calendar_year", "measure_code").limit(plan.clamped())
    if plan.shape == "share_of_total":
        total = _cell(_base(plan, fact, [plan.second_measure]), *place).select("geography_name", "geography_type", "calendar_year", F.col("value").alias("denominator_value"))
        out = _cell(base, *place).withColumnRenamed("value", "numerator_value").join(total, ["geography_name", "geography_type", "calendar_year"])
        return out.select("geography_name", "geography_type", "calendar_year", "numerator_value", "denominator_value", _share(F.col("numerator_value"), F.col("denominator_value"), 2, 100).alias("share_percent")).orderBy("geography_name", "calendar_year").limit(plan.clamped())
    if plan.shape == "compare_to_average":
        cells = _cell(base, *place)
        mean = cells.groupBy("calendar_year").agg(F.avg(F.col("value").cast("decimal(28,2)")).cast("double").alias("average_value"))
        out = cells.filter(named(F.col("geography_name"), plan.geographies)) if plan.geographies else cells.limit(0)
        out = out.join(mean, "calendar_year")
        return out.select("geography_name", "calendar_year", "value", F.round("average_value", 2).alias("average_value"), F.round(F.col("value") - F.col("average_value"), 2).alias("difference_from_average"), _share(F.col("value"), F.col("average_value"), 4).alias("ratio_to_average")).orderBy("geography_name", "calendar_year").limit(plan.clamped())
    if plan.shape == "multi_metric_rank":
        one = _cell(with_categories(_base(plan, fact, [plan.measure], False), bridge, plan.filters), *place)
        two = _cell(_base(plan, fact, [plan.second_measure], False), *place)
        out = one.select("geography_name", "calendar_year", F.col("value").alias("primary_value")).join(two.select("geography_name", "calendar_year", F.col("value").alias("secondary_value")), ["geography_name", "calendar_year"])
        year = Window.partitionBy("calendar_year")
        out = out.withColumn("primary_rank", F.rank().over(year.orderBy(F.desc_nulls_last("primary_value"))).cast("long")).withColumn("secondary_rank", F.rank().over(year.orderBy(F.asc_nulls_last("secondary_value"))).cast("long"))
        return out.withColumn("combined_rank_score", F.col("primary_rank") + F.col("secondary_rank")).orderBy("combined_rank_score", "primary_rank", "calendar_year", "geography_name").limit(plan.clamped())
    if plan.shape == "change_rank":
        at = lambda y: F.max(F.when(F.col("calendar_year") == y, F.col("value") * F.col("scale_factor"))).cast("double")
        ends = with_categories(_base(plan, fact, [plan.measure], False), bridge, plan.filters).filter(F.col("calendar_year").isin(plan.year_from, plan.year_to))
        out = ends.groupBy("geography_name", "geography_type").agg(at(plan.year_from).alias("start_value"), at(plan.year_to).alias("end_value")).filter("start_value is not null and end_value is not null")
        change = F.col("end_value") - F.col("start_value")
        return out.select("geography_name", "geography_type", F.lit(plan.year_from).cast("long").alias("start_year"), F.lit(plan.year_to).cast("long").alias("end_year"), "start_value", "end_value", F.round(change, 2).alias("absolute_change"), _share(change, F.col("start_value"), 2, 100).alias("percentage_change")).orderBy(F.desc_nulls_last("absolute_change"), "geography_name").limit(plan.clamped())
    raise PlanError(plan.shape)
