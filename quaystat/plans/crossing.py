"""Marts as records, comparison of metrics across them, and the aggregation sandbox over facts with a category map."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaystat.functions import rules
from quaystat.plans.categories import Filters, has_all, holds, total_members
from quaystat.plans.plan import PlanError, named

GRAIN = ("geography_name", "geography_code", "geography_type", "calendar_year")
AGGREGATES = {"count": lambda v: F.count("*"), "sum": F.sum, "avg": F.avg, "average": F.avg, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Mart:
    """A source of facts: its name on the list of sources, its domain, its facts.

    facts: measure_code, dataset_code, geography_name, geography_code, geography_type, calendar_year, value, is_missing, scale_factor,
    unit_code, and categories if filters are to hold on it.
    """

    name: str
    domain_id: str
    facts: DataFrame


@dataclass(frozen=True)
class Component:
    """A metric of a comparison: a measure of a mart, maybe of one dataset or under category filters."""

    metric_code: str
    source: str
    measure_code: str
    label: str
    dataset_code: str | None = None
    filters: Filters = field(default_factory=dict)


def complete_rows(marts: list[Mart], components: list[Component], year: int | None = None, years: tuple[int, int] | None = None, geography_type: str | None = None, names: tuple[str, ...] = ()) -> DataFrame:
    """(grain, metrics, metric_count, x, y): geographies and periods that have a value of every component.

    Each mart is looked at once, whatever the number of its components, and gives one row a component and cell to the shuffle. Components of
    unknown sources have no values, so that nothing is complete. x and y are the values of the first two components.
    """
    if len(components) < 2:
        raise PlanError("a comparison needs two components at least")
    parts = []
    for m in marts:
        own = [(k, c) for k, c in enumerate(components) if c.source == m.name]
        if not own:
            continue
        base = m.facts.filter(F.col("value").isNotNull() & ~F.col("is_missing") & F.col("measure_code").isin(*{c.measure_code for _, c in own}))
        if geography_type:
            base = base.filter(F.col("geography_type") == geography_type)
        if year is not None:
            base = base.filter(F.col("calendar_year") == year)
        if years:
            base = base.filter(F.col("calendar_year").between(*years))
        if names:
            base = base.filter(named(F.col("geography_name"), names))
        tests = []
        for k, c in own:
            test = F.col("measure_code") == c.measure_code
            if c.dataset_code:
                source = F.col("source_dataset_id") if "source_dataset_id" in base.columns else F.lit(None)
                test = test & ((F.col("dataset_code") == c.dataset_code) | F.coalesce(source == c.dataset_code, F.lit(False)))
            if c.filters:
                test = test & holds(c.filters)
            tests.append(F.when(test, F.lit(k)))
        base = base.withColumn("component", F.explode(F.array_compact(F.array(*tests))))
        scaled = F.col("value") * F.coalesce("scale_factor", F.lit(1))
        parts.append(base.groupBy(*GRAIN, "component").agg(F.max(scaled).cast("decimal(28,2)").alias("value"), F.max("value").cast("decimal(28,2)").alias("raw_value"), F.max("unit_code").alias("unit_code")))
    if not parts:
        raise PlanError("no component has a known source")
    every = reduce(DataFrame.unionByName, parts)
    domain = {m.name: m.domain_id for m in marts}
    text = lambda get: F.element_at(F.create_map(*(F.lit(x) for k, c in enumerate(components) for x in (k, get(c)))).cast("map<int,string>"), F.col("component"))
    code = text(lambda c: c.metric_code)
    metric = F.struct(text(lambda c: c.label).alias("label"), text(lambda c: domain.get(c.source)).alias("domain_id"), text(lambda c: c.source).alias("source"), text(lambda c: c.dataset_code).alias("dataset_code"), "value", "raw_value", "unit_code")
    at = lambda k: F.max(F.when(F.col("component") == k, F.col("value"))).cast("double")
    entries = F.sort_array(F.collect_list(F.struct(code.alias("metric_code"), metric.alias("m"))))
    out = every.groupBy(*GRAIN).agg(F.to_json(F.map_from_entries(entries)).alias("metrics"), F.count("*").alias("metric_count"), at(0).alias("x"), at(1).alias("y"))
    return out.filter(F.col("metric_count") == len(components))


def compare(rows: DataFrame, limit: int | None = None) -> DataFrame:
    """The newest complete rows, 10 by default and 50 at most."""
    return rows.drop("x", "y").orderBy(F.desc_nulls_last("calendar_year"), "geography_name", "geography_code").limit(max(1, min(10 if limit is None else limit, 50)))


def association(rows: DataFrame, components: list[Component]) -> DataFrame:
    """The record of the relationship between the first two components, over all complete rows."""
    out = rows.agg(
        F.count("*").alias("observation_count"), F.countDistinct("geography_code").alias("geography_count"), F.min("calendar_year").alias("year_min"), F.max("calendar_year").alias("year_max"),
        F.corr("x", "y").alias("r"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"),
    )
    out = out.withColumn("pearson_correlation", F.when(F.expr("observation_count >= 3 and sx > 0 and sy > 0"), F.round("r", 4))).drop("r", "sx", "sy")
    direction, strength = rules.relationship(F.col("pearson_correlation"), F.col("observation_count"))
    a, b = components[:2]
    return out.select(
        "*", F.lit(a.metric_code).alias("primary_metric_code"), F.lit(b.metric_code).alias("secondary_metric_code"), F.lit(a.label).alias("primary_label"), F.lit(b.label).alias("secondary_label"),
        direction.alias("relationship_direction"), strength.alias("relationship_strength"), F.lit("not_established").alias("causality_status"),
    )


def sandbox(
    facts: DataFrame, dims: DataFrame, how: str, dataset: str, measure: str | None = None, year: int | None = None, period: str | None = None, geography_type: str | None = None,
    filters: Filters | None = None, group: str | None = None, limit: int | None = None,
) -> DataFrame:
    """A chosen aggregate over published cells, which have any number of dimensions in their category map.

    The steps in their order: dataset (in three cases), measure, values, year, period and level; then, of a year without a period, only annual
    cells if there are any among those; then the category filters, by code or name; then, for every dimension of dims that is neither
    filtered nor grouped, only cells of its best total. A group dimension gives a row for each of a cell's members, and one without.
    """
    if how not in AGGREGATES:
        raise PlanError(f"unknown aggregate {how}")
    filters = filters or {}
    level = rules.geography_type(F.col("geography_code"), F.col("geography_type"))
    base = facts.filter(F.col("dataset_code").isin(dataset, dataset.upper(), dataset.lower()) & F.col("value").isNotNull() & ~F.col("is_missing"))
    if measure:
        base = base.filter(F.col("measure_code") == measure)
    if geography_type and geography_type != "all":
        base = base.filter(level == geography_type)
    if period:
        base = base.filter(F.col("period_code") == period)
    if year is not None:
        base = base.filter(F.col("calendar_year") == year)
        if not period:
            annual = F.coalesce(F.nullif("period_type", F.lit("")), F.lit("year")) == "year"
            there = base.agg(F.coalesce(F.bool_or(annual), F.lit(False))).scalar()
            base = base.filter(annual | ~there)
    totals = total_members(dims, dataset, (*filters, *([group] if group else []))).agg(F.collect_list(F.struct("dimension_code", "category_code", "category_name"))).scalar()
    base = base.filter(holds(filters)).withColumn("totals__", totals).filter(has_all(F.col("totals__"))).drop("totals__")
    if group:
        base = base.withColumn("g", F.explode_outer(F.filter("categories", lambda c: F.lower(c["dimension_code"]) == group.lower())))
    value = F.col("g.category_name") if group else F.lit(None).cast("string")
    out = base.groupBy("calendar_year", level.alias("geography_type"), "geography_code", "geography_name", value.alias("group_value")).agg(F.count("*").alias("row_count"), F.round(AGGREGATES[how](F.col("value")).cast("double"), 2).alias("aggregate_value"))
    return out.orderBy(F.desc_nulls_last("aggregate_value"), "geography_code", "calendar_year", "group_value").limit(max(1, min(25 if limit is None else limit, 100)))
