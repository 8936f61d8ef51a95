"""Lookups, the aggregation sandbox, cross-domain analysis and a second mart, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaystat.functions import rules
from quaystat.plans.plan import Plan, PlanError, _cell, compile_plan, named, validate, with_categories
from quaystat.plans.queries import MEASURES, _plan, _with
from quaystat.sources import mart
from quaystat.sources.mart import read

#: Measures of the first mart: code, name, unit, dataset, enabled.
CATALOGUE = (
    ("TOTAL_PRICE", "Total price", "euro", "ORDERS", True),
    ("QUANTITY", "Aantal stuks", "aantal", "LINEITEM", True),
    ("EXTENDED_PRICE", "Extended price", "1 000 euro", "LINEITEM", True),
    ("DISCOUNT_INDEX", "Discount index", "2021=100", "LINEITEM", False),
)
UNIT_NAMES = (("EUR", "Euro"), ("COUNT", "Number"), ("EUR_THOUSANDS", "Thousand euro"))
AGGREGATES = {"count": lambda v: F.count("*"), "sum": F.sum, "avg": F.avg, "average": F.avg, "min": F.min, "max": F.max}


def measure_dimension(spark: SparkSession) -> DataFrame:
    """One row for each measure with its key, unit, scale, aggregation and type."""
    m = spark.createDataFrame(CATALOGUE, "measure_code string, measure_name string, unit string, dataset_code string, is_enabled boolean")
    units = spark.createDataFrame(UNIT_NAMES, "unit_code string, unit_name string")
    code = rules.unit_code(F.col("unit"), F.col("measure_name"))
    m = m.withColumn("unit_code", code).withColumn("measure_key", rules.stable_key(F.lit("measure"), F.col("dataset_code"), F.col("measure_code")))
    how, kind = rules.default_aggregation(F.col("unit_code"), F.col("measure_name")), rules.value_type(F.col("unit_code"))
    m = m.select("*", rules.scale_factor(F.col("unit_code")).cast("long").alias("scale_factor"), how.alias("default_aggregation"), kind.alias("value_type"))
    return m.join(F.broadcast(units), "unit_code", "left")


def lookup_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of the enabled measures of a dataset that has facts of them, keys as text."""
    m = measure_dimension(spark).filter("is_enabled and dataset_code = 'LINEITEM'")
    have = mart.populated(mart.observations(spark, sf_dir, ("QUANTITY", "EXTENDED_PRICE"))).select("dataset_code", "measure_code").distinct()
    m = m.join(have, ["dataset_code", "measure_code"], "left_semi")
    return m.select(F.col("measure_key").cast("string").alias("measure_key"), "measure_code", "measure_name", "unit_code", "unit_name", "scale_factor", "default_aggregation", "value_type", "dataset_code")


def category_breakdown_qualified(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = Plan("category_breakdown", "TOTAL_PRICE", year=1998, dimension="Priority", qualifier=("Status", "O"), limit=50)
    validate(plan, MEASURES)
    return compile_plan(plan, mart.observations(spark, sf_dir, ("TOTAL_PRICE",)), mart.bridge(spark, sf_dir))


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published cells: sums by geography, period and priority, with a total member and, until 1998, annual rows."""
    fact = mart.populated(mart.observations(spark, sf_dir, ("TOTAL_PRICE",)))
    b = mart.bridge(spark, sf_dir).filter("dimension_code = 'Priority'")
    cell = fact.join(b, "observation_key").groupBy("geography_code", "geography_name", "geography_type", "calendar_year", "quarter", "category_name").agg(F.sum("value").alias("value"))
    member = F.explode(F.array(F.struct("category_name", F.lit("C").alias("kind")), F.struct(F.lit("Totaal").alias("category_name"), F.lit("T").alias("kind")), F.struct(F.lit("Priority totaal").alias("category_name"), F.lit("S").alias("kind"))))
    code = F.concat(F.col("calendar_year").cast("string"), F.lit("KW0"), F.col("quarter").cast("string"))
    year = F.concat(F.col("calendar_year").cast("string"), F.lit("JJ00"))
    periods = F.array_compact(F.array(F.struct(F.lit("quarter").alias("period_type"), code.alias("period_code")), F.when(F.col("calendar_year") <= 1998, F.struct(F.lit("year").alias("period_type"), year.alias("period_code")))))
    wide = cell.select("geography_code", "geography_name", "geography_type", "calendar_year", "value", member.alias("m"), F.explode(periods).alias("p"))
    out = wide.groupBy("geography_code", "geography_name", "geography_type", "calendar_year", "p.period_type", "p.period_code", "m.category_name", "m.kind").agg(F.sum("value").cast("decimal(24,2)").alias("value"))
    kind = F.concat(F.col("kind"), F.dense_rank().over(Window.partitionBy("geography_code", "period_code").orderBy("kind")).cast("string"))
    return out.select("*", kind.alias("category_code"), (F.col("kind") != "C").alias("is_total"), F.lit("CUBE").alias("dataset_code"), F.lit("Priority").alias("dimension_code"))


def sandbox_aggregate(cells: DataFrame, how: str, dataset: str, year: int | None = None, period: str | None = None, filters: dict[str, tuple[str, ...]] | None = None, group: str | None = None, geography_type: str | None = None, limit: int | None = None) -> DataFrame:
    """A chosen aggregate over published cells, one row for each cell and its category.

    The dataset is matched in three cases. A filter's values are codes or names. Of dimensions that are neither filtered
    nor grouped the best total stands for all members. Of a year without a period only annual rows count, if there are any.
    """
    if how not in AGGREGATES:
        raise PlanError(f"unknown aggregate {how}")
    filters = {d.lower(): v for d, v in (filters or {}).items()}
    base = cells.filter(F.col("dataset_code").isin(dataset, dataset.upper(), dataset.lower()) & F.col("value").isNotNull())
    dims = F.lower("dimension_code")
    name = F.lower("category_name")
    rank = F.row_number().over(Window.partitionBy(dims).orderBy(F.when(F.upper("category_code").startswith("T"), 0).otherwise(1), F.when(name.isin("totaal", "total"), 0).when(name.endswith(" totaal") | name.endswith(" total"), 1).otherwise(2), F.length("category_name"), "category_name"))
    free = ~dims.isin(*filters, *([group.lower()] if group else []), "")
    totals = base.filter(F.col("is_total") & free).select("dimension_code", "category_code", "category_name").distinct().withColumn("rn", rank).filter("rn = 1")
    totals = totals.select(dims.alias("total_dimension"), F.col("category_name").alias("total_name"))
    for d, values in filters.items():
        base = base.filter((dims != d) | F.trim("category_code").isin(*values) | F.col("category_name").isin(*values))
    if geography_type:
        base = base.filter(rules.geography_type(F.col("geography_code"), F.col("geography_type")) == geography_type)
    if period:
        base = base.filter(F.col("period_code") == period)
    if year is not None:
        base = base.filter(F.col("calendar_year") == year)
        if not period:
            annual = base.agg(F.coalesce(F.bool_or(F.col("period_type") == "year"), F.lit(False)).alias("annual"))
            base = base.crossJoin(F.broadcast(annual)).filter("not annual or period_type = 'year'").drop("annual")
    base = base.join(F.broadcast(totals), dims == F.col("total_dimension"), "left").filter("total_name is null or category_name = total_name")
    value = F.when(dims == group.lower(), F.col("category_name")) if group else F.lit(None).cast("string")
    out = base.groupBy("calendar_year", "geography_type", "geography_code", "geography_name", value.alias("group_value")).agg(F.count("*").alias("row_count"), F.round(AGGREGATES[how](F.col("value")).cast("double"), 2).alias("aggregate_value"))
    return out.orderBy(F.desc_nulls_last("aggregate_value"), "geography_code", "calendar_year", "group_value").limit(max(1, min(25 if limit is None else limit, 100)))


def sandbox_annual_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sandbox_aggregate(cube(spark, sf_dir), "avg", "cube", year=1997, geography_type="municipality", limit=100)


def sandbox_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sandbox_aggregate(cube(spark, sf_dir), "sum", "Cube", year=2000, filters={"priority": ("1-URGENT", "5-LOW")}, group="Priority", limit=100)


def _components(spark: SparkSession, sf_dir: str, first: str, second: str) -> DataFrame:
    """Cells with both metrics, as a map of decimals and apart."""
    fact = mart.populated(mart.observations(spark, sf_dir, (first, second)))
    one = fact.groupBy("geography_name", "geography_code", "geography_type", "calendar_year", "measure_code").agg(F.max(F.col("value") * F.col("scale_factor")).cast("decimal(24,2)").alias("value"))
    at = lambda m: F.max(F.when(F.col("measure_code") == m, F.col("value"))).cast("double")
    text = F.collect_list(F.struct("measure_code", F.col("value").cast("string").alias("value")))
    out = one.groupBy("geography_name", "geography_code", "geography_type", "calendar_year").agg(F.to_json(F.map_from_entries(F.sort_array(text))).alias("metrics"), F.count("*").alias("metric_count"), at(first).alias("x"), at(second).alias("y"))
    return out.filter("metric_count = 2")


def cross_domain_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _components(spark, sf_dir, "TOTAL_PRICE", "EXTENDED_PRICE").drop("x", "y")
    return out.orderBy(F.desc_nulls_last("calendar_year"), "geography_name").limit(50)


def cross_domain_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record that goes with the comparison: over all complete rows, not only those shown."""
    one = _components(spark, sf_dir, "TOTAL_PRICE", "EXTENDED_PRICE")
    out = one.agg(F.count("*").alias("observation_count"), F.countDistinct("geography_code").alias("geography_count"), F.min("calendar_year").alias("year_min"), F.max("calendar_year").alias("year_max"), F.corr("x", "y").alias("r"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    out = out.withColumn("pearson_correlation", F.when(F.expr("observation_count >= 3 and sx > 0 and sy > 0"), F.round("r", 4))).drop("r", "sx", "sy")
    direction, strength = rules.relationship(F.col("pearson_correlation"), F.col("observation_count"))
    return out.select("*", F.lit("TOTAL_PRICE").alias("primary_metric_code"), F.lit("EXTENDED_PRICE").alias("secondary_metric_code"), direction.alias("relationship_direction"), strength.alias("relationship_strength"))


def supply_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second mart: order lines at the place of their supplier."""
    n, s = read(spark, sf_dir, "nation"), read(spark, sf_dir, "supplier")
    place = s.join(F.broadcast(n), s.s_nationkey == n.n_nationkey).select("s_suppkey", F.format_string("GM%04d", "n_nationkey").alias("geography_code"), F.col("n_name").alias("geography_name"))
    line = read(spark, sf_dir, "lineitem")
    out = line.join(place, line.l_suppkey == place.s_suppkey)
    key = rules.stable_key(F.lit("supply"), F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("l_shipdate").cast("string"))
    return out.select(
        key.alias("observation_key"), F.lit("SUPPLY").alias("dataset_code"), F.lit("SUPPLY_VALUE").alias("measure_code"), F.lit("Supply value").alias("measure_name"), F.lit("EUR").alias("unit_code"), F.lit(1).alias("scale_factor"), "geography_code", "geography_name", F.lit("municipality").alias("geography_type"),
        F.year("l_shipdate").cast("long").alias("calendar_year"), F.col("l_extendedprice").cast("decimal(18,2)").alias("value"), F.lit(False).alias("is_missing"), "l_returnflag",
    )


def second_mart(fact: DataFrame, shape: str, dataset: str | None = None, geographies: tuple[str, ...] = (), years: tuple[int, int] | None = None, descending: bool = True, limit: int | None = None) -> DataFrame:
    """Comparison, ranking or trend by geography; the dataset counts, names are only asked for, nothing is left out."""
    base = mart.populated(fact)
    if dataset:
        base = base.filter(F.col("dataset_code") == dataset)
    if geographies:
        base = base.filter(named(F.col("geography_name"), geographies))
    if years:
        base = base.filter(F.col("calendar_year").between(*years))
    out = _cell(base, "geography_code", "geography_name", "geography_type", "calendar_year", "measure_name", "dataset_code")
    value = F.desc_nulls_last("value") if descending else F.asc_nulls_last("value")
    order = {"comparison": ["geography_name", "calendar_year"], "ranking": [value, "geography_name", "calendar_year"], "trend": ["calendar_year", "geography_name"]}
    if shape not in order:
        raise PlanError(f"unknown shape {shape}")
    return out.orderBy(*order[shape]).limit(max(1, min(10 if limit is None else limit, 50)))


def second_mart_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return second_mart(supply_observations(spark, sf_dir), "ranking", dataset="SUPPLY", years=(1996, 1997), descending=False, limit=20)


def second_mart_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return second_mart(supply_observations(spark, sf_dir), "trend", geographies=("NATION_0", "NATION_3 (x)"), limit=50)


def second_mart_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Category filters hold on this mart too."""
    fact = supply_observations(spark, sf_dir)
    bridge = fact.select("observation_key", F.lit("ReturnFlag").alias("dimension_code"), F.col("l_returnflag").alias("category_name")).distinct()
    return second_mart(with_categories(fact, bridge, {"returnflag": ("A", "R")}), "comparison", limit=50)


def merged_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked lists as one: of a geography in both the row of higher score stays."""
    one = second_mart(supply_observations(spark, sf_dir), "ranking", years=(1996, 1996), limit=20).select("geography_code", F.lit("supply").alias("source"), F.col("value").alias("score"))
    plan = Plan("ranking", "TOTAL_PRICE", year=1996, limit=20)
    two = compile_plan(plan, mart.observations(spark, sf_dir, ("TOTAL_PRICE",)), mart.bridge(spark, sf_dir)).select("geography_code", F.lit("orders").alias("source"), F.col("value").alias("score"))
    best = Window.partitionBy("geography_code").orderBy(F.desc("score"), "source")
    out = one.unionByName(two).withColumn("rn", F.row_number().over(best)).filter("rn = 1").drop("rn")
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "geography_code")).cast("long"))


_KEY = "('0x' || substr(sha256({0}), 1, 15))::BIGINT"
_CUBE = """, cc AS (SELECT geography_code, geography_name, geography_type, calendar_year, quarter, category_name, sum(value) AS value FROM fact JOIN bridge USING (observation_key) WHERE measure_code = 'TOTAL_PRICE' AND dimension_code = 'Priority' GROUP BY ALL),
cm AS (SELECT * EXCLUDE category_name, category_name, 'C' AS kind FROM cc UNION ALL SELECT * EXCLUDE category_name, 'Totaal', 'T' FROM cc UNION ALL SELECT * EXCLUDE category_name, 'Priority totaal', 'S' FROM cc),
cp AS (SELECT *, 'quarter' AS period_type FROM cm UNION ALL SELECT *, 'year' FROM cm WHERE calendar_year <= 1998),
cube AS (SELECT geography_code, geography_name, geography_type, calendar_year, period_type, CASE WHEN period_type = 'year' THEN 0 ELSE quarter END AS q, category_name, kind, sum(value)::DECIMAL(24,2) AS value FROM cp GROUP BY ALL)
"""
_PLACE = "geography_name, geography_code, geography_type, calendar_year"
_SUPPLY = "s AS (SELECT printf('GM%04d', n_nationkey) AS geography_code, n_name AS geography_name, 'municipality' AS geography_type, year(l_shipdate) AS calendar_year, 'Supply value' AS measure_name, 'SUPPLY' AS dataset_code, l_returnflag, l_extendedprice::DECIMAL(18,2) AS value FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"
_SCELL = "SELECT geography_code, geography_name, geography_type, calendar_year, measure_name, dataset_code, max(value)::DOUBLE AS value, max(value)::DOUBLE AS raw_value, 'EUR' AS unit_code FROM s"
_BOTH = """, one AS (SELECT geography_name, geography_code, geography_type, calendar_year, measure_code, max(value * scale_factor)::DECIMAL(24,2) AS value FROM fact WHERE measure_code IN ('TOTAL_PRICE', 'EXTENDED_PRICE') GROUP BY ALL),
two AS (SELECT geography_name, geography_code, geography_type, calendar_year, max(value) FILTER (measure_code = 'EXTENDED_PRICE') AS y, max(value) FILTER (measure_code = 'TOTAL_PRICE') AS x FROM one GROUP BY ALL HAVING count(*) = 2) """
SQL = {
    "lookup_measure": "SELECT " + _KEY.format("'measure|LINEITEM|' || c") + "::VARCHAR AS measure_key, c AS measure_code, n AS measure_name, CASE WHEN u = 'aantal' THEN 'COUNT' ELSE 'EUR_THOUSANDS' END AS unit_code, CASE WHEN u = 'aantal' THEN 'Number' ELSE 'Thousand euro' END AS unit_name, CASE WHEN u = 'aantal' THEN 1 ELSE 1000 END::BIGINT AS scale_factor, 'sum' AS default_aggregation, CASE WHEN u = 'aantal' THEN 'count' ELSE 'currency' END AS value_type, 'LINEITEM' AS dataset_code FROM (VALUES ('QUANTITY', 'Aantal stuks', 'aantal'), ('EXTENDED_PRICE', 'Extended price', '1 000 euro')) t(c, n, u) WHERE CASE c WHEN 'QUANTITY' THEN EXISTS (SELECT 1 FROM lineitem WHERE l_quantity IS NOT NULL) ELSE EXISTS (SELECT 1 FROM lineitem WHERE l_extendedprice IS NOT NULL) END",
    "category_breakdown_qualified": _plan("SELECT geography_name, calendar_year, dimension_code, category_name, max(value * scale_factor)::DOUBLE AS value, max(value)::DOUBLE AS raw_value, max(unit_code) AS unit_code FROM fact JOIN bridge b USING (observation_key) JOIN orders ON o_orderkey = observation_key WHERE measure_code = 'TOTAL_PRICE' AND calendar_year = 1998 AND dimension_code = 'Priority' AND o_orderstatus = 'O' GROUP BY ALL ORDER BY geography_name, calendar_year, category_name LIMIT 50"),
    "sandbox_annual_total": _with(_CUBE + "SELECT calendar_year, geography_type, geography_code, geography_name, NULL::VARCHAR AS group_value, count(*) AS row_count, round(avg(value)::DOUBLE, 2) AS aggregate_value FROM cube WHERE calendar_year = 1997 AND period_type = 'year' AND category_name = 'Totaal' GROUP BY ALL ORDER BY aggregate_value DESC NULLS LAST, geography_code LIMIT 100"),
    "sandbox_grouped": _with(_CUBE + "SELECT calendar_year, geography_type, geography_code, geography_name, category_name AS group_value, count(*) AS row_count, round(sum(value)::DOUBLE, 2) AS aggregate_value FROM cube WHERE calendar_year = 2000 AND category_name IN ('1-URGENT', '5-LOW') GROUP BY ALL ORDER BY aggregate_value DESC NULLS LAST, geography_code, group_value LIMIT 100"),
    "cross_domain_comparison": _with(_BOTH + "SELECT geography_name, geography_code, geography_type, calendar_year, '{\"EXTENDED_PRICE\":\"' || y::VARCHAR || '\",\"TOTAL_PRICE\":\"' || x::VARCHAR || '\"}' AS metrics, 2::BIGINT AS metric_count FROM two ORDER BY calendar_year DESC NULLS LAST, geography_name LIMIT 50"),
    "cross_domain_correlation": _with(
        _BOTH + ", r AS (SELECT count(*) AS observation_count, count(DISTINCT geography_code) AS geography_count, min(calendar_year) AS year_min, max(calendar_year) AS year_max, CASE WHEN count(*) >= 3 AND stddev_pop(x::DOUBLE) > 0 AND stddev_pop(y::DOUBLE) > 0 THEN round(corr(x::DOUBLE, y::DOUBLE), 4) END AS pearson_correlation FROM two) "
        "SELECT *, 'TOTAL_PRICE' AS primary_metric_code, 'EXTENDED_PRICE' AS secondary_metric_code, CASE WHEN pearson_correlation IS NULL THEN 'insufficient_data' WHEN pearson_correlation > 0 THEN 'positive' WHEN pearson_correlation < 0 THEN 'negative' ELSE 'none' END AS relationship_direction, "
        "CASE WHEN pearson_correlation IS NULL OR observation_count < 5 THEN 'insufficient_data' WHEN abs(pearson_correlation) >= 0.7 THEN 'strong' WHEN abs(pearson_correlation) >= 0.4 THEN 'moderate' WHEN abs(pearson_correlation) >= 0.2 THEN 'weak' ELSE 'very_weak' END AS relationship_strength FROM r"
    ),
    "second_mart_ranking": f"WITH {_SUPPLY} {_SCELL} WHERE calendar_year BETWEEN 1996 AND 1997 GROUP BY ALL ORDER BY value ASC NULLS LAST, geography_name, calendar_year LIMIT 20",
    "second_mart_trend": f"WITH {_SUPPLY} {_SCELL} WHERE lower(geography_name) IN ('nation_0', 'nation_3') GROUP BY ALL ORDER BY calendar_year, geography_name LIMIT 50",
    "second_mart_filtered": f"WITH {_SUPPLY} {_SCELL} WHERE l_returnflag IN ('A', 'R') GROUP BY ALL ORDER BY geography_name, calendar_year LIMIT 50",
    "merged_results": _plan(f", {_SUPPLY}, a AS (SELECT geography_code, 'supply' AS source, max(value)::DOUBLE AS score FROM s WHERE calendar_year = 1996 GROUP BY 1 ORDER BY score DESC, max(geography_name) LIMIT 20), b AS (SELECT geography_code, 'orders' AS source, max(value)::DOUBLE AS score FROM fact WHERE measure_code = 'TOTAL_PRICE' AND calendar_year = 1996 GROUP BY 1 ORDER BY score DESC, geography_code LIMIT 20), u AS (SELECT * FROM (SELECT * FROM a UNION ALL SELECT * FROM b) QUALIFY row_number() OVER (PARTITION BY geography_code ORDER BY score DESC, source) = 1) SELECT *, row_number() OVER (ORDER BY score DESC, geography_code) AS place FROM u"),
}
QUERIES = {n: globals()[n] for n in SQL}
