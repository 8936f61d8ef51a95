"""Plan shapes as registered queries, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaystat.functions.rules import relationship, relationship_profile
from quaystat.plans.plan import Plan, compile_plan, validate
from quaystat.sources import mart

MEASURES = {"TOTAL_PRICE", "QUANTITY", "EXTENDED_PRICE"}

PLANS: dict[str, Plan] = {
    "rank_geographies": Plan("ranking", "TOTAL_PRICE", year=1996),
    "rank_geographies_filtered": Plan("ranking", "EXTENDED_PRICE", year=1997, excluded=("NATION_1", "NATION_2 (old)"), having=("gt", 1000.0), descending=False, limit=20),
    "rank_geographies_by_category": Plan("ranking", "TOTAL_PRICE", filters={"Priority": ("1-URGENT", "2-HIGH"), "status": ("O",)}, limit=50),
    "compare_geographies": Plan("comparison", "TOTAL_PRICE", geographies=("Nation_3", "NATION_4"), filters={"Segment": ("BUILDING",)}, limit=50),
    "trend_measure": Plan("trend", "TOTAL_PRICE", limit=50),
    "trend_by_geography": Plan("trend_by_geography", "QUANTITY", geographies=("NATION_5", "NATION_6"), limit=50),
    "category_breakdown": Plan("category_breakdown", "TOTAL_PRICE", year=1998, dimension="Priority", limit=50),
    "metric_comparison": Plan("metric_comparison", "QUANTITY", "EXTENDED_PRICE", year=1996, limit=50),
    "share_of_total": Plan("share_of_total", "TOTAL_PRICE", "EXTENDED_PRICE", year=1997, limit=50),
    "compare_to_average": Plan("compare_to_average", "TOTAL_PRICE", geographies=("NATION_7", "NATION_8"), year=1996),
    "multi_metric_rank": Plan("multi_metric_rank", "TOTAL_PRICE", "QUANTITY", year=1996, limit=50),
    "change_rank": Plan("change_rank", "TOTAL_PRICE", year_from=1996, year_to=1999, limit=50),
}


def run(name: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        plan = PLANS[name]
        validate(plan, MEASURES)
        wanted = tuple(m for m in (plan.measure, plan.second_measure) if m)
        return compile_plan(plan, mart.observations(spark, sf_dir, wanted), mart.bridge(spark, sf_dir))

    return query


_CELL = "max(value * scale_factor)::DOUBLE AS value, max(value)::DOUBLE AS raw_value, max(unit_code) AS unit_code"
_PLACE = "geography_name, geography_code, geography_type, calendar_year"


def _with(body: str) -> str:
    return f"WITH {mart.SQL}{body}"


def _plan(body: str) -> str:
    """Plans leave out the geography of code GM0000."""
    return _with(body).replace("WHERE value IS NOT NULL)", "WHERE value IS NOT NULL AND geography_code <> 'GM0000')", 1)


_AVERAGE = ", c AS (SELECT {p}, max(value * scale_factor)::DOUBLE AS value FROM fact WHERE measure_code = '{m}' AND {w} GROUP BY {p})"
SQL: dict[str, str] = {
    "rank_geographies": _plan(f"SELECT {_PLACE}, {_CELL} FROM fact WHERE measure_code = 'TOTAL_PRICE' AND calendar_year = 1996 GROUP BY {_PLACE} ORDER BY value DESC NULLS LAST, geography_code, calendar_year LIMIT 10"),
    "rank_geographies_filtered": _plan(f"SELECT {_PLACE}, {_CELL} FROM fact WHERE measure_code = 'EXTENDED_PRICE' AND calendar_year = 1997 AND lower(geography_name) NOT IN ('nation_1', 'nation_2 (old)') AND regexp_replace(lower(geography_name), '\\s*\\([^)]*\\)\\s*$', '') NOT IN ('nation_1', 'nation_2') GROUP BY {_PLACE} HAVING max(value * scale_factor) > 1000 ORDER BY value ASC NULLS LAST, geography_code, calendar_year LIMIT 20"),
    "rank_geographies_by_category": _plan(f"SELECT {_PLACE}, {_CELL} FROM fact f WHERE measure_code = 'TOTAL_PRICE' AND EXISTS (SELECT 1 FROM bridge b WHERE b.observation_key = f.observation_key AND dimension_code = 'Priority' AND category_name IN ('1-URGENT', '2-HIGH')) AND EXISTS (SELECT 1 FROM bridge b WHERE b.observation_key = f.observation_key AND dimension_code = 'Status' AND category_name = 'O') GROUP BY {_PLACE} ORDER BY value DESC NULLS LAST, geography_code, calendar_year LIMIT 50"),
    "compare_geographies": _plan(f"SELECT {_PLACE}, {_CELL} FROM fact f WHERE measure_code = 'TOTAL_PRICE' AND lower(geography_name) IN ('nation_3', 'nation_4') AND EXISTS (SELECT 1 FROM bridge b WHERE b.observation_key = f.observation_key AND dimension_code = 'Segment' AND category_name = 'BUILDING') GROUP BY {_PLACE} ORDER BY geography_name, calendar_year LIMIT 50"),
    "trend_measure": _plan(f"SELECT calendar_year, {_CELL} FROM fact WHERE measure_code = 'TOTAL_PRICE' GROUP BY calendar_year ORDER BY calendar_year LIMIT 50"),
    "trend_by_geography": _plan(f"SELECT {_PLACE}, {_CELL} FROM fact WHERE measure_code = 'QUANTITY' AND lower(geography_name) IN ('nation_5', 'nation_6') GROUP BY {_PLACE} ORDER BY {_PLACE} LIMIT 50"),
    "category_breakdown": _plan(f"SELECT geography_name, calendar_year, dimension_code, category_name, {_CELL} FROM fact JOIN bridge USING (observation_key) WHERE measure_code = 'TOTAL_PRICE' AND calendar_year = 1998 AND dimension_code = 'Priority' GROUP BY ALL ORDER BY geography_name, calendar_year, category_name LIMIT 50"),
    "metric_comparison": _plan(f"SELECT measure_code, {_PLACE}, {_CELL} FROM fact WHERE measure_code IN ('QUANTITY', 'EXTENDED_PRICE') AND calendar_year = 1996 GROUP BY ALL ORDER BY geography_name, calendar_year, measure_code LIMIT 50"),
    "share_of_total": _plan(
        f", n AS (SELECT {_PLACE}, max(value * scale_factor)::DOUBLE AS numerator_value FROM fact WHERE measure_code = 'TOTAL_PRICE' AND calendar_year = 1997 GROUP BY {_PLACE}), d AS (SELECT geography_name, geography_type, calendar_year, max(value * scale_factor)::DOUBLE AS denominator_value FROM fact WHERE measure_code = 'EXTENDED_PRICE' AND calendar_year = 1997 GROUP BY ALL) "
        "SELECT geography_name, geography_type, calendar_year, numerator_value, denominator_value, round(numerator_value / nullif(denominator_value, 0) * 100, 2) AS share_percent FROM n JOIN d USING (geography_name, geography_type, calendar_year) ORDER BY geography_name, calendar_year LIMIT 50"
    ),
    "compare_to_average": _plan(
        _AVERAGE.format(p=_PLACE, m="TOTAL_PRICE", w="calendar_year = 1996") + ", a AS (SELECT calendar_year, avg(value) AS m FROM c GROUP BY calendar_year) "
        "SELECT geography_name, calendar_year, value, round(m, 2) AS average_value, round(value - m, 2) AS difference_from_average, round(value / nullif(m, 0), 4) AS ratio_to_average FROM c JOIN a USING (calendar_year) WHERE lower(geography_name) IN ('nation_7', 'nation_8')"
    ),
    "multi_metric_rank": _plan(
        ", p AS (SELECT geography_name, calendar_year, max(value * scale_factor)::DOUBLE AS primary_value FROM fact WHERE measure_code = 'TOTAL_PRICE' AND calendar_year = 1996 GROUP BY ALL), s AS (SELECT geography_name, calendar_year, max(value * scale_factor)::DOUBLE AS secondary_value FROM fact WHERE measure_code = 'QUANTITY' AND calendar_year = 1996 GROUP BY ALL), "
        "r AS (SELECT *, rank() OVER (PARTITION BY calendar_year ORDER BY primary_value DESC NULLS LAST) AS primary_rank, rank() OVER (PARTITION BY calendar_year ORDER BY secondary_value ASC NULLS LAST) AS secondary_rank FROM p JOIN s USING (geography_name, calendar_year)) "
        "SELECT *, primary_rank + secondary_rank AS combined_rank_score FROM r ORDER BY combined_rank_score, primary_rank, calendar_year, geography_name LIMIT 50"
    ),
    "change_rank": _plan(
        ", c AS (SELECT geography_name, geography_type, max(value * scale_factor) FILTER (calendar_year = 1996)::DOUBLE AS start_value, max(value * scale_factor) FILTER (calendar_year = 1999)::DOUBLE AS end_value FROM fact WHERE measure_code = 'TOTAL_PRICE' GROUP BY ALL) "
        "SELECT geography_name, geography_type, 1996::BIGINT AS start_year, 1999::BIGINT AS end_year, start_value, end_value, round(end_value - start_value, 2) AS absolute_change, round((end_value - start_value) / nullif(start_value, 0) * 100, 2) AS percentage_change FROM c WHERE start_value IS NOT NULL AND end_value IS NOT NULL ORDER BY absolute_change DESC NULLS LAST, geography_name LIMIT 50"
    ),
}


def cross_domain_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that have every one of the chosen measures: union, grouping, completeness, pivot."""
    wanted = ("TOTAL_PRICE", "QUANTITY")
    got = mart.populated(mart.observations(spark, sf_dir, wanted)).groupBy("geography_code", "calendar_year")
    top = lambda m: F.max(F.when(F.col("measure_code") == m, F.col("value") * F.col("scale_factor"))).cast("double")
    return got.agg(F.countDistinct("measure_code").alias("metric_count"), top("TOTAL_PRICE").alias("first_value"), top("QUANTITY").alias("second_value")).filter(F.col("metric_count") == len(wanted))


def measure_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(measure_code, other_measure, calendar_year, x, y) of each geography and year that has both: one pass over the facts.

    The means of a cell lie in one row, so that pairs are made inside it: no self-join.
    """
    fact = mart.populated(mart.observations(spark, sf_dir))
    mean = lambda m: F.round((F.sum(F.when(F.col("measure_code") == m, F.col("value") * F.col("scale_factor"))) / F.count_if(F.col("measure_code") == m)).cast("double"), 4)
    cell = fact.groupBy("geography_code", "calendar_year").agg(*(mean(m).alias(m) for m in mart.MEASURES))
    names = sorted(mart.MEASURES)
    pairs = [F.struct(F.lit(a).alias("measure_code"), F.lit(b).alias("other_measure"), F.col(a).alias("x"), F.col(b).alias("y")) for k, a in enumerate(names) for b in names[k + 1 :]]
    return cell.select("geography_code", "calendar_year", F.explode(F.array(*pairs)).alias("p")).select("geography_code", "calendar_year", "p.*").filter("x is not null and y is not null")


def _pearson(pair: DataFrame, *by: str) -> DataFrame:
    out = pair.groupBy(*by).agg(F.count("*").alias("pairs"), F.corr("x", "y").alias("r"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    r = F.when((F.col("pairs") >= 3) & (F.col("sx") > 0) & (F.col("sy") > 0), F.round("r", 4))
    return out.select(*by, "pairs", r.alias("pearson"))


def relationship_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pearson per pair of measures and year, as a query reports it."""
    out = _pearson(measure_pairs(spark, sf_dir), "measure_code", "other_measure", "calendar_year")
    direction, strength = relationship(F.col("pearson"), F.col("pairs"))
    return out.select("*", direction.alias("direction"), strength.alias("strength"))


def stored_profiles(pairs: DataFrame, min_pairs: int = 20, least: float = 0.0) -> DataFrame:
    """Relationships of each two measures and year that are kept: enough pairs, a coefficient of some size, with bands and quality."""
    out = _pearson(pairs, "measure_code", "other_measure", "calendar_year")
    out = out.filter((F.col("pairs") >= min_pairs) & (F.abs(F.coalesce("pearson", F.lit(0.0))) >= least))
    direction, strength, quality = relationship_profile(F.col("pearson"), F.col("pairs"))
    return out.select("*", direction.alias("direction"), strength.alias("strength"), quality.alias("quality_status"))


def relationship_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_profiles(measure_pairs(spark, sf_dir), least=0.1)


def availability_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = mart.observations(spark, sf_dir)
    full = F.col("value").isNotNull()
    return fact.groupBy("dataset_code", "measure_code", "geography_type", "calendar_year").agg(F.count_if(full).alias("populated_count"), F.count("*").alias("row_count"), F.min("value").cast("double").alias("min_value"), F.max("value").cast("double").alias("max_value"))


def availability_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four nested levels of a request in one pass of conditional counts."""
    fact = mart.populated(mart.observations(spark, sf_dir, ("TOTAL_PRICE",)))
    metric = F.col("measure_code") == "TOTAL_PRICE"
    dataset = metric & (F.col("dataset_code") == "ORDERS")
    grain = dataset & (F.col("geography_type") == "municipality")
    period = grain & (F.col("calendar_year") == 1998)
    counts = fact.agg(*(F.count_if(c).alias(f"{n}_count") for n, c in (("metric", metric), ("dataset", dataset), ("grain", grain), ("period", period))), F.array_join(F.sort_array(F.collect_set(F.when(grain, F.col("calendar_year")))), ",").alias("available_years"))
    return counts.select("*", *((F.col(f"{n}_count") > 0).alias(f"{n}_available") for n in ("metric", "dataset", "grain", "period")))


def sandbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen aggregates by year and group dimension over unscaled values."""
    fact = mart.populated(mart.observations(spark, sf_dir, ("TOTAL_PRICE",)))
    groups = mart.bridge(spark, sf_dir).filter("dimension_code = 'Segment'").select("observation_key", F.col("category_name").alias("group_value"))
    out = fact.join(groups, "observation_key", "left").groupBy("calendar_year", "group_value")
    return out.agg(F.count("*").alias("row_count"), F.sum("value").cast("double").alias("sum_value"), F.round(F.avg("value").cast("double"), 4).alias("avg_value"), F.min("value").cast("double").alias("min_value"), F.max("value").cast("double").alias("max_value"))


def facet_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each category under the filters of the other dimensions, its own filter left out."""
    filters = {"Priority": ["1-URGENT"], "Status": ["O", "F"]}
    b = mart.bridge(spark, sf_dir)
    ok = F.lit(False)
    for d, v in filters.items():
        ok = ok | ((F.col("dimension_code") == d) & F.col("category_name").isin(v))
    met = b.filter(F.col("dimension_code").isin(list(filters))).groupBy("observation_key").agg(F.count_if(ok).alias("met"), F.collect_set(F.when(ok, F.col("dimension_code"))).alias("dims"))
    own = F.col("dimension_code").isin(list(filters))
    need = F.lit(len(filters)) - own.cast("int")
    have = F.col("met") - (own & F.array_contains("dims", F.col("dimension_code"))).cast("int")
    out = b.join(met, "observation_key").filter(have == need).groupBy("dimension_code", "category_name").agg(F.count("*").alias("row_count"))
    return out.select("*", F.row_number().over(Window.partitionBy("dimension_code").orderBy(F.desc("row_count"), "category_name")).cast("long").alias("value_rank"))


def shared_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = mart.populated(mart.observations(spark, sf_dir))
    return fact.groupBy("calendar_year").agg(F.countDistinct("measure_code").alias("n")).filter("n = 3").select("calendar_year")


def year_region_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact sums by year, a column for each quarter, 0 where nothing is."""
    fact = mart.populated(mart.observations(spark, sf_dir, ("TOTAL_PRICE",)))
    out = fact.groupBy("calendar_year", "province_name").pivot("quarter", [1, 2, 3, 4]).agg(F.sum("value").cast("double"))
    return out.select("calendar_year", "province_name", *(F.coalesce(F.col(str(q)), F.lit(0.0)).alias(f"q{q}") for q in (1, 2, 3, 4)))


def growth_since_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = mart.populated(mart.observations(spark, sf_dir, ("TOTAL_PRICE",)))
    per = fact.groupBy("province_name", "calendar_year").agg(F.sum("value").cast("double").alias("total"))
    base = per.groupBy("province_name").agg(F.min_by("total", "calendar_year").alias("base"))
    return per.join(base, "province_name").select("province_name", "calendar_year", "total", F.round((F.col("total") - F.col("base")) / F.col("base") * 100, 2).alias("growth_percent"))


_PEARSON = ", m AS (SELECT geography_code, calendar_year, measure_code, round((sum(value * scale_factor)::DOUBLE / count(*)), 4) AS value FROM fact GROUP BY ALL), c AS (SELECT a.measure_code, b.measure_code AS other_measure, a.calendar_year, count(*) AS pairs, CASE WHEN count(*) >= 3 AND stddev_pop(a.value) > 0 AND stddev_pop(b.value) > 0 THEN round(corr(a.value, b.value), 4) END AS pearson FROM m a JOIN m b ON a.geography_code = b.geography_code AND a.calendar_year = b.calendar_year AND a.measure_code < b.measure_code GROUP BY ALL) "
QUERIES = {name: run(name) for name in PLANS} | {f.__name__: f for f in (cross_domain_rows, relationship_profiles, relationship_candidates, availability_cube, availability_counts, sandbox, facet_counts, shared_years, year_region_pivot, growth_since_base)}
SQL |= {
    "cross_domain_rows": _with("SELECT geography_code, calendar_year, count(DISTINCT measure_code) AS metric_count, max(value * scale_factor) FILTER (measure_code = 'TOTAL_PRICE')::DOUBLE AS first_value, max(value * scale_factor) FILTER (measure_code = 'QUANTITY')::DOUBLE AS second_value FROM fact WHERE measure_code IN ('TOTAL_PRICE', 'QUANTITY') GROUP BY ALL HAVING count(DISTINCT measure_code) = 2"),
    "relationship_profiles": _with(
        _PEARSON + "SELECT *, CASE WHEN pearson IS NULL THEN 'insufficient_data' WHEN pearson > 0 THEN 'positive' WHEN pearson < 0 THEN 'negative' ELSE 'none' END AS direction, CASE WHEN pearson IS NULL OR pairs < 5 THEN 'insufficient_data' WHEN abs(pearson) >= 0.7 THEN 'strong' WHEN abs(pearson) >= 0.4 THEN 'moderate' WHEN abs(pearson) >= 0.2 THEN 'weak' ELSE 'very_weak' END AS strength FROM c"
    ),
    "relationship_candidates": _with(
        _PEARSON + "SELECT *, CASE WHEN pearson IS NULL THEN 'unknown' WHEN abs(pearson) < 0.05 THEN 'none' WHEN pearson > 0 THEN 'positive' ELSE 'negative' END AS direction, CASE WHEN pearson IS NULL THEN 'insufficient_data' WHEN abs(pearson) >= 0.7 THEN 'strong' WHEN abs(pearson) >= 0.4 THEN 'moderate' WHEN abs(pearson) >= 0.2 THEN 'weak' ELSE 'very_weak' END AS strength, "
        "CASE WHEN pairs < 20 OR pearson IS NULL THEN 'insufficient_observations' WHEN abs(pearson) >= 0.7 THEN 'strong_candidate' WHEN abs(pearson) >= 0.4 THEN 'moderate_candidate' ELSE 'profiled' END AS quality_status FROM c WHERE pairs >= 20 AND abs(coalesce(pearson, 0)) >= 0.1"
    ),
    "availability_cube": _with("SELECT dataset_code, measure_code, 'municipality' AS geography_type, calendar_year, count(value) AS populated_count, count(*) AS row_count, min(value)::DOUBLE AS min_value, max(value)::DOUBLE AS max_value FROM obs GROUP BY ALL"),
    "availability_counts": _with("SELECT count(*) AS metric_count, count(*) FILTER (dataset_code = 'ORDERS') AS dataset_count, count(*) FILTER (dataset_code = 'ORDERS') AS grain_count, count(*) FILTER (calendar_year = 1998) AS period_count, (SELECT string_agg(y, ',' ORDER BY y) FROM (SELECT DISTINCT calendar_year AS y FROM fact WHERE measure_code = 'TOTAL_PRICE')) AS available_years, count(*) > 0 AS metric_available, count(*) > 0 AS dataset_available, count(*) > 0 AS grain_available, count(*) FILTER (calendar_year = 1998) > 0 AS period_available FROM fact WHERE measure_code = 'TOTAL_PRICE'"),
    "sandbox": _with("SELECT calendar_year, category_name AS group_value, count(*) AS row_count, sum(value)::DOUBLE AS sum_value, round(avg(value), 4) AS avg_value, min(value)::DOUBLE AS min_value, max(value)::DOUBLE AS max_value FROM fact LEFT JOIN (SELECT * FROM bridge WHERE dimension_code = 'Segment') USING (observation_key) WHERE measure_code = 'TOTAL_PRICE' GROUP BY ALL"),
    "facet_counts": _with(
        ", ok AS (SELECT o_orderkey AS k, o_orderpriority = '1-URGENT' AS p, o_orderstatus IN ('O', 'F') AS s FROM place), c AS (SELECT dimension_code, category_name, count(*) AS row_count FROM bridge JOIN ok ON k = observation_key WHERE CASE dimension_code WHEN 'Priority' THEN s WHEN 'Status' THEN p ELSE p AND s END GROUP BY ALL) SELECT *, row_number() OVER (PARTITION BY dimension_code ORDER BY row_count DESC, category_name) AS value_rank FROM c"
    ),
    "shared_years": _with("SELECT calendar_year FROM fact GROUP BY 1 HAVING count(DISTINCT measure_code) = 3"),
    "year_region_pivot": _with("SELECT calendar_year, province_name, " + ", ".join(f"coalesce(sum(value) FILTER (quarter = {q}), 0)::DOUBLE AS q{q}" for q in (1, 2, 3, 4)) + " FROM fact WHERE measure_code = 'TOTAL_PRICE' GROUP BY ALL"),
    "growth_since_base": _with(", p AS (SELECT province_name, calendar_year, sum(value)::DOUBLE AS total FROM fact WHERE measure_code = 'TOTAL_PRICE' GROUP BY ALL), b AS (SELECT province_name, min_by(total, calendar_year) AS base FROM p GROUP BY ALL) SELECT province_name, calendar_year, total, round((total - base) / base * 100, 2) AS growth_percent FROM p JOIN b USING (province_name)"),
}
