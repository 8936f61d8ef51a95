"""Profiles, contracts and checks over the observation mart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaystat.functions.rules import default_aggregation, is_total
from quaystat.operators.profiles import first_rows
from quaystat.sources import mart
from quaystat.sources.mart import SQL, read


def fact_profile_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rollup that feeds all profiles: one pass over the fact."""
    fact = mart.observations(spark, sf_dir)
    by = ["dataset_code", "measure_code", "unit_code", "geography_type", "calendar_year"]
    return fact.groupBy(*by).agg(F.count("*").alias("fact_rows"), F.count_if(~F.col("is_missing")).alias("populated_rows"), F.count_if("is_missing").alias("missing_rows"), F.min("value").cast("double").alias("min_value"), F.max("value").cast("double").alias("max_value"))


def fact_profile_sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over the first 1000 facts of each dataset by key, found without a sort of all."""
    first = first_rows(mart.observations(spark, sf_dir), "dataset_code", ["observation_key", "measure_code", "value", "calendar_year", "quarter"], 1000)
    return first.groupBy("dataset_code", "measure_code").agg(F.count("*").alias("fact_rows"), F.count_if(~F.col("is_missing")).alias("populated_rows"))


def measure_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    roll = fact_profile_exact(spark, sf_dir)
    out = roll.groupBy("dataset_code", "measure_code", "unit_code").agg(F.sum("populated_rows").alias("populated_rows"), F.sum("missing_rows").alias("missing_rows"), F.countDistinct("calendar_year").alias("year_count"), F.min("calendar_year").alias("first_year"), F.max("calendar_year").alias("last_year"))
    how = default_aggregation(F.col("unit_code"), F.col("measure_code"))
    return out.select("*", how.alias("default_aggregation"), (how != "sum").alias("is_non_additive"), (F.col("populated_rows") > F.col("missing_rows")).alias("is_usable"))


def dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    roll = fact_profile_exact(spark, sf_dir)
    return roll.groupBy("dataset_code").agg(F.array_join(F.sort_array(F.collect_set("measure_code")), ",").alias("measures"), F.array_join(F.sort_array(F.collect_set("calendar_year")), ",").alias("years"), F.bool_or(F.col("geography_type") == "municipality").alias("has_municipality"), F.sum("populated_rows").alias("populated_rows"))


def dimension_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = mart.bridge(spark, sf_dir)
    counts = b.groupBy("dimension_code", "category_name").agg(F.count("*").alias("n"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "category_name"))), lambda x: x["category_name"])
    return counts.groupBy("dimension_code").agg(F.count("*").alias("category_count"), F.sum("n").alias("observations"), F.array_join(ordered, "|").alias("categories"))


def category_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories with a Totaal member of each dimension; totals come first as filters."""
    b = mart.bridge(spark, sf_dir)
    own = b.groupBy("dimension_code", "category_name").agg(F.count("*").alias("observations"))
    total = own.groupBy("dimension_code").agg(F.lit("Totaal").alias("category_name"), F.sum("observations").alias("observations"))
    both = own.unionByName(total)
    t = is_total(F.lit(None).cast("string"), F.col("category_name"))
    return both.select("*", t.alias("is_total"), F.when(t, 100).otherwise(50).cast("long").alias("filter_priority"))


def total_category_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best total member of each dimension: by kind of name, shortest, name."""
    c = category_profile(spark, sf_dir)
    rank = F.when(F.lower("category_name").isin("totaal", "total"), 0).when(F.col("is_total"), 1).otherwise(2)
    w = Window.partitionBy("dimension_code").orderBy(rank, F.length("category_name"), "category_name")
    return c.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("dimension_code", "category_name", "observations")


def grain_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    fact = mart.populated(mart.observations(spark, sf_dir))
    return fact.groupBy("dataset_code", F.concat_ws("_", "geography_type", F.lit("year")).alias("grain")).agg(F.countDistinct("calendar_year").alias("years"), F.countDistinct("geography_code").alias("geographies"), F.count("*").alias("facts"))


def dataset_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default measure by name and rows, default breakdown by number of categories, supported shapes and status.

    All of it from one pass over the facts, rolled up to measures first.
    """
    fact = mart.observations(spark, sf_dir)
    m = fact.groupBy("dataset_code", "measure_code", "unit_code").agg(F.count_if(~F.col("is_missing")).alias("populated"), F.bool_or(F.col("geography_type") == "municipality").alias("has_municipality"))
    name = F.lower("measure_code")
    rank = F.struct((F.col("populated") == 0).alias("empty"), F.when(F.contains(name, F.lit("total")), 0).when(F.contains(name, F.lit("beginstand")), 1).when(F.col("unit_code") == "COUNT", 2).otherwise(10).alias("kind"), (-F.col("populated")).alias("rows"), "measure_code")
    out = m.groupBy("dataset_code").agg(F.min_by("measure_code", rank).alias("default_measure"), F.bool_or("has_municipality").alias("has_municipality"), F.sum("populated").alias("populated"))
    dims = dimension_profile(spark, sf_dir).filter("category_count > 1").withColumn("dataset_code", F.lit("ORDERS"))
    order = F.struct(F.when(F.contains(F.lower("dimension_code"), F.lit("type")), 0).otherwise(10).alias("kind"), (-F.col("category_count")).alias("n"), "dimension_code")
    breakdown = dims.groupBy("dataset_code").agg(F.min_by("dimension_code", order).alias("default_breakdown"))
    out = out.join(F.broadcast(breakdown), "dataset_code", "left")
    shapes = F.array_compact(F.array(F.when(F.col("default_measure").isNotNull(), "lookup_value"), F.when(F.col("has_municipality"), "rank_geographies"), F.when(F.col("has_municipality"), "compare_geographies"), F.when(F.col("default_breakdown").isNotNull(), "category_breakdown")))
    return out.select("dataset_code", "default_measure", "default_breakdown", F.array_join(shapes, ",").alias("shapes"), F.when(F.col("populated") == 0, "metadata_only").when(F.col("default_breakdown").isNotNull(), "complete").otherwise("usable").alias("status"))


def metric_dimension_compatibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measure_profile(spark, sf_dir).select("dataset_code", "measure_code")
    d = dimension_profile(spark, sf_dir).select(F.lit("ORDERS").alias("dataset_code"), "dimension_code", "category_count")
    return m.join(d, "dataset_code")


def measure_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = measure_profile(spark, sf_dir)
    return m.select("measure_code", (F.col("year_count") > 1).alias("supports_trend"), (F.col("populated_rows") > 0).alias("supports_ranking"), F.when(F.col("populated_rows") == 0, "no_populated_facts").when(F.col("missing_rows") > F.col("populated_rows"), "partial_sparse").otherwise("ready").alias("status"))


def category_value_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One contract for each category value: a filter map as sorted text, and grains."""
    c = category_profile(spark, sf_dir).filter("not is_total")
    filters = F.to_json(F.map_from_arrays(F.array("dimension_code"), F.array("category_name")))
    return c.select(F.lower(F.concat_ws("_", F.lit("total_price"), "dimension_code", F.regexp_replace("category_name", "[^A-Za-z0-9]+", "_"))).alias("contract_code"), filters.alias("filters"), F.lit("municipality_year,province_year,country_year").alias("grains"))


def contract_observation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many facts satisfy each of some contracts' filters: one join of the bridge with the small filter list."""
    contracts = [("urgent_open", "Priority", "1-URGENT"), ("urgent_open", "Status", "O"), ("building", "Segment", "BUILDING"), ("open", "Status", "O"), ("nothing", "Status", "?")]
    f = spark.createDataFrame(contracts, "contract string, dimension_code string, category_name string")
    need = f.groupBy("contract").agg(F.count("*").alias("need"))
    hit = mart.bridge(spark, sf_dir).join(F.broadcast(f), ["dimension_code", "category_name"]).groupBy("contract", "observation_key").agg(F.count("*").alias("have"))
    ok = hit.join(F.broadcast(need), "contract").filter("have = need")
    fact = mart.populated(mart.observations(spark, sf_dir, ("TOTAL_PRICE",))).select("observation_key")
    return ok.join(fact, "observation_key").groupBy("contract").agg(F.count("*").alias("facts"))


def review_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What speaks against each measure of the mart, by its profile, and its state in the review."""
    m = measure_profile(spark, sf_dir)
    issues = F.array_compact(
        F.array(
            F.when(F.col("populated_rows") == 0, "no_populated_facts"),
            F.when(F.col("default_aggregation") == "none", "unsafe_aggregation"),
            F.when(F.col("is_non_additive"), "non_additive_metric"),
            F.when(F.col("missing_rows") > 0, "has_missing"),
        )
    )
    return m.select("measure_code", F.array_join(issues, ",").alias("diagnostics"), F.when(F.size(issues) == 0, "review_candidate").otherwise("profiled").alias("state"))


def quality_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze and silver checks of the orders in one aggregate."""
    o = read(spark, sf_dir, "orders")
    a = o.agg(F.count("*").alias("rows"), F.countDistinct("o_orderkey").alias("keys"), F.count_if(F.col("o_totalprice").isNull()).alias("nulls"))
    return a.select("rows", "keys", "nulls", F.when(F.col("rows") == 0, "failed").when((F.col("rows") != F.col("keys")) | (F.col("nulls") > 0), "warning").otherwise("passed").alias("status"))


def dataset_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.collect_set(F.year("o_orderdate")).alias("years"))
    bucket = F.when(F.col("n") < 5, "small").when(F.col("n") < 15, "medium").otherwise("large")
    recent = F.arrays_overlap("years", F.array(F.lit(2000), F.lit(2001)))
    return o.select(bucket.alias("size"), recent.alias("recent")).groupBy("size", "recent").agg(F.count("*").alias("customers"))


def null_safe_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    a, b = F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderstatus"))
    return o.filter(~a.eqNullSafe(b)).agg(F.count("*").alias("different"))


_ROLL = SQL + ", roll AS (SELECT dataset_code, measure_code, unit_code, 'municipality' AS geography_type, calendar_year, count(*) AS fact_rows, count(value) AS populated_rows, count(*) - count(value) AS missing_rows, min(value)::DOUBLE AS min_value, max(value)::DOUBLE AS max_value FROM obs GROUP BY ALL)"
_MEASURE = _ROLL + ", mp AS (SELECT dataset_code, measure_code, unit_code, sum(populated_rows)::BIGINT AS populated_rows, sum(missing_rows)::BIGINT AS missing_rows, count(DISTINCT calendar_year) AS year_count, min(calendar_year) AS first_year, max(calendar_year) AS last_year, 'sum' AS default_aggregation, false AS is_non_additive, sum(populated_rows) > sum(missing_rows) AS is_usable FROM roll GROUP BY ALL)"
_CATEGORY = SQL + ", cp AS (SELECT dimension_code, category_name, count(*) AS observations, false AS is_total, 50::BIGINT AS filter_priority FROM bridge GROUP BY ALL UNION ALL SELECT dimension_code, 'Totaal', count(*), true, 100 FROM bridge GROUP BY ALL)"
ORACLES = {
    "fact_profile_exact": f"WITH {_ROLL} SELECT * FROM roll",
    "fact_profile_sampled": f"WITH {SQL}, s AS (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY dataset_code ORDER BY observation_key, measure_code, value NULLS FIRST, calendar_year, quarter) <= 1000) SELECT dataset_code, measure_code, count(*) AS fact_rows, count(value) AS populated_rows FROM s GROUP BY ALL",
    "measure_profile": f"WITH {_MEASURE} SELECT * FROM mp",
    "dataset_profile": f"WITH {_ROLL} SELECT dataset_code, string_agg(DISTINCT measure_code, ',' ORDER BY measure_code) AS measures, string_agg(DISTINCT calendar_year, ',' ORDER BY calendar_year) AS years, true AS has_municipality, sum(populated_rows)::BIGINT AS populated_rows FROM roll GROUP BY dataset_code",
    "dimension_profile": f"WITH {SQL}, c AS (SELECT dimension_code, category_name, count(*) AS n FROM bridge GROUP BY ALL) SELECT dimension_code, count(*) AS category_count, sum(n)::BIGINT AS observations, string_agg(category_name, '|' ORDER BY n DESC, category_name) AS categories FROM c GROUP BY ALL",
    "category_profile": f"WITH {_CATEGORY} SELECT * FROM cp",
    "total_category_collapse": f"WITH {_CATEGORY} SELECT dimension_code, category_name, observations FROM cp QUALIFY row_number() OVER (PARTITION BY dimension_code ORDER BY CASE WHEN lower(category_name) IN ('totaal', 'total') THEN 0 WHEN contains(lower(category_name), 'total') OR contains(lower(category_name), 'totaal') THEN 1 ELSE 2 END, length(category_name), category_name) = 1",
    "grain_profile": f"WITH {SQL} SELECT dataset_code, 'municipality_year' AS grain, count(DISTINCT calendar_year) AS years, count(DISTINCT geography_code) AS geographies, count(*) AS facts FROM fact GROUP BY ALL",
    "dataset_contract": f"WITH {SQL}, m AS (SELECT dataset_code, measure_code, unit_code, count(value) AS n FROM obs GROUP BY ALL), b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY dataset_code ORDER BY n = 0, CASE WHEN contains(lower(measure_code), 'total') THEN 0 WHEN contains(lower(measure_code), 'beginstand') THEN 1 WHEN unit_code = 'COUNT' THEN 2 ELSE 10 END, n DESC, measure_code) = 1), d AS (SELECT * FROM (SELECT dimension_code, count(DISTINCT category_name) AS n FROM bridge GROUP BY dimension_code) WHERE n > 1 ORDER BY contains(lower(dimension_code), 'type') DESC, n DESC, dimension_code LIMIT 1), t AS (SELECT dataset_code, sum(n) AS n FROM m GROUP BY ALL) SELECT b.dataset_code, measure_code AS default_measure, CASE WHEN b.dataset_code = 'ORDERS' THEN dimension_code END AS default_breakdown, 'lookup_value,rank_geographies,compare_geographies' || CASE WHEN b.dataset_code = 'ORDERS' THEN ',category_breakdown' ELSE '' END AS shapes, CASE WHEN t.n = 0 THEN 'metadata_only' WHEN b.dataset_code = 'ORDERS' THEN 'complete' ELSE 'usable' END AS status FROM b JOIN t USING (dataset_code), d",
    "metric_dimension_compatibility": f"WITH {SQL}, m AS (SELECT DISTINCT dataset_code, measure_code FROM obs WHERE measure_code IN (SELECT DISTINCT measure_code FROM obs JOIN bridge USING (observation_key) WHERE dataset_code = 'ORDERS')), d AS (SELECT dimension_code, count(DISTINCT category_name) AS category_count FROM bridge GROUP BY ALL) SELECT m.dataset_code, m.measure_code, dimension_code, category_count FROM m, d WHERE m.dataset_code = 'ORDERS'",
    "measure_capability": f"WITH {_MEASURE} SELECT measure_code, year_count > 1 AS supports_trend, populated_rows > 0 AS supports_ranking, CASE WHEN populated_rows = 0 THEN 'no_populated_facts' WHEN missing_rows > populated_rows THEN 'partial_sparse' ELSE 'ready' END AS status FROM mp",
    "category_value_contracts": f"WITH {_CATEGORY} SELECT lower('total_price_' || dimension_code || '_' || regexp_replace(category_name, '[^A-Za-z0-9]+', '_', 'g')) AS contract_code, '{{\"' || dimension_code || '\":\"' || category_name || '\"}}' AS filters, 'municipality_year,province_year,country_year' AS grains FROM cp WHERE NOT is_total",
    "contract_observation_index": f"WITH {SQL}, t AS (SELECT p.o_orderstatus AS s, p.o_orderpriority AS p, p.c_mktsegment AS m FROM place p WHERE o_orderstatus <> 'P') SELECT 'urgent_open' AS contract, count(*) AS facts FROM t WHERE s = 'O' AND p = '1-URGENT' UNION ALL SELECT 'building', count(*) FROM t WHERE m = 'BUILDING' UNION ALL SELECT 'open', count(*) FROM t WHERE s = 'O'",
    "review_diagnostics": f"WITH {_MEASURE} SELECT measure_code, concat_ws(',', CASE WHEN populated_rows = 0 THEN 'no_populated_facts' END, CASE WHEN missing_rows > 0 THEN 'has_missing' END) AS diagnostics, CASE WHEN missing_rows > 0 OR populated_rows = 0 THEN 'profiled' ELSE 'review_candidate' END AS state FROM mp",
    "quality_checks": "SELECT count(*) AS rows, count(DISTINCT o_orderkey) AS keys, count(*) - count(o_totalprice) AS nulls, CASE WHEN count(*) = 0 THEN 'failed' WHEN count(*) <> count(DISTINCT o_orderkey) OR count(*) <> count(o_totalprice) THEN 'warning' ELSE 'passed' END AS status FROM orders",
    "dataset_facets": "WITH c AS (SELECT o_custkey, count(*) AS n, bool_or(year(o_orderdate) IN (2000, 2001)) AS recent FROM orders GROUP BY 1) SELECT CASE WHEN n < 5 THEN 'small' WHEN n < 15 THEN 'medium' ELSE 'large' END AS size, recent, count(*) AS customers FROM c GROUP BY ALL",
    "null_safe_diff": "SELECT count(*) AS different FROM orders WHERE CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END IS DISTINCT FROM CASE WHEN o_orderkey % 3 <> 0 THEN o_orderstatus END",
}
QUERIES = {n: globals()[n] for n in ORACLES}
