"""Queries of the semantic catalogue's build, with DuckDB oracles: parts are measures, brands data sets, nations places, priorities categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystat.operators import metadata as M
from quaystat.sources.mart import read

PROVIDER = "statistics"


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    one = lambda *v: F.element_at(F.array(*(F.lit(x) for x in v)), (k % len(v) + 1).cast("int"))
    p = read(spark, sf_dir, "part").select(
        k.alias("measure_key"), F.col("p_type").alias("measure_code"), F.col("p_name").alias("measure_name"), F.when(k % 4 == 0, "").when(k % 4 != 1, F.concat(F.lit("Prijs van "), "p_name")).alias("measure_description"),
        F.col("p_brand").alias("dataset_code"), F.when(k % 17 != 0, F.col("p_size")).alias("dataset_key"), one("EUR", "COUNT", "PERCENT").alias("unit_code"), F.when(k % 13 != 0, k % 3).alias("unit_key"), one("amount", "Index", None, "median", "count").alias("value_type"),
        one("sum", "average", "SUM", None, "", "median", "latest").alias("default_aggregation"), (k % 2 == 0).alias("is_additive"), F.when(k % 3 == 0, k % 6 == 0).alias("is_semi_additive"), (k % 5 == 0).alias("is_non_additive"),
        (k % 3 == 2).alias("is_percentage"), F.when(k % 8 < 4, k % 8 == 1).alias("is_index"), F.when(k % 2 == 0, "trade").alias("domain_id"), F.concat(F.lit("v"), (k % 3).cast("string")).alias("dataset_version"),
    )
    lines = read(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' and l_linenumber = 7")
    return M.with_fact_data(p, lines, "measure_key", "l_partkey")


def _stored(new: DataFrame) -> DataFrame:
    """Metrics of an earlier build: two of three, of which some are curated and some lack keys; and some that are no longer generated."""
    k = F.col("measure_key")
    old = new.filter(k % 3 != 0).withColumns({"metric_label": F.concat(F.lit("old "), "metric_label"), "aggregation": F.lit("max"), "unit_key": F.when(k % 4 != 0, k % 3 + 100), "metadata_origin": F.when(k % 5 == 0, "curated").otherwise("generated")})
    gone = new.filter(k % 50 == 0).withColumns({"metric_code": F.concat("metric_code", F.lit("_gone")), "metadata_origin": F.lit("curated")})
    return old.unionByName(gone)


def catalogue_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of all parts, merged over those of an earlier build."""
    new = M.metrics(measures(spark, sf_dir))
    out = M.upserted(_stored(new), new, ("metric_code",), M.KEYS)
    return out.withColumns({c: F.col(c).cast("string") for c in ("dataset_key", "unit_key")})


def catalogue_metric_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dimensions of the metrics; the table of dimensions, from the regions, lacks one."""
    d = read(spark, sf_dir, "region").select(F.element_at(F.array(*(F.lit(x) for x in ("time", "geography", "category", "dataset", "other"))), F.col("r_regionkey") + 1).alias("dimension_code"), F.col("r_regionkey").alias("dimension_id"))
    return M.metric_dimensions(M.metrics(measures(spark, sf_dir)), d)


def catalogue_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of measures and of nations, folded; equal ones once."""
    m = measures(spark, sf_dir).select(F.lit("metric").alias("object_type"), F.col("measure_key").alias("object_id"), F.array("measure_code", "measure_name", F.upper("measure_name"), F.lit("--"), "measure_description").alias("synonyms"))
    n = read(spark, sf_dir, "nation").select(F.lit("dimension_value").alias("object_type"), F.col("n_nationkey").cast("long").alias("object_id"), F.array("n_name", F.lower(F.regexp_replace("n_name", "_", " "))).alias("synonyms"))
    return M.synonyms(m.unionByName(n))


def catalogue_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that an earlier build of two of three measures does not have; of every tenth it had another text."""
    m = measures(spark, sf_dir)
    k = F.col("measure_key")
    earlier = m.filter(k % 3 != 0).withColumn("measure_description", F.when(k % 10 == 3, "Vroeger").otherwise(F.col("measure_description")))
    return M.definition_versions(m, M.definition_versions(earlier))


def catalogue_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of brands, parts, nations and priorities, with where they come from."""
    m = measures(spark, sf_dir)
    d = read(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("dataset_code")).agg(F.min("p_partkey").alias("dataset_key"), F.min("p_type").alias("dataset_title"), F.max("p_type").alias("dataset_description"))
    n = read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("geography_key"), F.when(F.col("n_nationkey") == 3, "UNKNOWN").otherwise(F.format_string("GM%04d", "n_nationkey")).alias("geography_code"), F.col("n_name").alias("geography_name"), F.lit("municipality").alias("geography_type"))
    c = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.min("o_orderkey").alias("category_key")).select("category_key", F.substring("o_orderpriority", 1, 1).alias("category_code"), F.col("o_orderpriority").alias("category_name"), F.lit("Priority").alias("dimension_code"), F.lit("ORDERS").alias("dataset_code"))
    out = M.items(d, m, n, c, PROVIDER)
    flat = [F.col(f"lineage.{x}").alias(x) for x in ("source_provider", "source_dataset_code", "source_dataset_version", "gold_table", "gold_primary_key", "semantic_object")]
    return out.select(*(x for x in out.columns if x not in ("tags", "lineage", "has_fact_data")), F.array_join("tags", ",").alias("tags"), F.col("has_fact_data").cast("string").alias("has_fact_data"), *flat, F.array_join("lineage.derived_from_layers", ",").alias("layers"))


def property_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema of each brand's parts: eight fields a part, some of them null."""
    k = F.col("p_partkey")
    none = F.lit(None).cast("string")
    p = F.struct(
        k.alias("id"), F.when(k % 7 != 0, F.concat(F.lit("k"), k.cast("string"))).alias("key"), F.col("p_name").alias("title"), F.lit("Topic").alias("type"), F.when(k % 2 == 0, "Double").alias("datatype"),
        F.col("p_type").alias("unit"), F.col("p_size").alias("position"), none.alias("parentId"),
    )
    return read(spark, sf_dir, "part").groupBy("p_brand").agg(F.count("*").alias("properties"), M.property_hash(F.collect_list(p)).alias("schema_hash"))


_MEASURES = """m AS (SELECT p_partkey AS k, p_type AS measure_code, p_name AS measure_name, CASE WHEN p_partkey % 4 = 0 THEN '' WHEN p_partkey % 4 <> 1 THEN 'Prijs van ' || p_name END AS measure_description, p_brand AS dataset_code,
  CASE WHEN p_partkey % 17 <> 0 THEN p_size END AS dataset_key, ['EUR', 'COUNT', 'PERCENT'][p_partkey % 3 + 1] AS unit_code, CASE WHEN p_partkey % 13 <> 0 THEN p_partkey % 3 END AS unit_key, ['amount', 'Index', NULL, 'median', 'count'][p_partkey % 5 + 1] AS value_type,
  ['sum', 'average', 'SUM', NULL, '', 'median', 'latest'][p_partkey % 7 + 1] AS given, p_partkey % 3 = 2 OR p_partkey % 8 = 1 AS ratio FROM part)"""
_METRICS = f"""{_MEASURES}, a AS (SELECT *, coalesce(lower(given), 'none') AS how, ratio OR coalesce(lower(value_type) IN ('percentage', 'index', 'average', 'median', 'ratio'), false) AS bad FROM m),
g AS (SELECT k, rtrim(regexp_replace(lower('cbs ' || dataset_code || ' ' || measure_code || ' ' || unit_code || ' ' || k), '[^a-z0-9]+', '_', 'g'), '_') AS metric_code, measure_name AS metric_label, measure_description AS description, dataset_key, unit_key, value_type, ratio,
  CASE WHEN bad AND how IN ('sum', '') THEN 'average' WHEN how = '' THEN 'none' ELSE how END AS aggregation FROM a),
new AS (SELECT *, k % 2 = 0 AND NOT ratio AS is_additive, k % 6 = 0 AS is_semi_additive, k % 5 = 0 OR ratio AS is_non_additive, dataset_key IS NOT NULL AND unit_key IS NOT NULL AND aggregation IN ('sum', 'average', 'min', 'max', 'count', 'latest') AS is_enabled FROM g)"""
ORACLES = {
    "catalogue_metrics": f"""WITH {_METRICS}, old AS (SELECT k, 'old ' || metric_label AS metric_label, 'max' AS aggregation, CASE WHEN k % 4 <> 0 THEN k % 3 + 100 END AS unit_key, k % 5 = 0 AS curated FROM new WHERE k % 3 <> 0)
SELECT n.metric_code, n.k AS measure_key, CASE WHEN curated THEN o.metric_label ELSE n.metric_label END AS metric_label, description, dataset_key::VARCHAR AS dataset_key, CASE WHEN curated THEN o.aggregation ELSE n.aggregation END AS aggregation, coalesce(o.unit_key, n.unit_key)::VARCHAR AS unit_key,
 value_type, is_additive, is_semi_additive, is_non_additive, is_enabled, CASE WHEN is_enabled THEN 'complete' ELSE 'incomplete' END AS metadata_completeness_status, CASE WHEN curated THEN 'curated' ELSE 'generated' END AS metadata_origin FROM new n LEFT JOIN old o USING (k)
UNION ALL SELECT metric_code || '_gone', k, metric_label, description, dataset_key::VARCHAR, aggregation, unit_key::VARCHAR, value_type, is_additive, is_semi_additive, is_non_additive, is_enabled, CASE WHEN is_enabled THEN 'complete' ELSE 'incomplete' END, 'curated' FROM new WHERE k % 50 = 0""",
    "catalogue_metric_dimensions": f"""WITH {_METRICS}, d AS (SELECT ['time', 'geography', 'category', 'dataset', 'other'][r_regionkey + 1] AS dimension_name, r_regionkey AS dimension_id FROM region), w AS (SELECT metric_code, unnest(['time', 'geography', 'category', 'dataset', 'status']) AS dimension_name FROM new)
SELECT metric_code, dimension_name, dimension_id, dimension_name IN ('time', 'geography') AS is_required, dimension_name IN ('time', 'geography') AS is_default, true AS supports_grouping, true AS supports_filtering FROM w JOIN d USING (dimension_name)""",
    "catalogue_synonyms": f"""WITH {_MEASURES}, s AS (SELECT 'metric' AS object_type, k::VARCHAR AS object_id, unnest([measure_code, measure_name, upper(measure_name), measure_description]) AS synonym, unnest([0, 1, 2, 4]) AS pos FROM m
  UNION ALL SELECT 'dimension_value', n_nationkey::VARCHAR, unnest([n_name, lower(replace(n_name, '_', ' '))]), unnest([0, 1]) FROM nation), f AS (SELECT *, trim(regexp_replace(lower(synonym), '[^a-z0-9]+', ' ', 'g')) AS normalized_synonym FROM s WHERE synonym <> '')
SELECT object_type, object_id, arg_min(synonym, pos) AS synonym, normalized_synonym, 'nl' AS language_code, 1.0::DOUBLE AS weight, 'source' AS metadata_origin FROM f GROUP BY object_type, object_id, normalized_synonym""",
    "catalogue_definitions": f"""WITH {_MEASURES} SELECT 'metric' AS object_type, k::VARCHAR AS object_id, measure_description AS definition_text, 'unknown' AS comparability_status, dataset_code || ' ' || measure_code AS source_reference, 'source' AS metadata_origin
FROM m WHERE measure_description <> '' AND (k % 3 = 0 OR k % 10 = 3)""",
    "catalogue_items": f"""WITH {_MEASURES}, have AS (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R' AND l_linenumber = 7), i AS (
SELECT 'dataset' AS object_type, min(p_partkey)::VARCHAR AS object_id, min(p_type) AS title, p_brand AS subtitle, max(p_type) AS description, p_brand || ' ' || min(p_type) || ' ' || max(p_type) AS search_text, p_brand AS dataset_code, NULL AS measure_code, NULL AS geography_code, NULL AS unit_code, 'dataset' AS tags,
 NULL AS has_fact_data, p_brand AS source_dataset_code, NULL AS source_dataset_version, 'dim_dataset' AS gold_table, 'dataset' AS semantic_object FROM part GROUP BY p_brand
UNION ALL SELECT 'measure', k::VARCHAR, measure_name, dataset_code || ' · ' || unit_code, measure_description, concat_ws(' ', measure_code, measure_name, nullif(measure_description, ''), unit_code), dataset_code, measure_code, NULL, unit_code,
 concat_ws(',', 'measure', value_type, given, CASE WHEN k % 2 = 0 THEN 'trade' END), (k IN (FROM have))::VARCHAR, dataset_code, 'v' || k % 3, 'dim_measure', 'metric' FROM m
UNION ALL SELECT 'geography', n_nationkey::VARCHAR, n_name, 'municipality · ' || printf('GM%04d', n_nationkey), 'municipality', printf('GM%04d', n_nationkey) || ' ' || n_name || ' municipality', NULL, NULL, printf('GM%04d', n_nationkey), NULL, 'geography,municipality', NULL, NULL, NULL, 'dim_geography', 'geography' FROM nation WHERE n_nationkey <> 3
UNION ALL SELECT 'category', min(o_orderkey)::VARCHAR, o_orderpriority, 'ORDERS · Priority', NULL, o_orderpriority[1] || ' ' || o_orderpriority || ' Priority ORDERS', 'ORDERS', NULL, NULL, NULL, 'category,Priority', NULL, 'ORDERS', NULL, 'dim_category', 'category' FROM orders GROUP BY o_orderpriority)
SELECT *, '{PROVIDER}' AS source_provider, object_id AS gold_primary_key, 'api,bronze,silver,gold' AS layers FROM i""",
    "property_hashes": """WITH p AS (SELECT p_brand, CASE WHEN p_partkey % 7 <> 0 THEN 'k' || p_partkey ELSE p_partkey::VARCHAR END AS place, '{"datatype":' || CASE WHEN p_partkey % 2 = 0 THEN '"Double"' ELSE 'null' END || ',"id":' || p_partkey || ',"key":' || CASE WHEN p_partkey % 7 <> 0 THEN '"k' || p_partkey || '"' ELSE 'null' END
  || ',"parentId":null,"position":' || p_size || ',"title":"' || p_name || '","type":"Topic","unit":"' || p_type || '"}' AS t FROM part) SELECT p_brand, count(*) AS properties, sha256('[' || string_agg(t, ',' ORDER BY place) || ']') AS schema_hash FROM p GROUP BY p_brand""",
}
QUERIES = {n: globals()[n] for n in ORACLES}
