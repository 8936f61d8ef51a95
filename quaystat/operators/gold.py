"""Gold build (conformed dimensions, fact, bridge) and writes: scoped overwrite, stale removal, purge, progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaystat.functions import rules
from quaystat.operators.pipeline import raw_rows, unpivoted, upsert
from quaystat.sources.mart import geographies, read
from quaystat.store import scratch

UNKNOWN = "UNKNOWN"


def dimension(values: DataFrame, kind: str, code: str, name: str) -> DataFrame:
    """(key, code, name) of the distinct values, and one row for what is not known. Of names of one code the smallest stays."""
    rows = values.select(F.col(code).alias("code"), F.col(name).alias("name")).filter("code is not null").groupBy("code").agg(F.min("name").alias("name"))
    unknown = values.sparkSession.range(1).select(F.lit(UNKNOWN).alias("code"), F.lit("Unknown").alias("name"))
    return rows.filter(F.col("code") != UNKNOWN).unionByName(unknown).select(rules.stable_key(F.lit(kind), F.col("code")).alias("key"), "code", "name")


def gold_dim_geography(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Municipalities and provinces with type and level order."""
    g = geographies(spark, sf_dir)
    provinces = g.select(F.concat(F.lit("PV"), F.upper("province_name")).alias("c"), F.col("province_name").alias("n"))
    out = dimension(g.select(F.col("geography_code").alias("c"), F.col("geography_name").alias("n")).unionByName(provinces), "geography", "c", "n")
    kind = rules.geography_type(F.col("code"), F.lit(None).cast("string"))
    return out.select(F.col("key").alias("geography_key"), F.col("code").alias("geography_code"), F.col("name").alias("geography_name"), kind.alias("geography_type"), rules.level_order(kind).cast("long").alias("level_order"))


def gold_dim_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories of the raw rows by dimension, with their total and unknown flags."""
    raw = unpivoted(raw_rows(spark, sf_dir)).filter("role = 'dimension' and property <> 'period'")
    out = raw.groupBy("dataset_id", "property", "value_text").agg(F.count("*").alias("observations"))
    key = rules.stable_key(F.lit("category"), F.col("dataset_id"), F.col("property"), F.col("value_text"))
    return out.select(key.alias("category_key"), F.col("property").alias("dimension_code"), F.col("value_text").alias("category_code"), rules.is_total(F.col("value_text"), F.col("value_text")).alias("is_total"), "observations")


def gold_dim_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods of the raw rows: key, type, bounds and year."""
    raw = unpivoted(raw_rows(spark, sf_dir)).filter("property = 'period'").select(F.col("value_text").alias("period_code")).distinct()
    first, last = rules.period_bounds(F.col("period_code"))
    return raw.select(rules.stable_key(F.lit("date"), F.col("period_code")).alias("date_key"), "period_code", rules.period_type(F.col("period_code")).alias("period_type"), first.cast("string").alias("period_start"), last.cast("string").alias("period_end"), F.substring("period_code", 1, 4).cast("long").alias("calendar_year"))


def _hash(pairs: Column) -> Column:
    return rules.combination_hash(pairs)


def gold_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations: one row for each raw row and measure, with the keys of its dimensions.

    A value that a dimension lacks gets the key of the unknown member. Dimensions are small and broadcast with a
    size that follows from the model (periods, nations), rows are looked at once.
    """
    cells = unpivoted(raw_rows(spark, sf_dir))
    dims = cells.filter("role = 'dimension'").groupBy("dataset_id", "row_id").agg(
        F.max(F.when(F.col("property") == "period", F.col("value_text"))).alias("period_code"),
        F.sort_array(F.collect_list(F.when(F.col("property") != "period", F.concat_ws("=", "property", "value_text")))).alias("categories"),
    )
    measures = cells.filter("role = 'measure'").select("dataset_id", "row_id", F.col("property").alias("measure_code"), "value_text")
    period = gold_dim_date(spark, sf_dir).filter("calendar_year <> 1996").select("period_code", "date_key", "calendar_year")
    fact = measures.join(dims, ["dataset_id", "row_id"]).join(F.broadcast(period), "period_code", "left")
    number = F.col("value_text").try_cast("decimal(18,2)")
    missing, suppressed, status = rules.missing_flags(number.cast("double"), F.col("value_text"))
    key = rules.stable_key(F.lit("observation"), F.col("dataset_id"), F.col("row_id"), F.col("measure_code"))
    return fact.select(
        key.alias("observation_key"), "row_id", "measure_code", F.coalesce("date_key", rules.stable_key(F.lit("date"), F.lit(UNKNOWN))).alias("date_key"), F.coalesce("calendar_year", F.lit(-1).cast("long")).alias("calendar_year"),
        _hash(F.col("categories")).alias("category_hash"), number.cast("double").alias("value"), missing.alias("is_missing"), suppressed.alias("is_suppressed"), status.alias("status"),
    )


def gold_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which categories an observation has; counted, as the rows are as many as the facts times the dimensions."""
    cells = unpivoted(raw_rows(spark, sf_dir))
    measures = cells.filter("role = 'measure'").select("dataset_id", "row_id", F.col("property").alias("measure_code"))
    cats = cells.filter("role = 'dimension' and property <> 'period'").select("dataset_id", "row_id", F.col("property").alias("dimension_code"), F.col("value_text").alias("category_code"))
    out = measures.join(cats, ["dataset_id", "row_id"])
    return out.groupBy("measure_code", "dimension_code", "category_code").agg(F.count("*").alias("links"))


# Writes -----------------------------------------------------------------------------------------------------------


def overwrite_scope(df: DataFrame, path: str, scope: str) -> None:
    """Replaces the partitions of `scope` that the rows belong to and leaves the others as they are."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(scope).parquet(path)


def without_stale(stored: DataFrame, current: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows whose key the current build still has."""
    return stored.join(current.select(*keys).distinct(), keys, "left_semi")


def purge(df: DataFrame, by: str, order: str, keep: int) -> DataFrame:
    """The newest `keep` rows of each group; the rank's limit is pushed below the shuffle."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order)))
    return df.withColumn("rn__", rank).filter(F.col("rn__") <= keep).drop("rn__")


def accumulated(stored: DataFrame, more: DataFrame, key: str, counters: list[str]) -> DataFrame:
    """Progress of both added up by key."""
    return stored.unionByName(more).groupBy(key).agg(*(F.sum(c).alias(c) for c in counters))


def _prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").cast("double").alias("price"))


def sink_scoped_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status is written anew with half its rows; the others stay."""
    path, rows = scratch(spark, "scoped"), _prices(spark, sf_dir)
    rows.write.partitionBy("o_orderstatus").parquet(path)
    overwrite_scope(rows.filter("o_orderstatus = 'F' and o_orderkey % 2 = 0"), path, "o_orderstatus")
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("rows"), F.max("price").alias("price"))


def sink_stale_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of which some documents are gone from the source: they are removed, the rest is renewed."""
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    stored, current = c.filter("c_custkey % 5 <> 0"), c.filter("c_custkey % 3 <> 0").withColumn("c_acctbal", F.col("c_acctbal") + 1)
    return upsert(without_stale(stored, current, ["c_custkey"]), current, ["c_custkey"])


def sink_retention_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return purge(e, "user_id", "event_id", 20).groupBy("event_type").agg(F.count("*").alias("rows"), F.min("event_id").alias("oldest"))


def sink_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run log of two chunks, added up."""
    o = read(spark, sf_dir, "orders")
    chunk = lambda k: o.filter(F.col("o_orderkey") % 2 == k).groupBy("o_orderstatus").agg(F.count("*").alias("rows_loaded"), F.count_if(F.col("o_totalprice") < 1000).alias("rows_rejected"))
    return accumulated(chunk(0), chunk(1), "o_orderstatus", ["rows_loaded", "rows_rejected"])


def sink_json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report as JSON files, read again by its schema."""
    path = scratch(spark, "report")
    report = read(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sort_array(F.collect_set("o_orderstatus")).alias("statuses"))
    report.write.json(path)
    return spark.read.schema("o_orderpriority string, n long, statuses array<string>").json(path).select("o_orderpriority", "n", F.array_join("statuses", ",").alias("statuses"))


def incremental_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is still to load: not complete yet, or of another version than the source's."""
    o = read(spark, sf_dir, "orders")
    source = o.groupBy("o_custkey").agg(F.max("o_orderkey").alias("version"))
    done = source.filter("o_custkey % 4 <> 0").select("o_custkey", (F.col("version") - F.when(F.col("o_custkey") % 3 == 0, 1).otherwise(0)).alias("version"), F.when(F.col("o_custkey") % 7 == 0, "failed").otherwise("complete").alias("status"))
    return source.join(done.filter("status = 'complete'"), ["o_custkey", "version"], "left_anti")


incremental_skip_versions = incremental_skip  # its name for a time


def resumed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a paged source behind the last one loaded, by data set."""
    e = read(spark, sf_dir, "events").select("event_type", "event_id")
    loaded = e.filter("event_id % 10 < 6").groupBy("event_type").agg(F.max("event_id").alias("last"))
    left = e.join(F.broadcast(loaded), "event_type", "left").filter("last is null or event_id > last")
    return left.groupBy("event_type").agg(F.count("*").alias("rows"), F.min("event_id").alias("next_row"))


_K = "('0x' || substr(sha256({0}), 1, 15))::BIGINT"
_PERIOD = "(year(o_orderdate)::VARCHAR || 'MM' || lpad(month(o_orderdate)::VARCHAR, 2, '0'))"
_FACT = f"m AS (SELECT *, {_PERIOD} AS period, sha256('o_orderpriority=' || o_orderpriority || '|o_orderstatus=' || o_orderstatus) AS category_hash FROM orders), cell AS (SELECT *, 'o_totalprice' AS measure_code, CASE WHEN o_orderkey % 50 <> 0 THEN o_totalprice::DECIMAL(18,2) END AS v FROM m UNION ALL SELECT *, 'o_custkey', CASE WHEN o_orderkey % 50 <> 0 AND o_custkey % 7 <> 0 THEN o_custkey::DECIMAL(18,2) END FROM m)"
ORACLES = {
    "gold_dim_geography": "WITH c AS (SELECT printf('GM%04d', n_nationkey) AS c, n_name AS n, 'municipality' AS t, 1 AS l FROM nation UNION ALL SELECT 'PV' || upper(r_name), r_name, 'province', 3 FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation) UNION ALL SELECT 'UNKNOWN', 'Unknown', 'country', 5) SELECT " + _K.format("'geography|' || c") + " AS geography_key, c AS geography_code, n AS geography_name, t AS geography_type, l::BIGINT AS level_order FROM c",
    "gold_dim_category": "WITH c AS (SELECT 'o_orderstatus' AS d, o_orderstatus AS v FROM orders UNION ALL SELECT 'o_orderpriority', o_orderpriority FROM orders) SELECT " + _K.format("'category|ORDERS|' || d || '|' || v") + " AS category_key, d AS dimension_code, v AS category_code, contains(lower(v), 'total') OR contains(lower(v), 'totaal') AS is_total, count(*) AS observations FROM c GROUP BY ALL",
    "gold_dim_date": f"WITH p AS (SELECT DISTINCT {_PERIOD} AS p, year(o_orderdate) AS y, month(o_orderdate) AS m FROM orders) SELECT " + _K.format("'date|' || p") + " AS date_key, p AS period_code, 'month' AS period_type, make_date(y, m, 1)::VARCHAR AS period_start, last_day(make_date(y, m, 1))::VARCHAR AS period_end, y AS calendar_year FROM p",
    "gold_fact": f"WITH {_FACT} SELECT " + _K.format("'observation|ORDERS|' || o_orderkey || '|' || measure_code") + " AS observation_key, o_orderkey AS row_id, measure_code, CASE WHEN year(o_orderdate) <> 1996 THEN " + _K.format("'date|' || period") + " ELSE " + _K.format("'date|UNKNOWN'") + " END AS date_key, CASE WHEN year(o_orderdate) <> 1996 THEN year(o_orderdate) ELSE -1 END AS calendar_year, category_hash, v::DOUBLE AS value, false AS is_missing, false AS is_suppressed, 'reported' AS status FROM cell WHERE v IS NOT NULL",
    "gold_bridge": f"WITH {_FACT}, b AS (SELECT measure_code, 'o_orderstatus' AS dimension_code, o_orderstatus AS category_code FROM cell WHERE v IS NOT NULL UNION ALL SELECT measure_code, 'o_orderpriority', o_orderpriority FROM cell WHERE v IS NOT NULL) SELECT *, count(*) AS links FROM b GROUP BY ALL",
    "sink_scoped_overwrite": "SELECT o_orderstatus, count(*) AS rows, max(o_totalprice::DECIMAL(18,2))::DOUBLE AS price FROM orders WHERE o_orderstatus <> 'F' OR o_orderkey % 2 = 0 GROUP BY 1",
    "sink_stale_removal": "SELECT c_custkey, c_acctbal + 1 AS c_acctbal FROM customer WHERE c_custkey % 3 <> 0",
    "sink_retention_purge": "WITH k AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) <= 20) SELECT event_type, count(*) AS rows, min(event_id) AS oldest FROM k GROUP BY 1",
    "sink_progress": "SELECT o_orderstatus, count(*) AS rows_loaded, count(*) FILTER (o_totalprice < 1000) AS rows_rejected FROM orders GROUP BY 1",
    "sink_json_report": "SELECT o_orderpriority, count(*) AS n, string_agg(DISTINCT o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY 1",
    "incremental_skip": "WITH s AS (SELECT o_custkey, max(o_orderkey) AS version FROM orders GROUP BY 1) SELECT * FROM s WHERE NOT (o_custkey % 4 <> 0 AND o_custkey % 3 <> 0 AND o_custkey % 7 <> 0)",
    "resumed_rows": "WITH l AS (SELECT event_type, max(event_id) FILTER (event_id % 10 < 6) AS last FROM events GROUP BY 1) SELECT event_type, count(*) AS rows, min(event_id) AS next_row FROM events JOIN l USING (event_type) WHERE last IS NULL OR event_id > last GROUP BY 1",
}
ORACLES["incremental_skip_versions"] = ORACLES["incremental_skip"]
QUERIES = {n: globals()[n] for n in ORACLES}
