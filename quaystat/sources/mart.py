"""The observation mart over the sales tables: a fact with dimensions on it, and a category bridge."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def geographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as municipalities of their regions: two small dimensions, joined once. The first has the code GM0000, which plans leave out."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return n.join(r, n.n_regionkey == r.r_regionkey).select("n_nationkey", F.format_string("GM%04d", F.col("n_nationkey")).alias("geography_code"), F.col("n_name").alias("geography_name"), F.col("r_name").alias("province_name"))


#: The measures of order lines: code, unit, factor, column.
LINE_MEASURES = (("QUANTITY", "COUNT", 1, "l_quantity"), ("EXTENDED_PRICE", "EUR_THOUSANDS", 1000, "l_extendedprice"))
MEASURES = ("TOTAL_PRICE", *(m[0] for m in LINE_MEASURES))


def observations(spark: SparkSession, sf_dir: str, measures: tuple[str, ...] = MEASURES) -> DataFrame:
    """One row for each order (total price) and each order line and measure of it; tables of measures not wanted are not read."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    place = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(geographies(spark, sf_dir)), F.col("c_nationkey") == F.col("n_nationkey"))
    geo = ["geography_code", "geography_name", "province_name"]
    price = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).cast("decimal(18,2)")
    orders = place.select(
        F.col("o_orderkey").alias("observation_key"), F.lit("ORDERS").alias("dataset_code"), F.lit("TOTAL_PRICE").alias("measure_code"), F.lit("EUR").alias("unit_code"), F.lit(1).alias("scale_factor"),
        *geo, F.year("o_orderdate").cast("long").alias("calendar_year"), F.quarter("o_orderdate").cast("long").alias("quarter"), price.alias("value"),
    )
    parts = [orders] if "TOTAL_PRICE" in measures else []
    wanted = [m for m in LINE_MEASURES if m[0] in measures]
    if wanted:
        lines = read(spark, sf_dir, "lineitem").join(place.select("o_orderkey", *geo), F.col("l_orderkey") == F.col("o_orderkey"))
        when = [F.year("l_shipdate").cast("long").alias("calendar_year"), F.quarter("l_shipdate").cast("long").alias("quarter")]
        cells = [F.struct(F.lit(m).alias("measure_code"), F.lit(u).alias("unit_code"), F.lit(s).alias("scale_factor"), F.col(v).cast("decimal(18,2)").alias("value")) for m, u, s, v in wanted]
        cell = F.explode(F.array(*cells)) if len(cells) > 1 else cells[0]
        lines = lines.select(F.col("l_orderkey").alias("observation_key"), F.lit("LINEITEM").alias("dataset_code"), *geo, *when, cell.alias("m"))
        parts.append(lines.select("observation_key", "dataset_code", "m.measure_code", "m.unit_code", "m.scale_factor", *geo, "calendar_year", "quarter", "m.value"))
    out = reduce(DataFrame.unionByName, parts)
    return out.withColumn("geography_type", F.lit("municipality")).withColumn("is_missing", F.col("value").isNull())


def populated(fact: DataFrame) -> DataFrame:
    return fact.filter(F.col("value").isNotNull() & ~F.col("is_missing"))


def bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(observation_key, dimension_code, category_name) of the orders: priority, status, segment."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    wide = o.join(c, o.o_custkey == c.c_custkey).select(F.col("o_orderkey").alias("observation_key"), F.col("o_orderpriority").alias("Priority"), F.col("o_orderstatus").alias("Status"), F.col("c_mktsegment").alias("Segment"))
    return wide.unpivot("observation_key", ["Priority", "Status", "Segment"], "dimension_code", "category_name")


#: DuckDB SQL of the same views, for the oracles.
SQL = """
place AS (SELECT o.*, c_mktsegment, printf('GM%04d', n_nationkey) AS geography_code, n_name AS geography_name, r_name AS province_name
          FROM orders o JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
obs AS (SELECT o_orderkey AS observation_key, 'ORDERS' AS dataset_code, 'TOTAL_PRICE' AS measure_code, 'EUR' AS unit_code, 1 AS scale_factor, geography_code, geography_name, province_name,
               year(o_orderdate) AS calendar_year, quarter(o_orderdate) AS quarter, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END::DECIMAL(18,2) AS value FROM place
        UNION ALL SELECT l_orderkey, 'LINEITEM', 'QUANTITY', 'COUNT', 1, geography_code, geography_name, province_name, year(l_shipdate), quarter(l_shipdate), l_quantity::DECIMAL(18,2) FROM lineitem JOIN place ON l_orderkey = o_orderkey
        UNION ALL SELECT l_orderkey, 'LINEITEM', 'EXTENDED_PRICE', 'EUR_THOUSANDS', 1000, geography_code, geography_name, province_name, year(l_shipdate), quarter(l_shipdate), l_extendedprice::DECIMAL(18,2) FROM lineitem JOIN place ON l_orderkey = o_orderkey),
fact AS (SELECT *, 'municipality' AS geography_type FROM obs WHERE value IS NOT NULL),
bridge AS (SELECT o_orderkey AS observation_key, 'Priority' AS dimension_code, o_orderpriority AS category_name FROM place
           UNION ALL SELECT o_orderkey, 'Status', o_orderstatus FROM place UNION ALL SELECT o_orderkey, 'Segment', c_mktsegment FROM place)
"""
