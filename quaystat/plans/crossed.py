"""Queries over two marts, facts with a category map, and the bitmap index, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystat.plans.categories import BitmapIndex, holds, member
from quaystat.plans.crossing import Component, Mart, association, compare, complete_rows, sandbox
from quaystat.plans.extended import supply_observations
from quaystat.plans.plan import compile_plan, validate
from quaystat.plans.queries import MEASURES, PLANS, _with
from quaystat.plans.queries import SQL as PLAN_SQL
from quaystat.sources import mart
from quaystat.sources.mart import geographies, read
from quaystat.store import scratch


def order_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' total price with the category map on each row."""
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    place = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(geographies(spark, sf_dir)), F.col("c_nationkey") == F.col("n_nationkey"))
    categories = F.array(
        member("Priority", F.concat(F.lit("P"), F.substring("o_orderpriority", 1, 1)), F.col("o_orderpriority")),
        member("Status", F.lit(None).cast("string"), F.col("o_orderstatus")),
        member("Segment", F.substring("c_mktsegment", 1, 3), F.col("c_mktsegment")),
    )
    return place.select(
        F.col("o_orderkey").alias("observation_key"), F.lit("ORDERS").alias("dataset_code"), F.lit("T1").alias("source_dataset_id"), F.lit("TOTAL_PRICE").alias("measure_code"), F.lit("EUR").alias("unit_code"), F.lit(1).alias("scale_factor"),
        "geography_code", "geography_name", F.lit("municipality").alias("geography_type"), F.year("o_orderdate").cast("long").alias("calendar_year"), F.quarter("o_orderdate").cast("long").alias("quarter"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).cast("decimal(18,2)").alias("value"), F.when(F.col("o_orderstatus") == "P", True).otherwise(False).alias("is_missing"), categories.alias("categories"),
    )


def marts(spark: SparkSession, sf_dir: str) -> list[Mart]:
    """The sources that may be compared."""
    return [Mart("orders", "trade", order_facts(spark, sf_dir)), Mart("supply", "logistics", supply_observations(spark, sf_dir))]


COMPONENTS = [
    Component("total_price", "orders", "TOTAL_PRICE", "Total price"),
    Component("supply_value", "supply", "SUPPLY_VALUE", "Supply value", dataset_code="SUPPLY"),
    Component("urgent_price", "orders", "TOTAL_PRICE", "Urgent price", dataset_code="T1", filters={"priority": ("P1",), "Status": ("F", "O")}),
]


def cross_source_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest cells that have all three metrics, of two marts."""
    return compare(complete_rows(marts(spark, sf_dir), COMPONENTS, years=(1995, 1999), geography_type="municipality"), 50)


def cross_source_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association(complete_rows(marts(spark, sf_dir), COMPONENTS, years=(1995, 1999)), COMPONENTS)


def category_map_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts with wanted members in two dimensions, by code or by name, counted by year: a predicate on the row, no join of a bridge."""
    facts = mart.populated(order_facts(spark, sf_dir))
    return facts.filter(holds({"PRIORITY": ("P1", "2-HIGH"), "segment": ("BUI", "MACHINERY")})).groupBy("calendar_year").agg(F.count("*").alias("facts"), F.sum("value").cast("double").alias("total"))


# The sandbox over cells of two dimensions ----------------------------------------------------------------------------


def published(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(cells, category dimension): sums by geography, period, priority and segment with totals of both.

    Quarters are always published; years until 1998, of single priorities only in every second geography. Segments have two totals.
    """
    f = mart.populated(order_facts(spark, sf_dir))
    at = lambda k: F.get("categories", F.lit(k))
    fine = f.groupBy("geography_code", "geography_name", "geography_type", "calendar_year", "quarter", at(0).alias("p"), at(2).alias("s")).agg(F.sum("value").alias("value"))
    total = lambda d, code, name: member(d, F.lit(code), F.lit(name))
    fine = fine.withColumn("p", F.explode(F.array("p", total("Priority", "T001", "Totaal"))))
    fine = fine.withColumn("s", F.explode(F.array("s", total("Segment", "T009", "Segment totaal"), total("Segment", "A000", "Totaal van alles"))))
    quarter = F.struct(F.lit("quarter").alias("t"), F.concat(F.col("calendar_year").cast("string"), F.lit("KW0"), F.col("quarter").cast("string")).alias("c"))
    annual = F.struct(F.lit("").alias("t"), F.concat(F.col("calendar_year").cast("string"), F.lit("JJ00")).alias("c"))
    has_year = (F.col("calendar_year") <= 1998) & ((F.col("p.category_code") == "T001") | (F.substring("geography_code", 3, 4).cast("int") % 2 == 0))
    fine = fine.withColumn("period", F.explode(F.array_compact(F.array(quarter, F.when(has_year, annual)))))
    cells = fine.groupBy("geography_code", "geography_name", "geography_type", "calendar_year", "period", "p", "s").agg(F.sum("value").cast("decimal(24,2)").alias("value"))
    cells = cells.select(
        "geography_code", "geography_name", "geography_type", "calendar_year", F.col("period.t").alias("period_type"), F.col("period.c").alias("period_code"), F.lit("Cells").alias("dataset_code"), F.lit("PRICE").alias("measure_code"),
        "value", F.lit(False).alias("is_missing"), F.array("p", "s").alias("categories"),
    )
    dims = spark.createDataFrame([("Cells", "Priority", "T001", "Totaal", True), ("Cells", "Segment", "T009", "Segment totaal", True), ("Cells", "Segment", "A000", "Totaal van alles", True), ("Cells", "Segment", "BUI", "BUILDING", False), ("Other", "Colour", "T", "Totaal", True)], "dataset_code string, dimension_code string, category_code string, category_name string, is_total boolean")
    return cells, dims


def sandbox_two_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without filters both dimensions collapse to their best total, and the year to its annual cells."""
    return sandbox(*published(spark, sf_dir), "avg", "Cells", "PRICE", year=1997, geography_type="municipality", limit=100)


def sandbox_annual_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The year has annual cells, so quarters don't count, also where the filtered priorities have none but quarters."""
    return sandbox(*published(spark, sf_dir), "sum", "Cells", "PRICE", year=1997, filters={"priority": ("1-URGENT", "P5")}, limit=100)


def sandbox_two_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A year without annual cells, one dimension filtered by code, the other grouped, its totals among the groups."""
    return sandbox(*published(spark, sf_dir), "max", "Cells", year=2000, filters={"Priority": ("T001",)}, group="segment", limit=100)


# The bitmap index ----------------------------------------------------------------------------------------------------


def plan_by_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan rank_geographies_by_category with its category filters as bits."""
    plan = PLANS["rank_geographies_by_category"]
    validate(plan, MEASURES)
    bridge = mart.bridge(spark, sf_dir)
    return compile_plan(plan, mart.observations(spark, sf_dir, (plan.measure,)), bridge, BitmapIndex.build(bridge, scratch(spark, "bitmaps")))


def contract_bitmaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many facts each contract has, from the bitmaps alone."""
    index = BitmapIndex.build(mart.bridge(spark, sf_dir), scratch(spark, "bitmaps"))
    contracts = {"urgent": {"Priority": ("1-URGENT",)}, "urgent_open": {"Priority": ("1-URGENT", "2-HIGH"), "Status": ("O",)}, "building": {"Segment": ("BUILDING",), "Priority": ("3-MEDIUM",), "Status": ("F", "P")}, "nothing": {"Status": ("?",)}}
    return index.contracts(contracts).groupBy("contract").agg(F.sum(F.bitmap_count("bitmap")).alias("facts"))


_OF = "place.o_orderkey = f.observation_key"
_SUPPLY = "s AS (SELECT n_name AS geography_name, printf('GM%04d', n_nationkey) AS geography_code, year(l_shipdate) AS calendar_year, max(l_extendedprice::DECIMAL(18,2)) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)"
_CROSS = f""", {_SUPPLY}, t AS (SELECT geography_name, geography_code, calendar_year, max(value) AS v FROM fact WHERE measure_code = 'TOTAL_PRICE' GROUP BY ALL),
u AS (SELECT f.geography_name, f.geography_code, f.calendar_year, max(value) AS v FROM fact f JOIN place ON {_OF} WHERE measure_code = 'TOTAL_PRICE' AND o_orderpriority = '1-URGENT' AND o_orderstatus IN ('F', 'O') GROUP BY ALL),
x AS (SELECT t.geography_name, t.geography_code, 'municipality' AS geography_type, t.calendar_year, t.v AS tv, s.v AS sv, u.v AS uv FROM t JOIN s USING (geography_code, calendar_year) JOIN u USING (geography_code, calendar_year) WHERE t.calendar_year BETWEEN 1995 AND 1999)
"""


def _metric(code: str, label: str, domain: str, source: str, dataset: str | None, value: str) -> str:
    own = f'"dataset_code":"{dataset}",' if dataset else ""
    return f"""'"{code}":{{"label":"{label}","domain_id":"{domain}","source":"{source}",{own}"value":' || {value}::DECIMAL(28,2)::VARCHAR || ',"raw_value":' || {value}::DECIMAL(28,2)::VARCHAR || ',"unit_code":"EUR"}}'"""


_METRICS = "'{' || " + " || ',' || ".join([_metric("supply_value", "Supply value", "logistics", "supply", "SUPPLY", "sv"), _metric("total_price", "Total price", "trade", "orders", None, "tv"), _metric("urgent_price", "Urgent price", "trade", "orders", "T1", "uv")]) + " || '}'"
_CELLS = """, f0 AS (SELECT f.geography_code, f.geography_name, f.geography_type, f.calendar_year, f.quarter, 'P' || substr(o_orderpriority, 1, 1) AS pc, o_orderpriority AS pn, substr(c_mktsegment, 1, 3) AS sc, c_mktsegment AS sn, value FROM fact f JOIN place ON place.o_orderkey = f.observation_key WHERE measure_code = 'TOTAL_PRICE'),
f1 AS (SELECT * FROM f0 UNION ALL SELECT * REPLACE ('T001' AS pc, 'Totaal' AS pn) FROM f0),
f2 AS (SELECT * FROM f1 UNION ALL SELECT * REPLACE ('T009' AS sc, 'Segment totaal' AS sn) FROM f1 UNION ALL SELECT * REPLACE ('A000' AS sc, 'Totaal van alles' AS sn) FROM f1),
f3 AS (SELECT *, 'quarter' AS period_type FROM f2 UNION ALL SELECT * REPLACE (0 AS quarter), 'year' FROM f2 WHERE calendar_year <= 1998 AND (pc = 'T001' OR substr(geography_code, 3, 4)::INT % 2 = 0)),
cells AS (SELECT geography_code, geography_name, geography_type, calendar_year, quarter, period_type, pc, pn, sc, sn, sum(value)::DECIMAL(24,2) AS value FROM f3 GROUP BY ALL)
"""


def _sandbox_sql(how: str, where: str, group: str = "NULL::VARCHAR") -> str:
    return _with(_CELLS + f"SELECT calendar_year, geography_type, geography_code, geography_name, {group} AS group_value, count(*) AS row_count, round({how}(value)::DOUBLE, 2) AS aggregate_value FROM cells WHERE {where} GROUP BY ALL ORDER BY aggregate_value DESC NULLS LAST, geography_code, calendar_year, group_value LIMIT 100")


SQL = {
    "cross_source_comparison": _with(_CROSS + f"SELECT geography_name, geography_code, geography_type, calendar_year, {_METRICS} AS metrics, 3::BIGINT AS metric_count FROM x ORDER BY calendar_year DESC, geography_name, geography_code LIMIT 50"),
    "cross_source_association": _with(
        _CROSS + ", r AS (SELECT count(*) AS observation_count, count(DISTINCT geography_code) AS geography_count, min(calendar_year) AS year_min, max(calendar_year) AS year_max, CASE WHEN count(*) >= 3 AND stddev_pop(tv::DOUBLE) > 0 AND stddev_pop(sv::DOUBLE) > 0 THEN round(corr(tv::DOUBLE, sv::DOUBLE), 4) END AS pearson_correlation FROM x) "
        "SELECT *, 'total_price' AS primary_metric_code, 'supply_value' AS secondary_metric_code, 'Total price' AS primary_label, 'Supply value' AS secondary_label, CASE WHEN pearson_correlation IS NULL THEN 'insufficient_data' WHEN pearson_correlation > 0 THEN 'positive' WHEN pearson_correlation < 0 THEN 'negative' ELSE 'none' END AS relationship_direction, "
        "CASE WHEN pearson_correlation IS NULL OR observation_count < 5 THEN 'insufficient_data' WHEN abs(pearson_correlation) >= 0.7 THEN 'strong' WHEN abs(pearson_correlation) >= 0.4 THEN 'moderate' WHEN abs(pearson_correlation) >= 0.2 THEN 'weak' ELSE 'very_weak' END AS relationship_strength, 'not_established' AS causality_status FROM r"
    ),
    "category_map_filter": _with(f"SELECT f.calendar_year, count(*) AS facts, sum(value)::DOUBLE AS total FROM fact f JOIN place ON {_OF} WHERE measure_code = 'TOTAL_PRICE' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND (c_mktsegment LIKE 'BUI%' OR c_mktsegment = 'MACHINERY') GROUP BY 1"),
    "sandbox_two_dimensions": _sandbox_sql("avg", "calendar_year = 1997 AND period_type = 'year' AND pn = 'Totaal' AND sc = 'T009'"),
    "sandbox_annual_first": _sandbox_sql("sum", "calendar_year = 1997 AND period_type = 'year' AND pn IN ('1-URGENT', '5-LOW') AND sc = 'T009'"),
    "sandbox_two_grouped": _sandbox_sql("max", "calendar_year = 2000 AND pc = 'T001'", "sn"),
    "plan_by_bitmaps": PLAN_SQL["rank_geographies_by_category"],
    "contract_bitmaps": _with("SELECT 'urgent' AS contract, count(*) AS facts FROM place WHERE o_orderpriority = '1-URGENT' UNION ALL SELECT 'urgent_open', count(*) FROM place WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus = 'O' UNION ALL SELECT 'building', count(*) FROM place WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '3-MEDIUM' AND o_orderstatus IN ('F', 'P')"),
}
QUERIES = {n: globals()[n] for n in SQL}
