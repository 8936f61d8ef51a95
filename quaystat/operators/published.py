"""Queries of source mappers and of the public side, with DuckDB oracles.

Orders stand for raw records of two sources and events for those of a third; suppliers stand for data sets and their order lines for values and loads.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystat.operators import mappers, publishing
from quaystat.sources.mart import read

PROVIDER = "statistics"


def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four of five nations as municipalities and all regions as provinces."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    towns = n.join(r, n.n_regionkey == r.r_regionkey).filter("n_nationkey % 5 <> 4")
    towns = towns.select(F.format_string("%04d", "n_nationkey").alias("code"), F.col("n_name").alias("name"), F.col("r_name").alias("province"), F.concat(F.lit("NL"), F.col("n_nationkey").cast("string")).alias("nuts3"))
    none = F.lit(None).cast("string")
    return towns.unionByName(r.select(F.concat(F.lit("PV2"), F.col("r_regionkey").cast("string")).alias("code"), F.col("r_name").alias("name"), none.alias("province"), none.alias("nuts3")))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return o.join(c, o.o_custkey == c.c_custkey)


def _flat(df: DataFrame) -> DataFrame:
    """Structs as columns, their numbers as text, and of the lineage what it comes from, its version and the names of its fields."""
    out = []
    for f in df.schema:
        if f.name == "lineage":
            names = F.transform("lineage.field_mappings", lambda m: F.concat_ws(">", m["source_field"], m["target_field"]))
            out += [F.col("lineage.provenance").alias("provenance"), F.col("lineage.mapper_version").alias("mapper_version"), F.array_join(names, ",").alias("mappings")]
        elif f.dataType.typeName() == "struct":
            out += [F.col(f"{f.name}.{g.name}").cast("string").alias(f"{f.name}_{g.name}") for g in f.dataType]
        else:
            out.append(F.col(f.name))
    return df.select(*out)


def statistics_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records of municipalities, provinces and the country by years, quarters, months and what is none of them."""
    k, n = F.col("o_orderkey"), F.col("c_nationkey")
    town = F.format_string("GM%04d ", n)
    code = F.when(k % 7 == 0, "NL01").when(k % 7 == 1, F.concat(F.lit("PV2"), (n % 8).cast("string"))).when(k % 7 == 2, F.format_string("%04d", n)).when(k % 7 == 3, F.lit(None)).otherwise(town)
    year, month = F.date_format("o_orderdate", "yyyy"), F.month("o_orderdate")
    part = F.when(k % 5 == 0, "JJ00").when(k % 5 == 1, F.format_string("KW%02d", F.quarter("o_orderdate"))).when(k % 5 == 2, F.format_string("mm%02d", month)).when(k % 5 == 3, "HJ01").otherwise(F.format_string("KW%02d", month))
    raw = _orders(spark, sf_dir).select(
        k.alias("order"), code.alias("region_code"), F.concat(year, part).alias("period_code"), (F.col("o_custkey") % 300).alias("inhabitants"), F.floor(F.col("o_custkey") % 300 / 3).alias("aged_65"),
        F.when(k % 3 != 0, F.col("o_custkey").cast("double")).alias("income"), F.floor("o_totalprice").alias("home_value"), k.alias("dwellings"), (k % 90).alias("density"),
    )
    return _flat(mappers.mapped(raw, mappers.STATISTICS, F.concat(F.lit("orders:"), F.col("order").cast("string")), registry(spark, sf_dir)))


def valuation_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as valuations of homes in municipalities, of which the registry lacks some."""
    k = F.col("o_orderkey")
    code = F.when(k % 9 != 0, F.format_string("%04d", "c_nationkey")).otherwise("PV21")
    raw = _orders(spark, sf_dir).select(
        k.alias("order"), code.alias("municipality_code"), F.when(k % 8 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("reference_day"), F.floor("o_totalprice").alias("value"), (k % 400).alias("surface"), (F.col("o_custkey") % 200 + 1800).alias("built")
    )
    return _flat(mappers.mapped(raw, mappers.VALUATIONS, F.concat(F.lit("orders:"), F.col("order").cast("string")), registry(spark, sf_dir)))


def climate_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as daily climate records of the users' stations, with traces, gaps and days that do not exist."""
    e, k = read(spark, sf_dir, "events"), F.col("event_id")
    tenths = lambda n: F.when(k % n == 0, F.lit(-1.0)).when(k % n != 1, F.floor("value").cast("double"))
    day = F.when(k % 13 == 0, F.lit(20240230)).otherwise(F.date_format("ts", "yyyyMMdd").cast("int"))
    raw = e.select(k, F.col("user_id").alias("station"), day.alias("day"), *(tenths(n).alias(c) for c, n in (("mean_temp", 9), ("max_temp", 11), ("min_temp", 12), ("rain", 10))))
    return _flat(mappers.mapped(raw, mappers.CLIMATE, F.concat(F.lit("events:"), k.cast("string"))))


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("S"), k.cast("string")).alias("dataset_id"), F.when(k % 9 != 0, F.col("s_name")).alias("title"), F.when(k % 5 == 0, "").when(k % 5 != 1, F.concat("s_name", F.lit(" kort"))).alias("short_title"),
        F.when(k % 4 == 1, "Cijfers 1990 tot 2003").when(k % 4 != 0, "Cijfers").alias("short_description"), F.when(k % 3 == 0, "1992 - 1998").alias("period"), F.when(k % 2 == 0, "2001-01-01").alias("updated_at"),
    )


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").withColumn("dataset_id", F.concat(F.lit("S"), F.col("l_suppkey").cast("string")))


def dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periods, places and brands of two of three data sets."""
    own = read(spark, sf_dir, "supplier").filter("s_suppkey % 3 <> 2").select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("dataset_id"), F.col("s_suppkey").alias("k"))
    one = lambda key, title, kind: F.struct(F.lit(key).alias("dimension_key"), title.cast("string").alias("title"), F.lit(kind).cast("string").alias("type"))
    three = F.array(one("Perioden", F.lit(None), "TimeDimension"), one("RegioS", F.lit("Regio"), "GeoDimension"), one("Merk", F.when(F.col("k") % 2 == 0, "").otherwise("Brand"), None))
    return own.select("dataset_id", F.inline(three), (F.col("k") % 40).alias("values_count"))


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months, places and parts of the lines; some data sets have no months, some no places."""
    k, n = F.col("l_suppkey"), F.col("l_linenumber")
    none = F.lit(None).cast("string")
    one = lambda key, value, title=none: F.struct(F.lit(key).alias("dimension_key"), value.alias("value_key"), title.alias("title"), none.alias("description"))
    place = F.when(n == 1, "NL01").when(n == 2, "PV20").when(n == 3, F.format_string("GM%04d", k)).when(n == 4, "BU00010001").otherwise("X")
    month = F.when(k % 4 < 2, F.date_format("l_shipdate", "yyyy'MM'MM"))
    each = F.array(one("Perioden", month), one("RegioS", F.when(n <= k % 6, place)), one("Merk", F.lit("1999")))
    return _lines(spark, sf_dir).select("dataset_id", F.inline(each))


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loads of the data sets: returned lines of some are rejected, of others missing; what was expected of some is unknown."""
    k = F.col("k")
    per = _lines(spark, sf_dir).groupBy("dataset_id", F.col("l_suppkey").alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("r"), F.max(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("last_loaded_at"))
    state = F.element_at(F.array(*(F.lit(s) for s in ("complete", "partial", "failed", "completed", "metadata_loaded", None))), (k % 6 + 1).cast("int"))
    return per.select(
        "dataset_id", state.alias("status"), F.when(k % 10 != 7, k % 3).alias("dimensions"), F.when(k % 10 != 7, k % 2).alias("measures"), F.when(k % 11 != 0, F.col("n")).alias("expected_observations"),
        F.when(k % 7 == 0, 0).otherwise(F.col("n") - F.col("r")).cast("long").alias("observations_loaded"), F.when(k % 4 == 0, F.col("r")).alias("rejected_rows"), "last_loaded_at",
    )


def public_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = publishing.catalogue(datasets(spark, sf_dir), dimensions(spark, sf_dir), values(spark, sf_dir), status(spark, sf_dir), PROVIDER)
    text = lambda x, by: F.array_join(F.col(x).cast("array<string>"), by).alias(x)
    whole = {x: F.col(x).cast("string") for x in ("record_count", "year_start", "year_end")}
    return c.withColumns(whole).withColumns({"years": text("years", ","), "geographic_levels": text("geographic_levels", ","), "qualification_evidence": text("qualification_evidence", "; ")})


def public_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publishing.dimension_rows(datasets(spark, sf_dir).filter("period is not null"), dimensions(spark, sf_dir))


def public_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publishing.check_rows(status(spark, sf_dir))


def public_layer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = publishing.layer_summary(publishing.quality(status(spark, sf_dir)), PROVIDER)
    return s.withColumn("quality_statuses", F.array_join(F.transform(F.map_entries("quality_statuses"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ","))


_REGISTRY = """towns AS (SELECT printf('%04d', n_nationkey) AS code, n_name AS name, r_name AS province, 'NL' || n_nationkey AS nuts3 FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 4),
provinces AS (SELECT 'PV2' || r_regionkey AS code, r_name AS name, NULL AS province, NULL AS nuts3 FROM region)"""
_SETS = """sets AS (SELECT s_suppkey AS k, 'S' || s_suppkey AS dataset_id, CASE WHEN s_suppkey % 9 <> 0 THEN s_name END AS title, CASE WHEN s_suppkey % 5 = 0 THEN '' WHEN s_suppkey % 5 <> 1 THEN s_name || ' kort' END AS short_title,
  CASE s_suppkey % 4 WHEN 1 THEN 'Cijfers 1990 tot 2003' WHEN 0 THEN NULL ELSE 'Cijfers' END AS short_description, CASE WHEN s_suppkey % 3 = 0 THEN '1992 - 1998' END AS period, CASE WHEN s_suppkey % 2 = 0 THEN '2001-01-01' END AS updated_at FROM supplier)"""
_STATUS = """status AS (SELECT l_suppkey AS k, 'S' || l_suppkey AS dataset_id, ['complete', 'partial', 'failed', 'completed', 'metadata_loaded', NULL][l_suppkey % 6 + 1] AS status, CASE WHEN l_suppkey % 10 <> 7 THEN l_suppkey % 3 END AS dims,
  CASE WHEN l_suppkey % 10 <> 7 THEN l_suppkey % 2 END AS measures, CASE WHEN l_suppkey % 11 <> 0 THEN count(*) END AS expected, CASE WHEN l_suppkey % 7 = 0 THEN 0 ELSE count(*) FILTER (l_returnflag <> 'R') END AS loaded,
  CASE WHEN l_suppkey % 4 = 0 THEN count(*) FILTER (l_returnflag = 'R') ELSE 0 END AS rejected, max(l_shipdate)::DATE::VARCHAR AS last_loaded_at FROM lineitem GROUP BY l_suppkey)"""
_CHECKS = """checks AS (SELECT dataset_id, 'metadata_present' AS check_name, CASE WHEN dims > 0 OR measures > 0 THEN 'pass' ELSE 'fail' END AS status, NULL AS expected_value, coalesce(dims || ' dimensions, ' || measures || ' measures', 'none') AS actual_value FROM status
  UNION ALL SELECT dataset_id, 'rows_match_source', CASE WHEN expected IS NULL THEN 'warn' WHEN loaded + rejected >= expected THEN 'pass' WHEN loaded > 0 THEN 'warn' ELSE 'fail' END, expected::VARCHAR, (loaded + rejected)::VARCHAR FROM status
  UNION ALL SELECT dataset_id, 'rejected_rows', CASE WHEN rejected > 0 THEN 'warn' ELSE 'pass' END, '0', rejected::VARCHAR FROM status
  UNION ALL SELECT dataset_id, 'status_terminal', CASE WHEN status IN ('complete', 'complete_with_warnings', 'partial', 'metadata_loaded') THEN 'pass' ELSE 'warn' END, NULL, status FROM status)"""

ORACLES = {
    "statistics_records": f"""WITH {_REGISTRY}, known AS (SELECT * FROM towns UNION ALL SELECT * FROM provinces),
raw AS (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice, year(o_orderdate) AS y, month(o_orderdate) AS m, quarter(o_orderdate) AS q,
  CASE o_orderkey % 7 WHEN 0 THEN 'NL01' WHEN 1 THEN 'PV2' || c_nationkey % 8 WHEN 2 THEN printf('%04d', c_nationkey) WHEN 3 THEN NULL ELSE printf('GM%04d', c_nationkey) END AS source FROM orders JOIN customer ON o_custkey = c_custkey),
span AS (SELECT *, CASE k % 5 WHEN 1 THEN q WHEN 4 THEN CASE WHEN m <= 4 THEN m END END AS pq, CASE WHEN k % 5 = 2 THEN m END AS pm, CASE WHEN source LIKE 'GM%' THEN substr(source, 3) ELSE source END AS code,
  y || CASE k % 5 WHEN 0 THEN 'JJ00' WHEN 1 THEN printf('KW%02d', q) WHEN 2 THEN printf('mm%02d', m) WHEN 3 THEN 'HJ01' ELSE printf('KW%02d', m) END AS period FROM raw)
SELECT source AS region_source_code, code AS region_code, CASE WHEN source = 'NL01' THEN 'country' WHEN source LIKE 'PV%' THEN 'province' WHEN source LIKE 'GM%' THEN 'municipality' WHEN source IS NOT NULL THEN 'other' END AS region_level,
 coalesce(name, CASE WHEN source = 'NL01' THEN 'Nederland' END, 'Unknown region (' || code || ')') AS region_name, province AS region_province, nuts3 AS region_nuts3,
 period AS period_source_code, y::VARCHAR AS period_year, pq::VARCHAR AS period_quarter, pm::VARCHAR AS period_month, CASE WHEN pq IS NOT NULL THEN 'quarterly' WHEN pm IS NOT NULL THEN 'monthly' ELSE 'annual' END AS period_granularity,
 make_date(y, coalesce(pq * 3 - 2, pm, 1), 1)::VARCHAR AS period_iso_start, last_day(make_date(y, coalesce(pq * 3, pm, 12), 1))::VARCHAR AS period_iso_end,
 c % 300 AS population, c % 300 // 3 AS population_65_plus, CASE WHEN c % 300 <> 0 THEN round((c % 300 // 3)::DOUBLE / (c % 300) * 10000) / 100 END AS pct_65_plus, CASE WHEN k % 3 <> 0 THEN c::DOUBLE END AS avg_income_eur,
 floor(o_totalprice)::BIGINT * 1000 AS avg_home_value_eur, k AS dwelling_count, k % 90 AS density_per_km2, 'orders:' || k AS provenance, 'statistics@1.0.0' AS mapper_version,
 'region_code>region,period_code>period,inhabitants>population,aged_65>population_65_plus,aged_65>pct_65_plus,income>avg_income_eur,home_value>avg_home_value_eur,dwellings>dwelling_count,density>density_per_km2' AS mappings
FROM span LEFT JOIN known USING (code)""",
    "valuation_records": f"""WITH {_REGISTRY}, raw AS (SELECT *, CASE WHEN o_orderkey % 9 <> 0 THEN printf('%04d', c_nationkey) ELSE 'PV21' END AS code, CASE WHEN o_orderkey % 8 <> 0 THEN o_orderdate::DATE::VARCHAR END AS d FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT code AS region_source_code, code AS region_code, 'municipality' AS region_level, coalesce(name, 'Unknown municipality (' || code || ')') AS region_name, province AS region_province, nuts3 AS region_nuts3, d AS assessment_date,
 d AS period_source_code, year(d::DATE)::VARCHAR AS period_year, NULL::VARCHAR AS period_quarter, NULL::VARCHAR AS period_month, CASE WHEN d IS NOT NULL THEN 'annual' END AS period_granularity, substr(d, 1, 4) || '-01-01' AS period_iso_start, substr(d, 1, 4) || '-12-31' AS period_iso_end,
 floor(o_totalprice)::BIGINT AS value_eur, o_orderkey % 400 AS surface_m2, o_custkey % 200 + 1800 AS construction_year, 'orders:' || o_orderkey AS provenance, 'valuations@1.0.0' AS mapper_version,
 'municipality_code>region,reference_day>assessment_date,reference_day>period,value>value_eur,surface>surface_m2,built>construction_year' AS mappings
FROM raw LEFT JOIN towns USING (code)""",
    "climate_records": """WITH e AS (SELECT *, floor(value) AS v, CASE WHEN event_id % 13 <> 0 THEN ts::DATE END AS d FROM events)
SELECT user_id AS station_id, CASE WHEN d IS NULL THEN '20240230' ELSE strftime(d, '%Y%m%d') END AS period_source_code, year(d)::VARCHAR AS period_year, NULL::VARCHAR AS period_quarter, month(d)::VARCHAR AS period_month, 'daily' AS period_granularity, d::VARCHAR AS period_iso_start, d::VARCHAR AS period_iso_end,
 CASE WHEN event_id % 9 > 1 AND v <> -1 THEN v / 10 END AS mean_temp_c, CASE WHEN event_id % 11 > 1 AND v <> -1 THEN v / 10 END AS max_temp_c, CASE WHEN event_id % 12 > 1 AND v <> -1 THEN v / 10 END AS min_temp_c,
 CASE WHEN event_id % 10 = 0 THEN 0 WHEN event_id % 10 > 1 THEN CASE WHEN v = -1 THEN 0 ELSE v / 10 END END AS precipitation_mm, 'events:' || event_id AS provenance, 'climate@1.0.0' AS mapper_version,
 'station>station_id,day>period,mean_temp>mean_temp_c,max_temp>max_temp_c,min_temp>min_temp_c,rain>precipitation_mm' AS mappings FROM e""",
    "public_catalogue": f"""WITH {_SETS}, {_STATUS},
v AS (SELECT l_suppkey AS k, CASE WHEN l_suppkey % 4 < 2 THEN year(l_shipdate) END AS y, CASE WHEN l_linenumber <= l_suppkey % 6 THEN CASE l_linenumber WHEN 1 THEN 'country' WHEN 2 THEN 'province' WHEN 3 THEN 'municipality' WHEN 4 THEN 'neighborhood' END END AS lv FROM lineitem WHERE l_suppkey % 3 <> 2),
f AS (SELECT k, list_sort(list(DISTINCT y) FILTER (y BETWEEN 1970 AND 2026)) AS own, list_sort(list(DISTINCT lv) FILTER (lv IS NOT NULL)) AS levels FROM v GROUP BY k),
t AS (SELECT s.*, loaded AS record_count, coalesce(levels, []) AS levels, coalesce(own, []) AS own, CASE WHEN period IS NOT NULL THEN range(1992, 1999) ELSE [] END AS named, CASE WHEN s.k % 4 = 1 THEN range(1990, 2004) ELSE [] END AS told FROM sets s LEFT JOIN f USING (k) LEFT JOIN status USING (k)),
y AS (SELECT *, CASE WHEN len(own) > 0 THEN own WHEN len(named) > 0 THEN named ELSE told END AS years, CASE WHEN len(own) > 0 THEN 'perioden-dimension' WHEN len(named) > 0 THEN 'catalog-period' WHEN len(told) > 0 THEN 'catalog-text' ELSE 'none' END AS src,
  CASE WHEN list_has_all(levels, ['country', 'municipality', 'neighborhood']) THEN 'Netherlands — all municipalities, wijken and buurten' WHEN list_has_all(levels, ['country', 'province', 'municipality']) THEN 'Netherlands — country, provinces and municipalities'
   WHEN list_contains(levels, 'province') THEN 'Netherlands — provinces' WHEN list_contains(levels, 'municipality') THEN 'Netherlands — municipalities' WHEN list_contains(levels, 'country') THEN 'Netherlands — country' WHEN list_contains(levels, 'neighborhood') THEN 'Netherlands — wijken and buurten' END AS cover FROM t)
SELECT dataset_id, '{PROVIDER}' AS provider, coalesce(nullif(short_title, ''), title, dataset_id) AS title, coalesce(short_description, title, dataset_id) AS description, updated_at, record_count::VARCHAR AS record_count, list_min(years)::VARCHAR AS year_start, list_max(years)::VARCHAR AS year_end,
 array_to_string(years, ',') AS years, array_to_string(levels, ',') AS geographic_levels, cover AS spatial_coverage, src AS period_source, CASE WHEN k % 3 <> 2 THEN 'source-metadata' WHEN len(years) > 0 THEN 'partial-metadata' ELSE 'unqualified' END AS qualification_confidence,
 concat_ws('; ', CASE WHEN src = 'perioden-dimension' THEN 'Years from the period dimension' ELSE 'No period dimension found' END, CASE WHEN src = 'catalog-period' THEN 'Years expanded from the catalogue''s period' END, CASE WHEN src = 'catalog-text' THEN 'Years inferred from title and description' END,
  CASE WHEN len(levels) > 0 THEN 'Geographic levels from dimension values' ELSE 'No geography dimension values identified' END, 'Spatial coverage: ' || cover, CASE WHEN record_count IS NULL THEN 'Record count unavailable' ELSE 'Record count from observations loaded' END) AS qualification_evidence FROM y""",
    "public_dimensions": """SELECT 'S' || s_suppkey AS dataset_id, unnest(['Perioden', 'RegioS', 'Merk']) AS dimension_key, unnest(['Perioden', 'Regio', CASE WHEN s_suppkey % 2 = 0 THEN 'Merk' ELSE 'Brand' END]) AS title, unnest(['TimeDimension', 'GeoDimension', 'Dimension']) AS type, s_suppkey % 40 AS values_count
 FROM supplier WHERE s_suppkey % 3 = 0""",
    "public_checks": f"WITH {_STATUS}, {_CHECKS} SELECT dataset_id, 'silver' AS layer, check_name, status, expected_value, actual_value FROM checks",
    "public_layer_summary": f"""WITH {_STATUS}, {_CHECKS}, q AS (SELECT dataset_id, CASE WHEN bool_or(status = 'fail') THEN 'failed' WHEN bool_or(status = 'warn') THEN 'warning' ELSE 'passed' END AS quality FROM checks GROUP BY dataset_id),
g AS (SELECT string_agg(quality || '=' || n, ',' ORDER BY quality) AS quality_statuses FROM (SELECT quality, count(*) AS n FROM q GROUP BY quality)),
s AS (SELECT count(*) AS n, count(*) FILTER (status IN ('complete', 'completed')) AS complete, count(*) FILTER (status = 'partial') AS partial, count(*) FILTER (status = 'failed') AS failed, sum(expected)::BIGINT AS expected, sum(loaded)::BIGINT AS loaded, sum(rejected)::BIGINT AS rejected, max(last_loaded_at) AS last FROM status)
SELECT '{PROVIDER}' AS provider, 'silver' AS layer, CASE WHEN failed > 0 OR rejected > 0 THEN 'complete_with_warnings' WHEN partial > 0 THEN 'partial' WHEN complete > 0 THEN 'complete' ELSE 'pending' END AS status, n AS datasets_total, complete AS datasets_complete, partial AS datasets_partial, failed AS datasets_failed,
 expected AS records_expected, loaded AS records_loaded, least(100.0::DOUBLE, round((loaded + rejected)::DOUBLE / expected * 100, 2)) AS completeness_pct, rejected AS rejected_rows, last AS last_loaded_at, quality_statuses FROM s, g""",
}
QUERIES = {n: globals()[n] for n in ORACLES}
