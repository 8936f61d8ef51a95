"""Raw rows to observations, dimensions, facts and their checks; upserts and other writes as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaystat.functions import rules
from quaystat.operators.hierarchy import ancestors
from quaystat.sources.mart import read

#: Properties of the raw order rows: which are dimensions, which measures.
DIMENSIONS, MEASURES = ("o_orderstatus", "o_orderpriority", "period"), ("o_totalprice", "o_custkey")


def raw_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(dataset_id, row_id, raw JSON): the orders as a dynamic source would give them. Every 50th has no measures."""
    o = read(spark, sf_dir, "orders")
    keep = F.col("o_orderkey") % 50 != 0
    fields = F.struct(
        "o_orderstatus", "o_orderpriority", F.concat(F.year("o_orderdate").cast("string"), F.lit("MM"), F.lpad(F.month("o_orderdate").cast("string"), 2, "0")).alias("period"),
        F.when(keep, F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("o_totalprice"), F.when(keep & (F.col("o_custkey") % 7 != 0), F.col("o_custkey").cast("string")).alias("o_custkey"),
    )
    return o.select(F.lit("ORDERS").alias("dataset_id"), F.col("o_orderkey").alias("row_id"), F.to_json(fields).alias("raw"))


def unpivoted(raw: DataFrame) -> DataFrame:
    """(dataset_id, row_id, property, value_text, role): one row for each property of each raw row."""
    cells = raw.select("dataset_id", "row_id", F.explode(F.from_json("raw", "map<string,string>")).alias("property", "value_text"))
    role = F.when(F.col("property").isin(*DIMENSIONS), "dimension").when(F.col("property").isin(*MEASURES), "measure")
    return cells.withColumn("role", role).filter("role is not null")


def silver_unpivot_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = unpivoted(raw_rows(spark, sf_dir)).filter("role = 'dimension'")
    return got.groupBy("property", "value_text").agg(F.count("*").alias("observations"))


def silver_unpivot_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = unpivoted(raw_rows(spark, sf_dir)).filter("role = 'measure'")
    number = F.col("value_text").try_cast("decimal(18,2)")
    return got.select("row_id", "property", number.cast("double").alias("value_numeric"), F.when(number.isNotNull(), "numeric").otherwise("text").alias("value_type"))


def silver_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without any measure, as the dead-letter sink gets them."""
    raw = raw_rows(spark, sf_dir)
    fine = unpivoted(raw).filter("role = 'measure' and value_text is not null").select("row_id")
    return raw.join(fine, "row_id", "left_anti").select("row_id", F.lit("no_measures").alias("reason"))


def silver_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period codes of four kinds with their first and last day."""
    o = read(spark, sf_dir, "orders")
    y = F.year("o_orderdate").cast("string")
    nr = lambda c: F.lpad(c.cast("string"), 2, "0")
    codes = F.array(F.concat(y, F.lit("JJ00")), F.concat(y, F.lit("KW"), nr(F.quarter("o_orderdate"))), F.concat(y, F.lit("MM"), nr(F.month("o_orderdate"))), F.concat(y, F.lit("HJ"), nr(F.ceil(F.month("o_orderdate") / 6).cast("int"))))
    got = o.select(F.explode(codes).alias("period_code")).groupBy("period_code").agg(F.count("*").alias("observations"))
    first, last = rules.period_bounds(F.col("period_code"))
    return got.select("period_code", rules.period_type(F.col("period_code")).alias("period_type"), first.cast("string").alias("period_start"), last.cast("string").alias("period_end"), "observations")


def unit_normalisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of all parts, whose unit texts are of many kinds, with scale, aggregation and value type."""
    texts = ["%", "procentpunt", "1 000 euro", "mln euro", "x 1 000", "aantal personen", "2021=100", "m²", "1 000 m3", "uren", "", "euro", "huishoudens", "kg"]
    text = F.element_at(F.array(*(F.lit(t) for t in texts)), (F.col("p_partkey") % len(texts) + 1).cast("int"))
    name = F.when(F.col("p_partkey") % len(texts) % 5 == 4, "Gemiddeld inkomen").otherwise("Waarde")
    df = read(spark, sf_dir, "part").groupBy(text.alias("unit"), name.alias("measure")).agg(F.count("*").alias("parts"))
    code = rules.unit_code(F.col("unit"), F.col("measure"))
    return df.select("unit", "measure", "parts", code.alias("unit_code")).select("*", rules.scale_factor(F.col("unit_code")).cast("long").alias("scale_factor"), rules.default_aggregation(F.col("unit_code"), F.col("measure")).alias("aggregation"), rules.value_type(F.col("unit_code")).alias("value_type"))


def missing_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    text = F.when(F.col("o_orderstatus") == "P", "x").when(F.col("o_orderkey") % 11 == 0, ".").otherwise(F.col("o_totalprice").cast("string"))
    missing, suppressed, status = rules.missing_flags(F.when(F.col("o_orderkey") % 11 != 0, F.col("o_totalprice")), text)
    return o.select(status.alias("status"), missing.alias("is_missing"), suppressed.alias("is_suppressed")).groupBy("status", "is_missing", "is_suppressed").agg(F.count("*").alias("cells"))


def geography_typing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and levels of codes made from nations, regions and others."""
    n, r = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    codes = n.select(F.concat(F.lit("GM"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0")).alias("code"), F.lit(None).cast("string").alias("declared"))
    codes = codes.unionByName(r.select(F.concat(F.lit("PV"), F.col("r_regionkey").cast("string")).alias("code"), F.lit("region").alias("declared")))
    codes = codes.unionByName(r.select(F.concat(F.lit("ZZ"), F.col("r_regionkey").cast("string")).alias("code"), F.when(F.col("r_regionkey") == 0, "Totaal").otherwise("Region").alias("declared")))
    kind = rules.geography_type(F.col("code"), F.col("declared"))
    return codes.select("code", kind.alias("geography_type"), rules.level_order(kind).cast("long").alias("level_order"))


def stable_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders")
    parts = [F.lit("ORDERS"), F.col("o_orderkey"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus"))]
    return o.select("o_orderkey", rules.stable_hash(*parts).alias("record_hash"), rules.stable_key(*parts).alias("record_key"))


def category_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of an order's categories, whatever their order; of none for some."""
    o = read(spark, sf_dir, "orders")
    pairs = F.when(F.col("o_orderkey") % 13 == 0, F.array().cast("array<string>")).otherwise(F.array(F.concat(F.lit("Status="), "o_orderstatus"), F.concat(F.lit("Priority="), "o_orderpriority")))
    return o.select(rules.combination_hash(pairs).alias("combination_hash")).groupBy("combination_hash").agg(F.count("*").alias("observations"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], curated: str | None = None) -> DataFrame:
    """Rows of both by key: new ones win. With a `curated` column, keys whose old one is true stay as they are, and a null new value leaves the old one."""
    cols = old.columns
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys]
    both = o.withColumn("__o", F.lit(True)).alias("o").join(n.withColumn("__n", F.lit(True)).alias("n"), on, "full")
    stay = F.col("n.__n").isNull() | (F.coalesce(F.col(f"o.{curated}"), F.lit(False)) if curated else F.lit(False))
    new = lambda c: F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")) if curated else F.col(f"n.{c}")
    return both.select(*(F.when(stay, F.col(f"o.{c}")).otherwise(new(c)).alias(c) for c in cols))


def _versions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", (F.col("c_custkey") % 10 == 0).alias("curated"))
    return c.filter(F.col("c_custkey") % 3 != 0), c.filter(F.col("c_custkey") % 3 != 1).withColumn("c_acctbal", F.col("c_acctbal") + 1000)


def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return upsert(old, new, ["c_custkey"])


def curated_precedence_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curated customers stay, others take the new balance, every eleventh of which is null and leaves the old one."""
    old, new = _versions(spark, sf_dir)
    new = new.withColumn("c_acctbal", F.when(F.col("c_custkey") % 11 != 0, F.col("c_acctbal")))
    return upsert(old, new, ["c_custkey"], "curated").withColumn("c_acctbal", F.coalesce("c_acctbal", F.lit(-1e9)))


def insert_if_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return old.unionByName(new.join(old, "c_custkey", "left_anti"))


def latest_version_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest event of each user and type, by one aggregate without a window."""
    e = read(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


def incremental_skip_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose (key, version) has not been loaded."""
    c = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 4).alias("version"))
    done = c.filter("c_custkey % 5 <> 0").withColumn("version", F.when(F.col("c_custkey") % 2 == 0, F.col("version")).otherwise(F.col("version") - 1))
    return c.join(done, ["c_custkey", "version"], "left_anti")


def key_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by customer after a remap of some customer keys."""
    remap = read(spark, sf_dir, "customer").filter("c_custkey % 9 = 0").select("c_custkey", (F.col("c_custkey") + 1_000_000).alias("new_key"))
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return o.join(remap, "c_custkey", "left").select(F.coalesce("new_key", "c_custkey").alias("customer_key")).groupBy("customer_key").agg(F.count("*").alias("orders"))


def near_keys(rows: DataFrame, key: str, label: str, width: int) -> DataFrame:
    """(key, other_key) of the rows of one label whose keys are not equal and at most `width` apart.

    Keys lie in blocks of that width, and a row meets the rows of its label in its own block and the two beside it: the work follows the number of rows
    and not the square of a label's.
    """
    block = F.floor(F.col(key) / F.lit(width)).cast("long")
    p = rows.select(key, label, block.alias("block"))
    q = rows.select(F.col(key).alias("other_key"), label, F.explode(F.array(block - 1, block, block + 1)).alias("block"))
    return p.join(q, [label, "block"]).filter((F.col("other_key") != F.col(key)) & (F.abs(F.col("other_key") - F.col(key)) <= width)).select(key, "other_key")


def band_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near keys under an equal label, only unambiguous matches; a part without a brand or type has no label."""
    p = read(spark, sf_dir, "part").select("p_partkey", F.lower(F.concat("p_brand", F.lit("/"), "p_type")).alias("label"))
    got = near_keys(p, "p_partkey", "label", 64)
    return got.withColumn("n", F.count("*").over(Window.partitionBy("p_partkey"))).filter("n = 1").select("p_partkey", "other_key")


def full_outer_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    s = read(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    return c.join(s, "nation", "full").select("nation", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


def duplicate_grain_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


def preview_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").orderBy("o_orderkey").limit(25).select("o_orderkey", "o_orderstatus", "o_totalprice")


def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").filter("o_orderkey > 500").orderBy("o_orderkey").limit(100).select("o_orderkey", "o_custkey")


def theme_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions over nations as a tree: (id, level, path), of any depth; orphans are roots."""
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    nodes = r.select(F.concat(F.lit("R"), F.col("r_regionkey").cast("string")).alias("id"), F.lit(None).cast("string").alias("parent"), F.col("r_name").alias("title"))
    nodes = nodes.unionByName(n.select(F.concat(F.lit("N"), F.col("n_nationkey").cast("string")).alias("id"), F.when(F.col("n_nationkey") != 3, F.concat(F.lit("R"), F.col("n_regionkey").cast("string"))).otherwise("R99").alias("parent"), F.col("n_name").alias("title")))
    t = ancestors(nodes)
    return t.select("id", (F.col("depth") - 1).cast("long").alias("level"), F.array_join("titles", " > ").alias("path"))


QUERIES = {
    f.__name__: f
    for f in (
        silver_unpivot_dimensions, silver_unpivot_measures, silver_rejected, silver_periods, unit_normalisation, missing_classification, geography_typing, stable_keys, category_hash, upsert_latest, curated_precedence_upsert,
        insert_if_absent, latest_version_dedup, incremental_skip_keys, key_remap, band_match, full_outer_levels, duplicate_grain_check, preview_rows, keyset_page, theme_hierarchy,
    )
}

_OLD = "old AS (SELECT c_custkey, c_acctbal, c_custkey % 10 = 0 AS curated FROM customer WHERE c_custkey % 3 <> 0), new AS (SELECT c_custkey, c_acctbal + 1000 AS c_acctbal, c_custkey % 10 = 0 AS curated FROM customer WHERE c_custkey % 3 <> 1)"
ORACLES = {
    "silver_unpivot_dimensions": "SELECT 'o_orderstatus' AS property, o_orderstatus AS value_text, count(*) AS observations FROM orders GROUP BY ALL UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY ALL UNION ALL SELECT 'period', strftime(o_orderdate, '%YMM%m'), count(*) FROM orders GROUP BY ALL",
    "silver_unpivot_measures": "SELECT o_orderkey AS row_id, 'o_totalprice' AS property, o_totalprice::DECIMAL(18,2)::DOUBLE AS value_numeric, 'numeric' AS value_type FROM orders WHERE o_orderkey % 50 <> 0 UNION ALL SELECT o_orderkey, 'o_custkey', o_custkey::DOUBLE, 'numeric' FROM orders WHERE o_orderkey % 50 <> 0 AND o_custkey % 7 <> 0",
    "silver_rejected": "SELECT o_orderkey AS row_id, 'no_measures' AS reason FROM orders WHERE o_orderkey % 50 = 0",
    "silver_periods": """WITH c AS (SELECT unnest([strftime(o_orderdate, '%YJJ00'), year(o_orderdate) || 'KW0' || quarter(o_orderdate), strftime(o_orderdate, '%YMM%m'), year(o_orderdate) || 'HJ0' || (CASE WHEN month(o_orderdate) <= 6 THEN 1 ELSE 2 END)]) AS period_code FROM orders),
        g AS (SELECT period_code, count(*) AS observations, substr(period_code, 1, 4)::INT AS y, substr(period_code, 5, 2) AS k, substr(period_code, 7, 2)::INT AS nr FROM c GROUP BY ALL),
        b AS (SELECT *, CASE k WHEN 'JJ' THEN make_date(y, 1, 1) WHEN 'KW' THEN make_date(y, nr * 3 - 2, 1) WHEN 'MM' THEN make_date(y, nr, 1) ELSE make_date(y, nr * 6 - 5, 1) END AS s FROM g)
        SELECT period_code, CASE k WHEN 'JJ' THEN 'year' WHEN 'KW' THEN 'quarter' WHEN 'MM' THEN 'month' ELSE 'half_year' END AS period_type, s::VARCHAR AS period_start,
               (CASE k WHEN 'JJ' THEN s + INTERVAL 12 MONTH WHEN 'KW' THEN s + INTERVAL 3 MONTH WHEN 'MM' THEN s + INTERVAL 1 MONTH ELSE s + INTERVAL 6 MONTH END - INTERVAL 1 DAY)::DATE::VARCHAR AS period_end, observations FROM b""",
    "unit_normalisation": """WITH u AS (SELECT unnest(['%', 'procentpunt', '1 000 euro', 'mln euro', 'x 1 000', 'aantal personen', '2021=100', 'm²', '1 000 m3', 'uren', '', 'euro', 'huishoudens', 'kg']) AS unit, generate_subscripts(['%', 'procentpunt', '1 000 euro', 'mln euro', 'x 1 000', 'aantal personen', '2021=100', 'm²', '1 000 m3', 'uren', '', 'euro', 'huishoudens', 'kg'], 1) AS k),
        t AS (SELECT unit, (SELECT count(*) FROM part WHERE p_partkey % 14 = k - 1) AS parts, CASE WHEN k % 5 = 0 THEN 'Gemiddeld inkomen' ELSE 'Waarde' END AS measure, lower(unit || ' ' || CASE WHEN k % 5 = 0 THEN 'Gemiddeld inkomen' ELSE 'Waarde' END) AS x FROM u),
        c AS (SELECT unit, measure, parts, CASE WHEN trim(unit) = '' THEN 'UNKNOWN' WHEN regexp_matches(x, 'procentpunt|percentage point') THEN 'PERCENTAGE_POINTS' WHEN regexp_matches(x, '%|percentage|procent') THEN 'PERCENT' WHEN regexp_matches(x, 'mln euro|million euro') THEN 'EUR_MILLIONS' WHEN regexp_matches(x, '1 000 euro|1000 euro|eur1000') THEN 'EUR_THOUSANDS' WHEN contains(x, 'eur') THEN 'EUR'
          WHEN regexp_matches(x, 'index|\\b\\d{4}\\s*=\\s*100\\b') THEN 'INDEX' WHEN regexp_matches(x, 'm²|m2') THEN 'SQUARE_METERS' WHEN regexp_matches(x, 'm³|m3') THEN 'CUBIC_METERS' WHEN regexp_matches(x, 'uren|hours') THEN 'HOURS' WHEN contains(x, '1 000') THEN 'THOUSANDS' WHEN regexp_matches(x, 'personen|people|inwoners') THEN 'PERSONS' WHEN contains(x, 'huishoudens') THEN 'HOUSEHOLDS' WHEN regexp_matches(x, 'aantal|count|number|woningen|bedrijven|objecten') THEN 'COUNT' ELSE 'UNKNOWN' END AS unit_code FROM t)
        SELECT *, CASE WHEN unit_code IN ('EUR_THOUSANDS', 'THOUSANDS') THEN 1000 WHEN unit_code = 'EUR_MILLIONS' THEN 1000000 ELSE 1 END::BIGINT AS scale_factor, CASE WHEN unit_code IN ('PERCENT', 'PERCENTAGE_POINTS', 'INDEX') OR regexp_matches(lower(measure), 'gemiddeld|average|mediaan|index') THEN 'average' WHEN unit_code IN ('COUNT', 'PERSONS', 'HOUSEHOLDS', 'THOUSANDS') OR contains(unit_code, 'EUR') THEN 'sum' ELSE 'none' END AS aggregation,
          CASE WHEN unit_code = 'PERCENT' THEN 'percentage' WHEN contains(unit_code, 'EUR') THEN 'currency' WHEN unit_code = 'INDEX' THEN 'index' WHEN unit_code IN ('COUNT', 'PERSONS', 'HOUSEHOLDS') THEN 'count' ELSE 'decimal' END AS value_type FROM c""",
    "missing_classification": "SELECT CASE WHEN o_orderstatus = 'P' THEN 'suppressed' WHEN o_orderkey % 11 = 0 THEN 'missing' ELSE 'reported' END AS status, o_orderstatus = 'P' OR o_orderkey % 11 = 0 AS is_missing, o_orderstatus = 'P' AS is_suppressed, count(*) AS cells FROM orders GROUP BY ALL",
    "geography_typing": "SELECT 'GM' || lpad(n_nationkey::VARCHAR, 4, '0') AS code, 'municipality' AS geography_type, 1::BIGINT AS level_order FROM nation UNION ALL SELECT 'PV' || r_regionkey, 'province', 3 FROM region UNION ALL SELECT 'ZZ' || r_regionkey, CASE WHEN r_regionkey = 0 THEN 'country' ELSE 'region' END, CASE WHEN r_regionkey = 0 THEN 5 ELSE 2 END FROM region",
    "stable_keys": "SELECT o_orderkey, sha256(t) AS record_hash, ('0x' || substr(sha256(t), 1, 15))::BIGINT AS record_key FROM (SELECT o_orderkey, 'ORDERS|' || o_orderkey || '|' || CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus ELSE '' END AS t FROM orders)",
    "category_hash": "SELECT sha256(CASE WHEN o_orderkey % 13 = 0 THEN 'NO_CATEGORIES' ELSE 'Priority=' || o_orderpriority || '|Status=' || o_orderstatus END) AS combination_hash, count(*) AS observations FROM orders GROUP BY ALL",
    "upsert_latest": f"WITH {_OLD} SELECT * FROM new UNION ALL SELECT * FROM old WHERE c_custkey NOT IN (SELECT c_custkey FROM new)",
    "curated_precedence_upsert": f"WITH {_OLD} SELECT coalesce(n.c_custkey, o.c_custkey) AS c_custkey, coalesce(CASE WHEN o.curated OR n.c_custkey IS NULL OR n.c_custkey % 11 = 0 THEN o.c_acctbal ELSE n.c_acctbal END, -1e9::DOUBLE) AS c_acctbal, coalesce(o.curated, n.curated) AS curated FROM old o FULL JOIN new n ON o.c_custkey = n.c_custkey",
    "insert_if_absent": f"WITH {_OLD} SELECT * FROM old UNION ALL SELECT * FROM new WHERE c_custkey NOT IN (SELECT c_custkey FROM old)",
    "latest_version_dedup": "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "incremental_skip_keys": "SELECT c_custkey, c_custkey % 4 AS version FROM customer WHERE c_custkey % 5 = 0 OR c_custkey % 2 <> 0",
    "key_remap": "SELECT CASE WHEN o_custkey % 9 = 0 THEN o_custkey + 1000000 ELSE o_custkey END AS customer_key, count(*) AS orders FROM orders GROUP BY ALL",
    "band_match": "WITH p AS (SELECT p_partkey, lower(p_brand || '/' || p_type) AS label FROM part), g AS (SELECT a.p_partkey, b.p_partkey AS other_key FROM p a JOIN p b ON a.label = b.label AND a.p_partkey <> b.p_partkey AND b.p_partkey BETWEEN a.p_partkey - 64 AND a.p_partkey + 64) SELECT * FROM g QUALIFY count(*) OVER (PARTITION BY p_partkey) = 1",
    "full_outer_levels": "SELECT coalesce(a.k, b.k) AS nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS customers FROM customer WHERE c_custkey % 2 = 0 GROUP BY 1) a FULL JOIN (SELECT s_nationkey AS k, count(*) AS suppliers FROM supplier GROUP BY 1) b ON a.k = b.k",
    "duplicate_grain_check": "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "preview_rows": "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25",
    "keyset_page": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 500 ORDER BY o_orderkey LIMIT 100",
    "theme_hierarchy": "SELECT 'R' || r_regionkey AS id, 0::BIGINT AS level, r_name AS path FROM region UNION ALL SELECT 'N' || n_nationkey, CASE WHEN n_nationkey = 3 THEN 0 ELSE 1 END, CASE WHEN n_nationkey = 3 THEN n_name ELSE r_name || ' > ' || n_name END FROM nation JOIN region ON n_regionkey = r_regionkey",
}
