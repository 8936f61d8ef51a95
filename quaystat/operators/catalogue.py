"""File sources that resume, row numbers, index build, the metric catalogue with its reviews, and metadata of a metric."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaystat.functions import domain, rules
from quaystat.operators.gold import without_stale
from quaystat.operators.pipeline import upsert
from quaystat.sources import mart
from quaystat.sources.mart import SQL, read
from quaystat.store import scratch


def with_row_index(df: DataFrame, order: str, name: str = "row_index") -> DataFrame:
    """Numbers from 0 in the order of a column without a single-task sort: ranges are sorted apart, and the counts of the
    ranges before (one row for each) are added. The ranges are written once, so that both uses see the same."""
    path = scratch(df.sparkSession, "ranges")
    ranged = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("__m", F.monotonically_increasing_id())
    ranged.write.parquet(path)
    part = df.sparkSession.read.schema(ranged.schema).parquet(path).withColumn("__p", F.shiftright("__m", 33))
    part = part.withColumn("__i", F.col("__m") - F.shiftleft(F.col("__p"), 33))
    counts = part.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    return part.join(F.broadcast(before), "__p").withColumn(name, F.col("__i") + F.col("__b")).drop("__p", "__m", "__i", "__b")


def read_pages(spark: SparkSession, path: str, schema: str, after: int | None = None, page_rows: int = 500) -> DataFrame:
    """Rows of JSON page files in folders page=N behind a row index; only folders that can have such rows are read."""
    pages = spark.read.schema(f"{schema}, page long").json(path)
    return pages if after is None else pages.filter((F.col("page") >= (after + 1) // page_rows) & (F.col("row_index") > after))


def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_row_index(read(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey")


def paged_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as pages of 500 rows, read on behind row 1249 with two columns and a filter."""
    path = scratch(spark, "pages")
    e = with_row_index(read(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), "event_id")
    e.withColumn("page", F.floor(F.col("row_index") / 500)).write.partitionBy("page").json(path)
    rest = read_pages(spark, path, "event_id long, event_type string, user_id long, row_index long", 1249)
    return rest.filter("event_type = 'purchase'").select("row_index", "user_id")


def domain_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A list of domains with aliases, one JSON document over several lines, and the themes it names."""
    path = scratch(spark, "domains")
    text = '[{"id": "trade",\n "aliases": ["BUILDING", "Machinery"]},\n {"id": "home", "aliases": ["household"]}]'
    spark.range(1).select(F.lit(text).alias("value")).coalesce(1).write.text(path)
    config = spark.read.option("multiLine", True).schema("id string, aliases array<string>").json(path)
    names = config.select("id", F.explode("aliases").alias("alias"))
    c = read(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("customers"))
    return c.join(F.broadcast(names), F.upper("c_mktsegment") == F.upper("alias"), "left").select("c_mktsegment", F.coalesce("id", F.lit("none")).alias("domain"), "customers")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(document_id, kind, title, text) of six kinds of objects."""
    make = lambda t, kind, key, title, text: read(spark, sf_dir, t).select(F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("document_id"), F.lit(kind).alias("kind"), title.cast("string").alias("title"), text.cast("string").alias("text"))
    parts = [
        make("part", "metric", "p_partkey", F.col("p_name"), F.concat_ws(" ", "p_type", "p_brand")),
        make("supplier", "dataset", "s_suppkey", F.col("s_name"), F.lit("supplier")),
        make("customer", "customer", "c_custkey", F.col("c_name"), F.col("c_mktsegment")),
        make("nation", "geography", "n_nationkey", F.col("n_name"), F.lit("nation")),
        make("region", "region", "r_regionkey", F.col("r_name"), F.lit("region")),
        make("benchmark", "question", "item_id", F.substring("text", 1, 40), F.col("text")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index after a build: changed documents renewed, new ones added, those that are gone removed."""
    docs = _documents(spark, sf_dir)
    h = F.conv(F.substring(F.md5("document_id"), 29, 4), 16, 10).cast("long")
    stored = docs.filter(h % 3 != 0).withColumn("title", F.concat(F.lit("old "), "title"))
    current = docs.filter(h % 4 != 0)
    index = upsert(without_stale(stored, current, ["document_id"]), current, ["document_id"])
    return index.groupBy("kind").agg(F.count("*").alias("documents"), F.sum(F.length("title")).alias("title_chars"), F.count_if(F.col("title").startswith("old ")).alias("old"))


def _reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of parts: what orders say of them, newest last."""
    line = read(spark, sf_dir, "lineitem")
    return line.select(F.col("l_partkey").alias("metric"), F.col("l_orderkey").alias("at"), F.col("l_linenumber").alias("no"), F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_returnflag") == "A", "approved").otherwise("pending").alias("decision"))


def workbench_catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics whose texts hold a word, with synonyms in one text, the latest review if any, and an approval status."""
    p = read(spark, sf_dir, "part").filter(F.col("p_name").ilike("%WIDGET%") | F.col("p_type").ilike("%standard%") | F.col("p_brand").ilike("%zz%"))
    names = p.select("p_partkey", F.explode(F.array_union(F.split("p_name", " "), F.split(F.lower("p_type"), " "))).alias("w")).groupBy("p_partkey").agg(F.array_join(F.sort_array(F.collect_set("w")), " ").alias("synonyms"))
    latest = _reviews(spark, sf_dir).groupBy("metric").agg(F.max(F.struct("at", "no", "decision")).alias("r"), F.count("*").alias("reviews"))
    out = p.join(names, "p_partkey", "left").join(latest, F.col("p_partkey") == F.col("metric"), "left")
    status = rules.first_match([(F.col("r").isNull(), "unreviewed"), (F.col("r.decision") == "approved", "approved"), (F.col("r.decision") == "rejected", "needs_fix")], "in_review")
    return out.select(F.col("p_partkey").alias("metric"), "synonyms", F.coalesce("reviews", F.lit(0)).alias("reviews"), status.alias("approval_status"))


def catalogue_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = workbench_catalogue(spark, sf_dir)
    return w.groupBy("approval_status").agg(F.count("*").alias("metrics"), F.sum("reviews").alias("reviews"))


def review_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews with their events: only of metrics that were rejected at least once, numbered over the bundle."""
    r = _reviews(spark, sf_dir)
    bad = r.filter("decision = 'rejected'").select("metric").distinct()
    per = r.join(bad, "metric", "left_semi").groupBy("metric", "decision").agg(F.count("*").alias("n"), F.max("at").alias("last"))
    top = per.orderBy(F.desc("n"), F.desc("last"), "metric", "decision").limit(100)
    return top.select("metric", "decision", "n", F.row_number().over(Window.orderBy(F.desc("n"), F.desc("last"), "metric", "decision")).cast("long").alias("place"))


def metric_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each dimension of a metric from its metadata: years (filled in), grains and categories, ranked; no facts are read."""
    years = spark.range(1).select(F.explode(domain.expanded_years(F.array(F.lit(1995), F.lit(2001)))).alias("y"))
    year = years.select(F.lit("Year").alias("dimension_code"), F.col("y").cast("string").alias("category_code"), F.lit(False).alias("is_total"), F.lit(False).alias("is_unknown"))
    levels = spark.createDataFrame([("GM0363", None), ("CR11", None), ("XX", "region"), ("UNKNOWN", None)], "code string, declared string")
    kind = rules.geography_type(F.col("code"), F.col("declared"))
    level = levels.select(F.lit("Geography").alias("dimension_code"), F.when(kind == "region", "corop").otherwise(kind).alias("category_code"), F.lit(False).alias("is_total"), (F.col("code") == "UNKNOWN").alias("is_unknown")).distinct()
    cats = read(spark, sf_dir, "orders").select("o_orderpriority").distinct()
    extra = spark.createDataFrame([("Totaal",), ("Unknown",)], "o_orderpriority string")
    cat = cats.unionByName(extra).select(F.lit("Priority").alias("dimension_code"), F.col("o_orderpriority").alias("category_code"), rules.is_total(F.lit(""), F.col("o_orderpriority")).alias("is_total"), F.col("o_orderpriority").startswith("Unknown").alias("is_unknown"))
    out = year.unionByName(level).unionByName(cat)
    rank = F.row_number().over(Window.partitionBy("dimension_code").orderBy("is_unknown", F.desc("is_total"), "category_code"))
    return out.withColumn("value_rank", rank.cast("long")).filter("value_rank <= 5000")


def bronze_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checks of each data set's raw load in one pass: metadata, dimensions, rows, end state; passed, warning or failed."""
    o = read(spark, sf_dir, "orders")
    per = o.groupBy("o_custkey").agg(F.count("*").alias("rows"), F.countDistinct("o_orderstatus").alias("dims"), F.max("o_orderkey").alias("last"), F.count_if(F.col("o_orderpriority") == "5-LOW").alias("low"))
    state = F.when(F.col("last") % 5 == 0, "running").otherwise("complete")
    bad = F.array_compact(F.array(F.when(F.col("rows") == 0, "rows"), F.when(F.col("dims") < 2, "dimensions"), F.when(state != "complete", "status")))
    status = rules.first_match([(F.array_contains(bad, "rows") | (F.size(bad) > 1), "failed"), (F.size(bad) == 1, "warning")], "passed")
    return per.select(status.alias("status"), F.array_join(bad, ",").alias("failed_checks")).groupBy("status", "failed_checks").agg(F.count("*").alias("datasets"))


def year_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by building-period classes such as '1995 tot 1997' and 'vanaf 1999': a range lookup in a small list."""
    names = spark.createDataFrame([("1995 tot 1997",), ("1997 tot 1999",), ("vanaf 1999",)], "name string")
    bound = lambda p, g: F.regexp_extract("name", p, g).try_cast("int")
    lo = F.coalesce(bound(r"(\d{4}) tot (\d{4})", 1), bound(r"vanaf (\d{4})", 1))
    hi = F.coalesce(bound(r"(\d{4}) tot (\d{4})", 2), F.lit(9999))
    per = read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y")).agg(F.count("*").alias("n"))
    b = F.broadcast(names.select("name", lo.alias("lo"), hi.alias("hi")))
    return per.join(b, (F.col("y") >= F.col("lo")) & (F.col("y") < F.col("hi")), "left").groupBy(F.coalesce("name", F.lit("other")).alias("bucket")).agg(F.sum("n").alias("orders"))


def name_or_code_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts whose category equals a wanted value by name or by code, the dimension's case left aside."""
    want = spark.createDataFrame([("PRIORITY", "1"), ("segment", "MACHINERY")], "dim string, want string")
    b = mart.bridge(spark, sf_dir).withColumn("category_code", F.substring("category_name", 1, 1))
    hit = b.join(F.broadcast(want), (F.lower("dimension_code") == F.lower("dim")) & ((F.col("category_name") == F.col("want")) | (F.col("category_code") == F.col("want"))))
    keys = hit.groupBy("observation_key").agg(F.countDistinct(F.lower("dim")).alias("n")).filter("n = 2")
    fact = mart.populated(mart.observations(spark, sf_dir, ("TOTAL_PRICE",)))
    return fact.join(keys, "observation_key", "left_semi").groupBy("calendar_year").agg(F.count("*").alias("facts"), F.sum("value").cast("double").alias("total"))


_DOCS = """d AS (SELECT 'metric:' || p_partkey AS document_id, 'metric' AS kind, p_name AS title FROM part UNION ALL SELECT 'dataset:' || s_suppkey, 'dataset', s_name FROM supplier UNION ALL SELECT 'customer:' || c_custkey, 'customer', c_name FROM customer
 UNION ALL SELECT 'geography:' || n_nationkey, 'geography', n_name FROM nation UNION ALL SELECT 'region:' || r_regionkey, 'region', r_name FROM region UNION ALL SELECT 'question:' || item_id, 'question', substr(text, 1, 40) FROM benchmark)"""
_WB = """p AS (SELECT * FROM part WHERE p_name ILIKE '%WIDGET%' OR p_type ILIKE '%standard%' OR p_brand ILIKE '%zz%'), l AS (SELECT l_partkey, count(*) AS n, max_by(l_returnflag, (l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'approved' ELSE 'pending' END)) AS f FROM lineitem GROUP BY 1),
w AS (SELECT p_partkey AS metric, array_to_string(list_sort(list_distinct(list_concat(string_split(p_name, ' '), string_split(lower(p_type), ' ')))), ' ') AS synonyms, coalesce(n, 0) AS reviews, CASE WHEN n IS NULL THEN 'unreviewed' WHEN f = 'A' THEN 'approved' WHEN f = 'R' THEN 'needs_fix' ELSE 'in_review' END AS approval_status FROM p LEFT JOIN l ON p_partkey = l_partkey)"""
ORACLES = {
    "row_numbers": "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_index FROM orders",
    "paged_source": "SELECT i AS row_index, user_id FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) WHERE i > 1249 AND event_type = 'purchase'",
    "domain_config": "SELECT c_mktsegment, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'trade' WHEN c_mktsegment = 'HOUSEHOLD' THEN 'home' ELSE 'none' END AS domain, count(*) AS customers FROM customer GROUP BY ALL",
    "workbench_catalogue": f"WITH {_WB} SELECT * FROM w",
    "catalogue_summary": f"WITH {_WB} SELECT approval_status, count(*) AS metrics, sum(reviews)::BIGINT AS reviews FROM w GROUP BY 1",
    "review_bundle": "WITH r AS (SELECT l_partkey AS metric, CASE l_returnflag WHEN 'R' THEN 'rejected' WHEN 'A' THEN 'approved' ELSE 'pending' END AS decision, count(*) AS n, max(l_orderkey) AS last FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY ALL) SELECT metric, decision, n, row_number() OVER (ORDER BY n DESC, last DESC, metric, decision) AS place FROM r ORDER BY place LIMIT 100",
    "metric_detail": "WITH v AS (SELECT 'Year' AS dimension_code, y::VARCHAR AS category_code, false AS is_total, false AS is_unknown FROM (SELECT unnest(range(1995, 2002)) AS y) UNION ALL SELECT 'Geography', c, false, u FROM (VALUES ('municipality', false), ('corop', false), ('country', true)) t(c, u) UNION ALL SELECT 'Priority', p, contains(lower(p), 'total') OR contains(lower(p), 'totaal'), starts_with(p, 'Unknown') FROM (SELECT DISTINCT o_orderpriority AS p FROM orders UNION ALL SELECT 'Totaal' UNION ALL SELECT 'Unknown')) SELECT *, row_number() OVER (PARTITION BY dimension_code ORDER BY is_unknown, is_total DESC, category_code) AS value_rank FROM v",
    "bronze_checks": "WITH p AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderstatus) AS d, max(o_orderkey) AS l FROM orders GROUP BY 1), s AS (SELECT concat_ws(',', CASE WHEN d < 2 THEN 'dimensions' END, CASE WHEN l % 5 = 0 THEN 'status' END) AS failed_checks FROM p) SELECT CASE WHEN contains(failed_checks, ',') THEN 'failed' WHEN failed_checks <> '' THEN 'warning' ELSE 'passed' END AS status, failed_checks, count(*) AS datasets FROM s GROUP BY ALL",
    "year_buckets": "SELECT CASE WHEN year(o_orderdate) BETWEEN 1995 AND 1996 THEN '1995 tot 1997' WHEN year(o_orderdate) BETWEEN 1997 AND 1998 THEN '1997 tot 1999' WHEN year(o_orderdate) >= 1999 THEN 'vanaf 1999' ELSE 'other' END AS bucket, count(*) AS orders FROM orders GROUP BY 1",
    "name_or_code_filter": f"WITH {SQL} SELECT calendar_year, count(*) AS facts, sum(value)::DOUBLE AS total FROM fact JOIN place ON observation_key = o_orderkey WHERE measure_code = 'TOTAL_PRICE' AND o_orderpriority LIKE '1%' AND c_mktsegment = 'MACHINERY' GROUP BY 1",
}
ORACLES["index_build"] = f"WITH {_DOCS}, h AS (SELECT *, ('0x' || right(md5(document_id), 4))::BIGINT AS x FROM d) SELECT kind, count(*) AS documents, sum(length(title))::BIGINT AS title_chars, count(*) FILTER (starts_with(title, 'old ')) AS old FROM h WHERE x % 4 <> 0 GROUP BY 1"
QUERIES = {n: globals()[n] for n in ORACLES}
