"""Load planning, coverage, capability, contracts and review over data sets and the observation mart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaystat.functions import domain, rules
from quaystat.operators.hierarchy import ancestors
from quaystat.operators.semantic import dimension_profile, measure_profile
from quaystat.sources import mart
from quaystat.sources.mart import SQL, read

#: Words that make a data set wanted; a parameter of the planner.
TERMS = ("building", "house", "machinery", "auto", "furniture")
COMPLETE = ("complete", "complete_with_warnings", "completed", "completed_with_rejections")
GRAINS = ("municipality_year", "province_year", "region_year", "national_year")
#: Concepts of free texts by pattern.
CONCEPTS = {"prices": "price|euro|cost", "places": "nation|region|land", "growth": "grow|increase|trend", "the_end": r"\bend\b"}


def score(rules_: list[tuple[Column, int]], other: int) -> Column:
    """The points of the first rule that holds."""
    out = F.when(rules_[0][0], rules_[0][1])
    for c, n in rules_[1:]:
        out = out.when(c, n)
    return out.otherwise(other)


def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as published data sets: rows, properties, years, levels, status, texts."""
    o = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.countDistinct(F.year("o_orderdate")).alias("years"))
    c = read(spark, sf_dir, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    k = F.col("c_custkey")
    levels = F.array_compact(F.array(F.when(k % 2 == 0, "municipality"), F.when(k % 3 == 0, "province"), F.when(k % 5 == 0, "country"), F.when(k % 11 == 0, "neighborhood")))
    return c.select(
        k.alias("dataset_id"), F.concat_ws(" ", F.lower("c_mktsegment"), F.lit("of"), "c_name").alias("title"), (F.coalesce("n", F.lit(0)) * 20_000).alias("loaded_row_count"), (k % 6).alias("dimension_count"), (k % 320 + 5).alias("property_count"),
        F.coalesce("years", F.lit(0)).alias("year_count"), levels.alias("levels"), F.when(k % 4 == 0, "failed").when(k % 4 == 1, "complete_with_warnings").otherwise("complete").alias("status"), (k % 9 == 0).alias("featured"), "c_mktsegment",
    )


def load_planner(spark: SparkSession, sf_dir: str, terms: tuple[str, ...] = TERMS) -> DataFrame:
    """Priority, recommendation and estimated rows of each data set."""
    d = datasets(spark, sf_dir)
    has = lambda x: F.array_contains("levels", x)
    rows, measures = F.col("loaded_row_count"), F.greatest(F.lit(0), F.col("property_count") - F.col("dimension_count"))
    est = rows * F.greatest(F.lit(1), F.col("dimension_count") + measures)
    geo = score([(has("neighborhood"), 25), (has("municipality"), 23), (has("province"), 12), (has("country"), 5)], -10)
    years = score([(F.col("year_count") >= 10, 15), (F.col("year_count") >= 3, 10), (F.col("year_count") >= 1, 4)], -5)
    complete = score([(F.col("status").isin(*COMPLETE), 20), (rows > 0, 5)], -20)
    size = score([(rows == 0, -25), ((rows <= 100_000) & (measures <= 80), 18), ((rows <= 500_000) & (measures <= 120), 8), ((rows > 2_000_000) | (measures > 250), -25)], -5)
    found = F.size(F.filter(F.array(*(F.lit(t) for t in terms)), lambda t: F.contains(F.lower("title"), t)))
    total = geo + years + complete + size + F.least(F.lit(20), found * 4) + F.when(F.col("featured"), 8).otherwise(0)
    d = d.select("dataset_id", "loaded_row_count", "property_count", total.alias("total"), est.alias("estimated_rows"))
    what = rules.first_match(
        [
            ((F.col("total") >= 75) & (F.col("estimated_rows") < 50_000_000), "recommended"),
            ((F.col("total") >= 55) & (F.col("estimated_rows") < 150_000_000), "load_later"),
            ((F.col("estimated_rows") >= 150_000_000) | (F.col("property_count") > 300), "needs_review"),
            (F.col("loaded_row_count") == 0, "metadata_only"),
        ],
        "skip_for_now",
    )
    return d.select("dataset_id", F.greatest(F.lit(0), F.least(F.lit(100), F.col("total"))).cast("long").alias("priority_score"), what.alias("recommendation"), "estimated_rows")


def _coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bronze rows, silver rows and state of each data set."""
    o = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("dataset_id")).agg(F.count("*").alias("bronze_rows"), F.count_if(F.col("o_orderstatus") != "P").alias("silver"))
    d = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("dataset_id")).join(o, "dataset_id", "left")
    k, silver = F.col("dataset_id"), F.coalesce("silver", F.lit(0))
    return d.select("dataset_id", F.coalesce("bronze_rows", F.lit(0)).alias("bronze_rows"), F.when(k % 5 == 0, 0).otherwise(silver).alias("silver_rows"), (k % 7 != 0).alias("metadata_loaded"), F.when(k % 8 == 0, "failed").when(k % 8 == 1, "complete_with_warnings").otherwise("running").alias("status"), F.when(k % 8 == 1, 3).otherwise(0).alias("rejected"))


def silver_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    bronze, silver = F.col("bronze_rows"), F.col("silver_rows")
    kind = rules.first_match(
        [
            (~F.col("metadata_loaded") & (silver == 0), "not_loaded"),
            (silver == 0, F.when(F.col("status") == "failed", "failed_metadata").otherwise("metadata_only")),
            (F.col("status") == "failed", "failed_partial"),
            ((F.col("rejected") > 0) & F.col("status").isin("complete_with_warnings", "completed_with_rejections"), "complete_with_warnings"),
            ((bronze > 0) & (silver >= bronze), "complete"),
        ],
        "partial",
    )
    return _coverage(spark, sf_dir).withColumn("classification", kind)


def silver_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share loaded of each data set."""
    c = silver_classes(spark, sf_dir)
    return c.select("dataset_id", "bronze_rows", "silver_rows", domain.percent_complete(F.col("silver_rows"), F.col("bronze_rows")).alias("completeness_pct"), "classification")


def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all classes in one row, and by class as text."""
    c = silver_classes(spark, sf_dir).groupBy("classification").agg(F.count("*").alias("n"), F.count_if(F.col("bronze_rows") > 0).alias("with_rows"), F.count_if("metadata_loaded").alias("metadata"))
    by = F.array_join(F.sort_array(F.collect_list(F.concat_ws("=", "classification", F.col("n").cast("string")))), ",")
    pick = lambda *names: F.coalesce(F.sum(F.when(F.col("classification").isin(*names), F.col("n"))), F.lit(0))
    return c.agg(F.sum("n").alias("scanned"), F.sum("with_rows").alias("with_rows"), F.sum("metadata").alias("metadata_loaded"), pick("complete", "complete_with_warnings").alias("complete"), pick("partial", "failed_partial").alias("partial"), pick("metadata_only").alias("metadata_only"), pick("not_loaded").alias("not_loaded"), by.alias("by_class"))


def indicator_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as measures: kind flags by the words of title and unit."""
    p = read(spark, sf_dir, "part")
    unit = F.when(F.col("p_size") % 4 == 0, "%").when(F.col("p_size") % 4 == 1, "aantal").when(F.col("p_size") % 4 == 2, "2021=100 index").otherwise("kg")
    percent, index, count, additive = domain.indicator_flags(F.col("p_type"), unit)
    return p.select(percent.alias("is_percentage"), index.alias("is_index"), count.alias("is_count"), additive.alias("is_additive")).groupBy("is_percentage", "is_index", "is_count", "is_additive").agg(F.count("*").alias("measures"))


def topic_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles from the root to each property, joined by ' > ', over all parts and to any depth.

    Part k's parent is part k // 10; part 7 is its own parent's child through a loop (7 -> 70 -> 7), which ends where it
    comes back to a seen node.
    """
    k = F.col("p_partkey")
    parent = F.when(k == 7, 70).when(k >= 10, F.floor(k / 10)).cast("long")
    nodes = read(spark, sf_dir, "part").select(k.alias("id"), F.concat(F.lit("t"), k.cast("string")).alias("title"), parent.alias("parent"))
    return ancestors(nodes).select("id", F.array_join("titles", " > ").alias("path"))


def dataset_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Data sets to domains by the folded name of their root theme; names differ in case and marks."""
    aliases = spark.createDataFrame([("construction", "Buildíng"), ("mobility", "AUTOMOBILE "), ("home", "household!"), ("home", "Furniture")], "domain string, alias string")
    a = aliases.select("domain", domain.folded(F.col("alias")).alias("theme"))
    d = datasets(spark, sf_dir).select("dataset_id", domain.folded(F.col("c_mktsegment")).alias("theme"))
    return d.join(F.broadcast(a), "theme", "left").select("dataset_id", F.coalesce("domain", F.lit("unclassified")).alias("domain"))


def gold_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive readiness of each data set: domain, years, levels, measures, observations, quality."""
    d = datasets(spark, sf_dir)
    domains = F.array_compact(F.array(F.when(F.col("c_mktsegment") == "BUILDING", "con-struction"), F.when(F.col("dataset_id") % 3 == 0, "trade")))
    d = d.withColumn("domains", domains).withColumn("measures", F.greatest(F.lit(0), F.col("property_count") - F.col("dimension_count") - 100)).withColumn("observations", F.when(F.col("dataset_id") % 4 == 0, 0).otherwise(F.col("loaded_row_count")))
    yes = lambda c, n: F.when(c, n).otherwise(0)
    total = yes(F.size("domains") > 0, 20) + yes(F.col("year_count") > 0, 20) + yes(F.arrays_overlap("levels", F.array(F.lit("municipality"), F.lit("province"), F.lit("country"))), 20) + yes(F.col("measures") > 0, 20) + yes(F.col("observations") > 0, 10) + yes(F.col("status") == "complete", 10)
    model = F.when(F.size("domains") == 1, F.concat(F.lit("gold."), F.regexp_replace(F.get("domains", F.lit(0)), "-", "_"), F.lit("_facts"))).when(F.size("domains") > 1, "gold.cross_domain_facts").otherwise("gold.unclassified_facts")
    out = d.select("dataset_id", total.cast("long").alias("priority_score"), model.alias("model"))
    return out.withColumn("action", F.when(F.col("priority_score") >= 80, "ready_for_gold_candidate").when(F.col("priority_score") >= 50, "review_before_gold").otherwise("keep_in_silver"))


def _capable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts of three grains, one of them sparse: municipalities, provinces of even quarters, and the country."""
    fact = mart.observations(spark, sf_dir)
    p = fact.withColumn("geography_type", F.lit("province")).withColumn("geography_code", F.col("province_name")).filter("quarter % 2 = 0").withColumn("value", F.when(F.col("quarter") == 2, F.col("value")))
    return fact.unionByName(p).withColumn("period_type", F.when(F.col("geography_type") == "province", "").otherwise("year"))


def dataset_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What can be asked of each data set: grains, years, flags, status, and why not."""
    fact = _capable(spark, sf_dir)
    kind = F.when(F.col("geography_type").isin("country", "unknown"), "national").otherwise(F.coalesce(F.nullif("geography_type", F.lit("")), F.lit("unknown")))
    full = F.col("value").isNotNull()
    period = F.coalesce(F.nullif("period_type", F.lit("")), F.lit("year"))
    out = fact.groupBy("dataset_code").agg(
        F.count("*").alias("loaded_rows"), F.count_if(full).alias("populated_rows"), F.count_if(~full).alias("missing_rows"), F.countDistinct("measure_code").alias("measure_count"), F.countDistinct("geography_code").alias("geography_count"),
        F.sort_array(F.collect_set("calendar_year")).alias("years"), F.sort_array(F.collect_set(F.concat_ws("_", kind, period))).alias("grains"),
    )
    some = lambda *g: F.arrays_overlap("grains", F.array(*(F.lit(x) for x in g)))
    status = rules.first_match([(F.col("populated_rows") == 0, "no_populated_facts"), (~some(*GRAINS), "limited_unknown_grain"), (F.col("missing_rows") > F.col("populated_rows"), "partial_sparse")], "ready")
    why = F.array_compact(F.array(F.when(F.col("populated_rows") == 0, "no_populated_facts"), F.when(~some("municipality_year"), "no_municipality_year"), F.when(F.size("years") == 0, "no_year")))
    return out.select("dataset_code", "loaded_rows", "populated_rows", "missing_rows", "measure_count", "geography_count", F.array_join("years", ",").alias("years"), F.array_join("grains", ",").alias("grains"), (F.size("years") > 1).alias("supports_trend"), some(*GRAINS[:3]).alias("supports_ranking"), some(*GRAINS).alias("supports_comparison"), status.alias("status"), F.array_join(why, ",").alias("limits"))


def grain_capability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and years of each measure and grain."""
    fact = _capable(spark, sf_dir)
    return fact.groupBy("dataset_code", "measure_code", "geography_type", F.coalesce(F.nullif("period_type", F.lit("")), F.lit("year")).alias("period_type")).agg(F.count_if(F.col("value").isNotNull()).alias("populated_rows"), F.countDistinct("geography_code").alias("geographies"), F.min("calendar_year").alias("first_year"), F.max("calendar_year").alias("last_year"))


def metric_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts generated from profiles: code, aggregation that is safe, shapes and grain."""
    m = measure_profile(spark, sf_dir)
    how = domain.approved_aggregation(F.col("default_aggregation"), rules.value_type(F.col("unit_code")))
    code = domain.metric_code(F.col("dataset_code"), F.col("measure_code"), F.col("unit_code"), F.lit(1))
    shapes = F.array_compact(F.array(F.lit("lookup_value"), F.when(F.col("populated_rows") > 0, "rank_geographies"), F.when(F.col("populated_rows") > 0, "compare_geographies"), F.when(F.col("year_count") > 1, "trend")))
    return m.select(code.alias("metric_code"), domain.slug(F.col("measure_code")).alias("slug"), how.alias("aggregation"), F.lit("municipality_year").alias("default_grain"), F.array_join(shapes, ",").alias("shapes"))


def dimension_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid values of each dimension, ordered by use, and whether two asked values are among them."""
    counts = mart.bridge(spark, sf_dir).groupBy("dimension_code", "category_name").agg(F.count("*").alias("n"))
    values = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), F.col("category_name").alias("category_name")))), lambda x: F.struct(x["category_name"].alias("category_name")))
    out = counts.groupBy("dimension_code").agg(values.alias("values"))
    valid = lambda v: F.exists("values", lambda x: x["category_name"] == v)
    return out.select("dimension_code", F.initcap(F.lower("dimension_code")).alias("label"), F.to_json("values").alias("valid_values"), valid("BUILDING").alias("knows_building"), valid("nothing").alias("knows_nothing"))


def metric_dimension_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every metric with every dimension: a product of two code lists, allowed where the data set has the dimension."""
    m = measure_profile(spark, sf_dir).select("dataset_code", "measure_code")
    d = dimension_profile(spark, sf_dir).select("dimension_code")
    return m.crossJoin(F.broadcast(d)).withColumn("is_allowed", F.col("dataset_code") == "ORDERS")


def availability_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The availability cube under a contract's filters, by measure, grain and year."""
    from quaystat.plans.plan import with_categories

    fact = with_categories(mart.observations(spark, sf_dir, ("TOTAL_PRICE",)), mart.bridge(spark, sf_dir), {"Priority": ("1-URGENT",), "Segment": ("BUILDING", "MACHINERY")})
    return fact.groupBy("measure_code", "geography_type", "calendar_year").agg(F.count_if(F.col("value").isNotNull()).alias("populated_count"), F.count("*").alias("row_count"))


def review_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics and review state of measures: parts by type, of which some lack a key, a unit, facts or a grain."""
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    c = p.select(
        k.alias("measure"), F.when(k % 13 != 0, "PARTS").alias("dataset_code"), F.when(k % 17 != 0, k).alias("measure_key"), F.when(k % 11 == 0, "UNKNOWN").otherwise("EUR").alias("unit_code"),
        domain.safe_aggregation(F.when(k % 3 == 0, "none"), F.when(k % 5 == 0, "Gemiddeld").otherwise("Prijs"), F.when(k % 4 == 0, "aantal").otherwise("eur"), F.lit(None).cast("boolean")).alias("aggregation"),
        F.array_compact(F.array(F.when(k % 7 != 0, "municipality_year"), F.when(k % 19 != 0, "province_year"))).alias("grains"), (k % 23).alias("populated"), F.lower("p_type").alias("label"), (k % 2 == 0).alias("candidate"),
    )
    c = c.withColumn("same", F.count("*").over(Window.partitionBy("label")))
    block = F.array_compact(F.array(F.when(F.col("dataset_code").isNull(), "missing_dataset_code"), F.when(F.col("measure_key").isNull(), "missing_measure_key"), F.when(F.coalesce("unit_code", F.lit("UNKNOWN")) == "UNKNOWN", "missing_unit_code"), F.when(F.col("aggregation") == "none", "unsafe_aggregation"), F.when(F.size("grains") == 0, "missing_grains"), F.when(F.col("populated") == 0, "no_populated_facts")))
    warn = F.array_compact(F.array(F.when(F.col("same") > 1, "duplicate_label"), F.when(F.col("aggregation").isin("average", "median"), "non_additive_metric"), F.when(~F.array_contains("grains", "municipality_year"), "not_municipality_ready")))
    c = c.withColumn("blocking", block).withColumn("warnings", warn)
    state = rules.first_match([(F.size("blocking") > 0, "needs_fix"), (F.col("candidate"), "review_candidate")], "profiled")
    c = c.withColumn("state", state)
    risk = rules.first_match([(F.col("state") == "needs_fix", "high"), ((F.col("state") == "review_candidate") & (F.size("warnings") == 0), "low")], "medium")
    priority = F.when(F.col("state") == "needs_fix", 900).when(F.col("state") == "profiled", 500).when(F.size("warnings") > 0, 220).otherwise(120)
    return c.select("measure", "aggregation", F.array_join("blocking", ",").alias("blocking"), F.array_join("warnings", ",").alias("warnings"), "state", risk.alias("risk"), priority.cast("long").alias("priority"))


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most urgent reviews with their place in the whole queue."""
    r = review_states(spark, sf_dir).filter("state <> 'profiled'")
    top = r.orderBy("priority", "measure").limit(150)
    return top.select("measure", "state", "priority", F.row_number().over(Window.orderBy("priority", "measure")).cast("long").alias("place"))


def contract_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural checks of category contracts: a known dimension, a known value, facts behind it."""
    want = spark.createDataFrame([("c1", "Priority", "1-URGENT"), ("c2", "Priority", "nothing"), ("c3", "Colour", "red"), ("c4", "segment", "BUILDING")], "contract string, dimension_code string, category_name string")
    b = mart.bridge(spark, sf_dir).groupBy("dimension_code", "category_name").agg(F.count("*").alias("facts"))
    dims = b.select(F.lower("dimension_code").alias("known")).distinct()
    out = want.join(F.broadcast(dims), F.lower("dimension_code") == F.col("known"), "left")
    hit = b.select(F.lower("dimension_code").alias("d"), F.col("category_name").alias("v"), "facts")
    out = out.join(F.broadcast(hit), (F.lower("dimension_code") == F.col("d")) & (F.col("category_name") == F.col("v")), "left")
    errors = F.array_compact(F.array(F.when(F.col("known").isNull(), "unknown_dimension"), F.when(F.col("known").isNotNull() & F.col("v").isNull(), "unknown_value")))
    return out.select("contract", F.array_join(errors, ",").alias("errors"), F.coalesce("facts", F.lit(0)).alias("facts"), (F.size(errors) == 0).alias("passed"))


def concept_tagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts of all documents by keyword rules, counted."""
    d = read(spark, sf_dir, "documents")
    return d.select(F.explode(domain.concept_tags(F.col("text"), CONCEPTS)).alias("concept")).groupBy("concept").agg(F.count("*").alias("documents"))


def map_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of each municipality and year in long form, one row for each code."""
    fact = mart.populated(mart.observations(spark, sf_dir))
    at = lambda m: F.max(F.when(F.col("measure_code") == m, F.col("value"))).cast("double").alias(m)
    wide = fact.groupBy("geography_code", "calendar_year").agg(*(at(m) for m in mart.MEASURES))
    return wide.unpivot(["geography_code", "calendar_year"], list(mart.MEASURES), "indicator", "value").filter("value is not null")


def source_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Climate-like events to standard units and periods, with what they come from."""
    e = read(spark, sf_dir, "events")
    tenths = F.when(F.col("event_id") % 9 == 0, F.lit(-1.0)).otherwise(F.round(F.col("value")))
    day = F.date_format("ts", "yyyyMMdd")
    return e.select(F.concat(F.lit("events:"), F.col("event_id").cast("string")).alias("lineage"), domain.period_of_date(day)[0].cast("string").alias("period_start"), domain.celsius(tenths).alias("celsius"), domain.millimetres(tenths).alias("millimetres"))


def region_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Levels, code parts and coverage of region values that nations and regions stand for."""
    n = read(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    key = F.when(k % 6 == 0, "NL01").when(k % 6 == 1, F.concat(F.lit("PV"), k.cast("string"))).when(k % 6 == 2, F.format_string("GM%04d", k)).when(k % 6 == 3, F.format_string("BU%04d0001", k)).when(k % 6 == 4, F.lit("x")).otherwise(F.lit(None).cast("string"))
    title, text = F.when(k % 12 == 5, "Nederland").otherwise(F.col("n_name")), F.when(k % 12 == 4, "PV = provincie")
    v = n.select(k.alias("nation"), key.alias("value_key"), domain.geography_level(key, title, text).alias("dimension_level"), F.when(k % 5 == 0, "country").alias("row_level"), F.when(k % 2 == 0, "municipality").alias("code_level"))
    level, evidence = domain.record_level(F.col("dimension_level"), F.col("row_level"), F.col("code_level"))
    province, town = domain.region_code_parts(F.col("value_key"), F.col("dimension_level"))
    return v.select("nation", "value_key", "dimension_level", level.alias("level"), evidence.alias("evidence"), province.alias("province_code"), town.alias("municipality_code"))


def spatial_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return datasets(spark, sf_dir).select(domain.spatial_coverage(F.col("levels")).alias("coverage")).groupBy("coverage").agg(F.count("*").alias("datasets"))


def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Years, folded names, slugs, dates and numbers read from texts."""
    c = read(spark, sf_dir, "customer").select("c_custkey")
    k = F.col("c_custkey")
    text = F.concat(F.lit("Periode "), (1960 + k % 60).cast("string"), F.lit(" tot "), (1990 + k % 50).cast("string"))
    number = F.concat(F.lit("1."), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit(","), (k % 10).cast("string"))
    date = F.when(k % 3 == 0, F.concat(F.lit("2001-02-0"), (k % 9 + 1).cast("string"), F.lit("T10:00:00Z"))).otherwise(F.concat(F.lit("2/"), k.cast("string")))
    years = domain.years_in_text(text)
    return c.select(
        "c_custkey", F.array_join(years, ",").alias("years"), F.size(domain.expanded_years(years)).cast("long").alias("year_count"), domain.dutch_number(number).alias("number"), domain.safe_iso_date(date).alias("iso_date"),
        domain.folded(F.concat(F.lit("Ärzte-Café  No."), k.cast("string"), F.lit("!"))).alias("folded"), domain.slug(F.concat(F.lit("__Él "), k.cast("string"))).alias("slug"), domain.year_bucket(text, F.lit(1998)).alias("in_bucket"), domain.share_percent(k, F.lit(700)).alias("share"), domain.is_geography_dimension(F.when(k % 2 == 0, "RegioS").otherwise("Perioden")).alias("is_geography"),
    )


def schema_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of each brand's parts as a schema; it does not hang on their order."""
    p = read(spark, sf_dir, "part")
    return p.groupBy("p_brand").agg(F.count("*").alias("properties"), domain.schema_hash(F.collect_list(F.struct(F.col("p_partkey").alias("key"), F.col("p_size").alias("size")))).alias("schema_hash"))


def top_chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six nations with the largest share of large orders, as a chart shows them."""
    o, c, n = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer"), read(spark, sf_dir, "nation")
    per = o.join(c, o.o_custkey == c.c_custkey).groupBy("c_nationkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_totalprice") > 200_000).alias("large"))
    out = per.join(F.broadcast(n), per.c_nationkey == n.n_nationkey).select(F.col("n_name").alias("name"), "orders", domain.share_percent(F.col("large"), F.col("orders")).alias("share_percent"))
    return out.orderBy(F.desc("share_percent"), "name").limit(6)


def hash_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token-hash vectors of all parts' names, unit length, by the slots that are not zero.

    Parts are few bytes and much work: they are dealt out first, as their file alone would be read by one task or two. An inner explode would have each vector
    computed twice, for the filter of empty arrays that Spark infers from it.
    """
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # given as a number, so that they are not joined again by their few bytes
    p = read(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type").repartition(tasks, "p_partkey")
    p = p.select("p_partkey", domain.hash_embedding(F.concat_ws(" ", F.lit("the part"), "p_name", "p_type")).alias("v"))
    return p.select("p_partkey", F.posexplode_outer("v").alias("slot", "value")).filter("value <> 0").select("p_partkey", F.col("slot").cast("long").alias("slot"), F.round("value", 4).alias("value"))


_DS = """d AS (SELECT c_custkey AS dataset_id, lower(c_mktsegment) || ' of ' || c_name AS title, coalesce(n, 0) * 20000 AS loaded, c_custkey % 6 AS dims, c_custkey % 320 + 5 AS props, coalesce(years, 0) AS years, c_mktsegment,
  list_filter([CASE WHEN c_custkey % 2 = 0 THEN 'municipality' END, CASE WHEN c_custkey % 3 = 0 THEN 'province' END, CASE WHEN c_custkey % 5 = 0 THEN 'country' END, CASE WHEN c_custkey % 11 = 0 THEN 'neighborhood' END], lambda x: x IS NOT NULL) AS levels,
  CASE c_custkey % 4 WHEN 0 THEN 'failed' WHEN 1 THEN 'complete_with_warnings' ELSE 'complete' END AS status, c_custkey % 9 = 0 AS featured
  FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(DISTINCT year(o_orderdate)) AS years FROM orders GROUP BY 1) ON c_custkey = o_custkey)"""
_SC = """o AS (SELECT o_custkey, count(*) AS b, count(*) FILTER (o_orderstatus <> 'P') AS s FROM orders GROUP BY 1), c AS (SELECT c_custkey AS k, coalesce(b, 0) AS bronze, CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE coalesce(s, 0) END AS silver, c_custkey % 7 <> 0 AS meta FROM customer LEFT JOIN o ON c_custkey = o_custkey),
cl AS (SELECT *, CASE WHEN NOT meta AND silver = 0 THEN 'not_loaded' WHEN silver = 0 THEN CASE WHEN k % 8 = 0 THEN 'failed_metadata' ELSE 'metadata_only' END WHEN k % 8 = 0 THEN 'failed_partial' WHEN k % 8 = 1 THEN 'complete_with_warnings' WHEN bronze > 0 AND silver >= bronze THEN 'complete' ELSE 'partial' END AS classification FROM c)"""
_CAP = SQL + ", cap AS (SELECT dataset_code, measure_code, geography_code, 'municipality' AS t, calendar_year, value FROM obs UNION ALL SELECT dataset_code, measure_code, province_name, 'province', calendar_year, CASE WHEN quarter = 2 THEN value END FROM obs WHERE quarter % 2 = 0)"
_MP = SQL + ", mp AS (SELECT dataset_code, measure_code, unit_code, count(value) AS n, count(DISTINCT calendar_year) AS years FROM obs GROUP BY ALL)"
_REVIEW = """c AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 'average' WHEN p_partkey % 4 = 0 THEN 'sum' ELSE 'none' END AS aggregation, count(*) OVER (PARTITION BY lower(p_type)) AS same FROM part),
r AS (SELECT k AS measure, aggregation,
  concat_ws(',', CASE WHEN k % 13 = 0 THEN 'missing_dataset_code' END, CASE WHEN k % 17 = 0 THEN 'missing_measure_key' END, CASE WHEN k % 11 = 0 THEN 'missing_unit_code' END, CASE WHEN aggregation = 'none' THEN 'unsafe_aggregation' END, CASE WHEN k % 7 = 0 AND k % 19 = 0 THEN 'missing_grains' END, CASE WHEN k % 23 = 0 THEN 'no_populated_facts' END) AS blocking,
  concat_ws(',', CASE WHEN same > 1 THEN 'duplicate_label' END, CASE WHEN aggregation = 'average' THEN 'non_additive_metric' END, CASE WHEN k % 7 = 0 THEN 'not_municipality_ready' END) AS warnings FROM c),
s AS (SELECT *, CASE WHEN blocking <> '' THEN 'needs_fix' WHEN measure % 2 = 0 THEN 'review_candidate' ELSE 'profiled' END AS state FROM r),
q AS (SELECT *, CASE WHEN state = 'needs_fix' THEN 'high' WHEN state = 'review_candidate' AND warnings = '' THEN 'low' ELSE 'medium' END AS risk, CASE WHEN state = 'needs_fix' THEN 900 WHEN state = 'profiled' THEN 500 WHEN warnings <> '' THEN 220 ELSE 120 END::BIGINT AS priority FROM s)"""
ORACLES = {
    "load_planner": f"""WITH {_DS}, m AS (SELECT *, greatest(0, props - dims) AS measures, loaded * greatest(1, dims + greatest(0, props - dims)) AS est FROM d),
 t AS (SELECT *, CASE WHEN list_contains(levels, 'neighborhood') THEN 25 WHEN list_contains(levels, 'municipality') THEN 23 WHEN list_contains(levels, 'province') THEN 12 WHEN list_contains(levels, 'country') THEN 5 ELSE -10 END
  + CASE WHEN years >= 10 THEN 15 WHEN years >= 3 THEN 10 WHEN years >= 1 THEN 4 ELSE -5 END + CASE WHEN status <> 'failed' THEN 20 WHEN loaded > 0 THEN 5 ELSE -20 END
  + CASE WHEN loaded = 0 THEN -25 WHEN loaded <= 100000 AND measures <= 80 THEN 18 WHEN loaded <= 500000 AND measures <= 120 THEN 8 WHEN loaded > 2000000 OR measures > 250 THEN -25 ELSE -5 END
  + least(20, 4 * len(list_filter(['building', 'house', 'machinery', 'auto', 'furniture'], lambda w: contains(title, w)))) + CASE WHEN featured THEN 8 ELSE 0 END AS total FROM m)
 SELECT dataset_id, greatest(0, least(100, total))::BIGINT AS priority_score, CASE WHEN total >= 75 AND est < 50000000 THEN 'recommended' WHEN total >= 55 AND est < 150000000 THEN 'load_later' WHEN est >= 150000000 OR props > 300 THEN 'needs_review' WHEN loaded = 0 THEN 'metadata_only' ELSE 'skip_for_now' END AS recommendation, est AS estimated_rows FROM t""",
    "silver_coverage": f"WITH {_SC} SELECT k AS dataset_id, bronze AS bronze_rows, silver AS silver_rows, CASE WHEN bronze > 0 THEN least(100, round(silver::DOUBLE / bronze * 100, 2)) END::DOUBLE AS completeness_pct, classification FROM cl",
    "coverage_summary": f"WITH {_SC}, g AS (SELECT classification, count(*) AS n FROM cl GROUP BY 1) SELECT count(*) AS scanned, count(*) FILTER (bronze > 0) AS with_rows, count(*) FILTER (meta) AS metadata_loaded, count(*) FILTER (classification LIKE 'complete%') AS complete, count(*) FILTER (classification IN ('partial', 'failed_partial')) AS partial, count(*) FILTER (classification = 'metadata_only') AS metadata_only, count(*) FILTER (classification = 'not_loaded') AS not_loaded, (SELECT string_agg(classification || '=' || n, ',' ORDER BY classification || '=' || n) FROM g) AS by_class FROM cl",
    "indicator_candidates": "WITH p AS (SELECT lower(p_type) || ' ' || CASE p_size % 4 WHEN 0 THEN '%' WHEN 1 THEN 'aantal' WHEN 2 THEN '2021=100 index' ELSE 'kg' END AS t FROM part), f AS (SELECT regexp_matches(t, '%|percentage|procent') AS is_percentage, contains(t, 'index') AS is_index, regexp_matches(t, 'aantal|number|personen|huishoudens|woningen|bedrijven') AS is_count FROM p) SELECT *, CASE WHEN is_percentage OR is_index THEN false WHEN is_count THEN true END AS is_additive, count(*) AS measures FROM f GROUP BY ALL",
    "topic_paths": "WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey = 7 THEN 70 WHEN p_partkey >= 10 THEN p_partkey // 10 END AS parent FROM part), w AS (SELECT id, [id] AS seen, 't' || id AS path, parent FROM n UNION ALL SELECT w.id, list_append(seen, n.id), 't' || n.id || ' > ' || path, n.parent FROM w JOIN n ON n.id = w.parent WHERE NOT list_contains(seen, n.id)) SELECT id, path FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY len(seen) DESC) = 1",
    "dataset_domains": "SELECT c_custkey AS dataset_id, CASE c_mktsegment WHEN 'BUILDING' THEN 'construction' WHEN 'AUTOMOBILE' THEN 'mobility' WHEN 'HOUSEHOLD' THEN 'home' WHEN 'FURNITURE' THEN 'home' ELSE 'unclassified' END AS domain FROM customer",
    "gold_readiness": f"WITH {_DS}, r AS (SELECT dataset_id, (CASE WHEN c_mktsegment = 'BUILDING' OR dataset_id % 3 = 0 THEN 20 ELSE 0 END + CASE WHEN years > 0 THEN 20 ELSE 0 END + CASE WHEN dataset_id % 2 = 0 OR dataset_id % 3 = 0 OR dataset_id % 5 = 0 THEN 20 ELSE 0 END + CASE WHEN props - dims > 100 THEN 20 ELSE 0 END + CASE WHEN dataset_id % 4 <> 0 AND loaded > 0 THEN 10 ELSE 0 END + CASE WHEN status = 'complete' THEN 10 ELSE 0 END)::BIGINT AS priority_score, CASE WHEN c_mktsegment = 'BUILDING' AND dataset_id % 3 = 0 THEN 'gold.cross_domain_facts' WHEN c_mktsegment = 'BUILDING' THEN 'gold.con_struction_facts' WHEN dataset_id % 3 = 0 THEN 'gold.trade_facts' ELSE 'gold.unclassified_facts' END AS model FROM d) SELECT *, CASE WHEN priority_score >= 80 THEN 'ready_for_gold_candidate' WHEN priority_score >= 50 THEN 'review_before_gold' ELSE 'keep_in_silver' END AS action FROM r",
    "dataset_capability": f"WITH {_CAP}, g AS (SELECT dataset_code, count(*) AS loaded_rows, count(value) AS populated_rows, count(*) - count(value) AS missing_rows, count(DISTINCT measure_code) AS measure_count, count(DISTINCT geography_code) AS geography_count, string_agg(DISTINCT calendar_year, ',' ORDER BY calendar_year) AS years, string_agg(DISTINCT t || '_year', ',' ORDER BY t || '_year') AS grains, count(DISTINCT calendar_year) > 1 AS supports_trend FROM cap GROUP BY 1) SELECT *, true AS supports_ranking, true AS supports_comparison, CASE WHEN populated_rows = 0 THEN 'no_populated_facts' WHEN missing_rows > populated_rows THEN 'partial_sparse' ELSE 'ready' END AS status, CASE WHEN populated_rows = 0 THEN 'no_populated_facts' ELSE '' END AS limits FROM g",
    "grain_capability": f"WITH {_CAP} SELECT dataset_code, measure_code, t AS geography_type, 'year' AS period_type, count(value) AS populated_rows, count(DISTINCT geography_code) AS geographies, min(calendar_year) AS first_year, max(calendar_year) AS last_year FROM cap GROUP BY ALL",
    "metric_contracts": f"WITH {_MP} SELECT 'cbs_' || lower(dataset_code) || '_' || lower(measure_code) || '_' || lower(unit_code) || '_1' AS metric_code, lower(measure_code) AS slug, 'sum' AS aggregation, 'municipality_year' AS default_grain, concat_ws(',', 'lookup_value', CASE WHEN n > 0 THEN 'rank_geographies,compare_geographies' END, CASE WHEN years > 1 THEN 'trend' END) AS shapes FROM mp",
    "dimension_contracts": f"WITH {SQL}, c AS (SELECT dimension_code, category_name, count(*) AS n FROM bridge GROUP BY ALL) SELECT dimension_code, dimension_code AS label, '[' || string_agg('{{\"category_name\":\"' || category_name || '\"}}', ',' ORDER BY n DESC, category_name) || ']' AS valid_values, bool_or(category_name = 'BUILDING') AS knows_building, bool_or(category_name = 'nothing') AS knows_nothing FROM c GROUP BY ALL",
    "metric_dimension_matrix": f"WITH {SQL}, m AS (SELECT DISTINCT dataset_code, measure_code FROM obs), d AS (SELECT DISTINCT dimension_code FROM bridge) SELECT dataset_code, measure_code, dimension_code, dataset_code = 'ORDERS' AS is_allowed FROM m CROSS JOIN d",
    "availability_filtered": f"WITH {SQL} SELECT measure_code, 'municipality' AS geography_type, calendar_year, count(value) AS populated_count, count(*) AS row_count FROM obs JOIN place ON observation_key = o_orderkey WHERE measure_code = 'TOTAL_PRICE' AND o_orderpriority = '1-URGENT' AND c_mktsegment IN ('BUILDING', 'MACHINERY') GROUP BY ALL",
    "review_states": f"WITH {_REVIEW} SELECT * FROM q",
    "review_queue": f"WITH {_REVIEW} SELECT measure, state, priority, row_number() OVER (ORDER BY priority, measure) AS place FROM q WHERE state <> 'profiled' ORDER BY priority, measure LIMIT 150",
    "contract_checks": f"WITH {SQL} SELECT 'c1' AS contract, '' AS errors, (SELECT count(*) FROM bridge WHERE category_name = '1-URGENT') AS facts, true AS passed UNION ALL SELECT 'c2', 'unknown_value', 0, false UNION ALL SELECT 'c3', 'unknown_dimension', 0, false UNION ALL SELECT 'c4', '', (SELECT count(*) FROM bridge WHERE category_name = 'BUILDING'), true",
    "concept_tagging": "SELECT concept, count(*) AS documents FROM (SELECT unnest(list_filter([CASE WHEN regexp_matches(lower(text), 'price|euro|cost') THEN 'prices' END, CASE WHEN regexp_matches(lower(text), 'nation|region|land') THEN 'places' END, CASE WHEN regexp_matches(lower(text), 'grow|increase|trend') THEN 'growth' END, CASE WHEN regexp_matches(lower(text), '\\bend\\b') THEN 'the_end' END], lambda x: x IS NOT NULL)) AS concept FROM documents) GROUP BY 1",
    "map_snapshot": f"WITH {SQL} SELECT geography_code, calendar_year, measure_code AS indicator, max(value)::DOUBLE AS value FROM fact GROUP BY ALL",
    "source_mapping": "WITH e AS (SELECT *, CASE WHEN event_id % 9 = 0 THEN -1 ELSE round(value) END AS t FROM events) SELECT 'events:' || event_id AS lineage, ts::DATE::VARCHAR AS period_start, CASE WHEN t <> -1 THEN round(t) / 10 END AS celsius, CASE WHEN t = -1 THEN 0 ELSE round(t) / 10 END AS millimetres FROM e",
    "region_rules": """WITH v AS (SELECT n_nationkey AS nation, CASE n_nationkey % 6 WHEN 0 THEN 'NL01' WHEN 1 THEN 'PV' || n_nationkey WHEN 2 THEN printf('GM%04d', n_nationkey) WHEN 3 THEN printf('BU%04d0001', n_nationkey) WHEN 4 THEN 'x' END AS value_key,
 CASE n_nationkey % 12 WHEN 0 THEN 'country' WHEN 6 THEN 'country' WHEN 5 THEN 'country' WHEN 1 THEN 'province' WHEN 7 THEN 'province' WHEN 4 THEN 'province' WHEN 2 THEN 'municipality' WHEN 8 THEN 'municipality' WHEN 3 THEN 'neighborhood' WHEN 9 THEN 'neighborhood' END AS dimension_level FROM nation)
 SELECT nation, value_key, dimension_level, coalesce(dimension_level, CASE WHEN nation % 5 = 0 THEN 'country' END, CASE WHEN nation % 2 = 0 THEN 'municipality' END) AS level, CASE WHEN dimension_level IS NOT NULL THEN 'dimension' WHEN nation % 5 = 0 THEN 'row' WHEN nation % 2 = 0 THEN 'code' ELSE 'none' END AS evidence,
 CASE WHEN value_key LIKE 'PV%' AND dimension_level = 'province' THEN value_key END AS province_code, CASE WHEN value_key LIKE 'GM%' THEN value_key WHEN value_key LIKE 'BU%' THEN substr(value_key, 1, 6) END AS municipality_code FROM v""",
    "spatial_labels": f"WITH {_DS} SELECT CASE WHEN list_has_all(levels, ['country', 'municipality', 'neighborhood']) THEN 'Netherlands — all municipalities, wijken and buurten' WHEN list_has_all(levels, ['country', 'province', 'municipality']) THEN 'Netherlands — country, provinces and municipalities' WHEN list_contains(levels, 'province') THEN 'Netherlands — provinces' WHEN list_contains(levels, 'municipality') THEN 'Netherlands — municipalities' WHEN list_contains(levels, 'country') THEN 'Netherlands — country' WHEN list_contains(levels, 'neighborhood') THEN 'Netherlands — wijken and buurten' END AS coverage, count(*) AS datasets FROM d GROUP BY 1",
    "text_rules": """WITH y AS (SELECT c_custkey, 1960 + c_custkey % 60 AS a, 1990 + c_custkey % 50 AS b FROM customer), l AS (SELECT *, list_filter([a, b], lambda x: x BETWEEN 1970 AND 2026) AS years FROM y)
 SELECT c_custkey, array_to_string(years, ',') AS years, CASE WHEN len(years) < 2 THEN len(years) ELSE abs(years[1] - years[2]) + 1 END AS year_count, (1000 + c_custkey % 1000) + (c_custkey % 10) / 10.0::DOUBLE AS number, CASE WHEN c_custkey % 3 = 0 THEN '2001-02-0' || (c_custkey % 9 + 1) END AS iso_date, 'arzte cafe no ' || c_custkey AS folded, 'el_' || c_custkey AS slug, 1998 >= a AND 1998 < b AS in_bucket, round(c_custkey / 700.0::DOUBLE * 10000) / 100 AS share, c_custkey % 2 = 0 AS is_geography FROM l""",
    "schema_hashes": "SELECT p_brand, count(*) AS properties, sha256('[' || string_agg('{\"key\":' || p_partkey || ',\"size\":' || p_size || '}', ',' ORDER BY p_partkey) || ']') AS schema_hash FROM part GROUP BY 1",
    "top_chart": "SELECT n_name AS name, count(*) AS orders, round(count(*) FILTER (o_totalprice > 200000) / count(*)::DOUBLE * 10000) / 100 AS share_percent FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY share_percent DESC, name LIMIT 6",
    "hash_vectors": r"""WITH t AS (SELECT p_partkey, sha256(unnest(regexp_extract_all(lower('the part ' || p_name || ' ' || p_type), '[\p{L}\p{N}]+'))) AS h FROM part),
        b AS (SELECT p_partkey, h, unnest(range(0, 8)) AS k FROM t), s AS (SELECT p_partkey, ('0x' || substr(h, (2 * k + 1)::INT, 2))::BIGINT % 64 AS slot, sum(CASE WHEN ('0x' || substr(h, (2 * k + 17)::INT, 2))::BIGINT >= 128 THEN -1 ELSE 1 END) AS v FROM b GROUP BY 1, 2),
        n AS (SELECT *, sqrt(sum(v * v) OVER (PARTITION BY p_partkey)::DOUBLE) AS n FROM s) SELECT p_partkey, slot, round(round(v::DOUBLE / n, 6), 4) AS value FROM n WHERE v <> 0""",
}
QUERIES = {n: globals()[n] for n in ORACLES}
