"""Queries of the life of metric contracts over the parts as measures and their order lines as facts, with DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystat.operators import contracts as C
from quaystat.sources.mart import read

UNITS = ("EUR", "COUNT", "PERCENT", "UNKNOWN", "INDEX", "M2")
NAMES = ("Gemiddelde prijs", "Mediaan inkomen", "Aantal woningen", "Totaal", "Waarde per inwoner", "Voorraad")
GRAIN_SETS = (("municipality_year", "country_year"), ("province_year",), (), ("country_year",), ("region_quarter",))


def capabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a measure, with the years and number of its lines; some lack a key, a unit, grains or a way to add up."""
    k = F.col("p_partkey")
    one = lambda values, n: F.element_at(F.array(*(F.lit(v) for v in values)), (k % n + 1).cast("int"))
    lines = read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.min(F.year("l_shipdate")).alias("a"), F.max(F.year("l_shipdate")).alias("b"))
    p = read(spark, sf_dir, "part").join(lines, k == F.col("l_partkey"), "left")
    grains = F.element_at(F.array(*(F.array(*(F.lit(g) for g in s)).cast("array<string>") for s in GRAIN_SETS)), (k % 5 + 1).cast("int"))
    return p.select(
        F.lit("trade").alias("domain_id"), F.when(k % 97 != 1, F.concat(F.lit("D"), (k % 7).cast("string"))).alias("dataset_code"), F.when(k % 89 != 2, k).alias("measure_key"), F.col("p_name").alias("measure_code"),
        F.concat(one(NAMES, 6), F.lit(" - "), F.col("p_type"), F.when(k % 3 == 0, k.cast("string")).otherwise("")).alias("measure_name"), one(UNITS, 6).alias("unit_code"),
        F.when(k % 4 == 1, "none").when(k % 4 == 2, "sum").when(k % 4 == 3, "unknown").alias("default_aggregation"), (k % 5 == 0).alias("is_additive"), grains.alias("grains"),
        F.coalesce("n", F.lit(0)).alias("populated_fact_rows"), F.col("a").cast("long").alias("min_year"), F.col("b").cast("long").alias("max_year"), (k % 2 == 0).alias("executable_candidate"),
    )


def contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The diagnosed contracts, of which a person has touched some: another label and unit, and the default grain of the nation."""
    own = C.generated(capabilities(spark, sf_dir))
    curated = own.filter("measure_key % 50 = 3").select("metric_code", F.concat(F.lit("Curated "), "label").alias("label"), F.lit("COUNT").alias("unit_code"), F.when(F.col("measure_key") % 4 == 0, "national_year").alias("default_grain"))
    return C.diagnosed(C.with_curation(own, curated))


def contract_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every contract with its code, what speaks against it and its place in the review."""
    c = contracts(spark, sf_dir)
    text = lambda x: F.array_join(x, ",").alias(x)
    return c.select("metric_code", "label", "aggregation", "default_grain", "metadata_origin", F.size("synonyms").cast("long").alias("n_synonyms"), text("blocking"), text("warnings"), "review_status", "recommendation", "risk", "priority")


def contract_test_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.test_cases(C.generated(capabilities(spark, sf_dir)))


def _line_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = read(spark, sf_dir, "lineitem")
    k = F.col("l_partkey")
    return line.select(
        k.alias("measure_key"), F.concat(F.lit("D"), ((k + F.col("l_linenumber") % 2) % 7).cast("string")).alias("dataset_code"), F.when(F.col("l_suppkey") % 3 != 0, "municipality").alias("geography_type"), (F.col("l_suppkey") % 10).cast("string").alias("geography_code"),
        F.when(F.col("l_linestatus") == "F", "year").otherwise("").alias("period_type"), F.year("l_shipdate").cast("long").alias("calendar_year"), F.when(F.col("l_returnflag") != "R", F.col("l_extendedprice")).cast("decimal(18,2)").alias("value"), (F.col("l_returnflag") == "R").alias("is_missing"),
    )


def _available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts of two data sets each, their own and the next one, and what they have."""
    own = C.generated(capabilities(spark, sf_dir)).filter("measure_key is not null and dataset_code is not null")
    following = F.concat(F.lit("D"), ((F.col("measure_key") + 1) % 7).cast("string"))
    return C.availability(own.withColumn("dataset_codes", F.array("dataset_code", following, "dataset_code")), _line_facts(spark, sf_dir))


def contract_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the contracts of two data sets each have, by year."""
    a = _available(spark, sf_dir)
    return a.select("metric_code", "dataset_code", "geography_type", "period_type", "calendar_year", "row_count", "geography_count", F.col("min_value").cast("double").alias("min_value"), F.col("max_value").cast("double").alias("max_value"))


def _filters(c: DataFrame) -> DataFrame:
    """Filters of some contracts: members that are there for all data sets, for one only, or nowhere."""
    k = F.col("measure_key")
    return c.filter(k % 4 == 0).select("metric_code", F.when(k % 8 == 0, "SEGMENT").otherwise("Priority").alias("dimension_code"), F.when(k % 12 == 0, "BUILDING").when(k % 20 == 0, "nothing").otherwise("1-URGENT").alias("value"))


def contract_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the executable contracts."""
    c = C.generated(capabilities(spark, sf_dir)).filter("executable_candidate")
    segments = read(spark, sf_dir, "customer").select(F.lit(None).cast("string").alias("dataset_code"), F.lit("Segment").alias("dimension_code"), F.substring("c_mktsegment", 1, 3).alias("category_code"), F.col("c_mktsegment").alias("category_name")).distinct()
    priorities = read(spark, sf_dir, "orders").select(F.lit("D4").alias("dataset_code"), F.lit("priority").alias("dimension_code"), F.lit(None).cast("string").alias("category_code"), F.col("o_orderpriority").alias("category_name")).distinct()
    out = C.structural_checks(c, _available(spark, sf_dir).select("metric_code", "row_count"), segments.unionByName(priorities), _filters(c))
    return out.select("metric_code", F.array_join("errors", ",").alias("errors"))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contracts as they are stored, in several states."""
    k = F.col("measure_key")
    c = C.generated(capabilities(spark, sf_dir)).filter("measure_key is not null")
    return c.withColumns({"contract_status": F.when(k % 3 == 0, "reviewed").when(k % 3 == 1, "generated").otherwise("deprecated"), "execution_status": F.when(k % 6 == 0, "enabled").otherwise("disabled"), "metadata_origin": F.lit("generated")})


def golden_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of questions that name a contract, some of which is not there, with a data set, a grain, a level or a year."""
    c = _stored(spark, sf_dir)
    k = F.col("measure_key")
    q = c.select(
        F.concat(F.lit("q"), k.cast("string")).alias("question"), F.when(k % 31 == 0, None).when(k % 29 == 0, "gone").otherwise(F.col("metric_code")).alias("expected_metric_code"), F.when(k % 2 == 0, F.concat(F.lit("D"), (k % 14).cast("string"))).alias("expected_dataset_code"),
        F.when(k % 5 < 2, "province_year").alias("expected_grain"), F.when(k % 3 == 0, "municipality").alias("expected_geography_type"), F.when(k % 4 == 0, 1997).cast("long").alias("expected_year"),
    )
    out = C.golden_checks(q, c, _available(spark, sf_dir))
    return out.select("question", F.array_join("errors", ",").alias("errors"))


def contract_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of requests to review or deprecate contracts: some are refused for their diagnostics, some forced, one is of no contract."""
    c = C.diagnosed(_stored(spark, sf_dir))
    k = F.col("measure_key")
    ask = c.filter(k % 2 == 0).select("metric_code", F.when(k % 10 == 0, "deprecated").when(k % 4 == 0, "curated").otherwise("reviewed").alias("to_status"), (k % 14 == 0).alias("force"), F.lit("someone").alias("reviewer"), F.lit("round").alias("reason"))
    none = spark.createDataFrame([("nowhere", "reviewed", False, "someone", "round")], ask.schema)
    after, events = C.promoted(c, ask.unionByName(none), c.select("metric_code", F.col("blocking").alias("errors")))
    both = events.join(after.select("metric_code", F.col("contract_status").alias("after_status"), F.col("metadata_origin").alias("after_origin")), "metric_code", "left")
    return both.select("metric_code", "outcome", "from_status", "to_status", "to_execution_status", "after_status", "after_origin", F.array_join("errors", ",").alias("errors"))


def contract_rule_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.reviewed_by_rules(C.generated(capabilities(spark, sf_dir)).filter("measure_key is not null"))


def concept_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concepts bound to all contracts whose label has one of their words."""
    concepts = spark.createDataFrame([("prices", ["prijs", "waarde"], "EUR", []), ("homes", ["Woningen"], None, ["municipality_year", "national_year"]), ("stock", ["voorraad", "standard"], None, [])], "concept_code string, words array<string>, required_unit_code string, valid_grains array<string>")
    return C.bound_concepts(concepts, C.diagnosed(C.generated(capabilities(spark, sf_dir)).filter("measure_key is not null")))


def contract_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of contracts: the first of contracts, bindings, measures and facts' grains."""
    c = C.diagnosed(C.generated(capabilities(spark, sf_dir)).filter("measure_key is not null"))
    grains = _available(spark, sf_dir).groupBy("dataset_code", "geography_type", "period_type").agg(F.min("calendar_year").alias("min_year"), F.max("calendar_year").alias("max_year"), F.sum("row_count").alias("fact_rows"))
    return C.bundle(
        {
            "metric_contracts": (c.select("metric_code", "unit_code", "aggregation", "default_grain", "priority"), ["priority", "metric_code"], 200),
            "concept_metric_bindings": (concept_bindings(spark, sf_dir), ["concept_code", "priority"], 100),
            "measures": (c.select("dataset_code", "measure_key", "populated_fact_rows"), ["dataset_code", "measure_key"], 150),
            "grains": (grains, ["dataset_code", "geography_type", "period_type"], 50),
        }
    )


def _pick(values: tuple, n: int) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][p_partkey % {n} + 1]"


_SETS = "[" + ", ".join("[" + ", ".join(f"'{g}'" for g in s) + "]::VARCHAR[]" for s in GRAIN_SETS) + "][p_partkey % 5 + 1]"
_DIGIT = "substr('0123456789abcdefghijklmnopqrstuvwxyz', (h // {0} % 36 + 1)::INT, 1)"
_CAP = f"""l AS (SELECT l_partkey, count(*) AS n, min(year(l_shipdate)) AS a, max(year(l_shipdate)) AS b FROM lineitem GROUP BY 1),
c0 AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 97 <> 1 THEN 'D' || p_partkey % 7 END AS dataset_code, CASE WHEN p_partkey % 89 <> 2 THEN p_partkey END AS measure_key, p_name AS measure_code, {_pick(NAMES, 6)} || ' - ' || p_type || CASE WHEN p_partkey % 3 = 0 THEN p_partkey::VARCHAR ELSE '' END AS label, {_pick(UNITS, 6)} AS unit_code,
    CASE p_partkey % 4 WHEN 1 THEN 'none' WHEN 2 THEN 'sum' WHEN 3 THEN 'unknown' END AS da, p_partkey % 5 = 0 AS is_additive, list_transform({_SETS}, lambda g: CASE WHEN g = 'country_year' THEN 'national_year' ELSE g END) AS g, coalesce(n, 0) AS n, a AS min_year, b AS max_year, p_partkey % 2 = 0 AS cand FROM part LEFT JOIN l ON l_partkey = p_partkey),
c1 AS (SELECT *, 'trade:' || coalesce(dataset_code, 'null') || ':' || coalesce(measure_key::VARCHAR, 'null') AS t FROM c0),
c2 AS (SELECT *, list_reduce(list_prepend(5381::BIGINT, list_transform(string_split(t, ''), lambda x: ascii(x)::BIGINT)), lambda h, x: xor(h * 33, x) & 4294967295) AS h FROM c1),
con AS (SELECT *, concat_ws('_', 'gen', coalesce(lower(dataset_code), 'dataset'), substr(regexp_replace(regexp_replace(lower(measure_code), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48), substr(ltrim({' || '.join(_DIGIT.format(36**p) for p in range(6, -1, -1))}, '0'), 1, 6)) AS metric_code,
    CASE WHEN da = 'sum' THEN 'sum' WHEN contains(lower(label), 'mediaan') THEN 'median' WHEN contains(lower(label), 'gemiddeld') OR unit_code = 'PERCENT' THEN 'average' WHEN is_additive OR unit_code = 'COUNT' THEN 'sum' ELSE 'none' END AS aggregation,
    CASE WHEN list_contains(g, 'municipality_year') THEN 'municipality_year' WHEN list_contains(g, 'province_year') THEN 'province_year' WHEN list_contains(g, 'region_year') THEN 'region_year' WHEN list_contains(g, 'national_year') THEN 'national_year' ELSE g[1] END AS default_grain,
    len(list_distinct([label, measure_code, regexp_replace(label, '\\s+', ' ', 'g'), replace(label, '-', ' ')])) AS n_synonyms FROM c2
    QUALIFY row_number() OVER (PARTITION BY metric_code ORDER BY measure_key NULLS LAST, label NULLS LAST, unit_code NULLS LAST, da NULLS LAST, is_additive, n, min_year NULLS LAST, max_year NULLS LAST, cand) = 1),
"""
_DIA = """cu AS (SELECT * REPLACE (CASE WHEN cur THEN 'Curated ' || label ELSE label END AS label, CASE WHEN cur THEN 'COUNT' ELSE unit_code END AS unit_code, CASE WHEN cur AND measure_key % 4 = 0 THEN 'national_year' ELSE default_grain END AS default_grain) FROM (SELECT *, {cur} AS cur FROM con)),
du AS (SELECT *, count(*) OVER (PARTITION BY lower(label)) AS same FROM cu),
di AS (SELECT *, concat_ws(',', CASE WHEN dataset_code IS NULL THEN 'missing_dataset_code' END, CASE WHEN measure_key IS NULL THEN 'missing_measure_key' END, CASE WHEN unit_code = 'UNKNOWN' THEN 'missing_unit_code' END, CASE WHEN aggregation = 'none' THEN 'unsafe_aggregation' END, CASE WHEN len(g) = 0 THEN 'missing_grains' END, CASE WHEN default_grain IS NULL THEN 'missing_default_grain' END, CASE WHEN n <= 0 THEN 'no_populated_facts' END) AS blocking,
    concat_ws(',', CASE WHEN same > 1 THEN 'duplicate_label' END, CASE WHEN NOT is_additive OR aggregation IN ('average', 'median') THEN 'non_additive_metric' END, CASE WHEN NOT list_contains(g, 'municipality_year') THEN 'not_municipality_ready' END, CASE WHEN n_synonyms < 2 THEN 'thin_synonyms' END) AS warnings FROM du),
rev AS (SELECT *, CASE WHEN blocking <> '' THEN 'needs_fix' WHEN cand THEN 'review_candidate' ELSE 'profiled' END AS review_status, CASE WHEN blocking <> '' THEN 'high' WHEN cand AND warnings = '' THEN 'low' ELSE 'medium' END AS risk, CASE WHEN blocking <> '' THEN 900 WHEN cand AND warnings <> '' THEN 220 WHEN cand THEN 120 ELSE 500 END::BIGINT AS priority FROM di)"""
_DIAG = _DIA.replace("{cur}", "coalesce(measure_key % 50 = 3, false)")
_PLAIN = _DIA.replace("{cur}", "false").replace("FROM con)", "FROM con WHERE measure_key IS NOT NULL)")
_FACTS = "f AS (SELECT l_partkey AS measure_key, 'D' || (l_partkey + l_linenumber % 2) % 7 AS dataset_code, CASE WHEN l_suppkey % 3 <> 0 THEN 'municipality' ELSE 'unknown' END AS geography_type, l_suppkey % 10 AS place, 'year' AS period_type, year(l_shipdate) AS calendar_year, l_extendedprice::DECIMAL(18,2) AS value FROM lineitem WHERE l_returnflag <> 'R'),"
_AVAIL = f"{_FACTS} pr AS (SELECT metric_code, measure_key, dataset_code FROM con WHERE measure_key IS NOT NULL AND dataset_code IS NOT NULL UNION SELECT metric_code, measure_key, 'D' || (measure_key + 1) % 7 FROM con WHERE measure_key IS NOT NULL AND dataset_code IS NOT NULL), av AS (SELECT metric_code, dataset_code, geography_type, period_type, calendar_year, count(*) AS row_count, count(DISTINCT place) AS geography_count, min(value)::DOUBLE AS min_value, max(value)::DOUBLE AS max_value FROM pr JOIN f USING (measure_key, dataset_code) GROUP BY ALL)"
_CASE = "SELECT {q} AS question, '{i}' AS expected_intent, {y} AS expected_year, metric_code AS expected_metric_code, dataset_code AS expected_dataset_code, default_grain AS expected_grain FROM con WHERE {w}"
_BIND = """cw AS (SELECT metric_code, unit_code, g, priority, unnest(list_distinct(regexp_split_to_array(lower(label), '[^\\p{L}\\p{N}]+'))) AS word FROM rev),
ch AS (SELECT DISTINCT concept_code, metric_code, cw.priority FROM cw JOIN (VALUES ('prices', 'prijs'), ('prices', 'waarde'), ('homes', 'woningen'), ('stock', 'voorraad'), ('stock', 'standard')) t(concept_code, word) USING (word) WHERE (concept_code <> 'prices' OR unit_code = 'EUR') AND (concept_code <> 'homes' OR list_has_any(g, ['municipality_year', 'national_year']))),
cb AS (SELECT concept_code, metric_code, CASE WHEN p = 1 THEN 'primary' ELSE 'alternative' END AS binding_role, p AS priority FROM (SELECT *, row_number() OVER (PARTITION BY concept_code ORDER BY priority, metric_code) AS p FROM ch))"""
_J = lambda *c: "'{' || concat_ws(',', " + ", ".join(f"'\"{n}\":' || " + (f"'\"' || {n} || '\"'" if s else f"{n}::VARCHAR") for n, s in c) + ") || '}'"
ORACLES = {
    "contract_lifecycle": f"WITH {_CAP}{_DIAG} SELECT metric_code, label, aggregation, default_grain, CASE WHEN cur THEN 'curated' ELSE 'generated' END AS metadata_origin, n_synonyms, blocking, warnings, review_status, CASE WHEN review_status = 'review_candidate' THEN 'human_review_then_enable' ELSE 'keep_disabled' END AS recommendation, risk, priority FROM rev",
    "contract_test_cases": f"WITH {_CAP.rstrip().rstrip(',')} "
    + " UNION ALL ".join(
        [
            _CASE.format(q="'Waar is ' || label || ' het hoogst in ' || max_year || '?'", i="rank_geographies", y="max_year", w="max_year IS NOT NULL AND list_has_any(g, ['municipality_year', 'province_year', 'region_year'])"),
            _CASE.format(q="'Vergelijk ' || label || ' per ' || coalesce(regexp_replace(default_grain, '_year$', ''), 'gebied') || ' in ' || max_year || '.'", i="compare_geographies", y="max_year", w="max_year IS NOT NULL AND len(g) > 0"),
            _CASE.format(q="'Hoe ontwikkelde ' || label || ' zich sinds ' || min_year || '?'", i="trend", y="min_year", w="max_year > min_year"),
        ]
    ),
    "contract_availability": f"WITH {_CAP}{_AVAIL} SELECT * FROM av",
    "contract_structure": f"""WITH {_CAP}{_AVAIL}, fl AS (SELECT metric_code, CASE WHEN k % 8 = 0 THEN 'segment' ELSE 'priority' END AS d, CASE WHEN k % 12 = 0 THEN 'BUILDING' WHEN k % 20 = 0 THEN 'nothing' ELSE '1-URGENT' END AS v, dataset_code FROM con WHERE measure_key % 4 = 0),
        bad AS (SELECT metric_code FROM fl WHERE NOT ((d = 'segment' AND v IN (SELECT c_mktsegment FROM customer)) OR (d = 'priority' AND dataset_code IS NOT DISTINCT FROM 'D4' AND v IN (SELECT o_orderpriority FROM orders))))
        SELECT metric_code, concat_ws(',', CASE WHEN dataset_code IS NULL THEN 'missing_dataset_codes' END, CASE WHEN measure_key IS NULL THEN 'missing_measure_key' END, CASE WHEN aggregation = 'none' THEN 'missing_safe_aggregation' END, CASE WHEN len(g) = 0 THEN 'missing_valid_grains' END, CASE WHEN default_grain IS NULL THEN 'missing_default_grain' END,
          CASE WHEN metric_code NOT IN (SELECT metric_code FROM av) THEN 'missing_contract_availability' END, CASE WHEN metric_code IN (SELECT metric_code FROM bad) THEN 'invalid_category_filter' END) AS errors FROM con WHERE cand""",
    "golden_questions": f"""WITH {_CAP}{_AVAIL}, q AS (SELECT k, 'q' || k AS question, CASE WHEN k % 31 = 0 THEN NULL WHEN k % 29 = 0 THEN 'gone' ELSE metric_code END AS em, CASE WHEN k % 2 = 0 THEN 'D' || k % 14 END AS ed, CASE WHEN k % 5 < 2 THEN 'province_year' END AS eg, CASE WHEN k % 3 = 0 THEN 'municipality' END AS et, CASE WHEN k % 4 = 0 THEN 1997 END AS ey FROM con WHERE measure_key IS NOT NULL)
        SELECT question, concat_ws(',', CASE WHEN em IS NULL THEN 'missing_expected_metric_code' END, CASE WHEN c.metric_code IS NULL THEN 'expected_metric_contract_not_found' END, CASE WHEN c.k % 6 <> 0 THEN 'expected_metric_not_executable' END, CASE WHEN c.k % 3 <> 0 THEN 'expected_metric_not_reviewed' END, CASE WHEN ed IS NOT NULL AND (c.dataset_code IS NULL OR c.dataset_code <> ed) THEN 'expected_dataset_not_in_contract' END,
          CASE WHEN eg IS NOT NULL AND NOT coalesce(list_contains(c.g, eg), false) THEN 'expected_grain_not_in_contract' END, CASE WHEN NOT EXISTS (SELECT 1 FROM av a WHERE a.metric_code = em AND (ed IS NULL OR a.dataset_code = ed) AND (et IS NULL OR a.geography_type = et) AND (ey IS NULL OR a.calendar_year = ey)) THEN 'missing_expected_availability' END) AS errors
        FROM q LEFT JOIN con c ON c.metric_code = em""",
    "contract_promotion": f"""WITH {_CAP}{_PLAIN}, s AS (SELECT *, CASE k % 3 WHEN 0 THEN 'reviewed' WHEN 1 THEN 'generated' ELSE 'deprecated' END AS st, CASE WHEN k % 6 = 0 THEN 'enabled' ELSE 'disabled' END AS ex, CASE WHEN k % 10 = 0 THEN 'deprecated' WHEN k % 4 = 0 THEN 'curated' ELSE 'reviewed' END AS ts FROM rev WHERE k % 2 = 0),
        o AS (SELECT *, ts = 'deprecated' OR blocking = '' OR k % 14 = 0 AS ok FROM s)
        SELECT metric_code, CASE WHEN ok THEN 'promoted' ELSE 'refused' END AS outcome, st AS from_status, ts AS to_status, CASE WHEN ok THEN CASE WHEN ts = 'deprecated' THEN 'disabled' ELSE 'enabled' END ELSE ex END AS to_execution_status, CASE WHEN ok THEN ts ELSE st END AS after_status, CASE WHEN ok AND ts <> 'deprecated' THEN 'curated' ELSE 'generated' END AS after_origin,
          array_to_string(list_sort(list_filter(string_split(blocking, ','), lambda x: x <> '')), ',') AS errors FROM o UNION ALL SELECT 'nowhere', 'not_found', NULL, 'reviewed', NULL, NULL, NULL, ''""",
    "contract_rule_review": f"""WITH {_CAP} t AS (SELECT *, CASE WHEN contains(lower(label || ' ' || unit_code), 'aandeel') OR contains(lower(unit_code), 'percentage') THEN 'percentage' WHEN contains(lower(label), 'per inwoner') THEN 'ratio' WHEN contains(lower(label), 'gemiddeld') OR contains(lower(label), 'mediaan') THEN 'average_or_median' WHEN unit_code = 'INDEX' THEN 'index' WHEN contains(lower(label), 'waarde') OR contains(lower(label), 'inkomen') THEN 'amount' WHEN contains(lower(label), 'aantal') THEN 'count' ELSE 'unknown' END AS mt FROM con WHERE measure_key IS NOT NULL),
        a AS (SELECT *, mt IN ('percentage', 'ratio', 'average_or_median', 'index') AS fx, aggregation = 'sum' OR is_additive AS ad FROM t)
        SELECT metric_code, mt AS metric_type, CASE WHEN fx THEN 'non_additive' WHEN ad THEN 'additive' WHEN aggregation <> 'none' THEN 'non_additive' ELSE 'unknown' END AS aggregation_classification, CASE WHEN fx THEN CASE WHEN aggregation = 'median' THEN 'median' ELSE 'average' END WHEN ad THEN 'sum' WHEN aggregation <> 'none' THEN aggregation ELSE 'unknown' END AS recommended_aggregation,
          CASE unit_code WHEN 'UNKNOWN' THEN 'missing' WHEN 'M2' THEN 'source_specific' ELSE 'standard' END AS unit_quality, lower(label) = 'totaal' AS is_answer FROM a""",
    "concept_bindings": f"WITH {_CAP}{_PLAIN}, {_BIND} SELECT * FROM cb",
    "contract_bundle": f"""WITH {_CAP}{_PLAIN}, {_BIND}, {_AVAIL}, gr AS (SELECT dataset_code, geography_type, period_type, min(calendar_year) AS min_year, max(calendar_year) AS max_year, sum(row_count)::BIGINT AS fact_rows FROM av GROUP BY ALL),
        a AS (SELECT 'metric_contracts' AS s, row_number() OVER (ORDER BY priority, metric_code) AS p, {_J(('metric_code', 1), ('unit_code', 1), ('aggregation', 1), ('default_grain', 1), ('priority', 0))} AS r, 200 AS lim FROM rev UNION ALL SELECT 'concept_metric_bindings', row_number() OVER (ORDER BY concept_code, priority), {_J(('concept_code', 1), ('metric_code', 1), ('binding_role', 1), ('priority', 0))}, 100 FROM cb
          UNION ALL SELECT 'measures', row_number() OVER (ORDER BY dataset_code NULLS FIRST, measure_key), {_J(('dataset_code', 1), ('measure_key', 0), ('n', 0)).replace('"n"', '"populated_fact_rows"')}, 150 FROM rev UNION ALL SELECT 'grains', row_number() OVER (ORDER BY dataset_code, geography_type, period_type), {_J(('dataset_code', 1), ('geography_type', 1), ('period_type', 1), ('min_year', 0), ('max_year', 0), ('fact_rows', 0))}, 50 FROM gr)
        SELECT s AS record_set, p AS position, r AS record FROM a WHERE p <= lim""",
}
QUERIES = {n: globals()[n] for n in ORACLES}
