"""Metric contracts: generated from capabilities, curated, diagnosed, reviewed, checked against facts, promoted, and handed out.

All take and give DataFrames. A capability is what is known of a measure: domain_id, dataset_code, measure_key, measure_code, measure_name, unit_code,
default_aggregation, is_additive, grains, populated_fact_rows, min_year, max_year, executable_candidate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quaystat.functions import domain, rules

GRAINS = ("municipality_year", "province_year", "region_year", "national_year")
#: Labels that are an answer and no measure, alone or as a part of a label or code.
ANSWERS = ("totaal", "overig", "weet niet", "weetniet", "ja", "nee", "waarschijnlijk", "onwaarschijnlijk", "zeer waarschijnlijk", "zeer onwaarschijnlijk", "gunstige tijd", "ongunstige tijd", "een goed moment", "een slecht moment")
#: Words of a label and the kind of metric that they tell, in order of precedence.
KINDS = (
    ("percentage", ("%", "percentage", "procent", "aandeel")),
    ("ratio", ("ratio", "verhouding", "per inwoner", "per persoon")),
    ("average_or_median", ("gemiddeld", "average", "median", "mediaan")),
    ("index", ("index", "vertrouwen", "saldo")),
    ("amount", ("waarde", "inkomen", "bedrag", "kosten", "uitgaven", "bestedingen")),
    ("count", ("aantal", "woningen", "personen", "huishoudens", "achterstanden")),
)


def slug(text: Column, other: str = "metric") -> Column:
    """Lower-case letters and digits with single underscores, 48 characters at most."""
    folded = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", "_"), r"^_+|_+$", "")
    cut = F.substring(folded, 1, 48)
    return F.when(cut == "", F.lit(other)).otherwise(cut)


def suffix(text: Column) -> Column:
    """Up to six digits to the base of 36 of a 32-bit hash: times 33, exclusive or with each character, from 5381."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    word = F.aggregate(chars, F.lit(5381).cast("long"), lambda h, c: (h * 33).bitwiseXOR(F.ascii(c).cast("long")).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.substring(F.lower(F.conv(word.cast("string"), 10, 36)), 1, 6)


def generated(capabilities: DataFrame) -> DataFrame:
    """The contract that a capability suggests: code, label, aggregation, grains, synonyms, and which plans it supports.

    Codes end in a short hash, so that two measures of one name can share a code: the one of smallest key stays. Without keys all other columns decide, so
    that the rows' order never does.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    code = F.concat_ws(
        "_", F.lit("gen"), F.lower(F.coalesce("dataset_code", F.lit("dataset"))), slug(F.coalesce("measure_code", "measure_name", F.col("measure_key").cast("string"))),
        suffix(F.concat_ws(":", text("domain_id"), text("dataset_code"), text("measure_key"))),
    )
    how = domain.safe_aggregation(F.col("default_aggregation"), F.col("measure_name"), F.col("unit_code"), F.col("is_additive"))
    grains = F.array_distinct(F.transform(F.coalesce("grains", F.array().cast("array<string>")), lambda g: F.when(g == "country_year", "national_year").otherwise(g)))
    default = F.coalesce(*(F.when(F.array_contains("valid_grains", g), F.lit(g)) for g in GRAINS), F.get("valid_grains", F.lit(0)))
    names = F.array("label", "measure_code", F.regexp_replace("label", r"\s+", " "), F.regexp_replace("label", "-", " "))
    synonyms = F.array_distinct(F.filter(F.transform(names, lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != ""))
    first = [F.asc_nulls_last(c) for c in ("measure_key", "measure_name", "unit_code", "default_aggregation", "is_additive", "populated_fact_rows", "min_year", "max_year", "executable_candidate", "measure_code", "grains", "domain_id", "dataset_code")]
    one = capabilities.withColumn("metric_code", code).withColumn("n__", F.row_number().over(Window.partitionBy("metric_code").orderBy(*first))).filter("n__ = 1").drop("n__")
    out = one.withColumns({ "label": F.coalesce("measure_name", "measure_code"), "aggregation": how, "valid_grains": grains})
    out = out.withColumns({"default_grain": default, "synonyms": synonyms})
    wide = F.arrays_overlap("valid_grains", F.array(*(F.lit(g) for g in GRAINS[:3])))
    return out.withColumns({"dataset_codes": F.array_compact(F.array("dataset_code")), "supports_ranking": wide, "supports_comparison": F.size("valid_grains") > 0, "supports_trend": F.coalesce(F.col("max_year") > F.col("min_year"), F.lit(False))})


def with_curation(contracts: DataFrame, curated: DataFrame) -> DataFrame:
    """Contracts with curated ones over them: a curated value wins where it is not null, and curated contracts that were not generated join.

    curated has metric_code and any of the contracts' columns. metadata_origin tells which rows a person has touched.
    """
    own = [c for c in curated.columns if c != "metric_code"]
    c = curated.select(F.col("metric_code").alias("c_code"), *(F.col(x).alias(f"c_{x}") for x in own))
    both = contracts.join(c, F.col("metric_code") == F.col("c_code"), "full")
    value = lambda x: F.coalesce(f"c_{x}", x).alias(x) if x in own else F.col(x)
    cols = [F.coalesce("metric_code", "c_code").alias("metric_code"), *(value(x) for x in contracts.columns if x not in ("metric_code", "metadata_origin"))]
    return both.select(*cols, F.when(F.col("c_code").isNotNull(), "curated").otherwise("generated").alias("metadata_origin"))


def diagnosed(contracts: DataFrame) -> DataFrame:
    """Contracts with `blocking` and `warnings`, review_status, recommendation, risk and priority."""
    some = lambda *pairs: F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in pairs)))
    same = F.count("*").over(Window.partitionBy("domain_id", F.lower("label")))
    out = contracts.withColumn("same_label", same)
    blocking = some(
        ("missing_dataset_code", F.col("dataset_code").isNull()), ("missing_measure_key", F.col("measure_key").isNull()), ("missing_unit_code", F.coalesce("unit_code", F.lit("UNKNOWN")).isin("", "UNKNOWN")),
        ("unsafe_aggregation", F.col("aggregation") == "none"), ("missing_grains", F.size("valid_grains") == 0), ("missing_default_grain", F.col("default_grain").isNull()), ("no_populated_facts", F.coalesce("populated_fact_rows", F.lit(0)) <= 0),
    )
    warnings = some(
        ("duplicate_label", F.col("same_label") > 1), ("non_additive_metric", ~F.coalesce("is_additive", F.lit(True)) | F.col("aggregation").isin("average", "median")),
        ("not_municipality_ready", ~F.array_contains("valid_grains", "municipality_year")), ("thin_synonyms", F.size("synonyms") < 2),
    )
    out = out.withColumns({"blocking": blocking, "warnings": warnings})
    bad, ready, warned = F.size("blocking") > 0, F.coalesce("executable_candidate", F.lit(False)), F.size("warnings") > 0
    return out.withColumns(
        {
            "review_status": rules.first_match([(bad, "needs_fix"), (ready, "review_candidate")], "profiled"),
            "recommendation": F.when(~bad & ready, "human_review_then_enable").otherwise("keep_disabled"),
            "risk": rules.first_match([(bad, "high"), (ready & ~warned, "low")], "medium"),
            "priority": F.when(bad, 900).when(ready & warned, 220).when(ready, 120).otherwise(500).cast("long"),
        }
    ).drop("same_label")


def test_cases(contracts: DataFrame) -> DataFrame:
    """Questions that a contract must answer: the highest place and a comparison in its last year, and the trend since its first."""
    case = lambda ok, question, intent, year: F.when(ok & year.isNotNull(), F.struct(question.alias("question"), F.lit(intent).alias("expected_intent"), year.cast("long").alias("expected_year")))
    first, last, text = F.col("min_year"), F.col("max_year"), lambda *x: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in x))
    place = F.coalesce(F.regexp_replace("default_grain", "_year$", ""), F.lit("gebied"))
    cases = F.array_compact(
        F.array(
            case(F.col("supports_ranking"), text("Waar is ", F.col("label"), " het hoogst in ", last, "?"), "rank_geographies", last),
            case(F.col("supports_comparison"), text("Vergelijk ", F.col("label"), " per ", place, " in ", last, "."), "compare_geographies", last),
            case(F.col("supports_trend"), text("Hoe ontwikkelde ", F.col("label"), " zich sinds ", first, "?"), "trend", first),
        )
    )
    return contracts.select("metric_code", F.get("dataset_codes", F.lit(0)).alias("expected_dataset_code"), F.col("default_grain").alias("expected_grain"), F.explode(cases).alias("c")).select("c.*", F.col("metric_code").alias("expected_metric_code"), "expected_dataset_code", "expected_grain")


def availability(contracts: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows, places and bounds of each contract by dataset, level, period type and year.

    A contract names several data sets: they are exploded, so that the join is on (measure, dataset) and no list is searched for each fact; facts are added up
    by measure and data set before, so that contracts that share them do not multiply rows.
    """
    known = facts.filter(F.col("value").isNotNull() & ~F.col("is_missing") & F.col("dataset_code").isNotNull() & F.col("calendar_year").isNotNull())
    by = [F.coalesce("geography_type", F.lit("unknown")).alias("geography_type"), F.coalesce(F.nullif("period_type", F.lit("")), F.lit("year")).alias("period_type"), "calendar_year"]
    cells = known.groupBy("measure_key", "dataset_code", *by).agg(F.count("*").alias("row_count"), F.countDistinct("geography_code").alias("geography_count"), F.min("value").alias("min_value"), F.max("value").alias("max_value"))
    pairs = contracts.select("metric_code", "measure_key", F.explode(F.array_distinct("dataset_codes")).alias("dataset_code")).distinct()
    return pairs.join(cells, ["measure_key", "dataset_code"])


def structural_checks(contracts: DataFrame, available: DataFrame, values: DataFrame, filters: DataFrame) -> DataFrame:
    """(metric_code, errors) of the contracts: what they lack, no facts, and filters on members that no dimension contract has.

    available: metric_code, row_count. values: dataset_code (null: of any), dimension_code, category_code, category_name. filters: metric_code, dimension_code, value, of
    contracts and of concepts that are bound to them.
    """
    have = available.filter("row_count > 0").select("metric_code").distinct().withColumn("has_facts", F.lit(True))
    member = F.explode(F.array_distinct(F.array_compact(F.array("category_code", "category_name"))))
    valid = values.select("dataset_code", F.lower("dimension_code").alias("d"), member.alias("v")).distinct()
    own = filters.join(contracts.select("metric_code", F.explode_outer("dataset_codes").alias("own_dataset")), "metric_code").withColumn("d", F.lower("dimension_code"))
    anywhere = valid.filter("dataset_code is null").select("d", F.col("v").alias("value"), F.lit(True).alias("any_set")).distinct()
    there = valid.filter("dataset_code is not null").select(F.col("dataset_code").alias("own_dataset"), "d", F.col("v").alias("value"), F.lit(True).alias("own_set"))
    own = own.join(anywhere, ["d", "value"], "left").join(there, ["own_dataset", "d", "value"], "left")
    own = own.groupBy("metric_code", "d", "value").agg(F.coalesce(F.bool_or(F.coalesce("any_set", F.lit(False)) | F.coalesce("own_set", F.lit(False))), F.lit(False)).alias("ok"))
    bad = own.filter("not ok").select("metric_code").distinct().withColumn("bad_filter", F.lit(True))
    out = contracts.join(have, "metric_code", "left").join(bad, "metric_code", "left")
    errors = [
        ("missing_dataset_codes", F.size("dataset_codes") <= 0), ("missing_measure_key", F.col("measure_key").isNull()), ("missing_unit_code", F.col("unit_code").isNull()), ("missing_safe_aggregation", F.coalesce("aggregation", F.lit("none")) == "none"),
        ("missing_valid_grains", F.size("valid_grains") <= 0), ("missing_default_grain", F.col("default_grain").isNull()), ("missing_contract_availability", F.col("has_facts").isNull()), ("invalid_category_filter", F.col("bad_filter").isNotNull()),
    ]
    return out.select("metric_code", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in errors))).alias("errors"))


def golden_checks(questions: DataFrame, contracts: DataFrame, available: DataFrame) -> DataFrame:
    """(question, errors): whether the contract that should answer a question is there, enabled and reviewed, and has the facts.

    questions: question, expected_metric_code, expected_dataset_code, expected_grain, expected_geography_type, expected_year; what is null is not asked for.
    """
    c = contracts.select(F.col("metric_code").alias("m"), "dataset_codes", "valid_grains", "execution_status", "contract_status")
    q = questions.withColumn("q_id", F.monotonically_increasing_id())
    a = available.filter("row_count > 0").select(F.col("metric_code").alias("expected_metric_code"), "dataset_code", "geography_type", "calendar_year").distinct()
    asked = lambda want, have: F.col(want).isNull() | (F.col(want) == F.col(have))
    hit = q.join(a, "expected_metric_code").filter(asked("expected_dataset_code", "dataset_code") & asked("expected_geography_type", "geography_type") & asked("expected_year", "calendar_year"))
    hit = hit.select(F.col("q_id").alias("h_id")).distinct()
    out = q.join(c, F.col("expected_metric_code") == F.col("m"), "left").join(hit, F.col("q_id") == F.col("h_id"), "left")
    found, none = F.col("m").isNotNull(), F.array().cast("array<string>")
    errors = [
        ("missing_expected_metric_code", F.col("expected_metric_code").isNull()), ("expected_metric_contract_not_found", ~found), ("expected_metric_not_executable", found & (F.col("execution_status") != "enabled")),
        ("expected_metric_not_reviewed", found & ~F.col("contract_status").isin("reviewed", "curated")), ("expected_dataset_not_in_contract", F.col("expected_dataset_code").isNotNull() & ~F.array_contains(F.coalesce("dataset_codes", none), F.col("expected_dataset_code"))),
        ("expected_grain_not_in_contract", F.col("expected_grain").isNotNull() & ~F.array_contains(F.coalesce("valid_grains", none), F.col("expected_grain"))), ("missing_expected_availability", F.col("h_id").isNull()),
    ]
    return out.select("question", "expected_metric_code", F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in errors))).alias("errors"))


def promoted(contracts: DataFrame, requests: DataFrame, errors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contracts after, events) of requests to change the status of contracts, all of them at once.

    requests: metric_code, to_status, force, reviewer, reason; one for a contract. errors: metric_code, errors, from any checks. A step to reviewed or curated
    is refused while there are errors, unless it is forced; it enables the contract and marks it as touched by a person. Events tell what became of
    each request; of an unknown contract it is `not_found`.
    """
    e = errors.groupBy("metric_code").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("errors")))).alias("errors"))
    r = requests.withColumnsRenamed({c: f"r_{c}" for c in requests.columns})
    up = F.col("r_to_status").isin("reviewed", "curated")
    both = contracts.join(r, F.col("metric_code") == F.col("r_metric_code"), "full").join(e.withColumnsRenamed({"metric_code": "e_code", "errors": "e_errors"}), F.coalesce("metric_code", "r_metric_code") == F.col("e_code"), "left")
    wrong = F.coalesce("e_errors", F.array().cast("array<string>"))
    outcome = rules.first_match([(F.col("metric_code").isNull(), "not_found"), (up & (F.size(wrong) > 0) & ~F.coalesce("r_force", F.lit(False)), "refused")], "promoted")
    both = both.withColumn("outcome", F.when(F.col("r_metric_code").isNotNull(), outcome))
    done = F.coalesce(F.col("outcome") == "promoted", F.lit(False))
    status = F.when(up, "enabled").otherwise("disabled")
    new = {"contract_status": F.when(done, F.col("r_to_status")).otherwise(F.col("contract_status")), "execution_status": F.when(done, status).otherwise(F.col("execution_status")), "metadata_origin": F.when(done & up, F.lit("curated")).otherwise(F.col("metadata_origin"))}
    after = both.filter("metric_code is not null").select(*(new[c].alias(c) if c in new else F.col(c) for c in contracts.columns))
    events = both.filter("outcome is not null").select(
        F.col("r_metric_code").alias("metric_code"), "outcome", F.col("contract_status").alias("from_status"), F.col("r_to_status").alias("to_status"), F.col("execution_status").alias("from_execution_status"),
        F.when(done, status).otherwise(F.col("execution_status")).alias("to_execution_status"), F.col("r_reviewer").alias("promoted_by"), F.col("r_reason").alias("event_reason"), wrong.alias("errors"),
    )
    return after, events


def reviewed_by_rules(contracts: DataFrame) -> DataFrame:
    """The kind of each metric by its words, how it may be added up, how good its unit is, and whether its label is an answer and no measure."""
    text = F.lower(F.concat_ws(" ", "label", "unit_code"))
    kind = rules.first_match([(reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in words)), name) for name, words in KINDS], "unknown")
    out = contracts.withColumn("metric_type", kind)
    how, fixed = F.lower("aggregation"), F.col("metric_type").isin("percentage", "ratio", "average_or_median", "index")
    additive = F.coalesce(how == "sum", F.lit(False)) | F.coalesce("is_additive", F.lit(False))
    known = ~F.coalesce(how, F.lit("none")).isin("", "unknown", "none")
    unit = F.trim(F.coalesce("unit_code", F.lit("")))
    label = F.trim(F.lower(F.coalesce("label", F.lit(""))))
    return out.select(
        "metric_code", "metric_type",
        rules.first_match([(fixed, "non_additive"), (additive, "additive"), (known, "non_additive")], "unknown").alias("aggregation_classification"),
        F.when(fixed, F.when(how == "median", "median").otherwise("average")).when(additive, "sum").when(known, how).otherwise("unknown").alias("recommended_aggregation"),
        rules.first_match([(unit.isin("", "UNKNOWN"), "missing"), (unit.isin("COUNT", "EUR", "EUR_THOUSANDS", "PERCENT", "INDEX"), "standard")], "source_specific").alias("unit_quality"),
        label.isin(*ANSWERS).alias("is_answer"),
    )


def bound_concepts(concepts: DataFrame, contracts: DataFrame) -> DataFrame:
    """(concept_code, metric_code, binding_role, priority): contracts whose label has a word of a concept, its unit and one of its grains.

    concepts: concept_code, words, required_unit_code (null: any), valid_grains (empty: any). Words of labels are exploded and joined, so no concept is held against
    every contract. The first binding of a concept by selection order is its primary one.
    """
    words = concepts.select("concept_code", "required_unit_code", F.col("valid_grains").alias("c_grains"), F.explode(F.transform("words", lambda w: F.lower(w))).alias("word"))
    cut = F.explode(F.array_distinct(F.split(F.lower(F.coalesce("label", F.lit(""))), r"[^\p{L}\p{N}]+")))
    own = contracts.select("metric_code", "unit_code", "valid_grains", "priority", cut.alias("word"))
    hit = own.join(words, "word").filter(F.col("required_unit_code").isNull() | (F.col("required_unit_code") == F.col("unit_code")))
    hit = hit.filter((F.size("c_grains") <= 0) | F.arrays_overlap("c_grains", "valid_grains")).select("concept_code", "metric_code", "priority").distinct()
    place = F.row_number().over(Window.partitionBy("concept_code").orderBy("priority", "metric_code"))
    return hit.select("concept_code", "metric_code", F.when(place == 1, "primary").otherwise("alternative").alias("binding_role"), place.cast("long").alias("priority"))


def bundle(sets: dict[str, tuple[DataFrame, list, int]]) -> DataFrame:
    """(record_set, position, record): the first rows of several sets in their orders, each as JSON; what a reader of contracts is given."""
    parts = []
    for name, (df, order, limit) in sets.items():
        top = df.orderBy(*order).limit(limit)
        place = F.row_number().over(Window.orderBy(*order)).cast("long")  # over as many rows as the limit
        parts.append(top.select(F.lit(name).alias("record_set"), place.alias("position"), F.to_json(F.struct(*(F.col(c) for c in df.columns))).alias("record")))
    return reduce(DataFrame.unionByName, parts)
