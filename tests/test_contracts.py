"""The life of contracts on rows with gaps."""

import pytest
from pyspark.sql import functions as F

from quaystat.operators import contracts as C

CAP = "domain_id string, dataset_code string, measure_key long, measure_code string, measure_name string, unit_code string, default_aggregation string, is_additive boolean, grains array<string>, populated_fact_rows long, min_year long, max_year long, executable_candidate boolean"


def js_suffix(text):
    """The 32-bit hash as a script engine computes it."""
    h = 5381
    for c in text:
        h = ((h * 33) ^ ord(c)) & 0xFFFFFFFF
    out = ""
    while h:
        h, d = divmod(h, 36)
        out = "0123456789abcdefghijklmnopqrstuvwxyz"[d] + out
    return out[:6]


@pytest.mark.parametrize("text", ["", "a", "trade:D1:77", "x" * 200])
def test_suffix(spark, text):
    assert spark.range(1).select(C.suffix(F.lit(text))).first()[0] == js_suffix(text)


def test_slug(spark):
    texts = [(" Aantal / woningen--2020 ", "aantal_woningen_2020"), ("", "metric"), (None, "metric"), ("___", "metric"), ("a" * 60, "a" * 48)]
    df = spark.createDataFrame(texts, "t string, want string")
    assert all(r.got == r.want for r in df.select("want", C.slug(F.col("t")).alias("got")).collect())


def contracts(spark):
    rows = [
        ("d", "D", 1, "m1", "Aantal - huizen", "COUNT", None, True, ["country_year", "municipality_year"], 9, 1999, 2001, True),
        ("d", "D", 2, "m2", "Prijs", "EUR", "none", None, [], 0, None, None, True),
        ("d", None, None, None, "prijs", None, None, False, None, None, 2000, 2000, None),
    ]
    return C.generated(spark.createDataFrame(rows, CAP))


def test_diagnostics(spark):
    got = {r.measure_key: r for r in C.diagnosed(contracts(spark)).collect()}
    a, b, c = got[1], got[2], got[None]
    assert a.metric_code == "gen_d_m1_" + js_suffix("d:D:1") and a.blocking == [] and a.warnings == [] and (a.review_status, a.risk, a.priority) == ("review_candidate", "low", 120)
    assert a.valid_grains == ["national_year", "municipality_year"] and a.default_grain == "municipality_year" and a.synonyms == ["Aantal - huizen", "m1", "Aantal   huizen"]
    assert b.blocking == ["unsafe_aggregation", "missing_grains", "missing_default_grain", "no_populated_facts"] and b.review_status == "needs_fix"
    assert c.blocking[:3] == ["missing_dataset_code", "missing_measure_key", "missing_unit_code"] and "duplicate_label" in c.warnings and "thin_synonyms" in c.warnings


def test_test_cases(spark):
    got = sorted((r.expected_intent, r.question, r.expected_year) for r in C.test_cases(contracts(spark)).collect())
    assert got == [("compare_geographies", "Vergelijk Aantal - huizen per municipality in 2001.", 2001), ("rank_geographies", "Waar is Aantal - huizen het hoogst in 2001?", 2001), ("trend", "Hoe ontwikkelde Aantal - huizen zich sinds 1999?", 1999)]


def test_promotion(spark):
    c = contracts(spark).filter("measure_key is not null").withColumns({"contract_status": F.lit("generated"), "execution_status": F.lit("disabled"), "metadata_origin": F.lit("generated")})
    codes = {r.measure_key: r.metric_code for r in c.collect()}
    ask = spark.createDataFrame([(codes[1], "reviewed", None, "me", "why"), (codes[2], "curated", False, "me", None), ("none", "reviewed", True, "me", None)], "metric_code string, to_status string, force boolean, reviewer string, reason string")
    errors = spark.createDataFrame([(codes[2], ["b", "a"]), (codes[2], ["a"]), (codes[1], [])], "metric_code string, errors array<string>")
    after, events = C.promoted(c, ask, errors)
    assert {r.metric_code: (r.contract_status, r.execution_status, r.metadata_origin) for r in after.collect()} == {codes[1]: ("reviewed", "enabled", "curated"), codes[2]: ("generated", "disabled", "generated")}
    assert {r.metric_code: (r.outcome, r.errors, r.to_execution_status) for r in events.collect()} == {codes[1]: ("promoted", [], "enabled"), codes[2]: ("refused", ["a", "b"], "disabled"), "none": ("not_found", [], None)}
    assert after.columns == c.columns


def test_availability_counts_a_data_set_once(spark):
    c = spark.createDataFrame([("m", 1, ["A", "A", "B"]), ("n", 1, ["A"]), ("o", 2, []), ("p", None, ["A"])], "metric_code string, measure_key long, dataset_codes array<string>")
    f = spark.createDataFrame([(1, "A", None, "", 2000, "g", 1.0, False), (1, "A", None, "year", 2000, "g", 3.0, False), (1, "B", "x", "year", None, "g", 1.0, False), (1, "A", "x", "year", 2000, "g", None, False), (1, "A", "x", "year", 2000, "g", 1.0, True)], "measure_key long, dataset_code string, geography_type string, period_type string, calendar_year long, geography_code string, value double, is_missing boolean")
    got = sorted((r.metric_code, r.dataset_code, r.geography_type, r.period_type, r.row_count, r.geography_count, r.max_value) for r in C.availability(c, f).collect())
    assert got == [("m", "A", "unknown", "year", 2, 1, 3.0), ("n", "A", "unknown", "year", 2, 1, 3.0)]


def test_of_measures_without_key_the_order_of_rows_does_not_choose(spark):
    rows = [("d", "D", None, "m", "Prijs", "EUR", None, False, g, 9, 1999, 2001, True) for g in (["region_quarter"], [], ["province_year"], None)]
    got = [C.generated(spark.createDataFrame(x, CAP).coalesce(1)).select("metric_code", "valid_grains").collect() for x in (rows, rows[::-1])]
    assert len(got[0]) == 1 and got[0] == got[1]
