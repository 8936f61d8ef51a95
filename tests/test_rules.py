"""Rules and plan guards by example."""

import pytest
from pyspark.sql import functions as F

from quaystat.functions import rules
from quaystat.operators.search import query_terms
from quaystat.plans.plan import Plan, PlanError, validate


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def test_units(spark):
    texts = {"%": "PERCENT", "procentpunt": "PERCENTAGE_POINTS", "1 000 euro": "EUR_THOUSANDS", "mln euro": "EUR_MILLIONS", "x 1 000": "THOUSANDS", "aantal personen": "PERSONS", "2021=100": "INDEX", "m²": "SQUARE_METERS", "1 000 m3": "CUBIC_METERS", "uren": "HOURS", " ": "UNKNOWN"}
    df = spark.createDataFrame(list(texts.items()), "u string, w string")
    assert all(r.g == r.w for r in df.select("w", rules.unit_code(F.col("u"), F.lit("")).alias("g")).collect())


def test_geography_and_missing(spark):
    for code, kind in [("NL01", "country"), ("PV22", "province"), ("GM0363", "municipality"), ("CR11", "corop"), ("LD01", "landsdeel"), ("UNKNOWN", "country"), ("BU03630001", "neighborhood")]:
        assert one(spark, k=rules.geography_type(F.lit(code), F.lit(None).cast("string"))).k == kind
    for value, text, status in [(42.0, "42", "reported"), (None, ".", "missing"), (None, "x", "suppressed"), (1.0, "", "missing")]:
        assert one(spark, s=rules.missing_flags(F.lit(value).cast("double"), F.lit(text))[2]).s == status


def test_hashes(spark):
    r = one(spark, a=rules.combination_hash(F.array(F.lit("b=1"), F.lit("a=2"))), b=rules.combination_hash(F.array(F.lit("a=2"), F.lit("b=1"))), k=rules.stable_key(F.lit("x"), F.lit(None).cast("string")))
    assert r.a == r.b and 0 <= r.k < 2**60


def test_periods(spark):
    for code, first, last in [("2020JJ00", "2020-01-01", "2020-12-31"), ("2020KW02", "2020-04-01", "2020-06-30"), ("2020MM02", "2020-02-01", "2020-02-29"), ("2020HJ02", "2020-07-01", "2020-12-31"), ("1950JJ00", None, None), ("zzzz", None, None)]:
        a, b = rules.period_bounds(F.lit(code))
        r = one(spark, a=a.cast("string"), b=b.cast("string"))
        assert (r.a, r.b) == (first, last)


def test_plan_guards():
    ok = {"A", "B"}
    validate(Plan("ranking", "A"), ok)
    for bad in [Plan("nonsense", "A"), Plan("ranking", "C"), Plan("share_of_total", "A"), Plan("change_rank", "A", year_from=1), Plan("category_breakdown", "A")]:
        with pytest.raises(PlanError):
            validate(bad, ok)
    assert [Plan("ranking", "A", limit=n).clamped() for n in (None, 0, 7, 900)] == [10, 1, 7, 50]


def test_query_terms():
    assert query_terms("The big House of", {"big house": ["villa"]}) == (["the", "big", "house"], ["the", "big", "house", "villa"])


def test_event_stream(spark, tmp_path):
    from quaystat.streaming.ingest import append_to, event_stream

    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    (tmp_path / "in").mkdir()
    for k in range(2):  # the same events twice
        src.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = append_to(event_stream(spark, str(tmp_path / "in"), src.schema), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == src.count()
