"""Domain rules and the parts of search and writes by example."""

import pytest
from pyspark.sql import functions as F

from quaystat.functions import domain, rules
from quaystat.operators import gold
from quaystat.operators.search import parse_query
from quaystat.plans.extended import cube, sandbox_aggregate
from quaystat.plans.plan import PlanError


def one(spark, **cols):
    return spark.range(1).select(*(c.alias(k) for k, c in cols.items())).first()


def test_value_and_geography_types(spark):
    for unit, kind in [("PERCENT", "percentage"), ("PERCENTAGE_POINTS", "decimal"), ("THOUSANDS", "decimal"), ("EUR_MILLIONS", "currency"), ("PERSONS", "count"), ("INDEX", "index")]:
        assert one(spark, t=rules.value_type(F.lit(unit))).t == kind
    none = F.lit(None).cast("string")
    for code, declared, kind in [("TOTAAL", none, "country"), ("total", none, "country"), ("ZZ1", F.lit("other"), "region"), ("ZZ1", F.lit("neighborhood"), "region"), ("ZZ1", F.lit("corop"), "corop"), ("ZZ1", none, "country"), (None, none, "country")]:
        assert one(spark, t=rules.geography_type(F.lit(code).cast("string"), declared)).t == kind


def test_relationship_bands(spark):
    for r, n, want in [(0.03, 50, ("none", "very_weak", "profiled")), (-0.5, 50, ("negative", "moderate", "moderate_candidate")), (0.8, 19, ("positive", "strong", "insufficient_observations")), (None, 50, ("unknown", "insufficient_data", "insufficient_observations"))]:
        d, s, q = rules.relationship_profile(F.lit(r).cast("double"), F.lit(n))
        assert tuple(one(spark, d=d, s=s, q=q)) == want
    d, s = rules.relationship(F.lit(0.03), F.lit(4))
    assert tuple(one(spark, d=d, s=s)) == ("positive", "insufficient_data")


def test_numbers_dates_and_texts(spark):
    r = one(spark, a=domain.dutch_number(F.lit("1.234,5")), b=domain.dutch_number(F.lit("x")), c=domain.safe_iso_date(F.lit("2001-02-03T01:00")), d=domain.safe_iso_date(F.lit("3-2-2001")), e=domain.folded(F.lit("  Ärzte-Café №1 ")), f=domain.slug(F.lit("--")), g=domain.percent_complete(F.lit(7), F.lit(3)), h=domain.percent_complete(F.lit(7), F.lit(0)))
    assert tuple(r)[:4] == (1234.5, None, "2001-02-03", None) and r.e.startswith("arzte cafe") and r.f == "metric" and r.g == 100.0 and r.h is None
    r = one(spark, a=domain.expanded_years(F.array(F.lit(1999), F.lit(2002))), b=domain.years_in_text(F.lit("1900, 1985 en 2030")), c=domain.celsius(F.lit(-1.0)), d=domain.millimetres(F.lit(-1.0)), e=domain.share_percent(F.lit(1), F.lit(3)), f=domain.share_percent(F.lit(1), F.lit(0)))
    assert (list(r.a), list(r.b), r.c, r.d, r.e, r.f) == ([1999, 2000, 2001, 2002], [1985], None, 0.0, 33.33, None)


def test_hash_vectors(spark):
    r = one(spark, a=domain.hash_embedding(F.lit("one two")), b=domain.hash_embedding(F.lit("TWO  one!")), c=domain.hash_embedding(F.lit("")))
    assert r.a == r.b and abs(sum(x * x for x in r.a) - 1) < 1e-4 and set(r.c) == {0.0} and len(r.a) == 64


def test_query_syntax():
    assert parse_query('big or small "old house" -new fish') == ([["big", "small"], ["fish"]], ["old house"], ["new"])
    assert parse_query("") == ([], [], [])


def test_sandbox_guards(spark):
    cells = cube(spark, "/root/testdata/sf0.001")
    with pytest.raises(PlanError):
        sandbox_aggregate(cells, "median", "CUBE")
    assert sandbox_aggregate(cells, "count", "nothing").count() == 0
    assert sandbox_aggregate(cells, "max", "CUBE", limit=0).count() == 1


def test_scoped_overwrite(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "v int, p string")
    df.write.partitionBy("p").parquet(str(tmp_path / "t"))
    gold.overwrite_scope(spark.createDataFrame([(9, "a")], "v int, p string"), str(tmp_path / "t"), "p")
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "t")).select("v", "p").collect())) == [(3, "b"), (9, "a")]


def test_upsert_of_nothing(spark):
    a = spark.createDataFrame([(1, 2)], "k int, v int")
    assert gold.upsert(gold.without_stale(a, a.limit(0), ["k"]), a, ["k"]).collect() == a.collect()


def test_digits_of_longer_numbers_are_no_years(spark):
    r = one(spark, a=domain.years_in_text(F.lit("Supplier#000001990 kort")), b=domain.years_in_text(F.lit("19951 1995JJ00, 1992-1998 x2001")))
    assert (list(r.a), list(r.b)) == ([], [1995, 1992, 1998, 2001])


def test_hash_vectors_by_the_definition(spark):
    import hashlib

    for text, slots in (("de kat", 64), ("a b c A b " * 50, 64), ("één 2", 16), ("", 8)):
        want = [0] * slots
        for t in text.lower().split():
            h = hashlib.sha256(t.encode()).digest()
            for k in range(8):
                want[h[k] % slots] += -1 if h[k + 8] >= 128 else 1
        norm = sum(x * x for x in want) ** 0.5 or 1.0
        assert one(spark, v=domain.hash_embedding(F.lit(text), slots)).v == pytest.approx([round(x / norm, 6) for x in want], abs=1e-9)


def test_hash_vectors_are_computed_once_and_in_many_tasks(spark):
    from quaystat.operators.governance import hash_vectors

    df = hash_vectors(spark, "/root/testdata/sf0.001")
    assert df._jdf.queryExecution().optimizedPlan().toString().count("sha2(") == 1
    assert df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
