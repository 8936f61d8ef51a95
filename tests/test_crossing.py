"""Category maps, bitmaps and marts on small tables, with nulls and repeats."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from quaystat.plans import categories, crossing
from quaystat.plans.plan import Plan, PlanError, compile_plan

CELL = "observation_key long, measure_code string, dataset_code string, geography_name string, geography_code string, geography_type string, calendar_year long, period_type string, period_code string, value decimal(18,2), scale_factor int, unit_code string, is_missing boolean, categories array<struct<dimension_code:string,category_code:string,category_name:string>>"


@pytest.fixture(scope="module")
def facts(spark):
    rng, rows = random.Random(7), []
    for k, (p, s) in enumerate(itertools.product(["a", "b", "Totaal"], ["x", "y", None, "Segment totaal"])):
        for year, kind in ((2000, "quarter"), (2000, "year"), (2001, "quarter"), (2001, None)):
            if year == 2001 and kind is None and p != "Totaal":
                continue
            cats = [("Prio", "T1" if p == "Totaal" else f" {p.upper()} ", p)] + ([("Seg", None, s)] if s else [])
            rows.append((len(rows), "M", "D", f"Place {k % 2} (z)", f"GM000{k % 2 + 1}", "municipality", year, kind, f"{year}{kind}", rng.randint(1, 900), 1, "EUR", False, cats))
    rows += [(900, "M", "D", "Place 0 (z)", "GM0001", "municipality", 2000, "year", "p", None, 1, "EUR", False, None), (901, "M", "D", "Place 0 (z)", "GM0001", "municipality", 2000, "year", "p", 5, 1, "EUR", True, []), (902, "M", "d", None, None, None, 2000, "year", "p", 7, 1, "EUR", False, None)]
    rows = [(*r[:9], None if r[9] is None else __import__("decimal").Decimal(r[9]), *r[10:]) for r in rows]
    return spark.createDataFrame(rows, CELL), rows


@pytest.mark.parametrize("filters", [{}, {"prio": ("a",)}, {"PRIO": ("A", "b")}, {"prio": ("b",), "seg": ("x", "y")}, {"seg": ("zzz",)}, {"nothing": ("a",)}, {"prio": ("T1",), "SEG": ("Segment totaal",)}])
def test_filters_on_the_map(facts, filters):
    df, rows = facts
    ok = lambda r: all(any(d.lower() == f.lower() and ((c or "").strip() in v or n in v) for d, c, n in r[13] or []) for f, v in filters.items())
    assert {r.observation_key for r in df.filter(categories.holds(filters)).collect()} == {r[0] for r in rows if ok(r)}


@pytest.mark.parametrize("filters", [{"prio": ("a",)}, {"PRIO": ("A", "b")}, {"prio": ("b",), "seg": ("x", "y")}, {"seg": ("zzz",)}, {"prio": ("T1", "a"), "SEG": ("Segment totaal",)}])
def test_bitmaps_are_the_map(spark, facts, tmp_path, filters):
    df, _ = facts
    far = df.withColumn("observation_key", F.col("observation_key") * 40_000 + 3)  # many buckets
    bridge = far.select("observation_key", F.explode("categories").alias("c")).select("observation_key", "c.*")
    index = categories.BitmapIndex.build(bridge, str(tmp_path / "x"))
    want = {r.observation_key for r in far.filter(categories.holds(filters)).collect()}
    got = index.within(far, filters)
    assert {r.observation_key for r in got.collect()} == want and got.columns == far.columns and got.count() == len(want)
    back = categories.category_map(bridge)
    assert {r.observation_key for r in back.filter(categories.holds(filters)).collect()} == want


def test_plans_with_and_without_bitmaps(spark, facts, tmp_path):
    df, _ = facts
    df = df.drop("categories").join(df.select("observation_key", F.lit(0).alias("z")), "observation_key")
    bridge = facts[0].select("observation_key", F.explode("categories").alias("c")).select("observation_key", "c.dimension_code", "c.category_name")
    index = categories.BitmapIndex.build(bridge, str(tmp_path / "x"))
    for plan in (Plan("ranking", "M", filters={"prio": ("a", "b")}, limit=50), Plan("trend", "M", filters={"seg": ("x",), "prio": ("a",)}, limit=50), Plan("ranking", "M", limit=50), Plan("change_rank", "M", year_from=2000, year_to=2001, filters={"prio": ("Totaal",)})):
        assert compile_plan(plan, df, bridge, index).collect() == compile_plan(plan, df, bridge).collect()


def brute_sandbox(rows, year=None, filters=None, group=None, totals=()):
    base = [r for r in rows if r[2] in ("D", "d") and r[9] is not None and not r[12] and (year is None or r[6] == year)]
    if year is not None and any((r[7] or "year") == "year" for r in base):
        base = [r for r in base if (r[7] or "year") == "year"]
    has = lambda r, f, v: any(d.lower() == f and ((c or "").strip() in v or n in v) for d, c, n in r[13] or [])
    base = [r for r in base if all(has(r, f.lower(), v) for f, v in (filters or {}).items()) and all(has(r, d, v) for d, v in totals if d not in {f.lower() for f in filters or {}} and d != (group or "").lower())]
    out = {}
    for r in base:
        names = [n for d, _, n in r[13] or [] if d.lower() == group.lower()] or [None] if group else [None]
        for n in names:
            key = (r[6], r[4], n)
            c, s = out.get(key, (0, 0))
            out[key] = (c + 1, s + int(r[9]))
    return {k: (c, float(s)) for k, (c, s) in out.items()}


@pytest.mark.parametrize("year,filters,group", [(None, None, None), (2000, None, None), (2001, {"Prio": ("a",)}, None), (2001, {"Prio": ("T1",)}, "Seg"), (2000, {"Prio": ("a", "B")}, "seg"), (None, {"seg": ("x",)}, "Prio")])
def test_sandbox(spark, facts, year, filters, group):
    df, rows = facts
    dims = spark.createDataFrame([("D", "Prio", "T1", "Totaal", True), ("D", "Prio", "A0", "Totaal", True), ("D", "Seg", None, "Segment totaal", True), ("D", "Seg", None, "Segment totaal en meer", True), ("E", "Seg", "T", "Totaal", True), ("D", "Seg", "x", "x", False)], "dataset_code string, dimension_code string, category_code string, category_name string, is_total boolean")
    got = {(r.calendar_year, r.geography_code, r.group_value): (r.row_count, r.aggregate_value) for r in crossing.sandbox(df, dims, "sum", "D", "M", year=year, filters=filters, group=group, limit=100).collect()}
    totals = [("prio", ("T1", "Totaal")), ("seg", ("Segment totaal",))]
    assert got == brute_sandbox(rows, year, filters, group, totals)


def test_comparison(spark, facts):
    df, _ = facts
    other = spark.createDataFrame([(1, "N", "S", "Place 0", "GM0001", "municipality", 2000, 10.0, False), (2, "N", "S", "Place 0 (z)", "GM0001", "municipality", 2000, 12.0, False), (3, "N", "S", "Place 0 (z)", "GM0001", "municipality", 2001, None, False)], "observation_key long, measure_code string, dataset_code string, geography_name string, geography_code string, geography_type string, calendar_year long, value double, is_missing boolean").withColumns({"scale_factor": F.lit(1000), "unit_code": F.lit("EUR_THOUSANDS")})
    both = [crossing.Mart("one", "d1", df), crossing.Mart("two", "d2", other)]
    parts = [crossing.Component("m", "one", "M", "M"), crossing.Component("n", "two", "N", "N")]
    rows = crossing.complete_rows(both, parts).collect()
    assert [(r.geography_name, r.calendar_year, r.metric_count, r.y) for r in rows] == [("Place 0 (z)", 2000, 2, 12000.0)]
    assert crossing.complete_rows(both, [*parts, crossing.Component("x", "unknown", "M", "X")]).count() == 0
    assert crossing.complete_rows(both, parts, names=("place 0",)).count() == 1
    assert crossing.complete_rows(both, [parts[0], crossing.Component("n", "two", "N", "N", dataset_code="other")]).count() == 0
    assert crossing.association(crossing.complete_rows(both, parts), parts).first().relationship_strength == "insufficient_data"
    with pytest.raises(PlanError):
        crossing.complete_rows(both, parts[:1])
    with pytest.raises(PlanError):
        crossing.complete_rows(both, [crossing.Component("x", "u", "M", "X")] * 2)
