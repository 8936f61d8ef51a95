"""Source mappers and the public side on rows with gaps."""

import datetime

import pytest
from pyspark.sql import functions as F

from quaystat.functions import periods
from quaystat.operators import mappers as M
from quaystat.operators import publishing as P


def period(spark, rule, kind, values):
    df = spark.createDataFrame([(v,) for v in values], f"v {kind}").select(rule(F.col("v")).alias("p")).select("p.*")
    return [tuple(r) for r in df.collect()]


def test_statistics_periods(spark):
    got = period(spark, periods.statistics_period, "string", ["2023JJ00", "2022KW04", "2024MM02", "2023kw02", "2023KW07", "2023MM13", "2023HJ01", "2023", "x", "", None])
    assert [r[1:] for r in got] == [
        (2023, None, None, "annual", "2023-01-01", "2023-12-31"),
        (2022, 4, None, "quarterly", "2022-10-01", "2022-12-31"),
        (2024, None, 2, "monthly", "2024-02-01", "2024-02-29"),
        (2023, 2, None, "quarterly", "2023-04-01", "2023-06-30"),
        *[(2023, None, None, "annual", "2023-01-01", "2023-12-31")] * 4,
        *[(None, None, None, "annual", None, None)] * 2,
        (None,) * 6,
    ]


def test_days(spark):
    assert [r[1:] for r in period(spark, periods.climate_period, "int", [20240229, 20230229, 7, None])] == [
        (2024, None, 2, "daily", "2024-02-29", "2024-02-29"),
        (None, None, None, "daily", None, None),
        (None, None, None, "daily", None, None),
        (None,) * 6,
    ]
    assert [r[1:] for r in period(spark, periods.valuation_period, "string", ["2022-06-15", "soon", None])] == [
        (2022, None, None, "annual", "2022-01-01", "2022-12-31"),
        (None, None, None, "annual", None, None),
        (None,) * 6,
    ]


def test_regions(spark):
    df = spark.createDataFrame([(c, k) for k, c in enumerate([" GM0363 ", "0363", "PV27", "NL01", "BU03630001", "GM9999", "", None])], "code string, k int")
    got = [r[0] and tuple(r[0]) for r in M.with_region(df, "code", M.default_registry(spark)).orderBy("k").select("code").collect()]
    assert got == [
        ("GM0363", "0363", "municipality", "Amsterdam", "Noord-Holland", "NL321"),
        ("0363", "0363", "other", "Amsterdam", "Noord-Holland", "NL321"),
        ("PV27", "PV27", "province", "Noord-Holland", None, None),
        ("NL01", "NL01", "country", "Nederland", None, None),
        ("BU03630001", "BU03630001", "neighborhood", "Unknown region (BU03630001)", None, None),
        ("GM9999", "9999", "municipality", "Unknown region (9999)", None, None),
        ("", "", "other", "Unknown region ()", None, None),
        None,
    ]
    got = [r[0] and tuple(r[0])[1:4] for r in M.with_region(df, "code", M.default_registry(spark), prefixed=False).orderBy("k").select("code").collect()]
    assert got[1] == ("0363", "municipality", "Amsterdam") and got[2] == ("PV27", "municipality", "Unknown municipality (PV27)") and got[7] is None


def test_a_repeated_registry_row_repeats_no_record(spark):
    twice = spark.createDataFrame([("0001", "B", "y", "n"), ("0001", "A", "x", "m"), (None, "C", "z", "o")], M.REGISTRY)
    got = M.with_region(spark.createDataFrame([("GM0001",), (None,)], "code string"), "code", twice).collect()
    assert sorted((r[0] and r[0]["name"] for r in got), key=str) == ["A", None]


def test_mapper_tells_its_fields(spark):
    raw = spark.createDataFrame([("GM0344", "2020JJ00", 0, 5, None, 310, 7, 9, "lost"), (None,) * 9], "region_code string, period_code string, inhabitants int, aged_65 int, income int, home_value int, dwellings int, density int, extra string")
    first, second = M.mapped(raw, M.STATISTICS, F.lit("here")).orderBy(F.col("population").isNull()).collect()
    assert (first.region.name, first.period.iso_end, first.pct_65_plus, first.avg_home_value_eur, first.avg_income_eur) == ("Utrecht", "2020-12-31", None, 310_000, None)
    assert [m.target_field for m in first.lineage.field_mappings] == [f.target for f in M.STATISTICS.fields]
    assert first.lineage.field_mappings[6].source_unit == "1000 EUR" and "avg_home_value_eur: multiply by 1000" in first.lineage.enrichments
    assert second.region is None and second.period.year is None and second.lineage.provenance == "here"
    assert "extra" not in first and M.mapped(raw.limit(0), M.STATISTICS, F.lit("x")).count() == 0


def test_climate_units(spark):
    raw = spark.createDataFrame([(1, 20240101, -1.0, 123.0, None, -1.0), (2, None, 55.0, -1.0, 0.0, 31.0)], "station int, day int, mean_temp double, max_temp double, min_temp double, rain double")
    got = [tuple(r)[2:6] for r in M.mapped(raw, M.CLIMATE, F.lit("x")).orderBy("station_id").collect()]
    assert got == [(None, 12.3, None, 0.0), (5.5, None, 0.0, 3.1)]


DATASETS = "dataset_id string, title string, short_title string, short_description string, period string, updated_at string"
DIMENSIONS = "dataset_id string, dimension_key string, title string, type string, values_count long"
VALUES = "dataset_id string, dimension_key string, value_key string, title string, description string"
STATUS = "dataset_id string, status string, dimensions int, measures int, expected_observations long, observations_loaded long, rejected_rows long, last_loaded_at string"


@pytest.fixture
def four(spark):
    sets = [("a", "A", "", None, "1990 - 1992", None), ("b", None, None, "van 2001 tot 2003", None, None), ("c", "C", "c", "", "1980", None), ("d", None, None, None, None, "2020"), (None, "no id", None, None, None, None)]
    dims = [("a", "Perioden", None, "TimeDimension", 3), ("a", "RegioS", "Regio", "GeoDimension", 2), ("a", "Merk", None, "", 1), ("x", "Perioden", None, None, 1)]
    values = [("a", "Perioden", v, None, None) for v in ("2005JJ00", "2003JJ00", "2003KW01", "1950JJ00", "abc", None)]
    values += [("a", "RegioS", "NL01", "Nederland", None), ("a", "RegioS", "GM0363", None, None), ("a", "RegioS", "PV20", None, None), ("a", "Merk", "1999", "Nederland", None), ("b", "Perioden", "1999JJ00", None, None)]
    status = [("a", "complete", 3, 2, 10, 10, 0, "2024-01-02"), ("b", "failed", None, None, 5, 0, 1, None), ("c", None, 0, 0, None, 4, None, "2024-01-03"), ("x", "partial", 1, 1, 2, 1, 0, None)]
    return [spark.createDataFrame(*x) for x in ((sets, DATASETS), (dims, DIMENSIONS), (values, VALUES), (status, STATUS))]


def test_catalogue(four):
    got = {r.dataset_id: r for r in P.catalogue(*four, "p").collect()}
    assert sorted(got) == ["a", "b", "c", "d"]
    a, b, c, d = (got[k] for k in "abcd")
    assert (a.years, a.period_source, a.geographic_levels, a.title, a.description) == ([2003, 2005], "perioden-dimension", ["country", "municipality", "province"], "A", "A")
    assert a.spatial_coverage.endswith("country, provinces and municipalities") and a.qualification_confidence == "source-metadata"
    assert (b.years, b.period_source, b.qualification_confidence) == ([2001, 2002, 2003], "catalog-text", "partial-metadata")  # its values belong to no known dimension
    assert (c.years, c.period_source, c.record_count) == ([1980], "catalog-period", 4)
    assert (d.title, d.years, d.year_start, d.qualification_confidence, d.qualification_evidence[-1]) == ("d", [], None, "unqualified", "Record count unavailable")


def test_quality_and_summary(spark, four):
    status = four[3]
    q = {r.dataset_id: r for r in P.quality(status).collect()}
    assert [q[k].quality_status for k in "abcx"] == ["passed", "failed", "failed", "warning"]
    assert [q[k].row_completeness_pct for k in "abcx"] == [100.0, 20.0, None, 50.0]
    checks = {(r.dataset_id, r.check_name): (r.status, r.expected_value, r.actual_value) for r in P.check_rows(status).collect()}
    assert len(checks) == 16 and checks["a", "metadata_present"] == ("pass", None, "3 dimensions, 2 measures") and checks["b", "metadata_present"][2] == "none"
    assert checks["c", "rows_match_source"] == ("warn", None, "4") and checks["b", "rows_match_source"] == ("fail", "5", "1")
    s = P.layer_summary(P.quality(status), "p").first()
    assert (s.status, s.datasets_total, s.datasets_complete, s.datasets_failed, s.records_expected, s.records_loaded, s.completeness_pct, s.last_loaded_at) == ("complete_with_warnings", 4, 1, 1, 17, 15, 94.12, "2024-01-03")
    assert s.quality_statuses == {"passed": 1, "failed": 2, "warning": 1}
    none = P.layer_summary(P.quality(status.limit(0)), "p").first()
    assert (none.status, none.datasets_total, none.completeness_pct, none.quality_statuses) == ("pending", 0, None, {})
    part = P.layer_summary(P.quality(status.filter("dataset_id in ('a', 'x')")), "p").first()
    assert part.status == "partial"


def test_publish_is_resumed_and_keeps_others(four, tmp_path):
    datasets, dimensions, values, status = four
    root = str(tmp_path / "public")
    out = P.publish(root, "one", datasets, dimensions, values, status, "p")
    assert {n: t.read().count() for n, t in out.items()} == {"catalogue": 4, "dimensions": 3, "checks": 12}
    assert sorted(r.title for r in out["dimensions"].read().collect()) == ["Merk", "Perioden", "Regio"]
    P.publish(root, "one", datasets.limit(0), dimensions, values, status, "other")
    assert {t.version() for t in out.values()} == {1}
    renamed = datasets.filter("dataset_id = 'a'").withColumn("title", F.lit("new"))
    P.publish(root, "two", renamed, dimensions, values, status, "p")
    rows = {r.dataset_id: r.title for r in out["catalogue"].read().collect()}
    assert rows == {"a": "new", "b": "b", "c": "c", "d": "d"}
    # broken off after the first table
    late = datasets.filter("dataset_id = 'd'").withColumn("updated_at", F.lit(str(datetime.date(2025, 1, 1))))
    more = dimensions.limit(0).unionByName(dimensions.filter("dataset_id = 'x'").withColumn("dataset_id", F.lit("d")))
    out["catalogue"].merge(P.catalogue(late, more, values, status, "p"), "three")
    versions = {n: t.version() for n, t in out.items()}
    P.publish(root, "three", late, more, values, status, "p")
    assert out["catalogue"].version() == versions["catalogue"] and out["dimensions"].read().filter("dataset_id = 'd'").count() == 1
