"""The semantic catalogue's build on rows with gaps, ties and repeats."""

import hashlib
import json

from pyspark.sql import functions as F

from quaystat.operators import metadata as M

MEASURE = (
    "measure_key long, measure_code string, measure_name string, measure_description string, dataset_code string, dataset_key int, unit_code string, unit_key int, value_type string, "
    "default_aggregation string, is_additive boolean, is_semi_additive boolean, is_non_additive boolean, is_percentage boolean, is_index boolean"
)


def measure(spark, *rows):
    base = {"measure_key": 1, "measure_code": "M", "measure_name": "name", "measure_description": "text", "dataset_code": "D1", "dataset_key": 7, "unit_code": "EUR", "unit_key": 3, "value_type": "amount", "default_aggregation": "sum", "is_additive": True}
    return spark.createDataFrame([tuple((base | r).get(c.split()[0]) for c in MEASURE.split(", ")) for r in rows], MEASURE)


def test_metrics(spark):
    got = {r.measure_key: r for r in M.metrics(measure(spark, {}, {"measure_key": 2, "is_percentage": True}, {"measure_key": 3, "default_aggregation": "median"}, {"measure_key": 4, "unit_key": None}, {"measure_key": 5, "default_aggregation": None}, {})).collect()}
    assert sorted(got) == [1, 2, 3, 4, 5]
    assert got[1].metric_code == "cbs_d1_m_eur_1" and got[1].is_enabled and got[1].is_additive and not got[1].is_non_additive
    assert (got[2].aggregation, got[2].is_additive, got[2].is_non_additive) == ("average", False, True)
    assert [got[k].is_enabled for k in (3, 4, 5)] == [False, False, False] and got[5].aggregation == "none"


def test_codes_that_are_cut_alike_are_one_metric(spark):
    long = {"measure_code": "x" * 300}
    got = M.metrics(measure(spark, long, long | {"measure_key": 9})).collect()
    assert [(len(r.metric_code), r.measure_key) for r in got] == [(180, 9)]
    assert M.metrics(measure(spark, {}).limit(0)).count() == 0


def test_upserted_keeps_what_is_curated(spark):
    kind = "k string, a string, id int, metadata_origin string"
    old = spark.createDataFrame([("1", "own", None, "curated"), ("2", "old", 5, "generated"), ("3", "gone", 6, "generated"), (None, "null key", 1, None)], kind)
    new = spark.createDataFrame([("1", "new", 8, "generated"), ("2", None, 9, "generated"), ("4", "new", 7, "generated"), (None, "new", 2, "generated")], kind)
    got = sorted(map(tuple, M.upserted(old, new, ("k",), ("id",)).collect()), key=str)
    assert got == sorted([("1", "own", 8, "curated"), ("2", None, 5, "generated"), ("3", "gone", 6, "generated"), ("4", "new", 7, "generated"), (None, "new", 1, "generated")], key=str)
    assert M.upserted(old.limit(0), new, ("k",)).count() == 4 and M.upserted(old, new.limit(0), ("k",)).count() == 4


def test_synonyms(spark):
    names = spark.createDataFrame([("m", "1", ["Été 1", "ete-1", None, "", "--", "Zon"]), ("m", "1", ["zon", "ZON"]), ("d", "1", ["Zon"]), ("d", "2", None)], "object_type string, object_id string, synonyms array<string>")
    got = sorted((r.object_type, r.object_id, r.synonym, r.normalized_synonym) for r in M.synonyms(names).collect())
    assert got == [("d", "1", "Zon", "zon"), ("m", "1", "zon", "zon"), ("m", "1", "Été 1", "ete 1")]


def test_definition_versions(spark):
    first = M.definition_versions(measure(spark, {}, {}, {"measure_key": 2, "measure_description": ""}, {"measure_key": 3, "measure_description": None}))
    assert [(r.object_id, r.source_reference) for r in first.collect()] == [("1", "D1 M")]
    again = M.definition_versions(measure(spark, {}, {"measure_description": "other text"}, {"measure_key": 4, "dataset_code": None, "measure_code": None}), first)
    assert sorted((r.object_id, r.definition_text) for r in again.collect()) == [("1", "other text"), ("4", "text")]
    assert M.definition_versions(measure(spark, {"measure_key": 4, "dataset_code": None, "measure_code": None}), again).count() == 0


def test_items(spark):
    d = spark.createDataFrame([(7, "D1", "title", None, "v2", "Office")], "dataset_key int, dataset_code string, dataset_title string, dataset_description string, dataset_version string, source_organization string")
    m = M.with_fact_data(measure(spark, {}, {"measure_key": 2, "measure_name": None}), spark.createDataFrame([(1,), (1,), (None,)], "measure_key long"), "measure_key")
    g = spark.createDataFrame([(1, "GM1", "Town", "municipality"), (-1, "UNKNOWN", "?", "other")], "geography_key int, geography_code string, geography_name string, geography_type string")
    c = spark.createDataFrame([(5, "a", "A", "Sex", "D9")], "category_key int, category_code string, category_name string, dimension_code string, dataset_code string")
    got = {(r.object_type, r.object_id): r for r in M.items(d, m, g, c, "p").collect()}
    assert sorted(got) == [("category", "5"), ("dataset", "7"), ("geography", "1"), ("measure", "1"), ("measure", "2")]
    one = got["dataset", "7"]
    assert (one.search_text, one.lineage.source_provider, one.lineage.source_dataset_version, one.lineage.gold_primary_key) == ("D1 title", "Office", "v2", "7")
    assert (got["measure", "1"].has_fact_data, got["measure", "2"].has_fact_data, got["category", "5"].has_fact_data) == (True, False, None)
    assert got["measure", "2"].title is None and got["measure", "1"].tags == ["measure", "amount", "sum"] and got["geography", "1"].lineage.source_provider == "p"


def test_property_hash(spark):
    rows = [{"id": 2, "key": "b", "title": "é \"q\"", "type": None, "datatype": "Double", "unit": "%", "position": 1, "parentId": None}, {"id": 1, "key": None, "title": None, "type": "T", "datatype": None, "unit": None, "position": None, "parentId": 3}]
    kind = "array<struct<id:int,key:string,title:string,type:string,datatype:string,unit:string,position:int,parentId:int>>"
    as_tuples = [tuple(r.values()) for r in rows]
    df = spark.createDataFrame([(1, as_tuples), (2, as_tuples[::-1]), (3, []), (4, None)], f"k int, p {kind}")
    got = [r[0] for r in df.orderBy("k").select(M.property_hash(F.col("p"))).collect()]
    text = json.dumps(sorted(rows, key=lambda r: r["key"] or str(r["id"])), sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    empty = hashlib.sha256(b"[]").hexdigest()
    assert got == [hashlib.sha256(text.encode()).hexdigest()] * 2 + [empty] * 2
