"""The paged data source: push-down, options, resuming."""

import glob
import shutil

import pytest
from pyspark.sql import functions as F

from quaystat.sources import paged


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("pages") / "t")
    df = spark.range(1000).select(F.col("id").alias("row_index"), (F.col("id") * 7 % 100).alias("a"), F.concat(F.lit("n"), F.col("id")).alias("name"), F.when(F.col("id") % 3 == 0, F.col("id") / 2).alias("half"))
    paged.write_pages(df, path, 100)
    paged.register(spark)
    return path


def load(spark, path, **options):
    return spark.read.format("paged").options(**options).load(path)


def test_whole(spark, folder):
    df = load(spark, folder)
    assert df.columns == ["row_index", "a", "name", "half"] and df.count() == 1000 and df.filter("half is null").count() == 666
    assert df.rdd.getNumPartitions() == 10
    assert paged.count(spark, folder).first().rows == 1000


def test_pages_that_cannot_match_are_not_opened(spark, folder, tmp_path):
    path = str(tmp_path / "t")
    shutil.copytree(folder, path)
    for k in (0, 1, 2, 4, 5, 6, 7, 8, 9):
        for f in glob.glob(f"{path}/page={k}/*"):
            with open(f, "w") as out:
                out.write("this is no JSON")
    df = load(spark, path, select="row_index,name").filter("row_index >= 310 and row_index < 320 and name like 'n31%'")
    assert sorted(r.name for r in df.collect()) == [f"n{k}" for k in range(310, 320)]
    assert df.rdd.getNumPartitions() == 1
    assert load(spark, path, skip="350", top="10").count() == 10
    assert load(spark, path, filter="row_index ge 300 and row_index lt 400 and substringof('39',name)", select="a").count() == 11
    with pytest.raises(Exception):
        load(spark, path).count()


def test_filters_leave_nothing_to_spark_but_what_the_source_cannot(spark, folder):
    df = load(spark, folder)
    for text in ("a = 7", "a > 90", "a <= 3", "a in (1, 2, 500)", "name like 'n1%'", "name like '%99%'", "half is not null", "a <> 5", "half > 100 and a = 21", "a = 1 or a = 2", "half is null and a < 3"):
        assert df.filter(text).count() == df.select("*", F.expr(text).alias("t")).rdd.filter(lambda r: r.t).count(), text


@pytest.mark.parametrize("text,sql", [("a eq 3 or a eq 4", "a in (3, 4)"), ("name eq 'n5' or a ge 98 and half gt 200.5", "name = 'n5' or (a >= 98 and half > 200.5)"), ("a ne 0", "a <> 0"), ("", "true")])
def test_filter_texts(spark, folder, text, sql):
    got = load(spark, folder, filter=text)
    assert got.count() == load(spark, folder).filter(sql).count()


def test_nothing_wanted(spark, folder):
    assert load(spark, folder).filter("row_index > 5000").collect() == [] and load(spark, folder, skip="2000").count() == 0


@pytest.mark.parametrize("text", ["a", "a eq", "a eq 3 and", "a like 'x'", "a eq 3 4"])
def test_no_filter(text):
    with pytest.raises(ValueError):
        paged.parse_filter(text)


def test_quotes():
    assert paged.parse_filter("name eq 'it''s and or' and substringof('''',name)") == [[("eq", "name", "it's and or"), ("contains", "name", "'")]]


def test_unknown_column(spark, folder):
    with pytest.raises(Exception, match="nothing"):
        load(spark, folder, select="a,nothing").count()


def test_follow_until_a_short_page(spark, folder, tmp_path):
    path = str(tmp_path / "t")
    shutil.copytree(folder, path)
    shutil.rmtree(f"{path}/page=7")  # as if the source ended there
    assert load(spark, path, follow="true", page_rows="100").agg(F.max("row_index")).first()[0] == 699
    assert load(spark, path, follow="true", page_rows="100", skip="650").count() == 50
    assert load(spark, path, follow="true", page_rows="101").count() == 100


def test_stream_goes_on_behind_its_last_row(spark, tmp_path):
    path, out, state = (str(tmp_path / x) for x in ("t", "out", "state"))
    paged.register(spark)
    rows = spark.range(250).select(F.col("id").alias("row_index"), (F.col("id") % 5).alias("a"))
    paged.write_pages(rows.filter("row_index < 100"), path, 50)

    def run():
        src = spark.readStream.format("paged").load(path)
        src.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
        return sorted(r.row_index for r in spark.read.parquet(out).collect())

    assert run() == list(range(100))
    assert run() == list(range(100))
    paged.write_pages(rows.filter("row_index >= 100"), path, 50)
    for f in glob.glob(f"{path}/page=0/*") + glob.glob(f"{path}/page=1/*"):
        with open(f, "w") as done:
            done.write("read before")
    assert run() == list(range(250))


def test_many_pages_are_read_several_by_a_task():
    pages = [paged.Page(k) for k in range(20_000)]
    for n in (0, 1, 128, 129, 20_000):
        got = paged.packed(pages[:n])
        assert [p for t in got for p in t.pages] == pages[:n] and len(got) <= max(128, n / 64 + 1)
    assert len(paged.packed(pages[:128])) == 128
