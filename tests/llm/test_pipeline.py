import brute
import corpus_pipeline
from quaystat.llm import bpe, decontaminate, near_dup, quality

DATA = "/root/testdata/sf0.001"


def wanted(spark, docs, bench):
    """The pipeline's rows by the plain versions of its stages; quality rules by the operator, whose SQL is tested elsewhere."""
    items = [(r.item_id, r.text) for r in bench.collect()]
    good = {r.text for r in quality.keep_good(docs).select("text").collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.text in good]
    rows = [(i, t) for i, _, _, t in brute.line_dedup(rows)]
    rows = [(i, t) for (i, t), r in zip(rows, brute.near_dup(rows, corpus_pipeline.NEAR_PERCENT)) if r[3]]
    rows = [(i, t) for (i, t), r in zip(rows, brute.contamination(rows, items)) if i is None or not r[5]]
    coder = bpe.ByteBpe.load(*bpe.vocabulary())
    return sorted(((i, len(coder.ids(t)), brute.sha(" ".join(map(str, coder.ids(t)))), brute.sha(t)) for i, t in rows), key=str)


def test_pipeline_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(90)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str) == wanted(spark, docs, bench)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_pipeline_with_odd_rows(spark, frame, tmp_path):
    """Null ids and texts, repeated ids with like and unlike texts, a contaminated text, other columns of clashing names."""
    bench = spark.read.parquet(f"{DATA}/benchmark.parquet")
    passage = bench.orderBy("item_id").first().text
    have = frame.limit(60).collect()
    two = [r for r in have if r.text and 30 < len(r.text.split()) < 400][:2]
    more = [(77_000, passage, "en", "a", 1, 2), (77_000, two[0].text, "en", "b", 3, 4), (77_001, two[0].text, "en", "b", 3, 4), (two[1].doc_id, passage + " and then some", "de", "c", 5, 6), (None, passage, "de", "d", 7, 8)]
    docs = frame.limit(0).unionByName(spark.createDataFrame([tuple(r) for r in have] + more, frame.schema)).unionByName(frame.filter("doc_id is null or doc_id > 9000"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect()), key=str) == wanted(spark, docs, bench)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0


def test_rows_that_share_an_id(spark):
    a, b = (" ".join(f"{x}{k}" for k in range(40)) for x in "ab")
    rows = [(1, a, 0), (5, a, 1), (5, b, 2), (5, b, 3), (None, a, 4), (6, None, 5), (6, "", 6), (6, a, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, __k1 int")
    left = lambda x: sorted(r["__k1"] for r in x.collect())
    assert left(near_dup.drop_copies(df)) == [0, 2, 3, 4, 5, 6]
    bench = spark.createDataFrame([("i", a)], "item_id string, text string")
    assert left(decontaminate.drop_contaminated(df, bench)) == [2, 3, 4, 5, 6]
    assert left(decontaminate.drop_contaminated(df, bench.limit(0))) == list(range(8))
    assert near_dup.drop_copies(df.limit(0)).columns == df.columns
