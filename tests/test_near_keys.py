"""Near keys under one label: many parts of one label, repeated keys, parts without a label."""

from collections import Counter

from quaystat.operators.pipeline import band_match, near_keys


def test_near_keys_of_one_label(spark):
    keys = [-130, -66, -2, -1, 0, 63, 64, 65, 128, 129, 5_000, 5_000, 5_064, 9_000]
    df = spark.createDataFrame([(k, "a") for k in keys] + [(64, "b"), (1, None), (None, "a")], "k long, label string")
    got = Counter(tuple(r) for r in near_keys(df, "k", "label", 64).collect())
    assert got == Counter((a, b) for a in keys for b in keys if a != b and abs(a - b) <= 64)


def test_work_does_not_grow_with_the_square_of_a_label(spark, tmp_path):
    n = 40_000
    parts = spark.range(n).selectExpr("id * 40 as p_partkey", "'Brand#1' as p_brand", "case when id = 7 then null else 'LARGE' end as p_type")
    parts.write.parquet(f"{tmp_path}/part.parquet")
    got = {tuple(r) for r in band_match(spark, str(tmp_path)).collect()}  # of two neighbours each, only the ends and those of part 7 have one
    assert got == {(0, 40), ((n - 1) * 40, (n - 2) * 40), (240, 200), (320, 360)}
