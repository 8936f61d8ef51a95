"""Fuzzy line dedup at its bound: pairs of a similarity of 0.80 to 0.85 that are found."""

import random

from quaystat.llm import line_dedup


def _grams(x, k=8):
    return {x[i : i + k] for i in range(len(x) - k + 1)}


def test_line_dedup_recall(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    pairs = []
    while len(pairs) < 300:
        a = [word() for _ in range(rng.choice((12, 40, 80)))]
        b = list(a)
        for _ in range(rng.randint(1, 5)):
            b[rng.randrange(len(b))] = word()
        x, y = " ".join(a), " ".join(b)
        s, t = _grams(x), _grams(y)
        if 0.80 <= len(s & t) / len(s | t) <= 0.85:
            pairs.append((x, y))
    docs = [(2 * k + i, p[i]) for k, p in enumerate(pairs) for i in (0, 1)]
    got = line_dedup.digests(spark.createDataFrame(docs, "doc_id long, text string")).filter("n_removed = 1").count()
    assert got >= 0.95 * len(pairs)


def test_line_dedup_of_a_dense_group(spark):
    """Versions of one line, of which many are unlike each other, against all pairs."""
    import brute

    rng = random.Random(5)
    base = [f"w{k:02d}ord{k % 7}" for k in range(40)]
    docs = []
    for i in range(120):
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(40)] = f"x{rng.randrange(60)}yz"
        docs.append((i, " ".join(t)))
    got = {(r.doc_id, r.n_removed) for r in line_dedup.digests(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    want = {(i, g) for i, _, g, _ in brute.line_dedup(docs)}
    assert len(got ^ want) <= 4  # each of 120 lines may be missed by the bands with a small chance


def test_parities_lose_no_pair(spark):
    """The bits in which two lists' parities differ are no more than the lists' differences, and most of them while they are few."""
    from pyspark.sql import functions as F

    rng = random.Random(3)
    rows, want = [], []
    for k in range(200):
        pool = rng.sample(range(-(2**31), 2**31), 400)
        both, n, m = pool[: rng.randrange(200)], rng.randrange(100), rng.randrange(100)
        x, y = both + pool[200 : 200 + n], both + pool[300 : 300 + m]
        rng.shuffle(y)
        rows.append((k, x, y))
        want.append(n + m)
    df = spark.createDataFrame(rows, "k int, x array<int>, y array<int>").select("k", line_dedup.parities(F.col("x")).alias("p"), line_dedup.parities(F.col("y")).alias("q"))
    got = [sum(bin((r.p[j] ^ r.q[j]) & (2**64 - 1)).count("1") for j in range(4)) for r in df.orderBy("k").collect()]
    assert all(g <= w and (w - g) % 2 == 0 and (w > 40 or 2 * g >= w) for g, w in zip(got, want))


def test_words_sign_a_line(spark):
    """A line of enough words is signed by its pairs of words, once; one of few or long words by all its shingles, or both ways."""
    words = [f"w{k:02d}ord{k % 7}" for k in range(12)]
    rows = [(0, " ".join(words)), (1, "  ".join(words)), (2, " ".join(words[:4])), (3, " ".join(words[:10])), (4, "x" * 90), (5, "a" + " " * 90 + "b")]
    src = line_dedup.lines(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    signed = line_dedup.signed(src)
    got = {}
    for r in signed.collect():
        got.setdefault(r.doc, []).append(r.bands)
    assert [len(got[k]) for k in range(6)] == [1, 1, 1, 2, 1, 1] and all(len(b) == line_dedup.BANDS for x in got.values() for b in x)
    assert got[0] == got[1]
    assert signed._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
