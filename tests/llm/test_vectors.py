"""Fingerprints, whitening and hard negatives against brute force."""

import itertools
import math

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quaystat.llm import hard_negatives, simhash, whitening

DATA = "/root/testdata/sf0.001"


def brute_fingerprint(text, k=3):
    words = (text or "").encode("utf-8").lower().split()
    grams = [b" ".join(words[i : i + k]) for i in range(max(len(words) - k + 1, min(len(words), 1)))]
    bits = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * bits[b] > len(grams))


def reach(values, radius=3):
    """The smallest of the values that each can reach."""
    low = {v: v for v in values}
    near = [(a, b) for a, b in itertools.combinations(sorted(values), 2) if bin(a ^ b).count("1") <= radius]
    while True:
        before = dict(low)
        for a, b in near:
            low[a] = low[b] = min(low[a], low[b])
        if low == before:
            return low


def test_simhash(spark, frame, docs):
    fps = {t: brute_fingerprint(t) for _, t in docs}
    root = reach({fps[t] for i, t in docs if i is not None})
    least = {}
    for i, t in docs:
        if i is not None:
            least[root[fps[t]]] = min(i, least.get(root[fps[t]], i))
    want = sorted(((i, f"{fps[t]:016x}", None if i is None else least[root[fps[t]]]) for i, t in docs), key=str)
    for more in ({}, {"blocks": 5, "tree": 2}):
        assert sorted(map(tuple, simhash.classes(frame, **more).collect()), key=str) == want
    got = {r.doc_id: r for r in simhash.classes(frame).collect()}
    assert got[9001].fingerprint == "0" * 16 and got[9001].component_id == got[9003].component_id == 9001
    assert simhash.classes(frame.limit(0)).count() == 0


def test_simhash_hash_is_that_of_spark(spark):
    row = spark.range(1).select(F.xxhash64(F.lit("ein zwei drei")).alias("h")).first()
    assert simhash.fingerprint("Ein  zwei\tdrei") == row.h


def test_simhash_very_long_text():
    text = "long words of many kinds " * 20_000 + "and one end"
    assert simhash.fingerprint(text) % (1 << 64) == brute_fingerprint(text)


@pytest.mark.parametrize("blocks", [4, 5, 6])
@pytest.mark.parametrize("tree", [3, 8192])
def test_simhash_links(spark, blocks, tree):
    """Clouds of fingerprints round some centres, whose chains are longer than the radius."""
    rng = np.random.default_rng(blocks)
    values = set()
    for c in rng.integers(0, 2**64, 40, dtype=np.uint64).tolist() + [0, 2**64 - 1]:
        for _ in range(12):
            values.add(c)
            for b in rng.integers(0, 64, rng.integers(1, 4)).tolist():
                c ^= 1 << b
    signed = {v: v - (1 << 64) if v >> 63 else v for v in values}
    table = spark.createDataFrame([(v,) for v in signed.values()], "fp long").repartition(3)
    edges = [tuple(r) for r in simhash.links(table, blocks, tree).collect()]
    back = {s: v for v, s in signed.items()}
    low = {v: v for v in values}
    for _ in range(len(values)):
        for a, b in edges:
            a, b = back[a], back[b]
            low[a] = low[b] = min(low[a], low[b])
    assert low == reach(values)


def test_bk_tree_finds_all_within_the_radius():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (300, 5)).astype(np.uint64)) * (rng.random((300, 5)) < 0.6)
    nodes, asked = base, base ^ np.bitwise_xor.reduce(flips, axis=1)
    tree = np.arange(300) % 4
    forest = simhash.Forest(nodes, tree)
    assert len(forest.keys) == 300 - 4 and (simhash.distance(nodes[forest.child], nodes[forest.keys // 65]) == forest.keys % 65).all()
    got = {(int(a), int(b)) for q, n in forest.near(asked, tree) for a, b in zip(q, n)}
    d = np.bitwise_count(asked[:, None] ^ nodes[None, :])
    assert got == {(int(a), int(b)) for a, b in zip(*np.nonzero((d <= 3) & (tree[:, None] == tree[None, :])))} and got


# whitening


def odd_vectors(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").limit(200).collect()]
    inf, nan = math.inf, math.nan
    bad = [(901, None), (902, []), (903, [nan, *rows[0][1][1:]]), (904, [inf] * 64), (905, [None, *rows[0][1][1:]]), (906, [1.0, 2.0]), (907, [-inf, *rows[1][1][1:]])]
    good = [*rows, rows[0], (908, rows[3][1]), (None, rows[5][1]), (rows[9][0], rows[8][1])]
    return good, bad


def test_whitening(spark):
    good, bad = odd_vectors(spark)
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in good + bad], "vec_id long, embedding array<float>, n int, x string").repartition(5)
    x = np.floor(64 * np.array([np.float32(v) for _, v in good]).astype(float)) + 1_000_000
    fit = np.unique(x, axis=0)
    c = fit - fit.mean(0)
    cov = c.T @ c / len(fit)
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:16], v[:, ::-1][:, :16]
    white = (x - fit.mean(0)) @ v / np.sqrt(e)
    exact = [sum((len(fit) * int(a) - s) ** 2 for a, s in zip(r, fit.sum(0).astype(int).tolist())) for r in x]
    got = whitening.whiten(df).collect()
    assert len(got) == 16 * len(good)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.deviation), []).append(r)
        assert r.n == len(fit) and abs(r.explained - e[r.component - 1] / np.trace(cov)) < 1e-9 and r.identity_error < 1e-9
    sign = None
    for (i, _), w, dev in zip(good, white, exact):
        rows = sorted(by[i, dev], key=lambda r: r.component)
        values = np.array([r.whitened for r in rows]).reshape(16, -1)
        assert (values == values[:, :1]).all()
        sign = np.sign(values[:, 0] * w) if sign is None else sign
        assert np.abs(values[:, 0] - sign * w).max() < 1e-8


def test_whitening_of_few_or_equal_vectors(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert whitening.whiten(frame([])).count() == 0
    assert whitening.whiten(frame([(1, None), (2, [])])).count() == 0
    assert whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0
    got = sorted(map(tuple, whitening.whiten(frame([(1, [1.0, 5.0]), (2, [3.0, 5.0]), (3, [3.0, 5.0])])).select("vec_id", "component", "n", "deviation", F.round("explained", 12)).collect()))
    assert got == [(1, 1, 2, 128**2, 1.0), (2, 1, 2, 128**2, 1.0), (3, 1, 2, 128**2, 1.0)]
    large = sorted(map(tuple, whitening.whiten(frame([(1, [1e12]), (2, [-1e12]), (3, [0.0])])).select("vec_id", "deviation").collect()))
    assert large == [(1, None), (2, None), (3, 0)]


@pytest.mark.parametrize("d,guard", [(5, 8), (40, 3), (160, 4)])
def test_lobpcg(d, guard):
    rng = np.random.default_rng(d)
    q = np.linalg.qr(rng.standard_normal((d, d)))[0]
    e = np.sort(rng.random(d))[::-1]
    a = (q * e) @ q.T
    got, v, worst = whitening.lobpcg(lambda b: a @ b, d, 4, guard)
    assert worst < 1e-11 and np.abs(got - e[:4]).max() < 1e-12
    assert np.abs(np.abs((v * q[:, :4]).sum(0)) - 1).max() < 1e-12


# hard negatives


def brute_negatives(rows):
    out, x = [], [[math.floor(256 * float(np.float32(c))) for c in v] for _, _, v in rows]
    for a, (i, lab, _) in enumerate(rows):
        if i % 50 == 0:
            s = sorted((-sum(p * q for p, q in zip(x[a], x[b])), rows[b][0], rows[b][1] == lab) for b in range(len(rows)) if b != a)
            for p, pid, _ in [t for t in s if t[2]][:5]:
                inside = [(-n, nid) for n, nid, same in s if not same and 50 * -p <= 100 * -n <= 95 * -p]
                out += [(i, pid, k + 1, nid, -p, n) for k, (n, nid) in enumerate(inside[:3])]
    return sorted(out)


@pytest.mark.parametrize("row_block,anchor_block,sample", [(4096, 1024, 4096), (40, 3, 8)])
def test_hard_negatives(spark, row_block, anchor_block, sample):
    src = [(r.vec_id, r.label, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").orderBy("vec_id").limit(260).collect()]
    flip = lambda v: [-c for c in v]
    good = src + [(3000 + k, k % 3, src[0][2]) for k in range(12)] + [(src[50][0], src[50][1], src[7][2]), (4000, 77, src[1][2]), (4050, 2, flip(src[2][2])), (4100, 2, [0.0] * 64)]
    bad = [(5000, None, src[0][2]), (5050, 1, None), (5100, 1, []), (5150, 1, [math.nan] * 64), (5200, 1, [None] * 64), (None, 1, src[0][2]), (5250, 1, [1.0]), (5300, 1, [1e30] * 64)]
    df = spark.createDataFrame([(*r, 1, 2) for r in good + bad], "vec_id long, label int, embedding array<float>, uid int, is_anchor int").repartition(4)
    got = hard_negatives.mine(df, F.col("vec_id") % 50 == 0, row_block=row_block, anchor_block=anchor_block, sample=sample)
    assert sorted(map(tuple, got.collect())) == brute_negatives(good)
    assert hard_negatives.mine(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert hard_negatives.mine(df, F.lit(False)).count() == 0


def test_hard_negatives_with_names_as_ids(spark):
    rows = [(f"n{k}", f"l{k % 2}", [math.cos(k), math.sin(k), 1.0]) for k in range(30)]
    df = spark.createDataFrame(rows, "name string, kind string, vector array<double>")
    got = hard_negatives.mine(df, F.col("name") == "n4", "name", "kind", "vector", low=0, high=100).collect()
    x = {i: [math.floor(256 * c) for c in v] for i, _, v in rows}
    s = sorted((-sum(p * q for p, q in zip(x["n4"], x[i])), i, lab == "l0") for i, lab, _ in rows if i != "n4")
    want = []
    for p, pid, _ in [t for t in s if t[2]][:5]:
        inside = [(n, nid) for n, nid, same in s if not same and 0 <= -n <= -p]
        want += [("n4", pid, k + 1, nid, -p, -n) for k, (n, nid) in enumerate(inside[:3])]
    assert sorted(map(tuple, got)) == sorted(want) and want


def test_bounds_hold_the_true_scores():
    rng = np.random.default_rng(1)
    x = (rng.standard_normal((500, 7)) * 300).astype(np.int64)
    true, width = x[:50] @ x.T, []
    for sample in (x[:5], x[:60], x):
        books = hard_negatives.fit(sample)
        code, norm = hard_negatives.encode(x, books)
        rows = type("rows", (), {"id": x, "code": code.T, "norm": norm.astype(float)})
        least, most = hard_negatives.bounds(x[:50], rows, books)
        assert (least <= true).all() and (true <= most).all()
        width.append((most - least).mean())
    assert width[0] > width[1] > width[2]
