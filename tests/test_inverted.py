"""The positional index against plain Python versions of cover density and of the search."""

import random
import re

import pytest

from quaystat.operators import inverted
from quaystat.operators.search import hybrid_search, parse_query, query_terms, search_documents

FIELDS = (inverted.Field("a", 1.0), inverted.Field("b", 0.4), inverted.Field("c", 0.1), inverted.Field("d", None))


def tokens(x):
    return [t for t in re.split(r"[\W_]+", (x or "").lower()) if t]


def brute_cover(fields, weights, query):
    """All extents by definition: each span of positions is tried, and the shortest that hold everything count."""
    groups, phrases, excluded = parse_query(query)
    row = [(t, w) for f, w in zip(fields, weights) for t in tokens(f)]
    if set(excluded) & {t for t, _ in row} or not groups and not phrases:
        return 0.0
    row = [(t, w) for t, w in row if w]  # words that are not ranked stand at the end
    wanted = {t for g in groups for t in g} | {t for p in phrases for t in p.split()}

    def holds(i, j):
        words = [t for t, _ in row[i : j + 1]]
        return all(set(g) & set(words) for g in groups) and all(any(words[k : k + len(p.split())] == p.split() for k in range(len(words))) for p in phrases)

    spans = [(i, j) for i in range(len(row)) for j in range(i, len(row)) if holds(i, j)]
    spans = [(i, j) for i, j in spans if not any((k, m) != (i, j) and i <= k and m <= j for k, m in spans)]
    out = 0.0
    for i, j in spans:
        hit = [w for t, w in row[i : j + 1] if t in wanted]
        out += len(hit) / sum(1 / w for w in hit) / (1 + (j - i + 1 - len(hit)))
    return out


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    rng = random.Random(4)
    word = lambda: rng.choice("ab ab cd cd ef gh ij kl abc x9 über".split())
    rows = [(k, *(" ".join(word() for _ in range(rng.randint(0, n))) for n in (2, 4, 25, 2))) for k in range(120)]
    rows += [(500, None, None, None, None), (501, "", "ab-cd", "AB, cd! ef", None), (502, "ab", "ab", "ab " * 12, "ab")]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string, d string")
    return inverted.build(df, str(tmp_path_factory.mktemp("index") / "x"), "id", FIELDS, buckets=5), rows


@pytest.mark.parametrize("query", ["ab", "ab cd", "ab or cd", "ab or cd ef", "ab cd ef", '"ab cd"', '"ab cd" ef', '"ab cd ef"', "ab -cd", '"ab ab"', "über x9", "ab nothing", "-ab", "", '"ab cd" "cd ab"'])
def test_cover_density(index, query):
    idx, rows = index
    want = {r[0]: round(c, 9) for r in rows if (c := brute_cover(r[1:], (1.0, 0.4, 0.1, None), query))}
    assert {r.document_id: round(r.cover, 9) for r in inverted.cover_density(idx, query).collect()} == want


def test_parts_of_words(index):
    idx, rows = index
    got = {tuple(r) for r in idx.having(["b", "gh", "zz"], ("a", "d")).collect()}
    assert got == {(r[0], t) for r in rows for t in ("b", "gh", "zz") if any(t in (r[c] or "").lower() for c in (1, 4))}


def test_only_the_buckets_of_the_query_are_read(index):
    idx, _ = index
    plan = idx.postings(["ab"])._jdf.queryExecution().executedPlan()
    scan = plan.collectLeaves().head()
    assert scan.metadata().get("PartitionFilters").get() != "[]" and "term" in scan.metadata().get("PushedFilters").get()
    assert scan.selectedPartitions().partitionCount() == 1


def test_search_by_the_index(spark, tmp_path):
    docs = search_documents(spark, "/root/testdata/sf0.001")
    idx = inverted.build(docs, str(tmp_path / "x"))
    query, synonyms = "widget economy or standard", {"widget": ["article"]}
    own, expanded = query_terms(query, synonyms)
    cols = [f.column for f in inverted.CATALOGUE_FIELDS]
    want = {}
    for r in docs.select("document_id", *cols).collect():
        text = lambda *c: " ".join((r[x] or "") for x in c).lower()
        cover = brute_cover([r[c] for c in cols], [f.weight for f in inverted.CATALOGUE_FIELDS], query + " article")
        any_hit = any(t in text("searchable", "title", "object_code", "dataset_code", "synonyms") for t in expanded)
        score = cover + 0.05 * any_hit + 0.2 * any(t in text("object_code", "dataset_code", "title") for t in own) + 0.45 * sum(t in text("title", "synonyms") for t in own) / len(own)
        terms = [t for t in expanded if t in text(*cols)]
        if cover or terms:
            want[r.document_id] = (round(cover, 9), any_hit, round(score, 9), terms)
    words = inverted.lexical(idx, query, synonyms)
    assert {r.document_id: (round(r.cover, 9), r.any_hit, round(r.lexical_score, 9), r.terms) for r in words.collect()} == want
    top = hybrid_search(docs, query, None, synonyms, words=words, limit=50).collect()
    assert top and all(abs(r.lexical_score - want[r.document_id][2]) < 1e-6 for r in top)


def test_rows_are_blocks_of_documents(spark, tmp_path):
    """One term's postings are few rows, and versions of a document are one, also where they are many."""
    rows = [(k % 90 if k % 3 else None, f"the {'a b' if k % 2 else 'b, a'} x{k % 7}", "The end") for k in range(600)] + [(7, None, None), (400, "", "--"), (401, "a\nb", "\n")]
    df = spark.createDataFrame(rows, "id long, a string, b string").repartition(5)
    want = {}
    for i, a, b in rows:
        words = [(f, t) for f, x in enumerate((a, b)) for t in tokens(x)]
        for p, (f, t) in enumerate(words):
            want.setdefault((t, i, f), set()).add(p)
    for block, most in ((1 << 20, 4), (200, 600)):
        path = str(tmp_path / str(block))
        idx = inverted.build(df, path, "id", (inverted.Field("a", 1.0), inverted.Field("b", 0.5)), buckets=3, block=block)
        got = idx.postings(sorted({t for t, _, _ in want})).collect()
        assert {(r.term, r.document_id, r.field): r.positions for r in got} == {k: sorted(v) for k, v in want.items()} and len(got) == len(want)
        assert {(r.term, r.field): r.documents for r in idx.vocabulary().collect()} == {(t, f): sum((t, f) == (u, g) for u, _, g in want) for t, _, f in want}
        stored = spark.read.parquet(f"{path}/postings").filter("term = 'the' and field = 0").count()
        assert 0 < stored <= most and (block > 200 or stored > 4)
