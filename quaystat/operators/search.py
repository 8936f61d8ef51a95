"""Hybrid search over a catalogue of documents: weighted terms, vectors, boosts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystat.sources.mart import read

TOKEN = r"[^\p{L}\p{N}]+"


def query_terms(query: str, synonyms: dict[str, list[str]] | None = None) -> tuple[list[str], list[str]]:
    """(own, expanded) terms of at least three letters; a synonym's targets join when its phrase is in the query."""
    cut = lambda s: [t for t in re.split(r"[\W_]+", s.lower()) if len(t) >= 3]
    more = [t for phrase, targets in (synonyms or {}).items() if phrase in query.lower() for x in targets for t in cut(x)]
    own = list(dict.fromkeys(cut(query)))
    return own, list(dict.fromkeys(own + more))


def cosine(a: Column, b: list[float]) -> Column:
    other = F.array(*(F.lit(float(x)) for x in b))
    dot = F.aggregate(F.zip_with(a, other, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.coalesce(F.try_divide(dot, norm * F.lit(sum(x * x for x in b) ** 0.5)), F.lit(0.0))


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("title"), F.col("p_type").alias("subtitle"), F.col("p_brand").alias("code"))


def scored(items: DataFrame, own: list[str], expanded: list[str], query: str) -> DataFrame:
    """Exact-code, lexical and total score of every item that holds any term; a filter before any sort."""
    words = lambda c: F.split(F.lower(c), TOKEN)
    hits = lambda c: F.size(F.array_intersect(words(c), F.array(*(F.lit(t) for t in expanded))))
    lexical = hits("title") * 1.0 + hits("subtitle") * 0.4 + hits("code") * 0.2
    exact = F.when(F.lower("code") == query.lower(), 1.0).otherwise(0.0)
    matched = F.array_intersect(F.array(*(F.lit(t) for t in own)), F.array_union(words("title"), words("subtitle")))
    out = items.select("*", exact.alias("exact_score"), F.round(lexical, 4).alias("lexical_score"), F.array_join(F.sort_array(matched), ",").alias("matched_terms"))
    return out.filter("exact_score > 0 or lexical_score > 0").withColumn("score", F.round(F.col("exact_score") * 1.25 + F.col("lexical_score") * 0.65, 6))


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, expanded = query_terms("part standard", {"standard": ["economy"]})
    return scored(catalogue(spark, sf_dir), own, expanded, "part standard").select("item_id", "lexical_score", "score", "matched_terms").orderBy(F.desc("score"), "item_id").limit(50)


def vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors most like a fixed one. The query vector is a parameter, every row is scored, the top is a limit."""
    query = [1.0 if k % 2 == 0 else -0.5 for k in range(64)]
    e = read(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.round(cosine(F.col("embedding"), query), 4).alias("vector_score")).orderBy(F.desc("vector_score"), "vec_id").limit(20)


#: Weights of the parts of a score, all of them settings with these defaults.
WEIGHTS = {
    "exact": 1.25, "lexical": 0.65, "vector": 0.30, "popularity": 0.01, "any_term": 0.05, "own_term": 0.20, "own_share": 0.45, "investigation": 0.12,
    "recent": 0.03, "fairly_recent": 0.01, "metric": 0.08, "dataset": 0.07, "geography": 0.06, "saved_analysis": 0.05, "other": 0.02, "curated": 0.05, "source": 0.04, "generated": 0.02,
}
FIELD_WEIGHTS = {"title": 1.0, "subtitle": 0.4, "description": 0.2, "searchable": 0.1}


def parse_query(query: str) -> tuple[list[list[str]], list[str], list[str]]:
    """(groups, phrases, excluded): every group needs one of its words, every phrase its words in a row.

    Words stand for themselves, `or` joins its neighbours, quotes make a phrase, a minus excludes.
    """
    groups: list[list[str]] = []
    phrases: list[str] = []
    excluded: list[str] = []
    join = False
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query.lower()):
        terms = [t for t in re.split(r"[\W_]+", phrase or word) if t]
        if not terms:
            continue
        if word == "or" and not minus:
            join = bool(groups)
        elif minus:
            excluded += terms
        elif phrase and len(terms) > 1:
            phrases.append(" ".join(terms))
        elif join:
            groups[-1] += terms
            join = False
        else:
            groups += [[t] for t in terms]
    return groups, phrases, excluded


def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index: parts as metrics, suppliers as data sets, nations as geographies; vectors where there are any."""
    e = read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    p = read(spark, sf_dir, "part").join(e, F.col("p_partkey") == F.col("vec_id"), "left")
    metric = p.select(
        F.concat(F.lit("metric:"), F.col("p_partkey").cast("string")).alias("document_id"), F.lit("metric").alias("object_type"), F.col("p_partkey").cast("string").alias("object_id"), F.col("p_brand").alias("object_code"), F.lit("PARTS").alias("dataset_code"),
        F.col("p_name").alias("title"), F.col("p_type").alias("subtitle"), F.concat_ws(" ", F.lit("part of size"), F.col("p_size").cast("string")).alias("description"), F.concat_ws(" ", "p_brand", "p_type").alias("searchable"), F.lit("article good").alias("synonyms"),
        F.when(F.col("p_partkey") % 2 == 0, "curated").otherwise("source").alias("source_quality"), (F.col("p_partkey") % 150).cast("double").alias("popularity"), F.when(F.col("p_partkey") % 7 == 0, "private").when(F.col("p_partkey") % 7 == 1, "shared").otherwise("global").alias("visibility"),
        F.when(F.col("p_partkey") % 7 == 0, F.concat(F.lit("u"), (F.col("p_partkey") % 3).cast("string"))).alias("author"), F.when(F.col("p_partkey") % 7 == 1, F.concat(F.lit("i"), (F.col("p_partkey") % 4).cast("string"))).alias("investigation"), F.when(F.col("p_partkey") % 5 == 0, "silver").otherwise("gold").alias("trusted_layer"),
        F.date_add(F.lit("2001-01-01").cast("date"), (F.col("p_partkey") % 365).cast("int")).alias("updated"), F.lit(1995).alias("year_start"), F.lit(2001).alias("year_end"), "embedding",
    )
    s = read(spark, sf_dir, "supplier")
    same = lambda kind, key, code, title: [F.concat(F.lit(f"{kind}:"), F.col(key).cast("string")).alias("document_id"), F.lit(kind).alias("object_type"), F.col(key).cast("string").alias("object_id"), code.alias("object_code"), F.lit("SUPPLY").alias("dataset_code"), title.alias("title")]
    rest = [F.lit("generated").alias("source_quality"), F.lit(10.0).alias("popularity"), F.lit("global").alias("visibility"), F.lit(None).cast("string").alias("author"), F.lit(None).cast("string").alias("investigation"), F.lit("gold").alias("trusted_layer"), F.lit("2001-12-01").cast("date").alias("updated"), F.lit(1990).alias("year_start"), F.lit(1996).alias("year_end"), F.lit(None).cast("array<float>").alias("embedding")]
    data = s.select(*same("dataset", "s_suppkey", F.concat(F.lit("S"), F.col("s_suppkey").cast("string")), F.col("s_name")), F.lit("supplier of parts").alias("subtitle"), F.lit("orders and prices").alias("description"), F.col("s_name").alias("searchable"), F.lit("standard vendor").alias("synonyms"), *rest)
    n = read(spark, sf_dir, "nation")
    place = n.select(*same("geography", "n_nationkey", F.col("n_name"), F.col("n_name")), F.lit("nation").alias("subtitle"), F.lit("a place").alias("description"), F.col("n_name").alias("searchable"), F.lit("country").alias("synonyms"), *rest)
    return metric.unionByName(data).unionByName(place)


def hybrid_search(docs: DataFrame, query: str, vector: list[float] | None = None, synonyms: dict[str, list[str]] | None = None, user: str | None = None, investigation: str | None = None, access: DataFrame | None = None, filters: dict | None = None, today: str = "2002-01-01", weights: dict[str, float] | None = None, limit: int | None = None, words: DataFrame | None = None) -> DataFrame:
    """The best documents by exact code, words, vector and boosts, with the parts of each score and its reason.

    access: (investigation, user). Private documents are their author's, documents of an investigation its members'.
    filters: dataset_code, object_types, source_quality, strict_gold_only, year, updated_after; those not given hold for all.
    The lexical part is cover (the mean over the query's groups of the weight of the best field, if all are found and
    nothing excluded is) and shares of words found as parts of the text. Without a vector only words count.
    words: inverted.lexical() of an index of the documents, which then stands for the lexical part: cover density by positions, and no
    document's text is cut into words.
    """
    w, f = {**WEIGHTS, **(weights or {})}, filters or {}
    own, expanded = query_terms(query, synonyms)
    groups, phrases, excluded = parse_query(query)
    none = F.lit("")
    code, title, subtitle = F.lower(F.coalesce("object_code", none)), F.lower(F.coalesce("title", none)), F.lower(F.coalesce("subtitle", none))
    if access is None:
        access = docs.sparkSession.createDataFrame([], "investigation string, user string")
    member = access.filter(F.col("user") == (user or "")).select(F.col("investigation").alias("own_investigation")).distinct()
    seen = docs.join(member, F.col("investigation") == F.col("own_investigation"), "left")
    mine = (F.col("visibility") == "private") & F.coalesce(F.col("author") == F.lit(user), F.lit(False))
    held = F.col("own_investigation").isNotNull() & (F.col("investigation") == F.lit(investigation))
    seen = seen.filter((F.col("investigation").isNull() | F.coalesce(held, F.lit(False))) & (~F.coalesce("visibility", F.lit("global")).isin("private", "shared") | mine | ((F.col("visibility") == "shared") & F.coalesce(held, F.lit(False)))))
    for key in ("dataset_code", "source_quality"):
        if key in f:
            seen = seen.filter(F.col(key) == f[key])
    if "object_types" in f:
        seen = seen.filter(F.col("object_type").isin(*f["object_types"]))
    if f.get("strict_gold_only"):
        seen = seen.filter(F.col("trusted_layer").isin("gold", "semantic"))
    if "year" in f:
        seen = seen.filter(F.lit(f["year"]).between(F.col("year_start"), F.col("year_end")))
    if "updated_after" in f:
        seen = seen.filter(F.col("updated") >= F.lit(f["updated_after"]).cast("date"))

    has = lambda text, terms: F.filter(F.array(*(F.lit(t) for t in terms)).cast("array<string>"), lambda t: F.contains(text, t))
    text = lambda *cols: F.lower(F.concat_ws(" ", *cols))
    fields = {c: F.split(F.lower(F.coalesce(c, none)), TOKEN) for c in FIELD_WEIGHTS}
    best = lambda t: F.greatest(*(F.when(F.array_contains(v, t), FIELD_WEIGHTS[c]).otherwise(0.0) for c, v in fields.items()))
    parts = [F.greatest(F.lit(0.0), *(best(t) for t in g)) for g in groups]
    whole = F.concat_ws(" ", *(F.concat_ws(" ", v) for v in fields.values()))
    ok = F.lit(True)
    for p in parts:
        ok = ok & (p > 0)
    for p in phrases:
        ok = ok & F.contains(whole, F.lit(p))
    for t in excluded:
        ok = ok & (best(t) == 0)
    cover = F.when(ok & F.lit(bool(groups or phrases)), (sum(parts, F.lit(0.0)) + float(len(phrases))) / float(max(1, len(groups) + len(phrases)))).otherwise(0.0)
    any_term = F.size(has(text("searchable", "title", "object_code", "dataset_code", "synonyms"), expanded)) > 0
    own_term = F.size(has(text("object_code", "dataset_code", "title"), own)) > 0
    share = F.size(has(text("title", "synonyms"), own)) / float(max(1, len(own)))
    lexical = cover + F.when(any_term, w["any_term"]).otherwise(0.0) + F.when(own_term, w["own_term"]).otherwise(0.0) + share * w["own_share"]
    want = query.strip().lower()
    exact = F.when((code == want) | (F.lower("dataset_code") == want), 1.0).when(F.lower("object_id") == want, 0.9).otherwise(0.0)
    similar = F.coalesce(cosine(F.col("embedding"), vector), F.lit(0.0)) if vector else F.lit(0.0)
    kind = F.coalesce(*(F.when(F.col("object_type") == t, w[t]) for t in ("metric", "dataset", "geography", "saved_analysis")), F.lit(w["other"]))
    context = F.when(F.col("investigation") == F.lit(investigation), w["investigation"]).otherwise(0.0)
    age = F.date_diff(F.lit(today).cast("date"), F.col("updated"))
    recency = F.when(age < 30, w["recent"]).when(age < 180, w["fairly_recent"]).otherwise(0.0)
    quality = F.coalesce(*(F.when(F.col("source_quality") == q, w[q]) for q in ("curated", "source", "generated")), F.lit(0.0))
    popular = F.least(F.coalesce("popularity", F.lit(0.0)), F.lit(100.0)) / 100 * w["popularity"]
    terms = has(text("title", "subtitle", "description", "searchable", "object_code", "dataset_code", "synonyms"), expanded)
    if words is not None:
        own_words = words.select("document_id", F.col("cover").alias("w_cover"), F.col("any_hit").alias("w_any"), F.col("lexical_score").alias("w_lexical"), F.col("terms").alias("w_terms"))
        seen = seen.join(own_words, "document_id", "left")
        cover, any_term, lexical = F.coalesce("w_cover", F.lit(0.0)), F.coalesce("w_any", F.lit(False)), F.coalesce("w_lexical", F.lit(0.0))
        terms = F.coalesce("w_terms", F.array().cast("array<string>"))
    candidate = (cover > 0) | any_term | (exact > 0) | F.lit(bool(vector)) & F.col("embedding").isNotNull()
    out = seen.filter(candidate).withColumns({"exact_match_score": exact, "lexical_score": lexical, "vector_score": similar, "object_type_boost": kind, "investigation_boost": context, "recency_boost": recency, "boost": quality + popular, "terms": terms})
    score = F.col("exact_match_score") * w["exact"] + F.col("lexical_score") * w["lexical"] + F.col("vector_score") * w["vector"] + F.col("object_type_boost") + F.col("investigation_boost") + F.col("recency_boost") + F.col("boost")
    reason = F.when(F.col("exact_match_score") >= 1, "Exact identifier match").when(F.size("terms") > 0, F.concat(F.lit("Matched keyword: "), F.get("terms", F.lit(0)))).when(F.col("vector_score") > 0, "Semantically similar metadata").when(F.col("investigation_boost") > 0, "Used in the current investigation").otherwise("Ranked catalogue result")
    action = F.when(F.col("object_type") == "dataset", "open_dataset").when(F.col("object_type") == "metric", "inspect_metric").when(F.col("object_type") == "geography", "open_entity").otherwise("open")
    figures = ["exact_match_score", "lexical_score", "vector_score", "object_type_boost", "investigation_boost", "recency_boost"]
    out = out.select("document_id", "object_type", "title", F.round(score, 6).alias("rank_score"), *(F.round(c, 6).alias(c) for c in figures), F.array_join("terms", ",").alias("matched_terms"), reason.alias("result_reason"), F.concat(action, F.lit(",save_to_investigation")).alias("available_actions"))
    return out.orderBy(F.desc("rank_score"), "title", "document_id").limit(max(1, min(10 if limit is None else limit, 50)))


def _access(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("i1", "u1"), ("i2", "u1"), ("i1", "u2")], "investigation string, user string")


def hybrid_search_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words, synonyms, boosts, visibility and filters; no vector."""
    docs = search_documents(spark, sf_dir)
    return hybrid_search(docs, "standard part -economy", None, {"standard": ["vendor"]}, "u1", "i1", _access(spark), {"strict_gold_only": True, "year": 1996}, limit=50)


def hybrid_search_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = [1.0 if k % 2 == 0 else -0.5 for k in range(64)]
    return hybrid_search(search_documents(spark, sf_dir), "nation_3", query, None, "u0", None, _access(spark), {"updated_after": "2001-03-01"}, limit=50)


_DOT = "list_sum(list_transform(range(1, 65), lambda k: embedding[k]::DOUBLE * CASE WHEN k % 2 = 1 THEN 1.0::DOUBLE ELSE -0.5::DOUBLE END))"


def _hybrid(own: list[str], expanded: list[str], groups: list[str], excluded: list[str], query: str, vector: str, user: str, investigation: str | None, where: str, by_vector: bool, ctes: str = "", cover: str | None = None) -> str:
    """DuckDB SQL of hybrid_search() for a query of single words. cover: another lexical cover, from further views over d."""
    lit = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]::VARCHAR[]"
    inv = f"'{investigation}'" if investigation else "NULL"
    field = {c: rf"regexp_split_to_array(lower({c}), '[^\p{{L}}\p{{N}}]+')" for c in FIELD_WEIGHTS}
    best = lambda t: "greatest(" + ", ".join(f"CASE WHEN list_contains({v}, '{t}') THEN {FIELD_WEIGHTS[c]}::DOUBLE ELSE 0 END" for c, v in field.items()) + ")"
    ok = " AND ".join([f"{best(t)} > 0" for t in groups] + [f"{best(t)} = 0" for t in excluded])
    cover = cover or f"CASE WHEN {ok} THEN ({' + '.join(best(t) for t in groups)}) / {len(groups)} ELSE 0 END"
    has = lambda text, xs: f"list_filter({lit(xs)}, lambda t: contains({text}, t))"
    ws = lambda *c: f"lower(concat_ws(' ', {', '.join(c)}))"
    rest = "'generated' AS source_quality, 10.0 AS popularity, 'global' AS visibility, NULL AS author, NULL AS investigation, 'gold' AS trusted_layer, DATE '2001-12-01' AS updated, 1990 AS year_start, 1996 AS year_end, NULL AS embedding"
    member = [i for i, u in (("i1", "u1"), ("i2", "u1"), ("i1", "u2")) if u == user]
    held = f"coalesce(investigation = {inv} AND list_contains({lit(member)}, investigation), false)"
    return rf"""
WITH d AS (SELECT 'metric:' || p_partkey AS document_id, 'metric' AS object_type, p_partkey::VARCHAR AS object_id, p_brand AS object_code, 'PARTS' AS dataset_code, p_name AS title, p_type AS subtitle, 'part of size ' || p_size AS description, p_brand || ' ' || p_type AS searchable, 'article good' AS synonyms,
  CASE WHEN p_partkey % 2 = 0 THEN 'curated' ELSE 'source' END AS source_quality, (p_partkey % 150)::DOUBLE AS popularity, CASE p_partkey % 7 WHEN 0 THEN 'private' WHEN 1 THEN 'shared' ELSE 'global' END AS visibility, CASE WHEN p_partkey % 7 = 0 THEN 'u' || p_partkey % 3 END AS author, CASE WHEN p_partkey % 7 = 1 THEN 'i' || p_partkey % 4 END AS investigation,
  CASE WHEN p_partkey % 5 = 0 THEN 'silver' ELSE 'gold' END AS trusted_layer, DATE '2001-01-01' + (p_partkey % 365)::INT AS updated, 1995 AS year_start, 2001 AS year_end, embedding FROM part LEFT JOIN embeddings ON vec_id = p_partkey
  UNION ALL SELECT 'dataset:' || s_suppkey, 'dataset', s_suppkey::VARCHAR, 'S' || s_suppkey, 'SUPPLY', s_name, 'supplier of parts', 'orders and prices', s_name, 'standard vendor', {rest} FROM supplier
  UNION ALL SELECT 'geography:' || n_nationkey, 'geography', n_nationkey::VARCHAR, n_name, 'SUPPLY', n_name, 'nation', 'a place', n_name, 'country', {rest} FROM nation),{ctes}
v AS (SELECT * FROM d WHERE (investigation IS NULL OR {held}) AND (visibility = 'global' OR (visibility = 'private' AND author = '{user}') OR (visibility = 'shared' AND {held})) AND {where}),
s AS (SELECT *, {cover} AS cover, len({has(ws('searchable', 'title', 'object_code', 'dataset_code', 'synonyms'), expanded)}) > 0 AS any_term,
  CASE WHEN len({has(ws('object_code', 'dataset_code', 'title'), own)}) > 0 THEN 0.2 ELSE 0 END::DOUBLE AS own_term, len({has(ws('title', 'synonyms'), own)}) / {len(own)}::DOUBLE * 0.45 AS share,
  CASE WHEN lower(object_code) = '{query}' OR lower(dataset_code) = '{query}' THEN 1.0 WHEN lower(object_id) = '{query}' THEN 0.9 ELSE 0 END::DOUBLE AS exact_match_score, ({vector})::DOUBLE AS vector_score,
  CASE object_type WHEN 'metric' THEN 0.08 WHEN 'dataset' THEN 0.07 ELSE 0.06 END::DOUBLE AS object_type_boost, CASE WHEN investigation = {inv} THEN 0.12 ELSE 0 END::DOUBLE AS investigation_boost,
  CASE WHEN DATE '2002-01-01' - updated < 30 THEN 0.03 WHEN DATE '2002-01-01' - updated < 180 THEN 0.01 ELSE 0 END::DOUBLE AS recency_boost,
  CASE source_quality WHEN 'curated' THEN 0.05 WHEN 'source' THEN 0.04 ELSE 0.02 END::DOUBLE + least(popularity, 100) / 100 * 0.01 AS boost, {has(ws('title', 'subtitle', 'description', 'searchable', 'object_code', 'dataset_code', 'synonyms'), expanded)} AS terms FROM v),
f AS (SELECT *, cover + CASE WHEN any_term THEN 0.05 ELSE 0 END + own_term + share AS lexical_score FROM s WHERE cover > 0 OR any_term OR exact_match_score > 0 {'OR embedding IS NOT NULL' if by_vector else ''})
SELECT document_id, object_type, title, round(exact_match_score * 1.25 + lexical_score * 0.65 + vector_score * 0.3 + object_type_boost + investigation_boost + recency_boost + boost, 6)::DOUBLE AS rank_score, round(exact_match_score, 6) AS exact_match_score, round(lexical_score, 6)::DOUBLE AS lexical_score, round(vector_score, 6) AS vector_score,
  round(object_type_boost, 6) AS object_type_boost, round(investigation_boost, 6) AS investigation_boost, round(recency_boost, 6) AS recency_boost, array_to_string(terms, ',') AS matched_terms,
  CASE WHEN exact_match_score >= 1 THEN 'Exact identifier match' WHEN len(terms) > 0 THEN 'Matched keyword: ' || terms[1] WHEN vector_score > 0 THEN 'Semantically similar metadata' WHEN investigation_boost > 0 THEN 'Used in the current investigation' ELSE 'Ranked catalogue result' END AS result_reason,
  CASE object_type WHEN 'dataset' THEN 'open_dataset' WHEN 'metric' THEN 'inspect_metric' ELSE 'open_entity' END || ',save_to_investigation' AS available_actions
FROM f ORDER BY rank_score DESC, title, document_id LIMIT 50"""


QUERIES = {"keyword_search": keyword_search, "vector_search": vector_search, "hybrid_search_words": hybrid_search_words, "hybrid_search_vector": hybrid_search_vector}
ORACLES = {
    "keyword_search": r"""WITH q AS (SELECT ['part', 'standard', 'economy'] AS e), w AS (SELECT p_partkey AS item_id, regexp_split_to_array(lower(p_name), '[^\p{L}\p{N}]+') AS t, regexp_split_to_array(lower(p_type), '[^\p{L}\p{N}]+') AS s, regexp_split_to_array(lower(p_brand), '[^\p{L}\p{N}]+') AS c, p_brand FROM part),
        l AS (SELECT item_id, round(len(list_distinct(list_intersect(t, e))) + 0.4 * len(list_distinct(list_intersect(s, e))) + 0.2 * len(list_distinct(list_intersect(c, e))), 4)::DOUBLE AS lexical_score, array_to_string(list_sort(list_distinct(list_intersect(['part', 'standard'], list_concat(t, s)))), ',') AS matched_terms FROM w, q)
        SELECT item_id, lexical_score, round(lexical_score * 0.65, 6)::DOUBLE AS score, matched_terms FROM l WHERE lexical_score > 0 ORDER BY score DESC, item_id LIMIT 50""",
    "vector_search": f"SELECT vec_id, round({_DOT} / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(40.0::DOUBLE)), 4) AS vector_score FROM embeddings ORDER BY vector_score DESC, vec_id LIMIT 20",
    "hybrid_search_words": _hybrid(["standard", "part", "economy"], ["standard", "part", "economy", "vendor"], ["standard", "part"], ["economy"], "standard part -economy", "0.0", "u1", "i1", "trusted_layer = 'gold' AND 1996 BETWEEN year_start AND year_end", False),
    "hybrid_search_vector": _hybrid(["nation"], ["nation"], ["nation", "3"], [], "nation_3", f"coalesce(round({_DOT} / (sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(40.0::DOUBLE)), 15), 0.0)", "u0", None, "updated >= DATE '2001-03-01'", True),
}
