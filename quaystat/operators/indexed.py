"""Queries over pages and the positional index, and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystat.operators import inverted, search
from quaystat.operators.catalogue import with_row_index
from quaystat.sources import paged
from quaystat.sources.mart import read
from quaystat.store import scratch

TEXT_FIELDS = (inverted.Field("source", 1.0), inverted.Field("lang", 0.4), inverted.Field("text", 0.1))


def _event_pages(spark: SparkSession, sf_dir: str) -> str:
    path = scratch(spark, "event-pages")
    e = with_row_index(read(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), "event_id")
    paged.write_pages(e, path)
    paged.register(spark)
    return path


def paged_pushdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two columns of the purchases behind row 649: the source picks pages by their bounds and rows by the filters."""
    rows = spark.read.format("paged").option("select", "row_index,user_id").option("filter", "event_type eq 'purchase'").load(_event_pages(spark, sf_dir))
    return rows.filter("row_index >= 650")


def paged_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows a paged source has, by its list of pages."""
    return paged.count(spark, _event_pages(spark, sf_dir))


def cover_density_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold `that`, `the` or `was`, a phrase, and no `von`, by cover density over whole texts."""
    index = inverted.build(read(spark, sf_dir, "documents").filter("doc_id is not null"), scratch(spark, "text-index"), "doc_id", TEXT_FIELDS)
    found = inverted.cover_density(index, "that the or was -von")
    return found.select(F.col("document_id").alias("doc_id"), F.round("cover", 6).alias("cover"))


def hybrid_search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue search with its lexical part from the index; the synonym's target joins the query."""
    docs = search.search_documents(spark, sf_dir)
    query, synonyms = "small or red bolt", {"bolt": ["article"]}
    words = inverted.lexical(inverted.build(docs, scratch(spark, "catalogue-index")), query, synonyms)
    return search.hybrid_search(docs, query, None, synonyms, "u1", "i1", search._access(spark), {"strict_gold_only": True}, limit=50, words=words)


def _cover_sql(table: str, key: str, fields: tuple[inverted.Field, ...], groups: list[list[str]], excluded: list[str]) -> str:
    """Views up to cov (key, cover): cover density of groups of words."""
    cut = lambda f: rf"list_transform(list_filter(regexp_split_to_array(lower(coalesce({f.column}, '')), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''), lambda x: {{'t': x, 'i': {1 / f.weight if f.weight else 0.0}::DOUBLE}})"
    words = sorted({t for g in groups for t in g})
    lit = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"
    row = cut(fields[0])
    for f in fields[1:]:
        row = f"list_concat({row}, {cut(f)})"
    gone = f"WHERE NOT list_has_any(list_transform(l, lambda x: x.t), [{', '.join(f'{chr(39)}{x}{chr(39)}' for x in excluded)}]::VARCHAR[])" if excluded else ""
    last = ", ".join(f"max(CASE WHEN t IN {lit(g)} THEN n END) OVER u AS l{k}" for k, g in enumerate(groups))
    every = " AND ".join(f"l{k} IS NOT NULL" for k in range(len(groups)))
    least = "least(" + ", ".join(f"l{k}" for k in range(len(groups))) + ")"
    return f"""
tok AS (SELECT {key}, {row} AS l FROM {table}),
occ AS (SELECT {key}, p, w.t AS t, w.i AS i FROM (SELECT {key}, unnest(l) AS w, generate_subscripts(l, 1) AS p FROM tok {gone}) WHERE w.t IN {lit(words)} AND w.i > 0),
num AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY p) AS n, sum(i) OVER (PARTITION BY {key} ORDER BY p) AS s FROM occ),
seen AS (SELECT *, {last} FROM num WINDOW u AS (PARTITION BY {key} ORDER BY p ROWS UNBOUNDED PRECEDING)),
ext AS (SELECT *, CASE WHEN {every} THEN {least} END AS b FROM seen),
ends AS (SELECT *, lag(b) OVER (PARTITION BY {key} ORDER BY p) AS before FROM ext),
cov AS (SELECT e.{key}, sum((e.n - b.n + 1) / (e.s - b.s + b.i) / (1 + (e.p - b.p) - (e.n - b.n))) AS cover FROM ends e JOIN num b ON b.{key} = e.{key} AND b.n = e.b
        WHERE e.b IS NOT NULL AND (e.before IS NULL OR e.b > e.before) GROUP BY 1)"""


_PAGES = "SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events"
ORACLES = {
    "paged_pushdown": f"SELECT i AS row_index, user_id FROM ({_PAGES}) WHERE i >= 650 AND event_type = 'purchase'",
    "paged_count": "SELECT count(*) AS rows FROM events",
    "cover_density_documents": "WITH" + _cover_sql("documents", "doc_id", TEXT_FIELDS, [["that"], ["the", "was"]], ["von"]) + " SELECT doc_id, round(cover, 6) AS cover FROM cov",
    "hybrid_search_indexed": search._hybrid(
        ["small", "red", "bolt"], ["small", "red", "bolt", "article"], [], [], "small or red bolt", "0.0", "u1", "i1", "trusted_layer = 'gold'", False,
        _cover_sql("d", "document_id", inverted.CATALOGUE_FIELDS, [["small", "red"], ["bolt"], ["article"]], []) + ",", "coalesce((SELECT cover FROM cov WHERE cov.document_id = v.document_id), 0)",
    ),
}
QUERIES = {n: globals()[n] for n in ORACLES}
