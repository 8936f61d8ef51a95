"""Secret scans with an incremental ledger of blobs.

Every version of every path is addressed by the SHA-256 of its content. A ledger, a Parquet table that only
grows, says which pairs of blob and rule version have been scanned and what was found; a run scans the pairs
that it lacks, once each, and joins the findings back to all paths. A rule that changes or comes new is looked for in
all blobs, the others are not looked for again. Built-in expressions only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystat.llm.common import free_name, new_path

#: (kind, pattern, group whose length counts, least length, a text that every match holds or None). A match
#: that is too short is dropped after matching: the search goes on behind it.
BASE: tuple[tuple[str, str, int, int, str | None], ...] = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, None),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20, "AKIA"),
    ("hex", r"[0-9a-f]{24,}", 0, 24, None),
)
ADDED: tuple[tuple[str, str, int, int, str | None], ...] = (
    ("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----", 0, 27, "PRIVATE KEY"),
    ("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40, "gh"),
    ("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15, "xox"),
    ("google", r"AIza[0-9A-Za-z_-]{35}", 0, 39, "AIza"),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 29, "eyJ"),
)
RULES = BASE + ADDED

_SPANS = "array<struct<start:int,end:int,rule:string>>"
_LEDGER = f"blob string, rules array<string>, spans {_SPANS}"


def rule_version(rule: tuple[str, str, int, int, str | None]) -> str:
    return hashlib.sha256(repr(rule).encode()).hexdigest()[:16]


def _found(text: Column, asked: Column, rule: tuple[str, str, int, int, str | None]) -> Column:
    """Spans of one rule in code points, if it is asked for: the pieces between matches and the matches give all lengths."""
    _, pattern, group, least, holds = rule
    pat = F.lit(pattern)
    match, counted, piece = F.regexp_extract_all(text, pat, F.lit(0)), F.regexp_extract_all(text, pat, F.lit(group)), F.split(text, pattern, -1)
    parts = F.arrays_zip(match.alias("m"), counted.alias("c"), F.slice(piece, F.lit(1), F.size(match)).alias("p"))
    walked = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast(_SPANS).alias("out")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["p"]) + F.length(x["m"])).alias("at"),
            F.when(F.length(x["c"]) < least, a["out"])
            .otherwise(F.concat(a["out"], F.array(F.struct((a["at"] + F.length(x["p"])).alias("start"), (a["at"] + F.length(x["p"]) + F.length(x["m"])).alias("end"), F.lit(rule_version(rule)).alias("rule")))))
            .alias("out"),
        ),
        lambda a: a["out"],
    )
    there = text.rlike(pattern) if holds is None else F.contains(text, F.lit(holds)) & text.rlike(pattern)
    return F.when(asked & there, walked).otherwise(F.array().cast(_SPANS))


def scan_versions(versions: DataFrame, ledger: str, text_col: str = "text", rules=RULES) -> DataFrame:
    """The rows of `versions` (any path, commit or id columns) with `blob` and `spans` added or replaced.

    Scans the pairs of blob and rule version that the ledger has not and appends them to it. spans: (start, rank, end,
    kind) by start and then by the order of the rules. A null text is the empty blob. Equal texts are one blob; null ids
    and repeated rows keep their rows; other columns may have any name. Very long texts are read whole.
    """
    spark, own = versions.sparkSession, [rule_version(r) for r in rules]
    current = F.array(*map(F.lit, own))
    spark.createDataFrame([], _LEDGER).write.mode("append").parquet(ledger)  # it exists from here on
    text = F.coalesce(versions[text_col], F.lit(""))
    blobs = versions.select(F.sha2(text, 256).alias("blob"), text.alias("text")).groupBy("blob").agg(F.first("text").alias("text"))
    scanned = spark.read.schema(_LEDGER).parquet(ledger).groupBy("blob").agg(F.flatten(F.collect_list("rules")).alias("seen"))
    left = F.array_except(current, F.coalesce("seen", F.array().cast("array<string>")))
    unseen = blobs.join(scanned, "blob", "left").select("blob", "text", left.alias("rules")).filter(F.size("rules") > 0)
    found = F.concat(*(_found(F.col("text"), F.array_contains("rules", v), r) for v, r in zip(own, rules)))
    unseen.select("blob", "rules", found.alias("spans")).write.mode("append").parquet(ledger)
    blob, spans = free_name(versions, "__blob"), free_name(versions, "__spans")
    hits = spark.read.schema(_LEDGER).parquet(ledger).select("blob", F.filter("spans", lambda x: F.array_contains(current, x["rule"])).alias("spans")).filter(F.size("spans") > 0)
    kinds = F.array(*(F.lit(r[0]) for r in rules))
    rank = lambda x: (F.array_position(current, x["rule"]) - 1).cast("int")
    whole = F.transform(F.array_distinct(F.flatten(F.collect_list("spans"))), lambda x: F.struct(x["start"].alias("start"), rank(x).alias("rank"), x["end"].alias("end"), F.get(kinds, rank(x)).alias("kind")))
    hits = hits.groupBy(F.col("blob").alias(blob)).agg(F.sort_array(whole).alias(spans))
    paths = versions.drop("blob", "spans").withColumn("blob", F.sha2(text, 256))
    none = F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")
    return paths.join(hits, paths["blob"] == hits[blob], "left").withColumn("spans", F.coalesce(spans, none)).drop(blob, spans)


def _listed(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: str | None = None) -> DataFrame:
    """(id_col, n_assign, n_access, n_hex, base_sha256, spans) for each row; a new ledger if none is named."""
    got = scan_versions(df.select(id_col, text_col), ledger or new_path(df.sparkSession, "secret-ledger"), text_col)
    base = F.filter("spans", lambda x: x["rank"] < len(BASE))


    def count(k: int) -> Column:
        return F.size(F.filter("spans", lambda x: x["rank"] == k)).cast("long").alias(f"n_{BASE[k][0]}")

    return got.select(id_col, *map(count, range(len(BASE))), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def oracle_sql() -> str:
    """DuckDB SQL of digests() over the table documents."""
    each = "\nUNION ALL\n".join(
        f"SELECT r, '{kind}' AS kind, {k} AS rank, regexp_extract_all(text, '{p}') AS m, regexp_extract_all(text, '{p}', {g}) AS c, string_split_regex(text, '{p}') AS p, {least} AS least FROM d"
        for k, (kind, pattern, g, least, _) in enumerate(RULES)
        for p in [pattern.replace("'", "''")]
    )
    counts = ", ".join(f"count(*) FILTER (rank = {k}) AS n_{r[0]}" for k, r in enumerate(BASE))
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
e AS ({each}),
u AS (SELECT *, generate_subscripts(m, 1) AS i FROM e WHERE len(m) > 0),
s AS (SELECT r, kind, rank, m[i] AS hit, c[i] AS counted, least,
             list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS lo FROM u),
k AS (SELECT r, rank, lo, kind || ':' || lo::BIGINT || ':' || (lo + length(hit))::BIGINT AS t FROM s WHERE length(counted) >= least),
a AS (SELECT r, {counts}, string_agg(t, ',' ORDER BY lo, rank) FILTER (rank < {len(BASE)}) AS base, string_agg(t, ',' ORDER BY lo, rank) AS spans FROM k GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""
