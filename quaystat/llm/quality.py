"""Quality rules: a table of thresholds that becomes one projection of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystat.llm.common import SPACE

WINDOW = 8

#: (measure, comparison, bound): a document is kept if every line holds. Ratios are per word or per
#: line with a word; a document without words has all ratios 0.
RULES: tuple[tuple[str, str, float], ...] = (
    ("n_words", ">=", 20),
    ("repeat_word_ratio", "<=", 0.30),
    ("mean_word_length", ">=", 2.0),
    ("mean_word_length", "<=", 12.0),
    ("symbol_ratio", "<=", 0.10),
    ("dup_line_ratio", "<=", 0.50),
    ("stop_word_ratio", ">=", 0.04),
)

#: Frequent function words of the four languages of the corpus.
STOP_WORDS: tuple[str, ...] = tuple(
    sorted(
        set(
            "the of and to a in is that it for was on with as be by are this at from or an he they not".split()
            + "der die und in den von zu das sich mit des auf für ist im nicht dem ein eine als".split()
            + "de la le et les en des un du une que est pour par dans avec qui pas sur au".split()
            + "de la que el en y los las se del un por con no una su para es al lo".split()
        )
    )
)


def measures(text: Column) -> list[dict[str, Column]]:
    """Layers of columns over a text; each layer reads the ones before it, the last has the figures."""
    n = F.size("__words")
    first = {"__text": F.coalesce(text, F.lit(""))}
    second = {
        "__words": F.filter(F.split("__text", SPACE, -1), lambda x: x != ""),
        "__lines": F.filter(F.split("__text", "\n", -1), lambda x: F.regexp_replace(x, SPACE, "") != ""),
    }
    # Inside one document 64 bits of hash stand for a word, and for a window of words.
    hashed = {"__hashes": F.transform("__words", lambda x: F.xxhash64(x))}
    at = lambda i: F.xxhash64(*(F.get("__hashes", i + k) for k in range(WINDOW)))
    third = {"__windows": F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), at)).otherwise(F.array().cast("array<long>"))}
    fourth = {
        "__sorted": F.when(
            F.size(F.array_distinct("__windows")) < F.size("__windows"),
            F.sort_array(F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
        )
    }
    s = F.col("__sorted")
    same = lambda e, at: F.coalesce(F.get(s, at)["h"] == e["h"], F.lit(False))
    again = F.filter(s, lambda e, i: same(e, i - 1) | same(e, i + 1))
    fifth = {"__again": F.sort_array(F.transform(again, lambda e: e["i"]))}
    covered = F.aggregate(
        "__again",
        F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["last"])).alias("n"), p.alias("last")),
        lambda a: a["n"].cast("long"),
    )
    sixth = {
        "n_words": n.cast("long"),
        "word_chars": F.length(F.regexp_replace("__text", SPACE, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace("__text", r"[^#*$%&|<>]+", "")).cast("long"),
        "n_lines": F.size("__lines").cast("long"),
        "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
        "n_stop_words": F.size(F.filter("__words", lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long"),
    }
    return [first, second, hashed, third, fourth, fifth, sixth]


def ratios() -> dict[str, Column]:
    def per(a: str, b: str) -> Column:
        return F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))

    return {
        "n_words": F.col("n_words").cast("double"),
        "repeat_word_ratio": per("n_repeat_words", "n_words"),
        "mean_word_length": per("word_chars", "n_words"),
        "symbol_ratio": per("n_symbols", "n_words"),
        "dup_line_ratio": per("n_dup_lines", "n_lines"),
        "stop_word_ratio": per("n_stop_words", "n_words"),
    }


def verdict(rules: tuple[tuple[str, str, float], ...] = RULES) -> Column:
    """The table as one boolean column."""
    have, out = ratios(), F.lit(True)
    for name, how, bound in rules:
        c = have[name]
        out = out & {">=": c >= bound, "<=": c <= bound, ">": c > bound, "<": c < bound}[how]
    return out


def _measured(df: DataFrame, keep: str) -> DataFrame:
    for layer in measures(F.col("__in")):
        kept = [c for c in df.columns if c != "__in" or "__text" in layer]
        df = df.select(*kept, *(c.alias(k) for k, c in layer.items()))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    figures = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words"]
    return df.select(keep, *figures, failed.alias("base_failed"))


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[tuple[str, str, float], ...] = RULES) -> DataFrame:
    """(id_col, figures, base_failed, kept) for each input row, without a shuffle or a user function.

    A null or empty text has no words and is not kept. Null and repeated ids and repeated rows each
    keep their row; ties do not arise. Other columns are not read, whatever their names.
    """
    out = _measured(df.select(df[id_col].alias("__id"), df[text_col].alias("__in")), "__id")
    row = F.struct(F.col("__id").alias(id_col), *out.columns[1:], (~F.col("base_failed") & verdict(rules)).alias("kept"))
    # A barrier: Catalyst would push a later filter below the layers and compute each of them again wherever it is used.
    return out.select(F.explode(F.array(row)).alias("__row")).select("__row.*")


def keep_good(df: DataFrame, text_col: str = "text", rules: tuple[tuple[str, str, float], ...] = RULES) -> DataFrame:
    """The rows that the rules keep, with all their columns as they were."""
    out = _measured(df.select(F.struct(*(df[c] for c in df.columns)).alias("__row"), df[text_col].alias("__in")), "__row")
    # Not a filter: Catalyst would push it below the layers and compute each of them again wherever it is used.
    return out.select(F.explode(F.when(~F.col("base_failed") & verdict(rules), F.array("__row"))).alias("__row")).select("__row.*")


def oracle_sql() -> str:
    """DuckDB SQL of score() over the table documents."""
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    have = {
        "n_words": "n_words",
        "repeat_word_ratio": "coalesce(n_repeat_words / nullif(n_words, 0)::double, 0)",
        "mean_word_length": "coalesce(word_chars / nullif(n_words, 0)::double, 0)",
        "symbol_ratio": "coalesce(n_symbols / nullif(n_words, 0)::double, 0)",
        "dup_line_ratio": "coalesce(n_dup_lines / nullif(n_lines, 0)::double, 0)",
        "stop_word_ratio": "coalesce(n_stop_words / nullif(n_words, 0)::double, 0)",
    }
    rules = " AND ".join(f"{have[a]} {op} {b}" for a, op, b in RULES)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS lines FROM d),
win AS (SELECT r, p, words[p:p + 7] AS k FROM (SELECT r, words, unnest(range(1, len(words) - 6)) AS p FROM w)),
again AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, k) AS n FROM win) WHERE n > 1),
cover AS (SELECT r, count(DISTINCT p + j) AS n FROM again, (SELECT unnest(range(0, 8)) AS j) GROUP BY r),
f AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(lines)::BIGINT AS n_lines,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(cover.n, 0)::BIGINT AS n_repeat_words,
             len(list_filter(words, lambda x: lower(x) IN ({stops})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN cover USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words, base_failed,
       NOT base_failed AND {rules} AS kept FROM b
"""
