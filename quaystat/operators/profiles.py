"""Profiles of facts: from file footers, from a sample, from all rows; qualification of measures with a cheaper way for large data sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quaystat.functions import rules

_BOUNDED = ("byte", "short", "integer", "long", "float", "double", "boolean", "date", "tinyint", "smallint", "int", "bigint")


def footer_profile(spark: SparkSession, path: str) -> DataFrame:
    """(column, rows, nulls, least, greatest) of each column of Parquet files, from their footers.

    Spark pushes the counts and bounds down to the footers in a session of its own whose Parquet reader can. Bounds are texts, and null for columns whose
    footers have none that are whole: texts, decimals, timestamps and nested ones. Of nested columns only the rows are known. A column whose values are all
    null in some block has no bounds there, which the push-down does not take: it is read by itself, all others are not.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", "")
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    df = own.read.parquet(path)
    fields = {f.name: f.dataType.typeName() for f in df.schema.fields}
    col = lambda n: F.col(f"`{n}`")
    flat = [n for n, kind in fields.items() if kind not in ("array", "map", "struct", "variant")]
    there = footer_counts(df, flat).first()
    number = {n: k for k, n in enumerate(flat)}
    bounded = [n for n in flat if fields[n] in _BOUNDED and there[f"n{number[n]}"]]

    def bounds(source: DataFrame, names: list[str]) -> dict[str, tuple]:
        if not names:
            return {}
        zero = lambda n, c: (c + 0.0 if fields[n] in ("float", "double") else c).cast("string")  # noqa: E731  a footer's least zero is the negative one
        row = source.agg(*(f(col(n)).alias(f"{a}{number[n]}") for n in names for a, f in (("a", F.min), ("b", F.max))))
        row = row.select(*(zero(n, F.col(f"{a}{number[n]}")).alias(f"{a}{number[n]}") for n in names for a in "ab")).first()
        return {n: (row[f"a{number[n]}"], row[f"b{number[n]}"]) for n in names}

    try:
        known = bounds(df, bounded)
    except Exception as e:  # a block without bounds: find the columns
        if "FAILED_READ_FILE" not in str(e):
            raise
        known = {}
        for n in bounded:
            try:
                known |= bounds(df, [n])
            except Exception as e:
                if "FAILED_READ_FILE" not in str(e):
                    raise
                known |= bounds(spark.read.parquet(path), [n])
    rows = [(n, there["rows"], there["rows"] - there[f"n{number[n]}"] if n in number else None, *known.get(n, (None, None))) for n in fields]
    return spark.createDataFrame(rows, "column string, rows long, nulls long, least string, greatest string")


def footer_counts(df: DataFrame, flat: list[str]) -> DataFrame:
    """One row: rows, and n0, n1, ... for how many values each flat column has."""
    return df.agg(F.count("*").alias("rows"), *(F.count(F.col(f"`{n}`")).alias(f"n{k}") for k, n in enumerate(flat)))


def first_rows(fact: DataFrame, by: str, order: list[str], rows: int, shares: int = 16) -> DataFrame:
    """The first rows of each group in the order of columns, exactly, without a sort of whole groups.

    Rows are dealt by hash into shares * rows shares of their group, and the least first column of each share is kept. As many rows as there are shares
    have a value up to theirs, so the rows-th least of them bounds the wanted rows from above: what lies behind it is left out, and only the few
    rows up to it are numbered. A group with fewer filled shares is numbered whole. Nulls come first, as in a sort, and are never left out.
    """
    key = order[0]
    share = F.pmod(F.xxhash64(*order), F.lit(shares * rows))
    least = fact.groupBy(F.col(by).alias("by__"), share.alias("share__")).agg(F.min(key).alias("least__"))
    place = F.row_number().over(Window.partitionBy("by__").orderBy("least__"))
    bound = least.filter("least__ is not null").withColumn("place__", place).filter(F.col("place__") == rows).select("by__", "least__")
    near = fact.join(F.broadcast(bound), F.col(by).eqNullSafe(F.col("by__")), "left").filter(F.col("least__").isNull() | F.col(key).isNull() | (F.col(key) <= F.col("least__"))).drop("by__", "least__")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return near.withColumn("rank__", rank).filter(F.col("rank__") <= rows).drop("rank__")


def fact_rollup(fact: DataFrame, measures: DataFrame, mode: str = "sampled", sample_rows: int = 10_000, key: str = "observation_key") -> DataFrame:
    """Counts and bounds of each measure, level and period type, with the depth of the profile.

    mode: `metadata` knows the measures and nothing of the facts, `sampled` looks at the first rows of each data set by key, `exact` at all.
    """
    if mode == "metadata":
        none = lambda kind: F.lit(None).cast(kind)
        zero = F.lit(0).cast("long")
        return measures.select("dataset_code", "measure_code", F.lit("unknown").alias("geography_type"), F.lit("unknown").alias("period_type"), none("long").alias("min_year"), none("long").alias("max_year"), zero.alias("fact_rows"), zero.alias("populated_rows"), none("double").alias("min_value"), none("double").alias("max_value"), F.lit("metadata_only").alias("profile_depth"))
    if mode == "sampled":
        fact = first_rows(fact, "dataset_code", [key, "measure_code"], sample_rows)
    elif mode != "exact":
        raise ValueError(f"unknown mode {mode}")
    value = F.when(populated(), F.col("value")).cast("double")
    return fact.groupBy("dataset_code", "measure_code", F.coalesce("geography_type", F.lit("unknown")).alias("geography_type"), F.coalesce("period_type", F.lit("unknown")).alias("period_type")).agg(
        F.min("calendar_year").alias("min_year"), F.max("calendar_year").alias("max_year"), F.count("*").alias("fact_rows"), F.count(value).alias("populated_rows"), F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        F.lit("sample_profiled" if mode == "sampled" else "fact_profiled").alias("profile_depth"),
    )


def populated() -> Column:
    return F.col("value").isNotNull() & ~F.col("is_missing")


def _filled(c: str, other: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(other))


def qualify(fact: DataFrame, indicators: DataFrame, stored: DataFrame, bound: int) -> DataFrame:
    """What each measure can do, by its populated facts with a year: years, levels, grains, flags, and why it can't be executed.

    Data sets of at most `bound` facts are looked at whole. Of larger ones only the rows of each measure are counted, and years and grains come from the
    stored profile (dataset_code, measure_code, available_years, geography_types, grains), whose data set may be written in another case. A measure
    without indicator, or of a large data set without facts or profile, is left out. indicators: dataset_code, measure_code, default_aggregation.
    """
    own = fact.filter(populated() & F.col("calendar_year").isNotNull())
    sizes = own.groupBy("dataset_code").agg((F.count("*") <= bound).alias("whole"))
    level, kind = _filled("geography_type", "country"), _filled("period_type", "year")
    grain = F.concat(F.when(level.isin("country", "unknown"), "national").otherwise(level), F.lit("_"), kind)
    # One pass: sets are only gathered where the data set is small; a set has few members, whatever the number of rows.
    rows = own.join(F.broadcast(sizes.limit(1_000_000)), "dataset_code")
    gather = lambda c: F.sort_array(F.collect_set(F.when(F.col("whole"), c)))
    one = rows.groupBy("dataset_code", "measure_code", "whole").agg(F.count("*").alias("populated_rows"), gather(F.col("calendar_year")).alias("years"), gather(level).alias("levels"), gather(grain).alias("grain_set"))
    s = stored.select(F.upper("dataset_code").alias("s_dataset"), F.col("measure_code").alias("s_measure"), "available_years", "geography_types", "grains").dropDuplicates(["s_dataset", "s_measure"])
    both = one.join(s, ~F.col("whole") & (F.upper("dataset_code") == F.col("s_dataset")) & (F.col("measure_code") == F.col("s_measure")), "left").filter("whole or s_dataset is not null")
    pick = lambda a, b: F.when(F.col("whole"), F.col(a)).otherwise(F.col(b))
    both = both.select("dataset_code", "measure_code", "populated_rows", pick("years", "available_years").alias("available_years"), pick("levels", "geography_types").alias("geography_types"), pick("grain_set", "grains").alias("grains"), F.when(F.col("whole"), "by_dataset").otherwise("by_measure").alias("profile_source"))
    both = both.join(indicators.select("dataset_code", "measure_code", "default_aggregation"), ["dataset_code", "measure_code"])
    years = [f"{g}_year" for g in ("municipality", "province", "region", "national")]
    safe = F.coalesce(F.col("default_aggregation"), F.lit("none")) != "none"
    ranked, compared = F.arrays_overlap("grains", F.array(*(F.lit(g) for g in years[:3]))), F.arrays_overlap("grains", F.array(*(F.lit(g) for g in years)))
    reasons = F.array_compact(F.array(F.when(F.col("populated_rows") == 0, "no_populated_facts"), F.when(~safe, "missing_safe_aggregation"), F.when(~compared, "unsupported_grain")))
    return both.select(
        "*", *(F.array_contains("grains", g).alias(f"supports_{g}") for g in years), (F.size("available_years") > 1).alias("supports_trend"), ranked.alias("supports_ranking"), compared.alias("supports_comparison"),
        ((F.col("populated_rows") > 0) & safe & compared).alias("executable_candidate"), reasons.alias("non_executable_reasons"),
    )


def resolved_levels(capability: DataFrame, declared: DataFrame, codes: DataFrame) -> DataFrame:
    """(domain_id, dataset_code, geography_types, grains): the levels of each data set from three sources, joined in full one after the other.

    Each has (domain_id, dataset_code, geography_types). Levels read off region codes win if there are any; else those of capability and of
    what is declared (country if that is empty) together, in the order of levels.
    """
    key = ["domain_id", "dataset_code"]
    named = lambda df, n: df.select(*key, F.col("geography_types").alias(n))
    both = named(capability, "g").withColumn("have_g", F.lit(True)).join(named(declared, "s"), key, "full").join(named(codes, "c"), key, "full")
    none = F.array().cast("array<string>")
    some = lambda c, other: F.when(F.coalesce(F.size(F.col(c)), F.lit(0)) > 0, F.col(c)).otherwise(other)
    levels = F.array_distinct(F.filter(F.concat(some("g", none), some("s", F.array(F.lit("country")))), lambda x: x.isNotNull() & (x != "")))
    order = lambda x: F.struct(rules.level_order(x).alias("o"), x.alias("level"))
    ranked = F.transform(F.sort_array(F.transform(levels, order)), lambda x: x["level"])
    out = both.select(*key, some("c", ranked).alias("geography_types"))
    unknown_last = lambda x: F.struct(F.when(x == "unknown", 5).otherwise(rules.level_order(x)).alias("o"), x.alias("level"))
    grains = F.transform(F.sort_array(F.transform("geography_types", unknown_last)), lambda x: F.concat(x["level"], F.lit("_year")))
    return out.select("*", grains.alias("grains"))
