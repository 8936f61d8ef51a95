"""The public side of loaded data sets: catalogue rows with evidence, dimensions, quality checks, and a summary of a layer.

All functions take tables with a row for each data set (or dimension, or value) and answer for all data sets at once. `publish` merges the
rows into versioned tables, parents before children, and a second run of the same load changes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystat.functions import domain
from quaystat.operators.versioned import VersionedTable

# States of a load and of its quality.
TERMINAL = ("complete", "complete_with_warnings", "partial", "metadata_loaded")
COMPLETE = ("complete", "complete_with_warnings", "completed", "completed_with_rejections")
PERIODS = "Perioden"


def _number(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0)).cast("long")


def quality(status: DataFrame) -> DataFrame:
    """status with `checks`, `quality_status`, `row_completeness_pct`, `metadata_completeness_pct` and `dimension_completeness_pct`.

    status: dataset_id, status, dimensions, measures, expected_observations, observations_loaded, rejected_rows. Null counts are 0, but
    an expectation that is null is unknown: its check warns and the share of rows is null.
    """
    expected, loaded, rejected = F.col("expected_observations").cast("long"), _number("observations_loaded"), _number("rejected_rows")
    dims, measures = _number("dimensions"), _number("measures")
    described = F.col("dimensions").isNotNull() | F.col("measures").isNotNull()
    actual = F.when(described, F.concat(dims.cast("string"), F.lit(" dimensions, "), measures.cast("string"), F.lit(" measures"))).otherwise("none")
    rows = F.when(expected.isNull(), "warn").when(loaded + rejected >= expected, "pass").when(loaded > 0, "warn").otherwise("fail")
    none = F.lit(None).cast("string")
    check = lambda name, result, want, got: F.struct(
        F.lit(name).alias("check_name"), result.alias("status"), want.cast("string").alias("expected_value"), got.cast("string").alias("actual_value")
    )
    checks = F.array(
        check("metadata_present", F.when((dims > 0) | (measures > 0), "pass").otherwise("fail"), none, actual),
        check("rows_match_source", rows, expected, loaded + rejected),
        check("rejected_rows", F.when(rejected > 0, "warn").otherwise("pass"), F.lit(0), rejected),
        check("status_terminal", F.when(F.coalesce(F.col("status").isin(*TERMINAL), F.lit(False)), "pass").otherwise("warn"), none, F.col("status")),
    )
    some = lambda result: F.exists("checks", lambda c: c["status"] == result)
    full = lambda n: F.when(n > 0, 100).otherwise(0)
    out = status.withColumn("checks", checks)
    return out.withColumns(
        {
            "quality_status": F.when(some("fail"), "failed").when(some("warn"), "warning").otherwise("passed"),
            "row_completeness_pct": domain.percent_complete(loaded + rejected, expected),
            "metadata_completeness_pct": full(measures),
            "dimension_completeness_pct": full(dims),
        }
    )


def check_rows(status: DataFrame, layer: str = "silver") -> DataFrame:
    """(dataset_id, layer, check_name, status, expected_value, actual_value): a row for each check of each data set."""
    return quality(status).select("dataset_id", F.lit(layer).alias("layer"), F.inline("checks"))


def layer_summary(status: DataFrame, provider: str, layer: str = "silver") -> DataFrame:
    """One row over all data sets of a layer: counts by state, rows expected and loaded, the share of them, and how many have which quality.

    status: as for quality(), with quality_status and last_loaded_at. A layer without data sets is pending. Counted by quality first, so that
    what is then summed is a row for each quality.
    """
    state = F.col("status")
    per = status.groupBy(F.coalesce("quality_status", F.lit("unknown")).alias("quality")).agg(
        F.count("*").alias("n"),
        F.count_if(state.isin(*COMPLETE)).alias("complete"),
        F.count_if(state == "partial").alias("partial"),
        F.count_if(state == "failed").alias("failed"),
        F.sum(_number("expected_observations")).alias("expected"),
        F.sum(_number("observations_loaded")).alias("loaded"),
        F.sum(_number("rejected_rows")).alias("rejected"),
        F.max("last_loaded_at").alias("last_loaded_at"),
    )
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    all_ = per.agg(
        *(total(c) for c in ("n", "complete", "partial", "failed", "expected", "loaded", "rejected")),
        F.max("last_loaded_at").alias("last_loaded_at"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("quality", "n")))).alias("quality_statuses"),
    )
    warned = (F.col("failed") > 0) | (F.col("rejected") > 0)
    return all_.select(
        F.lit(provider).alias("provider"),
        F.lit(layer).alias("layer"),
        F.when(warned, "complete_with_warnings").when(F.col("partial") > 0, "partial").when(F.col("complete") > 0, "complete").otherwise("pending").alias("status"),
        F.col("n").alias("datasets_total"),
        F.col("complete").alias("datasets_complete"),
        F.col("partial").alias("datasets_partial"),
        F.col("failed").alias("datasets_failed"),
        F.col("expected").alias("records_expected"),
        F.col("loaded").alias("records_loaded"),
        domain.percent_complete(F.col("loaded") + F.col("rejected"), F.col("expected")).alias("completeness_pct"),
        F.col("rejected").alias("rejected_rows"),
        "last_loaded_at",
        "quality_statuses",
    )


def public_dimension() -> Column:
    """Whether a dimension's values tell years or places."""
    key, kind = F.coalesce("dimension_key", F.lit("")), F.coalesce("type", F.lit(""))
    return (key == PERIODS) | kind.contains("Time") | kind.contains("Geo") | key.contains("Regio") | key.contains("Wijken") | key.contains("Gebieden")


def value_facts(dimensions: DataFrame, values: DataFrame) -> DataFrame:
    """(dataset_id, years, levels) from the values of public dimensions: all of them are read, and at most 57 years and 4 levels are kept a data set."""
    public = dimensions.filter(public_dimension()).select("dataset_id", "dimension_key").distinct()
    year = F.substring("value_key", 1, 4).try_cast("int")
    year = F.when((F.col("dimension_key") == PERIODS) & year.between(domain.FIRST_YEAR, domain.LAST_YEAR), year)
    level = domain.geography_level(F.col("value_key"), F.col("title"), F.col("description"))
    each = values.join(public, ["dataset_id", "dimension_key"], "left_semi").select("dataset_id", year.alias("year"), level.alias("level"))
    return each.groupBy("dataset_id").agg(F.sort_array(F.collect_set("year")).alias("years"), F.sort_array(F.collect_set("level")).alias("levels"))


def catalogue(datasets: DataFrame, dimensions: DataFrame, values: DataFrame, status: DataFrame, provider: str) -> DataFrame:
    """A public row for each data set: its years and places, where they come from, and what speaks for them.

    Years are those of the period dimension; without any, the range that the catalogue's period names; else the range in title and description. datasets:
    dataset_id, title, short_title, short_description, period, updated_at. Data sets without dimensions or a status have a row all the same; levels are
    in alphabetical order. Rows without a dataset_id are left out.
    """
    counted = dimensions.groupBy("dataset_id").agg(F.count("*").alias("n_dimensions"))
    got = status.groupBy("dataset_id").agg(F.max("observations_loaded").alias("record_count"))
    d = datasets.filter("dataset_id is not null").join(value_facts(dimensions, values), "dataset_id", "left").join(counted, "dataset_id", "left").join(got, "dataset_id", "left")
    empty = F.array().cast("array<int>")
    own = F.coalesce("years", empty)
    named = domain.expanded_years(domain.years_in_text(F.col("period")))
    told = domain.expanded_years(domain.years_in_text(F.concat_ws(" ", "title", "short_title", "short_description")))
    first = lambda *pairs: F.when(F.size(own) > 0, pairs[0]).when(F.size(named) > 0, pairs[1]).when(F.size(told) > 0, pairs[2]).otherwise(pairs[3])
    d = d.select(
        "*",
        first(own, named, told, empty).alias("all_years"),
        first(*(F.lit(s) for s in ("perioden-dimension", "catalog-period", "catalog-text", "none"))).alias("period_source"),
        F.coalesce("levels", F.array().cast("array<string>")).alias("geographic_levels"),
    ).withColumn("spatial_coverage", domain.spatial_coverage(F.col("geographic_levels")))
    places = F.size("geographic_levels") > 0
    says = lambda condition, yes, no=None: F.when(condition, yes).otherwise(F.lit(no).cast("string"))
    evidence = F.array_compact(
        F.array(
            says(F.col("period_source") == "perioden-dimension", "Years from the period dimension", "No period dimension found"),
            says(F.col("period_source") == "catalog-period", "Years expanded from the catalogue's period"),
            says(F.col("period_source") == "catalog-text", "Years inferred from title and description"),
            says(places, "Geographic levels from dimension values", "No geography dimension values identified"),
            F.concat(F.lit("Spatial coverage: "), F.col("spatial_coverage")),
            says(F.col("record_count").isNotNull(), "Record count from observations loaded", "Record count unavailable"),
        )
    )
    filled = lambda c: F.when(F.col(c) != "", F.col(c))
    return d.select(
        "dataset_id",
        F.lit(provider).alias("provider"),
        F.coalesce(filled("short_title"), filled("title"), "dataset_id").alias("title"),
        F.coalesce(filled("short_description"), filled("title"), "dataset_id").alias("description"),
        "updated_at",
        "record_count",
        F.array_min("all_years").alias("year_start"),
        F.array_max("all_years").alias("year_end"),
        F.col("all_years").alias("years"),
        "geographic_levels",
        "spatial_coverage",
        "period_source",
        F.when(F.col("n_dimensions") > 0, "source-metadata").when(F.size("all_years") > 0, "partial-metadata").otherwise("unqualified").alias("qualification_confidence"),
        evidence.alias("qualification_evidence"),
    )


def dimension_rows(datasets: DataFrame, dimensions: DataFrame) -> DataFrame:
    """The dimensions of known data sets; a title or type that is missing or empty is filled in."""
    filled = lambda c, other: F.coalesce(F.when(F.col(c) != "", F.col(c)), other).alias(c)
    known = dimensions.join(datasets.select("dataset_id").distinct(), "dataset_id", "left_semi")
    return known.select("dataset_id", "dimension_key", filled("title", F.col("dimension_key")), filled("type", F.lit("Dimension")), F.col("values_count").cast("long").alias("values_count"))


TABLES = {
    "catalogue": (
        ("dataset_id",),
        "dataset_id string, provider string, title string, description string, updated_at string, record_count long, year_start int, year_end int, years array<int>, "
        "geographic_levels array<string>, spatial_coverage string, period_source string, qualification_confidence string, qualification_evidence array<string>",
    ),
    "dimensions": (("dataset_id", "dimension_key"), "dataset_id string, dimension_key string, title string, type string, values_count long"),
    "checks": (("dataset_id", "layer", "check_name"), "dataset_id string, layer string, check_name string, status string, expected_value string, actual_value string"),
}


def tables(spark: SparkSession, root: str) -> dict[str, VersionedTable]:
    return {name: VersionedTable(spark, f"{root}/{name}", keys, schema) for name, (keys, schema) in TABLES.items()}


def publish(root: str, load: str, datasets: DataFrame, dimensions: DataFrame, values: DataFrame, status: DataFrame, provider: str, layer: str = "silver") -> dict[str, VersionedTable]:
    """Merges what the four tables tell into the public tables under root.

    Data sets come before what refers to them. Each table notes the load with its merge: a run that broke off is resumed at the table it had
    come to, and a load that is through changes nothing. Data sets that this load does not have keep their rows.
    """
    out = tables(datasets.sparkSession, root)
    known = datasets.select("dataset_id").distinct()
    out["catalogue"].merge(catalogue(datasets, dimensions, values, status, provider), load)
    out["dimensions"].merge(dimension_rows(datasets, dimensions), load)
    out["checks"].merge(check_rows(status.join(known, "dataset_id", "left_semi"), layer), load)
    return out
