"""The semantic catalogue from its dimensions: metrics, their dimensions, synonyms, versions of definitions, and items with lineage.

All take and give DataFrames; a write is `upserted(stored, new)`, so that what a person has curated survives each build.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quaystat.functions import domain

# Aggregations that a metric may be offered with, dimensions of every metric, and layers that an item went through.
SAFE = ("sum", "average", "min", "max", "count", "latest")
DIMENSIONS = ("time", "geography", "category", "dataset", "status")
LAYERS = ("api", "bronze", "silver", "gold")
#: Keys that stay as they were stored, whoever stored them.
KEYS = ("measure_key", "dataset_key", "unit_key")


def _true(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(False))


def metrics(measures: DataFrame) -> DataFrame:
    """A generated metric for each measure: code, label, aggregation, kinds of additivity, and whether it is complete enough to be enabled.

    measures: measure_key, measure_code, measure_name, measure_description, dataset_code, dataset_key, unit_code, unit_key, value_type,
    default_aggregation, is_additive, is_semi_additive, is_non_additive, is_percentage, is_index. Percentages and indices are never summed. Codes
    are cut, so that two measures can share one: the one of the greatest key stays. A null flag is false.
    """
    ratio = _true("is_percentage") | _true("is_index")
    how = domain.approved_aggregation(F.col("default_aggregation"), F.when(ratio, "ratio").otherwise(F.col("value_type")))
    code = domain.metric_code(F.col("dataset_code"), F.col("measure_code"), F.col("unit_code"), F.col("measure_key"))
    whole = F.col("measure_key").isNotNull() & F.col("dataset_key").isNotNull() & F.col("unit_key").isNotNull() & how.isin(*SAFE)
    each = measures.select(
        code.alias("metric_code"),
        "measure_key",
        F.col("measure_name").alias("metric_label"),
        F.col("measure_description").alias("description"),
        "dataset_key",
        how.alias("aggregation"),
        "unit_key",
        "value_type",
        (_true("is_additive") & ~ratio).alias("is_additive"),
        _true("is_semi_additive").alias("is_semi_additive"),
        (_true("is_non_additive") | ratio).alias("is_non_additive"),
        whole.alias("is_enabled"),
        F.when(whole, "complete").otherwise("incomplete").alias("metadata_completeness_status"),
    )
    values = [c for c in each.columns if c != "metric_code"]
    return each.groupBy("metric_code").agg(F.max(F.struct(*values)).alias("m")).select("metric_code", "m.*", F.lit("generated").alias("metadata_origin"))


def upserted(stored: DataFrame, new: DataFrame, keys: tuple[str, ...], kept: tuple[str, ...] = (), origin: str = "metadata_origin") -> DataFrame:
    """The stored rows with the new ones over them, by keys that are equal (null equals null).

    Rows that a person has curated stay whole, but for `kept` columns that they lack; others take the new values, null ones as well, but in `kept`
    columns the stored value stays where there is one. Both have the same columns, and at most one row a key.
    """
    o, n = stored.withColumn("__o", F.lit(True)).alias("o"), new.withColumn("__n", F.lit(True)).alias("n")
    both = o.join(n, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full")
    have, come = F.col("o.__o").isNotNull(), F.col("n.__n").isNotNull()
    stays = have & (~come | F.coalesce(F.col(f"o.{origin}") == "curated", F.lit(False)))
    value = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")) if c in (*keys, *kept) else F.when(stays, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    return both.select(*(value(c).alias(c) for c in stored.columns))


def metric_dimensions(metrics: DataFrame, dimensions: DataFrame) -> DataFrame:
    """(metric_code, dimension_name, dimension_id, is_required, is_default, supports_grouping, supports_filtering): each metric with the dimensions that exist.

    dimensions: dimension_code, dimension_id. Time and place are required. Names that `dimensions` lacks are left out.
    """
    each = metrics.select("metric_code", F.explode(F.array(*(F.lit(d) for d in DIMENSIONS))).alias("dimension_name"))
    known = dimensions.groupBy(F.col("dimension_code").alias("dimension_name")).agg(F.min("dimension_id").alias("dimension_id"))
    basic = F.col("dimension_name").isin("time", "geography")
    return each.join(known, "dimension_name").select(
        "metric_code", "dimension_name", "dimension_id", basic.alias("is_required"), basic.alias("is_default"), F.lit(True).alias("supports_grouping"), F.lit(True).alias("supports_filtering")
    )


def synonyms(names: DataFrame, language: str = "nl") -> DataFrame:
    """(object_type, object_id, synonym, normalized_synonym, language_code, weight, metadata_origin) from names: object_type, object_id, synonyms (an array).

    Of names that are equal when folded the first of the array stays. Null and empty names, and those without letters or digits, go. Objects that
    stand in several rows count once; of their arrays the smallest place of a name counts.
    """
    each = names.select("object_type", F.col("object_id").cast("string").alias("object_id"), F.posexplode("synonyms").alias("pos", "synonym"))
    each = each.withColumn("normalized_synonym", domain.folded(F.col("synonym"))).filter("normalized_synonym <> ''")
    one = each.groupBy("object_type", "object_id", "normalized_synonym").agg(F.min(F.struct("pos", "synonym"))["synonym"].alias("synonym"))
    return one.select("object_type", "object_id", "synonym", "normalized_synonym", F.lit(language).alias("language_code"), F.lit(1.0).alias("weight"), F.lit("source").alias("metadata_origin"))


def definition_versions(measures: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """Definitions of measures that are not stored with the same text and reference: a text that changes is a version beside the old one.

    Measures without a description, or with an empty one, have none. Repeated rows count once.
    """
    own = measures.filter("measure_description <> ''").select(
        F.lit("metric").alias("object_type"),
        F.col("measure_key").cast("string").alias("object_id"),
        F.col("measure_description").alias("definition_text"),
        F.lit("unknown").alias("comparability_status"),
        F.concat_ws(" ", "dataset_code", "measure_code").alias("source_reference"),
        F.lit("source").alias("metadata_origin"),
    )
    own = own.distinct()
    if stored is None:
        return own
    same = [F.col(f"n.{c}").eqNullSafe(F.col(f"s.{c}")) for c in ("object_type", "object_id", "definition_text")]
    reference = F.coalesce("n.source_reference", F.lit("")) == F.coalesce("s.source_reference", F.lit(""))
    return own.alias("n").join(stored.alias("s"), reduce(lambda a, b: a & b, [*same, reference]), "left_anti")


def lineage(table: str, key: Column, kind: str, provider: Column, dataset: Column, version: Column) -> Column:
    """Where an item comes from: its table and key, the data set and version behind it, and the layers between."""
    return F.struct(
        F.lit("gold").alias("trusted_layer"),
        provider.alias("source_provider"),
        dataset.alias("source_dataset_code"),
        version.cast("string").alias("source_dataset_version"),
        F.lit(table).alias("gold_table"),
        key.cast("string").alias("gold_primary_key"),
        F.lit(kind).alias("semantic_object"),
        F.array(*(F.lit(x) for x in LAYERS)).alias("derived_from_layers"),
    )


def _item(df: DataFrame, kind: str, table: str, key: str, title: str, subtitle: list[str], description: str | None, search: list[str], tags: list[str], lineage_kind: str, provider: str) -> DataFrame:
    col = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    text = lambda cols: F.concat_ws(" ", *(F.when(F.col(c) != "", F.col(c)) for c in cols))
    label = F.array_compact(F.array(F.lit(kind), *(col(t).cast("string") for t in tags)))
    return df.select(
        F.lit(kind).alias("object_type"),
        F.col(key).cast("string").alias("object_id"),
        F.col(title).alias("title"),
        F.concat_ws(" · ", *subtitle).alias("subtitle"),
        (F.col(description) if description else F.lit(None).cast("string")).alias("description"),
        text(search).alias("search_text"),
        col("dataset_code").alias("dataset_code"),
        col("measure_code").alias("measure_code"),
        col("geography_code").alias("geography_code"),
        col("unit_code").alias("unit_code"),
        label.alias("tags"),
        (_true("has_fact_data") if "has_fact_data" in df.columns else F.lit(None).cast("boolean")).alias("has_fact_data"),
        lineage(table, F.col(key), lineage_kind, F.coalesce(col("source_organization"), F.lit(provider)), col("dataset_code"), col("dataset_version")).alias("lineage"),
    )


def with_fact_data(dimension: DataFrame, facts: DataFrame, key: str, fact_key: str | None = None) -> DataFrame:
    """dimension with `has_fact_data`: whether a fact has its key. Keys are made distinct before they are joined, so no row is repeated."""
    have = facts.select(F.col(fact_key or key).alias(key)).distinct().withColumn("has_fact_data", F.lit(True))
    return dimension.join(have, key, "left").withColumn("has_fact_data", _true("has_fact_data"))


def items(datasets: DataFrame, measures: DataFrame, geographies: DataFrame, categories: DataFrame, provider: str) -> DataFrame:
    """Searchable items of four kinds in one shape, with the lineage of each; the unknown geography is left out.

    measures and categories may name data sets that do not exist; they are items all the same. Null and empty texts add nothing to search_text.
    """
    parts = [
        _item(datasets, "dataset", "dim_dataset", "dataset_key", "dataset_title", ["dataset_code"], "dataset_description", ["dataset_code", "dataset_title", "dataset_description"], ["domain_id"], "dataset", provider),
        _item(
            measures, "measure", "dim_measure", "measure_key", "measure_name", ["dataset_code", "unit_code"], "measure_description",
            ["measure_code", "measure_name", "measure_description", "unit_code"], ["value_type", "default_aggregation", "domain_id"], "metric", provider,
        ),
        _item(
            geographies.filter("geography_code <> 'UNKNOWN'"), "geography", "dim_geography", "geography_key", "geography_name", ["geography_type", "geography_code"], "geography_type",
            ["geography_code", "geography_name", "geography_type"], ["geography_type"], "geography", provider,
        ),
        _item(categories, "category", "dim_category", "category_key", "category_name", ["dataset_code", "dimension_code"], None, ["category_code", "category_name", "dimension_code", "dataset_code"], ["dimension_code", "domain_id"], "category", provider),
    ]
    return reduce(DataFrame.unionByName, parts)


#: Fields of a property that make its schema, in the order of their names, which is the order of the canonical text.
PROPERTY = ("datatype", "id", "key", "parentId", "position", "title", "type", "unit")


def property_hash(properties: Column) -> Column:
    """SHA-256 of the canonical JSON of an array of property structs, in the order of their keys (or ids): eight fields each, nulls included.

    Neither the order of the properties nor that of the struct's fields matters. A null or empty array is that of no properties.
    """
    whole = F.coalesce(properties, F.array())
    sortable = F.transform(whole, lambda p: F.struct(F.coalesce(p["key"], p["id"].cast("string"), F.lit("")).alias("by"), F.to_json(F.struct(*(p[c].alias(c) for c in PROPERTY)), {"ignoreNullFields": "false"}).alias("text")))
    return F.sha2(F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(sortable), lambda s: s["text"]), ","), F.lit("]")), 256)
