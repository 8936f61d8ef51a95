"""Raw records of three kinds of sources to records in standard periods, regions and units, with their lineage.

A mapper is a table of fields: from it come both the projection and the lineage that is told with each record, so the two cannot
differ. Regions are named from a registry, which is a table (code, name, province, nuts3) and is joined once.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quaystat.functions import domain, periods

REGISTRY = "code string, name string, province string, nuts3 string"

# The municipalities and provinces that are known without a registry of one's own.
MUNICIPALITIES = [
    ("0363", "Amsterdam", "Noord-Holland", "NL321"),
    ("0344", "Utrecht", "Utrecht", "NL310"),
    ("0599", "Rotterdam", "Zuid-Holland", "NL333"),
    ("0518", "Den Haag", "Zuid-Holland", "NL332"),
    ("0772", "Eindhoven", "Noord-Brabant", "NL413"),
    ("0014", "Groningen", "Groningen", "NL111"),
    ("0358", "Almere", "Flevoland", "NL230"),
    ("0392", "Tilburg", "Noord-Brabant", "NL412"),
    ("0153", "Enschede", "Overijssel", "NL213"),
    ("0384", "Breda", "Noord-Brabant", "NL412"),
    ("0302", "Rozendaal", "Gelderland", "NL221"),
    ("0376", "Blaricum", "Noord-Holland", "NL327"),
    ("0629", "Wassenaar", "Zuid-Holland", "NL332"),
    ("0385", "Bloemendaal", "Noord-Holland", "NL326"),
    ("0090", "Schiermonnikoog", "Groningen", "NL112"),
    ("0296", "Wijchen", "Gelderland", "NL226"),
]
PROVINCES = [
    ("PV20", "Groningen"),
    ("PV21", "Fryslan"),
    ("PV22", "Drenthe"),
    ("PV23", "Overijssel"),
    ("PV24", "Flevoland"),
    ("PV25", "Gelderland"),
    ("PV26", "Utrecht"),
    ("PV27", "Noord-Holland"),
    ("PV28", "Zuid-Holland"),
    ("PV29", "Zeeland"),
    ("PV30", "Noord-Brabant"),
    ("PV31", "Limburg"),
]


@dataclass(frozen=True)
class Field:
    """A target field: its source, how its value follows from the source, and in which units both are."""

    source: str
    target: str
    rule: str = "direct copy"
    value: Callable[[Column], Column] = lambda c: c
    units: tuple[str, str] | None = None


@dataclass(frozen=True)
class Mapper:
    version: str
    fields: tuple[Field, ...]
    #: Target whose value names a region and is replaced by a struct, with how the registry is asked.
    region: str | None = None
    prefixed: bool = True


def _share(whole: str) -> Callable[[Column], Column]:
    return lambda part: domain.share_percent(part, F.col(whole))


STATISTICS = Mapper(
    "statistics@1.0.0",
    (
        Field("region_code", "region", "code to region by the registry"),
        Field("period_code", "period", "code to first and last day", periods.statistics_period),
        Field("inhabitants", "population"),
        Field("aged_65", "population_65_plus"),
        Field("aged_65", "pct_65_plus", "aged_65 / inhabitants * 100", _share("inhabitants"), ("count", "%")),
        Field("income", "avg_income_eur", units=("EUR", "EUR")),
        Field("home_value", "avg_home_value_eur", "multiply by 1000", lambda c: c * 1000, ("1000 EUR", "EUR")),
        Field("dwellings", "dwelling_count"),
        Field("density", "density_per_km2", units=("inhabitants/km2", "inhabitants/km2")),
    ),
    region="region",
)
VALUATIONS = Mapper(
    "valuations@1.0.0",
    (
        Field("municipality_code", "region", "four digits to region by the registry"),
        Field("reference_day", "assessment_date", "kept as it is"),
        Field("reference_day", "period", "day to its year", periods.valuation_period),
        Field("value", "value_eur", units=("EUR", "EUR")),
        Field("surface", "surface_m2", units=("m2", "m2")),
        Field("built", "construction_year"),
    ),
    region="region",
    prefixed=False,
)
CLIMATE = Mapper(
    "climate@1.0.0",
    (
        Field("station", "station_id"),
        Field("day", "period", "number YYYYMMDD to a day", periods.climate_period),
        Field("mean_temp", "mean_temp_c", "divide by 10; -1 is missing", domain.celsius, ("0.1 C", "C")),
        Field("max_temp", "max_temp_c", "divide by 10; -1 is missing", domain.celsius, ("0.1 C", "C")),
        Field("min_temp", "min_temp_c", "divide by 10; -1 is missing", domain.celsius, ("0.1 C", "C")),
        Field("rain", "precipitation_mm", "divide by 10; -1 is a trace and 0", domain.millimetres, ("0.1 mm", "mm")),
    ),
)


def default_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MUNICIPALITIES + [(code, name, None, None) for code, name in PROVINCES], REGISTRY)


def with_region(df: DataFrame, column: str, registry: DataFrame, prefixed: bool = True) -> DataFrame:
    """df with the code in `column` replaced by a struct (source_code, code, level, name, province, nuts3).

    prefixed: codes are trimmed, GM is taken off, and how they begin tells their level; otherwise they are municipalities as they are,
    and provinces of the registry are not asked. A code that the registry lacks gets a name that says so; a null code is a null struct. Of
    registry rows that share a code the smallest counts, so no record is repeated. Which side is broadcast follows from the sizes.
    """
    known = registry if prefixed else registry.filter(~F.col("code").startswith("PV"))
    known = known.groupBy(F.col("code").alias("__code")).agg(F.min(F.struct("name", "province", "nuts3")).alias("__known"))
    source = F.trim(F.col(column)) if prefixed else F.col(column)
    code = F.when(source.startswith("GM"), F.substring(source, 3, 100)).otherwise(source) if prefixed else source
    level = periods.code_level(source) if prefixed else F.lit("municipality")
    unknown = F.concat(F.lit("Unknown region (" if prefixed else "Unknown municipality ("), F.col("__code"), F.lit(")"))
    country = F.when(level == "country", "Nederland") if prefixed else F.lit(None).cast("string")
    joined = df.withColumn("__code", code).join(known, "__code", "left")
    region = F.struct(
        source.alias("source_code"),
        F.col("__code").alias("code"),
        level.alias("level"),
        F.coalesce("__known.name", country, unknown).alias("name"),
        F.col("__known.province").alias("province"),
        F.col("__known.nuts3").alias("nuts3"),
    )
    return joined.withColumn(column, F.when(F.col(column).isNotNull(), region)).select(*df.columns)


def _lineage(mapper: Mapper, provenance: Column) -> Column:
    text = lambda x: F.lit(x).cast("string")
    one = lambda f: F.struct(
        F.lit(f.source).alias("source_field"),
        F.lit(f.target).alias("target_field"),
        F.lit(f.rule).alias("transformation"),
        text(f.units and f.units[0]).alias("source_unit"),
        text(f.units and f.units[1]).alias("target_unit"),
    )
    derived = [f for f in mapper.fields if f.rule not in ("direct copy", "kept as it is")]
    return F.struct(
        provenance.alias("provenance"),
        F.array(*(one(f) for f in mapper.fields)).alias("field_mappings"),
        F.array(*(F.lit(f"{f.target}: {f.rule}") for f in derived)).alias("enrichments"),
        F.lit(mapper.version).alias("mapper_version"),
    )


def mapped(raw: DataFrame, mapper: Mapper, provenance: Column, registry: DataFrame | None = None) -> DataFrame:
    """The mapper's target fields of each raw record, and `lineage`; one projection, and one join if there is a region.

    provenance: what a record comes from, as an expression over raw. Null values stay null; columns that no field names are left out.
    """
    out = raw.select(*(f.value(F.col(f.source)).alias(f.target) for f in mapper.fields), _lineage(mapper, provenance).alias("lineage"))
    if mapper.region:
        out = with_region(out, mapper.region, registry if registry is not None else default_registry(raw.sparkSession), mapper.prefixed)
    return out
