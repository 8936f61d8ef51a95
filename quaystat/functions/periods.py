"""Periods of three kinds of sources as one struct, and levels of region codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaystat.functions.rules import first_match

#: Months of a period by its granularity.
MONTHS = {"annual": 12, "quarterly": 3, "monthly": 1}


def _struct(source: Column, year: Column, quarter: Column, month: Column, granularity: Column, start: Column, end: Column) -> Column:
    return F.struct(
        source.cast("string").alias("source_code"),
        year.alias("year"),
        quarter.alias("quarter"),
        month.alias("month"),
        granularity.alias("granularity"),
        start.alias("iso_start"),
        end.alias("iso_end"),
    )


def _first_day(year: Column, month: Column) -> Column:
    """The first of the month as text; null if there is no such year."""
    return F.when(year.isNotNull(), F.format_string("%04d-%02d-01", year, month))


def statistics_period(code: Column) -> Column:
    """YYYYJJ00, YYYYKW0n and YYYYMMnn as a struct; what is none of these is the year that it begins with.

    A quarter or month that does not exist counts as none of these. A code that does not begin with a year has neither year nor days;
    a null code has a granularity of null as well.
    """
    year = F.substring(code, 1, 4).try_cast("int")
    kind, part = F.upper(F.substring(code, 5, 2)), F.substring(code, 7, 10).try_cast("int")
    quarter = F.when((kind == "KW") & part.between(1, 4), part)
    month = F.when((kind == "MM") & part.between(1, 12), part)
    granularity = F.when(code.isNotNull(), first_match([(quarter.isNotNull(), "quarterly"), (month.isNotNull(), "monthly")], "annual"))
    first = F.coalesce(quarter * 3 - 2, month, F.lit(1))
    last = F.coalesce(quarter * 3, month, F.lit(12))
    end = F.last_day(_first_day(year, last).try_cast("date")).cast("string")
    return _struct(code, year, quarter, month, granularity, _first_day(year, first), end)


def valuation_period(day: Column) -> Column:
    """The year of a reference day given as YYYY-MM-DD: valuations hold for a whole year."""
    none = F.lit(None).cast("int")
    year = F.substring(day, 1, 4).try_cast("int")
    end = F.when(year.isNotNull(), F.format_string("%04d-12-31", year))
    return _struct(day, year, none, none, F.when(day.isNotNull(), "annual"), _first_day(year, F.lit(1)), end)


def climate_period(number: Column) -> Column:
    """The day of a number YYYYMMDD; a number that is no such day has neither year nor days."""
    day = F.try_to_timestamp(number.cast("string"), F.lit("yyyyMMdd")).cast("date")
    text = day.cast("string")
    return _struct(number, F.year(day), F.lit(None).cast("int"), F.month(day), F.when(number.isNotNull(), "daily"), text, text)


def code_level(code: Column) -> Column:
    """Level that a region code tells by how it begins; `other` if it tells none."""
    k = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    return first_match(
        [
            (k.isin("NL00", "NL01", "NL", "NEDERLAND"), "country"),
            (k.startswith("PV"), "province"),
            (k.startswith("GM"), "municipality"),
            (k.startswith("WK") | k.startswith("BU"), "neighborhood"),
        ],
        "other",
    )
