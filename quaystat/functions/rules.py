"""Rules of the statistical domain as Column expressions: keys, units, aggregation, periods, missing cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_hash(*parts: Column) -> Column:
    """SHA-256 of the parts joined by |, a null part being empty."""
    return F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)


def stable_key(*parts: Column) -> Column:
    """The first 60 bits of the hash as a long."""
    return F.conv(F.substring(stable_hash(*parts), 1, 15), 16, 10).cast("long")


def combination_hash(pairs: Column) -> Column:
    """Hash of an array of dim=code strings in any order; NO_CATEGORIES for an empty one."""
    return F.sha2(F.when(F.coalesce(F.size(pairs), F.lit(0)) == 0, F.lit("NO_CATEGORIES")).otherwise(F.array_join(F.array_sort(pairs), "|")), 256)


def first_match(rules: list[tuple[Column, str]], other: Column | str) -> Column:
    head, *rest = rules
    return reduce(lambda c, r: c.when(r[0], r[1]), rest, F.when(head[0], head[1])).otherwise(other)


#: Unit code and the texts that stand for it, in order of precedence.
UNIT_TEXTS: list[tuple[str, list[str]]] = [
    ("PERCENTAGE_POINTS", ["procentpunt", "percentage point"]),
    ("PERCENT", ["%", "percentage", "procent"]),
    ("EUR_MILLIONS", ["mln euro", "million euro"]),
    ("EUR_THOUSANDS", ["1 000 euro", "1000 euro", "eur1000", "x 1 000 euro"]),
    ("EUR", ["euro", "eur"]),
    ("INDEX", ["index"]),
    ("SQUARE_METERS", ["m²", "m2"]),
    ("CUBIC_METERS", ["m³", "m3"]),
    ("HOURS", ["uren", "hours"]),
    ("THOUSANDS", ["x 1 000", "1 000"]),
    ("PERSONS", ["personen", "people", "inwoners"]),
    ("HOUSEHOLDS", ["huishoudens"]),
    ("COUNT", ["aantal", "count", "number", "woningen", "bedrijven", "objecten"]),
]
#: Factors that bring a unit to its base.
SCALE = {"EUR_THOUSANDS": 1000, "EUR_MILLIONS": 1_000_000, "THOUSANDS": 1000}


def unit_code(unit: Column, measure_name: Column) -> Column:
    text = F.lower(F.concat_ws(" ", unit, measure_name))
    rules = [(F.coalesce(F.trim(unit), F.lit("")) == "", "UNKNOWN")]
    for code, texts in UNIT_TEXTS:
        hit = reduce(lambda a, b: a | b, (F.contains(text, F.lit(t)) for t in texts))
        rules.append((hit | text.rlike(r"\b\d{4}\s*=\s*100\b") if code == "INDEX" else hit, code))
    return first_match(rules, "UNKNOWN")


def scale_factor(code: Column) -> Column:
    return first_match([(code == u, F.lit(f)) for u, f in SCALE.items()], F.lit(1))


def default_aggregation(code: Column, measure_name: Column) -> Column:
    return first_match(
        [
            (code.isin("PERCENT", "PERCENTAGE_POINTS", "INDEX") | F.lower(measure_name).rlike("gemiddeld|average|mediaan|index"), "average"),
            (code.isin("COUNT", "PERSONS", "HOUSEHOLDS", "EUR", "EUR_THOUSANDS", "EUR_MILLIONS", "THOUSANDS"), "sum"),
        ],
        "none",
    )


def value_type(code: Column) -> Column:
    """Percentage points and thousands are plain decimals."""
    return first_match([(code == "PERCENT", "percentage"), (code.isin("EUR", "EUR_THOUSANDS", "EUR_MILLIONS"), "currency"), (code == "INDEX", "index"), (code.isin("COUNT", "PERSONS", "HOUSEHOLDS"), "count")], "decimal")


def geography_type(code: Column, declared: Column) -> Column:
    """The level that a region code names by its beginning, else the declared one; country if nothing is known."""
    c = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    d = F.lower(F.coalesce(declared, F.lit("unknown")))
    return first_match(
        [
            (c.isin("", "UNKNOWN", "TOTAAL", "TOTAL", "NL", "NL00", "NL01"), "country"),
            (c.startswith("PV"), "province"),
            (c.startswith("GM"), "municipality"),
            (c.startswith("WK") | c.startswith("BU"), "neighborhood"),
            (c.startswith("CR") | c.startswith("COROP"), "corop"),
            (c.startswith("LD"), "landsdeel"),
            (d.isin("", "country", "national", "totaal", "unknown"), "country"),
            (d.isin("other", "neighborhood", "region"), "region"),
        ],
        d,
    )


def level_order(kind: Column) -> Column:
    order = {"neighborhood": 0, "municipality": 1, "corop": 2, "region": 2, "province": 3, "landsdeel": 4, "country": 5}
    return first_match([(kind == k, F.lit(v)) for k, v in order.items()], F.lit(99))


def period_type(code: Column) -> Column:
    return first_match([(code.rlike(r"^\d{4}JJ|^\d{4}$"), "year"), (code.rlike(r"^\d{4}KW\d{2}"), "quarter"), (code.rlike(r"^\d{4}MM\d{2}"), "month"), (code.rlike(r"^\d{4}HJ\d{2}"), "half_year")], "other")


def period_bounds(code: Column) -> tuple[Column, Column]:
    """First and last day; nulls for years outside 1970-2026."""
    year = F.expr("try_cast(1 as int)") * F.substring(code, 1, 4).try_cast("int")
    nr = F.coalesce(F.regexp_extract(code, r"(?:MM|KW|HJ)(\d{2})", 1).try_cast("int"), F.lit(1))
    kind = period_type(code)
    months = first_match([(kind == "month", F.lit(1)), (kind == "quarter", F.lit(3)), (kind == "half_year", F.lit(6))], F.lit(12))
    first = F.when(year.between(1970, 2026), F.make_date(year, (nr - 1) * months + 1, F.lit(1)))
    return first, F.last_day(F.add_months(first, months - 1))


def missing_flags(value: Column, text: Column) -> tuple[Column, Column, Column]:
    """(is_missing, is_suppressed, status) of a measure cell."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    suppressed = t.isin("x", "geheim", "suppressed")
    missing = value.isNull() | t.isin("", ".") | suppressed
    return missing, suppressed, first_match([(suppressed, "suppressed"), (missing, "missing")], "reported")


def is_total(code: Column, name: Column) -> Column:
    text = F.lower(F.concat_ws(" ", code, name))
    return F.contains(text, F.lit("totaal")) | F.contains(text, F.lit("total"))


def relationship(r: Column, n: Column) -> tuple[Column, Column]:
    """(direction, strength) of a Pearson coefficient over n pairs, as a query reports it."""
    direction = first_match([(r.isNull(), "insufficient_data"), (r > 0, "positive"), (r < 0, "negative")], "none")
    return direction, F.when(r.isNull() | (n < 5), "insufficient_data").otherwise(_strength(r))


def relationship_profile(r: Column, n: Column) -> tuple[Column, Column, Column]:
    """(direction, strength, quality) as a profile stores them: a band of 0.05 round zero is no direction."""
    known = r.isNotNull() & ~F.isnan(r)
    a = F.abs(r)
    direction = first_match([(~known, "unknown"), (a < 0.05, "none"), (r > 0, "positive")], "negative")
    quality = first_match([(~known | (n < 20), "insufficient_observations"), (a >= 0.7, "strong_candidate"), (a >= 0.4, "moderate_candidate")], "profiled")
    return direction, F.when(~known, "insufficient_data").otherwise(_strength(r)), quality


def _strength(r: Column) -> Column:
    a = F.abs(r)
    return first_match([(a >= 0.7, "strong"), (a >= 0.4, "moderate"), (a >= 0.2, "weak")], "very_weak")
