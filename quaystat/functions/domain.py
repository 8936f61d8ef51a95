"""More rules of the statistical domain as Column expressions: dates, numbers, regions, codes, texts."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quaystat.functions.rules import first_match

FIRST_YEAR, LAST_YEAR = 1970, 2026
#: A range of years is filled in if it is no longer.
LONGEST_RANGE = 80


def safe_iso_date(text: Column) -> Column:
    """The date that the text begins with, as text; null if it begins otherwise."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10))


def safe_iso_timestamp(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text)


def dutch_number(text: Column) -> Column:
    """1.234,5 as a double: dots group, a comma is the decimal sign; null if that is no number."""
    return F.regexp_replace(F.regexp_replace(text, r"\.", ""), ",", ".").try_cast("double")


def percent_complete(part: Column, total: Column) -> Column:
    """At most 100, to two places; null without a positive total."""
    return F.when(total > 0, F.least(F.lit(100.0), F.round(part.cast("double") / total * 100, 2)))


def _marks() -> tuple[str, str]:
    """Letters with marks and their base letters, by decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))) for c in range(0xC0, 0x250)]
    pairs = [(a, "".join(x for x in b if not unicodedata.combining(x))) for a, b in pairs]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """Lower case, without marks, everything but letters and digits as one space, trimmed."""
    have, want = _marks()
    bare = F.regexp_replace(F.translate(text, have, want), r"[̀-ͯ]", "")
    return F.trim(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]+", " "))


def slug(text: Column, other: str = "metric") -> Column:
    """At most 48 of a-z, 0-9 and inner underscores."""
    s = F.substring(F.regexp_replace(F.regexp_replace(F.regexp_replace(folded(text), "[^a-z0-9]+", "_"), "^_+", ""), "_+$", ""), 1, 48)
    return F.when(s == "", other).otherwise(s)


def metric_code(dataset: Column, measure: Column, unit: Column, key: Column) -> Column:
    return F.substring(F.regexp_replace(folded(F.concat_ws(" ", F.lit("cbs"), dataset, measure, F.coalesce(unit, F.lit("")), key.cast("string"))), r"\s+", "_"), 1, 180)


def approved_aggregation(aggregation: Column, value_type: Column) -> Column:
    """The declared aggregation, but ratios and indices are never summed."""
    how = F.lower(F.coalesce(aggregation, F.lit("none")))
    ratio = F.lower(F.coalesce(value_type, F.lit(""))).isin("percentage", "index", "average", "median", "ratio")
    return F.when(ratio & (how == "sum"), "average").when(ratio & (how == ""), "average").when(how == "", "none").otherwise(how)


def safe_aggregation(configured: Column, name: Column, unit: Column, additive: Column) -> Column:
    """The configured aggregation, else one that the names of measure and unit allow."""
    how, n, u = F.lower(F.coalesce(configured, F.lit(""))), folded(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(unit, F.lit("")))
    has = lambda c, *words: reduce(lambda a, b: a | b, (F.contains(c, F.lit(w)) for w in words))
    return first_match(
        [
            (~how.isin("", "none", "unknown"), how),
            (has(n, "mediaan", "median"), "median"),
            (has(n, "gemiddeld", "average") | has(u, "percent"), "average"),
            (F.coalesce(additive, F.lit(False)) | has(u, "count", "aantal", "personen", "woningen"), "sum"),
        ],
        "none",
    )


def geography_level(key: Column, title: Column, description: Column) -> Column:
    """Level of a region value; null if it is not told."""
    k, t, d = F.upper(F.trim(F.coalesce(key, F.lit("")))), F.lower(F.trim(F.coalesce(title, F.lit("")))), F.lower(F.coalesce(description, F.lit("")))
    return first_match(
        [
            (k.isin("NL00", "NL01", "NL") | (t == "nederland"), "country"),
            (k.startswith("PV") | F.contains(d, F.lit("pv = provincie")) | F.contains(t, F.lit("(pv)")), "province"),
            (k.startswith("GM"), "municipality"),
            (k.startswith("WK") | k.startswith("BU"), "neighborhood"),
        ],
        F.lit(None).cast("string"),
    )


def record_level(dimension_level: Column, row_level: Column, code_level: Column) -> tuple[Column, Column]:
    """(level, evidence): the dimension is believed before the row, the row before the code."""
    return F.coalesce(dimension_level, row_level, code_level), first_match([(dimension_level.isNotNull(), "dimension"), (row_level.isNotNull(), "row"), (code_level.isNotNull(), "code")], "none")


def spatial_coverage(levels: Column) -> Column:
    """Label of an array of levels."""
    has = lambda *names: reduce(lambda a, b: a & b, (F.array_contains(levels, n) for n in names))
    return first_match(
        [
            (has("country", "municipality", "neighborhood"), "Netherlands — all municipalities, wijken and buurten"),
            (has("country", "province", "municipality"), "Netherlands — country, provinces and municipalities"),
            (has("province"), "Netherlands — provinces"),
            (has("municipality"), "Netherlands — municipalities"),
            (has("country"), "Netherlands — country"),
            (has("neighborhood"), "Netherlands — wijken and buurten"),
        ],
        F.lit(None).cast("string"),
    )


def is_geography_dimension(key: Column) -> Column:
    return F.lower(F.coalesce(key, F.lit(""))).rlike("regio|gebieden|gemeente|wijk|buurt")


def region_code_parts(key: Column, level: Column) -> tuple[Column, Column]:
    """(province code, municipality code); a neighbourhood's begins with its municipality's six characters."""
    k = F.upper(F.trim(F.coalesce(key, F.lit(""))))
    town = F.when((level == "municipality") & k.startswith("GM"), k).when((level == "neighborhood") & (k.startswith("WK") | k.startswith("BU")), F.substring(k, 1, 6))
    return F.when((level == "province") & k.startswith("PV"), k), town


def years_in_text(text: Column) -> Column:
    """Years that the text names, in its order; four digits of a longer number are no year."""
    found = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<!\d)((?:19|20)\d{2})(?!\d)"), F.lit(1)), lambda y: y.cast("int"))
    return F.filter(found, lambda y: y.between(FIRST_YEAR, LAST_YEAR))


def expanded_years(years: Column) -> Column:
    """All years between the first and the last, unless they are fewer than two or too far apart."""
    lo, hi = F.array_min(years), F.array_max(years)
    return F.when((F.size(years) < 2) | (hi - lo > LONGEST_RANGE), years).otherwise(F.sequence(lo, hi))


def period_of_date(number: Column) -> tuple[Column, Column]:
    """(first day, last day) of a day given as the number YYYYMMDD."""
    day = F.try_to_date(number.cast("string"), "yyyyMMdd") if hasattr(F, "try_to_date") else F.to_date(number.cast("string"), "yyyyMMdd")
    return day, day


def celsius(tenths: Column) -> Column:
    """Tenths of a degree to one place; -1 stands for nothing."""
    return F.when(tenths != -1, F.round(tenths) / 10)


def millimetres(tenths: Column) -> Column:
    """Tenths of a millimetre to one place; -1 stands for a trace, which is 0."""
    return F.when(tenths == -1, F.lit(0.0)).otherwise(F.round(tenths) / 10)


def share_percent(part: Column, total: Column) -> Column:
    return F.when(total != 0, F.round(part.cast("double") / total * 10_000) / 100)


def to_thousands(eur: Column) -> Column:
    return F.round(eur / 1000)


def year_bucket(name: Column, year: Column) -> Column:
    """Whether the year is in the range that the name tells: 'a tot b' without b, or 'vanaf a'."""
    n = folded(name)
    bound = lambda p, g: F.regexp_extract(n, p, g).try_cast("int")
    span = r"\b(1[0-9]{3}|20[0-9]{2})\s+tot\s+(1[0-9]{3}|20[0-9]{2})\b"
    since = r"\bvanaf\s+(1[0-9]{3}|20[0-9]{2})\b"
    return F.coalesce((year >= bound(span, 1)) & (year < bound(span, 2)), F.lit(False)) | F.coalesce(year >= bound(since, 1), F.lit(False))


def schema_hash(properties: Column) -> Column:
    """SHA-256 of an array of structs (key first) in the order of their keys, as JSON."""
    return F.sha2(F.to_json(F.array_sort(properties)), 256)


def indicator_flags(title: Column, unit: Column) -> tuple[Column, Column, Column, Column]:
    """(is_percentage, is_index, is_count, is_additive) by the words of title and unit."""
    text = F.lower(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(unit, F.lit(""))))
    percent, index = text.rlike("%|percentage|procent"), F.contains(text, F.lit("index"))
    count = text.rlike("aantal|number|personen|huishoudens|woningen|bedrijven")
    return percent, index, count, F.when(percent | index, F.lit(False)).when(count, F.lit(True))


def concept_tags(text: Column, rules: dict[str, str]) -> Column:
    """Names of the patterns that the text meets, in the order of the rules."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_compact(F.array(*(F.when(low.rlike(p), F.lit(tag)) for tag, p in rules.items())))


def hash_embedding(text: Column, slots: int = 64) -> Column:
    """A unit vector of `slots` numbers from the tokens of a text: each token's SHA-256 chooses 8 slots and signs.

    A choice is the number 2 * slot, plus 1 if it adds. All choices are sorted, with one more of each number: where a number begins tells how often each
    number before it was chosen, so that choices are not gone through one by one for each slot.
    """
    tokens = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    word = lambda h, k: F.conv(F.substring(h, 8 * k + 1, 8), 16, 10).cast("long")  # noqa: E731  bytes 4k to 4k + 3 of the hash
    byte = lambda w, k: F.shiftright(w, 24 - 8 * k).bitwiseAND(F.lit(255))
    choices = lambda p: F.array(*((byte(p["s"], k) % slots * 2 + F.when(byte(p["v"], k) >= 128, 0).otherwise(1)).cast("int") for k in range(4)))
    one = lambda h: F.array(*(F.struct(word(h, k).alias("s"), word(h, k + 2).alias("v")) for k in range(2)))
    pairs = F.flatten(F.transform(tokens, lambda t: _once(F.sha2(t, 256), one)))
    ordered = F.sort_array(F.concat(F.flatten(F.transform(pairs, choices)), F.sequence(F.lit(0), F.lit(2 * slots))))
    begins = _once(ordered, lambda o: F.transform(F.sequence(F.lit(0), F.lit(2 * slots)), lambda n: F.array_position(o, n)))
    total = _once(begins, lambda at: F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.get(at, 2 * i + 2) - 2 * F.get(at, 2 * i + 1) + F.get(at, 2 * i)))
    return _once(total, lambda v: _once(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), lambda n: F.transform(v, lambda x: F.round(x / F.when(n == 0, 1.0).otherwise(n), 6))))


def _once(value: Column, then) -> Column:
    """then(value) with the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))
