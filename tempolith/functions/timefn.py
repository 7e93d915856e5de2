"""Temporal column functions.  Years are BIGINT: the data reach beyond DATE."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _year_of(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("bigint")


def parse_year(value: Column) -> Column:
    """The signed year of a plain year or of a full date; else null."""
    return F.when(value.rlike(r"^-?\d{1,12}$"), value.try_cast("bigint")).when(
        value.rlike(r"^-?\d{1,12}-\d{2}-\d{2}$"), _year_of(value, r"^(-?\d{1,12})-\d{2}-\d{2}$")
    )


def edge_year4(value: Column) -> Column:
    """The first four characters as a year, if all are digits."""
    return F.when(value.rlike(r"^\d{4}"), _year_of(value, r"^(\d{4})"))


def overlaps_year(start: Column, end: Column, year: Column) -> Column:
    """Closed intervals hold their years whichever way round; half-open ones are points; none at all holds nothing."""
    both = (F.least(start, end) <= year) & (year <= F.greatest(start, end))
    return F.when(start.isNotNull() & end.isNotNull(), both).when(start.isNotNull(), start == year).when(end.isNotNull(), end == year).otherwise(F.lit(False))


def within_range(start: Column, end: Column, first: Column, last: Column) -> Column:
    """False only for edges that are provably outside: undated ones stay."""
    lo, hi = F.coalesce(start, end), F.coalesce(end, start)
    return ~(F.coalesce(hi < first, F.lit(False)) | F.coalesce(lo > last, F.lit(False)))


def year_priority(start: Column, end: Column, year: int) -> Column:
    """0 holds the year, 1 undated, 2 at most a year away, 9 outside."""
    y = F.lit(year).cast("bigint")
    near = F.least(F.abs(F.coalesce(start, end) - y), F.abs(F.coalesce(end, start) - y)) <= 1
    return F.when(start.isNull() & end.isNull(), 1).when(overlaps_year(start, end, y), 0).when(near, 2).otherwise(9)


def parse_temporal(value: Column) -> Column:
    """Normal form of the time expressions that source records use.

    Year-months, quarters and halves become the first day; centuries the first
    day of their first year; "late 2010s" the eighth year; signed years lose
    leading zeros; timestamps become dates; present-like words ``PRESENT``.
    """
    v = F.trim(value)
    month = lambda y, m: F.concat(y, F.lit("-"), F.lpad(m.cast("string"), 2, "0"), F.lit("-01"))
    century = (F.regexp_extract(F.lower(v), r"^(\d{1,2})(?:st|nd|rd|th) century$", 1).try_cast("int") - 1) * 100 + 1
    decade = F.regexp_extract(F.lower(v), r"^(early|mid|late) (\d{3})0s$", 2)
    part = F.regexp_extract(F.lower(v), r"^(early|mid|late) \d{3}0s$", 1)
    return (
        F.when(v.rlike(r"^\d{4}-\d{2}$"), F.concat(v, F.lit("-01")))
        .when(v.rlike(r"^-?\d{1,12}$"), v.try_cast("bigint").cast("string"))
        .when(v.rlike(r"^-?\d{1,6}-\d{2}-\d{2}$"), v)
        .when(v.rlike(r"^\d{4}-\d{2}-\d{2}[T ]"), F.substring(v, 1, 10))
        .when(v.rlike(r"^\d{4}-[Qq][1-4]$"), month(F.substring(v, 1, 4), F.substring(v, 7, 1).try_cast("int") * 3 - 2))
        .when(v.rlike(r"^\d{4}-[Hh][12]$"), month(F.substring(v, 1, 4), F.substring(v, 7, 1).try_cast("int") * 6 - 5))
        .when(F.lower(v).rlike(r"^\d{1,2}(st|nd|rd|th) century$"), F.concat(F.lpad(century.cast("string"), 4, "0"), F.lit("-01-01")))
        .when(F.lower(v).rlike(r"^(early|mid|late) \d{3}0s$"), F.concat(decade, F.when(part == "early", "0").when(part == "mid", "5").otherwise("8"), F.lit("-01-01")))
        .when(F.lower(v).isin("present", "now", "recent years", "today", "ongoing", "current", "recent"), F.lit("PRESENT"))
    )


def years_in(text: Column) -> Column:
    """All years from 1000 to 2999 in a text, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"\b(1\d{3}|2\d{3})\b"), F.lit(1)), lambda y: y.cast("bigint"))


def clock(hour: Column, minute: Column, meridiem: Column) -> Column:
    """HH:MM of a clock reading with an optional am or pm."""
    h = F.when((F.lower(meridiem) == "pm") & (hour < 12), hour + 12).when((F.lower(meridiem) == "am") & (hour == 12), F.lit(0)).otherwise(hour)
    return F.concat(F.lpad(h.cast("string"), 2, "0"), F.lit(":"), F.lpad(F.coalesce(minute, F.lit(0)).cast("string"), 2, "0"))


def relative_date(reference: Column, phrase: Column) -> Column:
    """Days, weeks, months and years around a date; month ends clamp."""
    n = F.regexp_extract(phrase, r"(\d+)", 1).try_cast("int")
    back = phrase.rlike(r"ago$|^last")
    sign = F.when(back, -1).otherwise(1)
    size = sign * F.coalesce(n, F.lit(1))
    return (
        F.when(phrase == "today", reference)
        .when(phrase == "yesterday", F.date_add(reference, -1))
        .when(phrase == "tomorrow", F.date_add(reference, 1))
        .when(phrase.rlike(r"\bdays?\b"), F.date_add(reference, size))
        .when(phrase.rlike(r"\bweeks?\b"), F.date_add(reference, size * 7))
        .when(phrase.rlike(r"\bmonths?\b"), F.add_months(reference, size))
        .when(phrase.rlike(r"\byears?\b"), F.add_months(reference, size * 12))
    )


def weekday_date(reference: Column, weekday: Column, last: Column) -> Column:
    """The last or next given weekday (0 Monday), never the reference day itself."""
    behind = F.pmod(F.weekday(reference) - weekday, F.lit(7))
    ahead = F.pmod(weekday - F.weekday(reference), F.lit(7))
    return F.when(last, F.date_add(reference, -F.when(behind == 0, 7).otherwise(behind))).otherwise(F.date_add(reference, F.when(ahead == 0, 7).otherwise(ahead)))


def duration_days(iso: Column) -> Column:
    """Days of an ISO 8601 duration with years of 365 and months of 30 days; null if none."""
    day, clock_part = F.split_part(iso, F.lit("T"), F.lit(1)), F.split_part(iso, F.lit("T"), F.lit(2))

    def total(text: Column, weights: dict[str, float]) -> Column:
        out = F.lit(0.0)
        for unit, w in weights.items():
            found = F.regexp_extract_all(text, F.lit(rf"(\d+(?:\.\d+)?){unit}"), F.lit(1))
            out = out + F.aggregate(found, F.lit(0.0), lambda a, x: a + x.cast("double")) * w
        return out

    days = total(day, {"Y": 365.0, "M": 30.0, "W": 7.0, "D": 1.0}) + total(clock_part, {"H": 3600.0, "M": 60.0, "S": 1.0}) / 86400.0
    return F.when(iso.startswith("P") & (days > 0), days)


def date_tier(days: Column) -> Column:
    """How well two dates agree: within a day 1, within a week 0.8, else 0."""
    d = F.abs(days)
    return F.when(d <= 1, 1.0).when(d <= 7, 0.8).otherwise(0.0)
