"""Temporal expressions in texts: spans, types and normal forms.

Offsets and overlapping candidates have no form in SQL, so texts go through
Arrow batches; a text is handled on its own.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import map_batches

MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
DAYS = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
NUMBERS = {"a": 1, "an": 1, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10}
FUZZY = {"noon": "12:00", "midnight": "00:00", "morning": "MO", "afternoon": "AF", "evening": "EV", "night": "NI"}

_MONTH = r"(january|february|march|april|may|june|july|august|september|october|november|december)"
_DAY = r"(monday|tuesday|wednesday|thursday|friday|saturday|sunday)"
_UNIT = r"(years?|months?|weeks?|days?|hours?|hrs?|minutes?|mins?|seconds?|secs?)"
_COUNT = r"(\d+(?:\.\d+)?|an?|one|two|three|four|five|six|seven|eight|nine|ten)"


def _date(y: int, m: int, d: int) -> str | None:
    try:
        return dt.date(y, m, d).isoformat()
    except ValueError:
        return None


def _month(name: str) -> int:
    return MONTHS.index(name.lower()) + 1


def _clock(hour: str, minute: str | None, half: str | None) -> str | None:
    h, m = int(hour), int(minute or 0)
    if half:
        h = h % 12 + (12 if half.lower().startswith("p") else 0)
    return f"{h:02d}:{m:02d}" if h < 24 and m < 60 else None


def _shift(ref: dt.date, months: int) -> dt.date:
    """Months on or back; days beyond the month's end clamp to it."""
    k = ref.year * 12 + ref.month - 1 + months
    y, m = divmod(k, 12)
    last = (dt.date(y + (m == 11), (m + 1) % 12 + 1, 1) - dt.timedelta(1)).day
    return dt.date(y, m + 1, min(ref.day, last))


def _moved(ref: dt.date, n: int, unit: str) -> str:
    unit = unit.lower().rstrip("s")
    if unit in ("day", "week"):
        return (ref + dt.timedelta(n * (7 if unit == "week" else 1))).isoformat()
    return _shift(ref, n * (12 if unit == "year" else 1)).isoformat()


def _weekday(ref: dt.date, name: str, last: bool) -> str:
    k = DAYS.index(name.lower())
    away = (ref.weekday() - k) % 7 or 7 if last else (k - ref.weekday()) % 7 or 7
    return (ref + dt.timedelta(-away if last else away)).isoformat()


def _duration(text: str) -> str | None:
    """ISO 8601 of one or more counted units."""
    parts: dict[str, float] = {}
    for n, unit in re.findall(rf"{_COUNT}\s*-?\s*(years?|months?|weeks?|days?|hours?|hrs?|h|minutes?|mins?|m|seconds?|secs?|s)(?![a-z])", text, re.I):
        value = float(NUMBERS.get(n.lower(), 0) or n)
        u = unit.lower()
        key = {"y": "Y", "w": "W", "d": "D", "h": "H", "s": "S"}.get(u[0]) or ("Mo" if u.startswith("mo") else "Mi")
        parts[key] = parts.get(key, 0) + value
    show = lambda k: f"{parts[k]:g}{k[0]}" if k in parts else ""
    day, time = "".join(map(show, ("Y", "Mo", "W", "D"))), "".join(map(show, ("H", "Mi", "S")))
    return f"P{day}{'T' + time if time else ''}" if day or time else None


def _count(word: str) -> int:
    return int(float(NUMBERS.get(word.lower(), 0) or word))


Rule = tuple[str, re.Pattern, Callable[[re.Match, dt.date], "str | None"]]


def _rules() -> list[Rule]:
    def rule(kind: str, pattern: str, f: Callable) -> Rule:
        return kind, re.compile(pattern, re.I), f

    relative = {"today": 0, "tomorrow": 1, "yesterday": -1}
    at = r"(?:\s+at\s+(\d{1,2})(?::(\d{2}))?\s*(am|pm)?)?"

    def near(m: re.Match, ref: dt.date) -> str | None:
        day = (ref + dt.timedelta(relative[m[1].lower()])).isoformat()
        return f"{day}T{_clock(m[2], m[3], m[4])}" if m[2] else day

    return [
        rule("DATE", r"\b(\d{4}-\d{2}-\d{2})\s+(\d{2}:\d{2})\b", lambda m, r: f"{m[1]}T{m[2]}"),
        rule("DATE", r"\b(\d{4}-\d{2}-\d{2})\s*(?:/|to|-)\s*(\d{4}-\d{2}-\d{2})\b", lambda m, r: f"{m[1]}/{m[2]}"),
        rule("DATE", r"\b(\d{4})-(\d{2})-(\d{2})\b", lambda m, r: _date(int(m[1]), int(m[2]), int(m[3]))),
        rule("DATE", rf"\b{_MONTH}\s+(\d{{1,2}})\s*[-–]\s*(\d{{1,2}}),?\s+(\d{{4}})\b", lambda m, r: (a := _date(int(m[4]), _month(m[1]), int(m[2]))) and (b := _date(int(m[4]), _month(m[1]), int(m[3]))) and f"{a}/{b}"),
        rule("DATE", rf"\b{_MONTH}\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})\b", lambda m, r: _date(int(m[3]), _month(m[1]), int(m[2]))),
        rule("DATE", rf"\b{_MONTH}\s+(\d{{4}})\b", lambda m, r: f"{int(m[2]):04d}-{_month(m[1]):02d}"),
        rule("DATE", rf"\b(today|tomorrow|yesterday)\b{at}", near),
        rule("DATE", rf"\b(last|next)\s+{_DAY}\b", lambda m, r: _weekday(r, m[2], m[1].lower() == "last")),
        rule("DATE", r"\b(last|next)\s+(day|week|month|year)\b", lambda m, r: _moved(r, -1 if m[1].lower() == "last" else 1, m[2])),
        rule("DATE", rf"\b{_COUNT}\s+(days?|weeks?|months?|years?)\s+ago\b", lambda m, r: _moved(r, -_count(m[1]), m[2])),
        rule("DATE", rf"\bin\s+{_COUNT}\s+(days?|weeks?|months?|years?)\b", lambda m, r: _moved(r, _count(m[1]), m[2])),
        rule("SET", rf"\bevery\s+({_DAY}|day|week|month|year)\b", lambda m, r: f"every-{m[1].lower()}"),
        rule("SET", r"\b(once|twice|thrice)\s+an?\s+(day|week|month|year)\b", lambda m, r: f"{m[1].lower()}-a-{m[2].lower()}"),
        rule("TIME", r"\b(\d{1,2}):(\d{2})\s*(am|pm)?\b", lambda m, r: _clock(m[1], m[2], m[3])),
        rule("TIME", r"\b(\d{1,2})\s*(am|pm)\b", lambda m, r: _clock(m[1], None, m[2])),
        rule("TIME", r"\b(?:around\s+)?(noon|midnight)\b", lambda m, r: FUZZY[m[1].lower()]),
        rule("TIME", r"\bin the (morning|afternoon|evening)\b", lambda m, r: FUZZY[m[1].lower()]),
        rule("DURATION", rf"\b{_COUNT}[\s-]+{_UNIT}(?:(?:\s+and)?\s+{_COUNT}[\s-]+{_UNIT})*\b", lambda m, r: _duration(m[0])),
        rule("DURATION", r"\b(?:\d+h\s*\d+m(?:\s*\d+s)?|\d+h|\d+m\s*\d+s)\b", lambda m, r: _duration(m[0])),
        rule("DATE", r"\b(?:in|since|by|around|before|after|until)\s+(1\d{3}|2\d{3})\b", lambda m, r: m[1]),
    ]


RULES = _rules()


def tag(text: str, reference: dt.date) -> list[dict]:
    """Spans in page order, none overlapping: earlier ones first, of the same start the longest."""
    found = []
    for order, (kind, pattern, f) in enumerate(RULES):
        for m in pattern.finditer(text):
            found.append((m.start(), m.start() - m.end(), order, m.end(), kind, m[0], f(m, reference)))
    found.sort(key=lambda x: x[:3])
    out, end = [], 0
    for start, _, _, stop, kind, piece, value in found:
        if start >= end:
            out.append({"start": start, "end": stop, "text": piece, "type": kind, "value": value})
            end = stop
    return out


SPANS = "id long, start int, end int, text string, type string, value string"


def temporal_expressions(texts: DataFrame) -> DataFrame:
    """(id, text, reference date) -> a row for each expression."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text, ref in zip(pdf["id"], pdf["text"], pdf["reference"], strict=True):
                rows += [(i, s["start"], s["end"], s["text"], s["type"], s["value"]) for s in tag(text or "", ref)]
            yield pd.DataFrame(rows, columns=["id", "start", "end", "text", "type", "value"])

    return map_batches(texts.select(F.col("id").cast("long").alias("id"), "text", F.col("reference").cast("date").alias("reference")), run, SPANS)


def span_texts(text, spans):
    """Gold spans (struct start, end, type) with the text that they mark, as a column."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.coalesce(s["type"], F.lit("DATE")).alias("type"), F.substr(text, s["start"] + 1, s["end"] - s["start"]).alias("text")))


def normalise_one(text: str, reference: dt.date, kind: str | None = None) -> tuple[str | None, str, list[str]]:
    """(value, type, errors) of one expression: the first rule, of its kind if that is given and finds
    something, whose pattern it is as a whole, else the longest that is in it; an expression that no rule knows is an error."""
    best: tuple | None = None
    for order, (rule_kind, pattern, f) in enumerate(RULES):
        for m in pattern.finditer(text.strip()):
            value = f(m, reference)
            if value is not None:
                rank = (rule_kind != kind if kind else False, m.start() - m.end(), order)
                if best is None or rank < best[0]:
                    best = (rank, value, rule_kind)
    if best:
        return best[1], best[2], []
    fuzzy = FUZZY.get(text.strip().lower())
    return (fuzzy, "TIME", []) if fuzzy else (None, kind or "UNKNOWN", ["unhandled_expression"])


NORMAL = "id long, value string, type string, errors array<string>"


def normalise(expressions: DataFrame) -> DataFrame:
    """(id, text, type or null, reference) -> id, value, type, errors."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [normalise_one(t or "", r, k if isinstance(k, str) else None) for t, k, r in zip(pdf["text"], pdf["type"], pdf["reference"], strict=True)]
            yield pd.DataFrame({"id": pdf["id"], "value": [o[0] for o in out], "type": [o[1] for o in out], "errors": [o[2] for o in out]})

    return map_batches(expressions.select(F.col("id").cast("long").alias("id"), "text", "type", F.col("reference").cast("date").alias("reference")), run, NORMAL)


def mentions(texts: DataFrame) -> DataFrame:
    """(id, text, reference) -> id and what each text tells of time: dates, ranges (start/end), durations, years, each in order."""
    found = temporal_expressions(texts).where("value is not null")
    v = F.col("value")
    kind = F.when(v.startswith("P"), "duration").when(v.rlike(r"^\d{4}-\d{2}-\d{2}/\d{4}-\d{2}-\d{2}$"), "range").when(v.rlike(r"^\d{4}-\d{2}-\d{2}(?:T.*)?$"), "date")
    told = found.select("id", "start", kind.alias("kind"), v).where("kind is not null")
    of = lambda k: F.transform(F.array_sort(F.filter(F.collect_list(F.struct("start", "kind", "value")), lambda x: x["kind"] == k)), lambda x: x["value"]).alias(f"{k}s")
    grouped = told.groupBy("id").agg(of("date"), of("range"), of("duration"))
    years = F.transform(F.regexp_extract_all("text", F.lit(r"\b(1\d{3}|2\d{3})\b"), F.lit(1)), lambda y: y.cast("int"))
    none = F.array().cast("array<string>")
    full = texts.select("id", years.alias("years")).join(grouped, "id", "left")
    return full.select("id", *[F.coalesce(c, none).alias(c) for c in ("dates", "ranges", "durations")], F.coalesce("years", F.array().cast("array<int>")).alias("years"))
