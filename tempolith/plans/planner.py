"""From questions in words to typed plans, frames and canonical queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# The words by which a question shows its type, the most telling first.
TYPE_PATTERNS = (
    ("analogical_transfer", r"^if .*(?:will|could|same happen)"),
    ("reason_of", r"reason|^(?!if ).*cause"),
    ("start_affecting", r"start(?:ed)? affecting"),
    ("temporal_count", r"how many|\bcount\b"),
    ("temporal_path_existence", r"path|reach"),
    ("first_occurrence", r"^(?=.*came (?:first|earlier|later|last)\b).*(?:first|earlier)"),
    ("last_occurrence", r"came (?:later|last)\b"),
    ("first_occurrence", r"^(?=.*earlier).*or"),
    ("last_occurrence", r"^(?=.*later).*or"),
    ("first_occurrence", r"^(?=.*(?:was |did )).*before"),
    ("first_occurrence", r"^when did.*(?:first|start)"),
    ("existence_in_time", r"^(?:was|did) "),
)


def question_type(text: Column) -> Column:
    """The type of the first pattern that a question shows, else that of a state at a time."""
    low, out = F.lower(F.trim(text)), F.lit("state_at_time")
    for kind, pattern in reversed(TYPE_PATTERNS):
        out = F.when(low.rlike(f"(?s){pattern}"), kind).otherwise(out)
    return out


def question_year(text: Column) -> Column:
    """The last year outside quotation marks, else the last year."""
    bare = F.regexp_replace(text, r"[‘’'\"]+.+?[‘’'\"]+", "")
    years = lambda t: F.regexp_extract_all(t, F.lit(r"\b(1\d{3}|2\d{3})\b"), F.lit(1))
    return F.coalesce(F.try_element_at(years(bare), F.lit(-1)), F.try_element_at(years(text), F.lit(-1))).cast("bigint")


def plan(questions: DataFrame) -> DataFrame:
    """(q_id, text) -> q_id, query_type, year, confidence."""
    return questions.select("q_id", question_type(F.col("text")).alias("query_type"), question_year(F.col("text")).alias("year"), F.lit(0.4).alias("confidence"))


def slot(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(value)), r"[^a-z0-9\-]+", "_"), r"^_+|_+$", "")


def canonical(frames: DataFrame) -> DataFrame:
    """(id, intent, a map of slots) -> id, query: the canonical text of each frame."""
    order = {
        "POINT": ["entity", "event"],
        "INTERVAL": ["entity", "start", "end"],
        "AGG": ["metric", "period", "region"],
        "COMPARE": ["metric", "period_a", "period_b"],
        "SEQUENCE": ["anchor", "direction"],
        "CAUSAL": ["cause", "effect"],
        "OVERLAP": ["a", "b"],
        "PREDICT": ["metric", "horizon"],
    }
    body = F.lit(None).cast("string")
    for intent, names in order.items():
        parts = F.array_compact(F.array(*[F.when(F.try_element_at("slots", F.lit(n)).isNotNull(), F.concat(F.lit(f"{n}='"), F.try_element_at("slots", F.lit(n)), F.lit("'"))) for n in names]))
        body = F.when(F.col("intent") == intent, F.concat(F.lit(f"{intent}("), F.array_join(parts, ", "), F.lit(")"))).otherwise(body)
    return frames.select("id", body.alias("query"))


def parse_slots(query: Column) -> Column:
    """The slots of a canonical query as a map."""
    keys = F.regexp_extract_all(query, F.lit(r"(\w+)='([^']*)'"), F.lit(1))
    values = F.regexp_extract_all(query, F.lit(r"(\w+)='([^']*)'"), F.lit(2))
    return F.map_from_arrays(keys, values)
