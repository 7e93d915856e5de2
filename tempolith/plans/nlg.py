"""Texts from facts: templates, routing, sentences, diagrams.

A fact is a row: id, fact_type and the fields of its kind (:data:`FACT`).  The
library's templates are a literal table keyed by kind, so rendering is one narrow
projection: rows multiply by the templates of their kind and nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import join_and, mermaid_id, readability, truncate, word_count
from .templates import GENERIC_DEFAULTS, LIBRARY, REQUIRED

FACT = (
    "id long, fact_type string, entity string, event string, date string, start_date string, end_date string, duration string, events array<string>, timestamps array<string>, "
    "time_span string, time_period string, cause string, effect string, mechanism string, certainty string, first string, second string, inner string, outer string, frequency string, count int"
)
_MONTH = "(?:January|February|March|April|May|June|July|August|September|October|November|December)"
#: Words that begin a predicate: auxiliaries, or four letters and more that end like a participle.
_PREDICATE = r"(?i)^(?:(?:was|were|is|are|has|have|had|did|does|do|will|would|can|could|shall|should|may|might|must)\b|\w{4,}(?:ed|ing)\b)"


def with_fields(facts: DataFrame) -> DataFrame:
    """``facts`` with every field of a fact, those it lacks null."""
    have = set(facts.columns)
    return facts.withColumns({name: F.lit(None).cast(kind) for name, kind in (x.split(" ") for x in FACT.split(", ")) if name not in have})


def preposition(date: Column) -> Column:
    """``in`` for years, months, quarters, centuries and years before or after Christ; ``on`` for all else."""
    d = F.trim(F.coalesce(date, F.lit("")))
    coarse = rf"(?i)^(?:\d{{4}}|\d{{4}}-\d{{2}}|{_MONTH}\s+\d{{4}}|q[1-4]\s*\d{{4}}|\d+(?:st|nd|rd|th)\s+century|\d+\s*(?:BCE|BC|CE|AD))$"
    return F.when(d.rlike(coarse), "in").otherwise("on")


def event_clause(entity: Column, event: Column) -> Column:
    """What happened, as a clause: with its subject, or as it is, or with a verb of its own."""
    who, what = F.trim(F.coalesce(entity, F.lit(""))), F.trim(F.coalesce(event, F.lit("")))
    return F.when(who != "", F.concat_ws(" ", who, what)).when(what.rlike(_PREDICATE), what).otherwise(F.concat(F.lit("the "), what, F.lit(" happened")))


def event_subject(entity: Column, event: Column) -> Column:
    """What lasted, as a subject."""
    who, what = F.trim(F.coalesce(entity, F.lit(""))), F.trim(F.coalesce(event, F.lit("")))
    return F.when(who != "", who).when((what != "") & ~what.rlike(_PREDICATE), F.concat(F.lit("the "), what)).otherwise(what)


def anchor_hint(parts: Column, most: int = 1) -> Column:
    """The first ``most`` (at least one) distinct parts, six words of each, joined by bars."""
    short = F.array_distinct(F.filter(F.transform(F.array_compact(parts), lambda p: truncate(p, 6)), lambda p: p != ""))
    return F.array_join(F.slice(short, 1, max(1, most)), " | ")


def missing_fields(facts: DataFrame) -> DataFrame:
    """id, missing: names of required fields that a fact lacks."""
    facts = with_fields(facts)
    return facts.select("id", F.array_join(_missing(), ",").alias("missing"))


def _missing() -> Column:
    out = F.array(F.lit("fact_type"))
    for kind, names in REQUIRED.items():
        lacks = F.array_compact(F.array(*[F.when(F.col(n).isNull() if n != "events" else F.coalesce(F.size("events") <= 0, F.lit(True)), F.lit(n)) for n in names]))
        out = F.when(F.col("fact_type") == kind, lacks).otherwise(out)
    return out


def _fill(text: Column, fields: dict[str, Column]) -> Column:
    for name, value in fields.items():
        text = F.replace(text, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return text


def _library_fields() -> dict[str, Column]:
    events = F.transform(F.coalesce("events", F.array().cast("array<string>")), lambda e: truncate(e, 12))
    n = F.size(events)
    # a sequence of one or two is made three long by repeating the last
    three = F.when(n < 3, F.concat(events, F.array_repeat(F.try_element_at(events, F.lit(-1)), 3 - n))).otherwise(events)
    sequence = F.col("fact_type") == "sequence"
    event, rest = F.coalesce("event", F.lit("")), F.slice(events, 2, F.greatest(n - 1, F.lit(0)))
    cut = lambda c: F.when(F.col("fact_type") == "causality", truncate(F.col(c), 12)).otherwise(F.col(c))
    fields = {
        "event_clause": event_clause(F.col("entity"), event), "event_subject": event_subject(F.col("entity"), event),
        "date_prep": preposition(F.col("date")), "start_prep": preposition(F.col("start_date")), "end_prep": preposition(F.col("end_date")),
        "duration": F.coalesce("duration", F.lit("this period")), "time_span": F.coalesce("time_span", F.lit("this time")),
        "event_count": F.when(sequence, F.size(three)).otherwise(n), "events_last": F.try_element_at(three, F.lit(-1)),
        "events_joined_with_and": join_and(three, ", and "), "events_joined_except_last": F.array_join(F.slice(three, 1, F.greatest(F.size(three) - 1, F.lit(0))), ", "),
        "events_joined": F.array_join(events, " and "), "first_event": F.try_element_at(events, F.lit(1)), "other_events_joined": F.array_join(rest, " and "),
        "cause": cut("cause"), "effect": cut("effect"),
    }
    fields |= {f"events_{k}": F.try_element_at(three, F.lit(k + 1)) for k in range(3)}
    return fields | {n: F.col(n) for n in ("date", "start_date", "end_date", "time_period", "first", "second", "inner", "outer", "frequency", "count", "entity", "event")}


def _hint(most: int) -> Column:
    kind, events = F.col("fact_type"), F.transform(F.coalesce("events", F.array().cast("array<string>")), lambda e: truncate(e, 12))
    last = F.when(F.size(events) > 1, F.element_at(events, -1))
    when = F.coalesce(F.when(kind == "overlap", F.col("time_period")), F.try_element_at("timestamps", F.lit(1)), F.col("time_span"))
    told = F.array(F.try_element_at(events, F.lit(1)), last, when)
    causes = F.array("cause", "effect", "certainty", "mechanism")
    return F.when(kind.isin("sequence", "overlap"), anchor_hint(told, most)).when(kind == "causality", anchor_hint(causes, most)).otherwise("")


def render(facts: DataFrame, anchors: int = 1, only: str | None = None) -> DataFrame:
    """Facts with all templates of their kind (or the template ``only``): id, fact_type, template,
    template_id, confidence, text, error.  A fact that lacks a field has an error and no text, as
    does one of an unknown kind.  ``anchors``: key facts named at the end."""
    facts = with_fields(facts)
    row = lambda k, t: F.struct(F.lit(k).alias("template"), F.lit(t[0]).alias("template_id"), F.lit(t[1]).alias("pattern"), F.lit(t[2] / 5.0).alias("confidence"))
    table = F.create_map(*[x for kind, ts in LIBRARY.items() for x in (F.lit(kind), F.array(*[row(k, t) for k, t in enumerate(ts)]))])
    fields = _library_fields()
    # a fact's fields are made once, before it meets its templates
    made = facts.select("id", "fact_type", *[v.cast("string").alias(f"f_{n}") for n, v in fields.items()], _hint(anchors).alias("hint"), F.array_join(_missing(), ",").alias("lacks"))
    rows = made.select("*", F.explode_outer(F.try_element_at(table, F.col("fact_type"))).alias("t"))
    if only:
        rows = rows.where(F.col("t.template_id") == only)
    rows = once(rows, raw=_fill(F.col("t.pattern"), {n: F.col(f"f_{n}") for n in fields}))
    raw, hint, ok = F.col("raw"), F.col("hint"), F.col("lacks") == ""
    # sentences of points and intervals begin with a capital
    text = F.when(F.col("fact_type").isin("point_in_time", "interval"), F.concat(F.upper(F.substring(raw, 1, 1)), F.substring(raw, 2, 1 << 30))).otherwise(raw)
    text = F.when(hint != "", F.concat(text, F.lit(" Key facts: "), hint, F.lit("."))).otherwise(text)
    return rows.select("id", "fact_type", "t.template", "t.template_id", "t.confidence", F.when(ok, text).alias("text"), F.when(~ok, F.concat(F.lit("missing "), "lacks")).alias("error"))


def first_template(facts: DataFrame) -> DataFrame:
    """id, fact_type, text, error by the first template of each kind; one row for each fact."""
    return render(facts).where(F.coalesce(F.col("template"), F.lit(0)) == 0).select("id", "fact_type", "text", "error")


def once(rows: DataFrame, **values: Column) -> DataFrame:
    """``rows`` with further columns that are computed once for each row, however often later ones use them:
    behind a generator Spark does not put their expressions in place of their names."""
    held = rows.select("*", F.explode(F.array(F.struct(*[v.alias(n) for n, v in values.items()]))).alias("_once"))
    return held.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.col(f"_once.{n}").alias(n) for n in values])


def readable(rendered: DataFrame) -> DataFrame:
    told = once(rendered.where("text is not null"), text_=F.col("text")).drop("text").withColumnRenamed("text_", "text")
    told = once(told, scores=readability(F.col("text")))
    return told.select(*rendered.columns, F.round("scores.flesch", 6).alias("flesch"), F.round("scores.density", 6).alias("density"))


def generic(facts: DataFrame, pattern: str) -> DataFrame:
    """id, text, error of one pattern of the user's own, in which fields that are not given have a
    default; a name that the fact's kind does not know is an error."""
    import re

    facts = with_fields(facts)
    names = set(re.findall(r"\{(\w+)\}", pattern))
    have = set(facts.columns)
    stamped = F.transform("events", lambda e, i: F.when(F.get("timestamps", i).isNotNull(), F.concat(e, F.lit(" ("), F.get("timestamps", i), F.lit(")"))).otherwise(e))
    text, error = F.lit(None).cast("string"), F.concat(F.lit("unsupported kind "), F.coalesce("fact_type", F.lit("")))
    for kind, defaults in GENERIC_DEFAULTS.items():
        fields = {n: F.coalesce(F.col(n).cast("string") if n in have and n != "events" else F.lit(None).cast("string"), F.lit(d)) for n, d in defaults.items()}
        if "events" in defaults:
            some = F.coalesce(F.size("events") > 0, F.lit(False))
            joined = F.array_join(stamped, ", then ") if kind == "sequence" else F.array_join("events", " and ")
            fields |= {"events": F.when(some, joined).otherwise(defaults["events"]), "event_count": F.when(some, F.size("events")).otherwise(0)}
        unknown = sorted(names - set(defaults))
        here = F.col("fact_type") == kind
        text = F.when(here, F.lit(None) if unknown else _fill(F.lit(pattern), fields)).otherwise(text)
        error = F.when(here, F.lit(f"missing {','.join(unknown)}" if unknown else None)).otherwise(error)
    return facts.select("id", text.alias("text"), error.alias("error"))


def format_list(items: Column) -> Column:
    return join_and(items, ", and ")


# --- choice of a template ----------------------------------------------------

# Words that support nothing.
_IDLE = ("the", "and", "for", "with", "from", "this", "that", "then", "when", "was", "were", "are", "is", "at", "of", "in", "to", "by", "on")


def content_tokens(text: Column) -> Column:
    """Distinct words of four letters and more."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z][a-z0-9_-]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda w: F.length(w) >= 4))


def content_years(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(1\d{3}|2\d{3})\b"), F.lit(1)))


def supported(fact: Column, text: Column) -> Column:
    """Does a text stand on its fact: a shared year if the fact has any, and two shared words (or all that it has)."""
    return _stands(content_tokens(fact), content_years(fact), content_tokens(text), content_years(text))


def _stands(own: Column, years: Column, words: Column, said: Column) -> Column:
    shared = F.size(F.array_intersect(own, F.array_except(words, F.array(*map(F.lit, _IDLE)))))
    return ((F.size(years) == 0) | F.arrays_overlap(years, said)) & (shared >= F.least(F.lit(2), F.size(own)))


def selector_confidence(text: Column, score: Column) -> Column:
    return F.when(word_count(text) < 25, 0.4).otherwise(0.2) + 0.6 * F.least(F.lit(1.0), score / 75)


def choices(facts: DataFrame) -> DataFrame:
    """Every template of every fact that gives more than five characters, with its score: readability,
    confidence, and whether words and years of the fact are in it; and whether the fact supports it."""
    facts = with_fields(facts)
    parts = [F.col(n) for n in ("entity", "event", "date", "start_date", "end_date", "duration", "time_span", "time_period", "cause", "effect", "mechanism", "certainty", "first", "second", "inner", "outer", "frequency")]
    told = F.concat_ws(" ", *parts, F.array_join(F.coalesce("events", F.array().cast("array<string>")), " "), F.array_join(F.coalesce("timestamps", F.array().cast("array<string>")), " "))
    of_fact = facts.select("id", content_tokens(told).alias("own"), content_years(told).alias("own_years"))
    rows = readable(render(facts)).where(F.length(F.trim("text")) > 5).join(of_fact, "id")
    rows = once(rows, words=content_tokens(F.col("text")), said=content_years(F.col("text")), sure=selector_confidence(F.col("text"), F.col("flesch")))
    bonus = F.when(F.arrays_overlap("own", "words"), 20.0).otherwise(0.0) + F.when(F.arrays_overlap("own_years", "said"), 5.0).otherwise(0.0)
    score = 0.8 * F.col("flesch") + 20 * F.col("sure") + bonus
    passes = _stands(F.col("own"), F.col("own_years"), F.col("words"), F.col("said"))
    return rows.select("id", "fact_type", "template", "template_id", "text", "flesch", F.round("sure", 6).alias("confidence"), F.round(score, 6).alias("score"), passes.alias("passes"))


def best_template(facts: DataFrame) -> DataFrame:
    """Of each fact the best scored template that the fact supports, or the best scored one if none is; ties to the first."""
    order = Window.partitionBy("id").orderBy(F.desc("passes"), F.desc("score"), "template")
    best = choices(facts).withColumn("_r", F.row_number().over(order)).where("_r = 1")
    return best.select("id", "template_id", "text", "flesch", "score", F.when(F.col("passes"), "template").otherwise("unsupported").alias("source"))


# --- routing -----------------------------------------------------------------


def strategy(facts: DataFrame) -> DataFrame:
    """id, complexity, strategy: template, polish or llm, by the number of dates, events and words of context."""
    facts = with_fields(facts)
    context = F.col("context") if "context" in facts.columns else F.lit("")
    full = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    n = (full("start_date") & full("end_date")).cast("int") + (F.length(F.coalesce(context, F.lit(""))) > 50).cast("int") + F.when(F.coalesce(F.size("events"), F.lit(0)) > 2, 2).otherwise(0)
    return facts.select("id", n.alias("complexity"), F.when(n == 0, "template").when(n <= 2, "polish").otherwise("llm").alias("strategy"))


def generate(facts: DataFrame, force: str | None = None, polish=None, write=None) -> DataFrame:
    """id, text, strategy, confidence, error.  ``polish`` (text to text) and ``write`` (fact to text) are
    columns' functions that stand for a language model; without them the template's text stays."""
    told = first_template(facts).join(strategy(facts), "id")
    want = F.lit({"polished": "polish"}.get(force, force)) if force else F.col("strategy")
    rows = told.join(with_fields(facts).select("id", F.struct(*[F.col(x.split(" ")[0]) for x in FACT.split(", ")]).alias("fact")), "id")
    done = F.when((want == "polish") & F.lit(polish is not None), "polished").when((want == "llm") & F.lit(write is not None), "llm").otherwise("template")
    text = F.col("text")
    if polish:
        text = F.when(done == "polished", polish(F.col("text"))).otherwise(text)
    if write:
        text = F.when(done == "llm", write(F.col("fact"))).otherwise(text)
    sure = F.when(done == "polished", 0.85).when(done == "llm", 0.7).otherwise(0.9)
    return rows.select("id", text.alias("text"), done.alias("strategy"), sure.alias("confidence"), "error")


def routing(quality: Column, confidence: Column) -> Column:
    """Polish a template's text of middling quality (0.4 to 0.7) where the choice is sure (above 0.7)."""
    polish = quality.between(0.4, 0.7) & (confidence > 0.7)
    return F.struct(polish.alias("polish"), F.least(quality, confidence).alias("confidence"), F.when(polish, F.least(F.lit(0.95), quality + 0.2)).otherwise(quality).alias("estimate"))


# --- sentences and diagrams --------------------------------------------------


def span(start: Column, end: Column) -> Column:
    """An edge's time at the end of its sentence."""
    return F.when(start.isNull(), "").when(start == end, F.concat(F.lit(" in "), start.cast("string"))).otherwise(F.concat(F.lit(" from "), start.cast("string"), F.lit(" to "), end.cast("string")))


def edge_sentence(edges: DataFrame) -> DataFrame:
    """Labelled edges as sentences."""
    text = F.concat("source_label", F.lit(" ["), "source_category", F.lit("] "), "relation", F.lit(" "), "target_label", F.lit(" ["), "target_category", F.lit("]"), span(F.col("start_year"), F.col("end_year")))
    return edges.select("edge_uid", text.alias("sentence"))


def fact_text(subject: Column, predicate: Column, obj: Column, timeframe: Column) -> Column:
    """``S P O``, and ``during T`` where there is a time."""
    base = F.concat_ws(" ", subject, predicate, obj)
    return F.when(F.coalesce(timeframe, F.lit("")) != "", F.concat(base, F.lit(" during "), timeframe)).otherwise(base)


def delta_text(fact: dict[str, Column], other: dict[str, Column]) -> Column:
    """What a counterfactual changes, part by part."""
    show = lambda c: F.concat(F.lit("'"), F.coalesce(c, F.lit("None")), F.lit("'"))
    parts = [F.when(~fact[n].eqNullSafe(other[n]), F.concat(F.lit(f"{n} changed from "), show(fact[n]), F.lit(" to "), show(other[n]))) for n in ("subject", "predicate", "object", "timeframe")]
    text = F.array_join(F.array_compact(F.array(*parts)), "; ")
    return F.when(text == "", "no change").otherwise(text)


def mermaid(edges: DataFrame, by: str, most: int = 12) -> DataFrame:
    """A diagram for each group: its first ``most`` edges by support."""
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("support_count"), "edge_uid"))
    line = F.concat(F.lit("  "), mermaid_id(F.col("source_label")), F.lit(" -->|"), "relation", F.lit("| "), mermaid_id(F.col("target_label")))
    rows = edges.withColumn("r", rank).where(F.col("r") <= most).select(by, F.struct("r", line.alias("line")).alias("x"))
    lines = F.transform(F.sort_array(F.collect_list("x")), lambda x: x["line"])
    return rows.groupBy(by).agg(F.concat(F.lit("graph TD\n"), F.array_join(lines, "\n")).alias("diagram"))
