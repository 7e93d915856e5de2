"""Facts and questions from source records (id, time_scope, gold_facts: an array of
struct(subject, relation, object, value, start, end))."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.fidelity import bucket


def _full(value: Column) -> Column:
    return F.when(F.trim(F.coalesce(value, F.lit(""))) != "", value)


def event_phrase(f: Column) -> Column:
    """subject relation object; the value stands in for a missing object, or for everything."""
    return F.concat_ws(" ", *[F.trim(_full(f[c])) for c in ("subject", "relation")], F.trim(F.coalesce(_full(f["object"]), _full(f["value"]))))


def from_records(records: DataFrame) -> DataFrame:
    """One fact for each record of a known scope, with the fields of its kind."""
    f = F.try_element_at("gold_facts", F.lit(1))
    kind = bucket(F.col("time_scope"))
    only = lambda b, c: F.when(F.col("bucket") == b, c)
    some = lambda *names, default: F.coalesce(*[_full(f[n]) for n in names], F.lit(default))
    when = F.when(_full(f["start"]).isNotNull() & _full(f["end"]).isNotNull(), F.concat(f["start"], F.lit("–"), f["end"])).otherwise(some("start", "end", default=""))
    pair = F.array_compact(F.array(_full(f["subject"]), _full(f["object"])))
    steps = F.filter(F.transform("gold_facts", event_phrase), lambda x: x != "")
    is_one = F.col("bucket").isin("point", "interval")
    out = records.withColumn("bucket", kind).where(F.col("bucket") != "other").select(
        "id", F.when(F.col("bucket") == "point", "point_in_time").when(F.col("bucket") == "causal", "causality").otherwise(F.col("bucket")).alias("fact_type"),
        F.when(is_one, some("subject", "object", default="It")).alias("entity"), F.when(is_one, some("relation", default="occurred")).alias("event"), only("point", some("value", "start", "end", default="")).alias("date"),
        only("interval", some("start", "value", default="")).alias("start_date"), only("interval", some("end", "value", default="")).alias("end_date"),
        only("causal", some("subject", default="Event A")).alias("cause"), only("causal", some("object", "value", default="Event B")).alias("effect"),
        F.when(F.col("bucket") == "sequence", steps).when(F.col("bucket") == "overlap", F.when(F.size(pair) > 0, pair).otherwise(F.array(F.lit("Event A"), F.lit("Event B")))).alias("events"),
        only("sequence", F.transform("gold_facts", lambda g: F.coalesce(_full(g["start"]), _full(g["value"]), _full(g["end"]), F.lit("")))).alias("timestamps"), only("overlap", when).alias("time_period"),
    )
    return out.where(~((F.col("fact_type") == "sequence") & (F.size("events") == 0)))


PROMPTS = {
    "year": "Which year best matches the key time reference in the explanation?",
    "fill_blank": "Fill in the blank with an entity mentioned in the explanation: ________",
    "timeline": "List the events in chronological order (earliest to latest).",
    "inference": "Based on the explanation, what is the most plausible effect if the key cause did NOT happen?",
    "mcq": "Which statement is most consistent with the explanation?",
}
STATEMENTS = tuple(f"Statement {x} (author this)" for x in "ABCD")


def comprehension_questions(records: DataFrame, n: int = 4, seed: int = 7) -> DataFrame:
    """``n`` questions about each record: on its year, on an entity, on order or effect by scope, then general
    ones.  id, question_id, question_type, prompt, options, correct_answer.  Options are in an order that follows from the id."""
    facts = F.col("gold_facts")
    years = F.filter(F.flatten(F.transform(facts, lambda f: F.array(*[F.substring(f[c], 1, 4).try_cast("int") for c in ("start", "end")]))), lambda y: y.between(1000, 2999))
    names = F.filter(F.flatten(F.transform(facts, lambda f: F.array(f["subject"], f["object"], f["value"]))), lambda v: F.trim(F.coalesce(v, F.lit(""))) != "")
    year, name, scope = F.try_element_at(years, F.lit(1)), F.try_element_at(names, F.lit(1)), bucket(F.col("time_scope"))
    none = F.lit(None).cast("array<string>")
    near = F.transform(F.filter(F.array(*[year + k for k in (-5, -1, 0, 1, 5)]), lambda y: y.between(1000, 2999)), lambda y: y.cast("string"))
    dealt = F.transform(F.array_sort(F.transform(near, lambda y: F.struct(F.xxhash64(F.col("id").cast("string"), y, F.lit(seed)).alias("h"), y.alias("y")))), lambda x: x["y"])
    ask = lambda kind, prompt, options, answer: F.struct(F.lit(kind).alias("question_type"), F.lit(PROMPTS[prompt]).alias("prompt"), options.alias("options"), answer.cast("string").alias("correct_answer"))
    own = F.array_compact(F.array(
        F.when(year.isNotNull(), ask("mcq", "year", dealt, year)), F.when(name.isNotNull(), ask("fill_blank", "fill_blank", none, F.trim(name))),
        F.when(scope == "sequence", ask("timeline", "timeline", none, F.lit(None))), F.when(scope == "causal", ask("inference", "inference", none, F.lit(None))),
    ))
    general = F.array_repeat(ask("mcq", "mcq", F.array(*map(F.lit, STATEMENTS)), F.lit(STATEMENTS[0])), n)
    rows = records.select("id", F.posexplode(F.slice(F.concat(own, general), 1, n)).alias("k", "q"))
    return rows.select("id", F.concat(F.col("id").cast("string"), F.lit(".q"), F.lpad((F.col("k") + 1).cast("string"), 2, "0")).alias("question_id"), "q.*")
