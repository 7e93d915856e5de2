"""Truth maintenance: traces, beliefs, stores, triggers, staleness."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written

MAX_RECORD_BYTES = 10_000


def rules_fired(traces: DataFrame) -> DataFrame:
    """query_id, rules: the rules of each trace in order of firing."""
    order = F.sort_array(F.collect_list(F.struct("fired_us", "event_id", "rule_id")))
    return traces.groupBy("query_id").agg(F.array_join(F.transform(order, lambda x: x["rule_id"]), ",").alias("rules"))


def why_not(traces: DataFrame, expected: DataFrame) -> DataFrame:
    """(query_id, rule_id) expected -> whether each fired or is absent from the trace."""
    fired = traces.select("query_id", "rule_id").distinct().withColumn("hit", F.lit(True))
    return expected.join(fired, ["query_id", "rule_id"], "left").select("query_id", "rule_id", F.when(F.col("hit"), "fired").otherwise("absent in trace").alias("status"))


def influential_facts(traces: DataFrame, k: int = 10) -> DataFrame:
    counts = traces.where("input_fact <> ''").groupBy(F.col("input_fact").alias("fact_id")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "fact_id").limit(k)


def contradictions(traces: DataFrame) -> DataFrame:
    """query_id, fact_id with more than one distinct value."""
    out = traces.where("value is not null").groupBy("query_id", "fact_id").agg(F.countDistinct("value").alias("n_values"), F.count(F.lit(1)).alias("n_rules"))
    return out.where("n_values > 1")


def dependencies(traces: DataFrame) -> DataFrame:
    """Pairs of rules of a query where one concludes what the other takes in (equal keys), counted."""
    made = traces.select("query_id", F.col("rule_id").alias("producer"), F.regexp_replace("fact_id", "^concl_", "").alias("key")).distinct()
    used = traces.select("query_id", F.col("rule_id").alias("consumer"), F.regexp_replace("rule_id", "^rule_", "").alias("key")).distinct()
    return made.join(used, ["query_id", "key"]).groupBy("producer", "consumer").agg(F.countDistinct("query_id").alias("n_queries"))


def durations(traces: DataFrame) -> DataFrame:
    """query_id, n_firings, duration_ms: from the first to the last firing."""
    return traces.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_firings"), ((F.max("fired_us") - F.min("fired_us")) / 1000.0).alias("duration_ms"))


def support_chain(beliefs: DataFrame, starts: DataFrame, max_depth: int = 32) -> DataFrame:
    """start_id, belief_id, depth: all beliefs upstream, each at its least depth."""
    links = beliefs.where("support_id is not null").select(F.col("belief_id").alias("child"), "support_id").distinct()
    front = written(starts.select(F.col("belief_id").alias("start_id"), "belief_id").distinct(), "front")
    seen = front.withColumn("depth", F.lit(0))
    for depth in range(1, max_depth + 1):
        new = front.join(links, front["belief_id"] == links["child"]).select("start_id", F.col("support_id").alias("belief_id")).distinct()
        front = written(new.join(seen.select("start_id", "belief_id"), ["start_id", "belief_id"], "left_anti"), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front.withColumn("depth", F.lit(depth)))
    return seen.where("depth > 0")


def retract(beliefs: DataFrame, retracted: DataFrame, max_depth: int = 32) -> DataFrame:
    """belief_id, status after retraction: active dependants become dirty, and the
    cascade stops at beliefs that are not active."""
    links = beliefs.where("support_id is not null and status = 'active'").select("support_id", F.col("belief_id").alias("child")).distinct()
    front = written(retracted.select("belief_id").distinct(), "front")
    seen = front
    for _ in range(max_depth):
        new = front.join(links, front["belief_id"] == links["support_id"]).select(F.col("child").alias("belief_id")).distinct()
        front = written(new.join(seen, "belief_id", "left_anti"), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    dirty = seen.join(retracted.select("belief_id"), "belief_id", "left_anti").withColumn("new", F.lit("dirty"))
    gone = retracted.select("belief_id").distinct().withColumn("new", F.lit("retracted"))
    state = beliefs.select("belief_id", "status").distinct()
    return state.join(dirty.unionByName(gone), "belief_id", "left").select("belief_id", F.coalesce("new", "status").alias("status"))


def latest(log: DataFrame, key: str, *order) -> DataFrame:
    """Append logs: the last record of each key wins."""
    w = Window.partitionBy(key).orderBy(*order)
    return log.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def guarded(records: DataFrame, most: int = MAX_RECORD_BYTES) -> DataFrame:
    """Records that serialise to at most ``most`` bytes; a larger one is an error at run time."""
    size = F.octet_length(F.to_json(F.struct(*records.columns)))
    return records.where(F.when(size <= most, F.lit(True)).otherwise(F.raise_error(F.lit("record too large")).cast("boolean")))


def store_stats(log: DataFrame) -> DataFrame:
    size = F.octet_length(F.col("record"))
    return log.agg(F.count(F.lit(1)).alias("n"), F.max(size).cast("bigint").alias("max_bytes"), F.round(F.avg(size), 4).alias("mean_bytes"))


def stale_results(results: DataFrame, touched: DataFrame) -> DataFrame:
    """Results (result_id, facts array) -> those that depend on a touched fact (fact_id)."""
    deps = results.select("result_id", F.explode("facts").alias("fact_id"))
    return deps.join(touched.select("fact_id").distinct(), "fact_id", "left_semi").select("result_id").distinct()


def fire_triggers(contexts: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Contexts (context_id, ...) -> a query record for each rule whose SQL predicate holds."""
    out = None
    for rule, predicate in sorted(rules.items()):
        hit = contexts.where(predicate).select(F.concat(F.lit(f"trig_{rule}_"), F.col("context_id").cast("string")).alias("query_id"), F.lit(rule).alias("rule"), "context_id")
        out = hit if out is None else out.unionByName(hit)
    if out is None:
        raise ValueError("no trigger rules")
    return out


def justification_paths(firings: DataFrame, targets: DataFrame, max_depth: int = 6) -> DataFrame:
    """query_id, fact_id, path: the rules that lead back from a fact, nearest first.

    Firings are (query_id, rule_id, input_fact, fact_id); a rule is used once on
    a path; a path ends where no firing concludes its input, or at the depth.
    """
    made = firings.select("query_id", F.col("fact_id").alias("made"), "rule_id", "input_fact").distinct()
    front = targets.select("query_id", "fact_id").distinct().select("query_id", "fact_id", F.col("fact_id").alias("at"), F.array().cast("array<string>").alias("path"))
    done = None
    for _ in range(max_depth):
        step = front.join(made, "query_id").where((F.col("at") == F.col("made")) & ~F.array_contains("path", F.col("rule_id")))
        grown = written(step.select("query_id", "fact_id", F.col("input_fact").alias("at"), F.concat("path", F.array("rule_id")).alias("path")).distinct(), "paths")
        # what could not be prolonged is complete
        last = grown.join(made.select("query_id", F.col("made").alias("at"), F.col("rule_id").alias("next")), ["query_id", "at"], "left")
        open_ends = last.where(F.col("next").isNotNull() & ~F.array_contains("path", F.col("next"))).select("query_id", "fact_id", "at", "path").distinct()
        ended = grown.join(open_ends, ["query_id", "fact_id", "at", "path"], "left_anti")
        done = ended if done is None else done.unionByName(ended)
        front = written(open_ends, "open")
        if front.isEmpty():
            break
    out = done.unionByName(front).select("query_id", "fact_id", "path").distinct()
    return out.where(F.size("path") > 0)


def explain_fact(paths: DataFrame) -> DataFrame:
    """query_id, fact_id, text: the paths of each fact in words."""
    lines = F.sort_array(F.collect_set(F.array_join("path", " | ")))
    return paths.groupBy("query_id", "fact_id").agg(F.array_join(lines, " || ").alias("text"))


def upsert_claims(told: DataFrame) -> DataFrame:
    """claim_id, claim, confidence, evidence: of claims (claim_id, claim, confidence, evidence array, seq) the last
    wording and confidence, held to 0..1, and all evidence in the order in which it came."""
    sure = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    last = F.max_by(F.struct("claim", sure.alias("confidence")), "seq")
    grouped = told.groupBy("claim_id").agg(last.alias("l"), F.flatten(F.filter(F.transform(F.array_sort(F.collect_list(F.struct("seq", "evidence"))), lambda x: x["evidence"]), lambda e: e.isNotNull())).alias("evidence"))
    return grouped.select("claim_id", "l.claim", "l.confidence", "evidence")


def add_support(beliefs: DataFrame, supports: DataFrame) -> DataFrame:
    """Beliefs (belief_id, support_id, status) with further supports (belief_id, support_id), each once; a
    support of a belief that is not known is dropped."""
    state = beliefs.select("belief_id", "status").distinct()
    new = supports.join(state, "belief_id").select("belief_id", "support_id", "status")
    return beliefs.select("belief_id", "support_id", "status").unionByName(new).distinct()


def shifted(beliefs: DataFrame, delta: str) -> DataFrame:
    """Counterfactual beliefs (belief_id, payload map): each depends on the original and carries the shift."""
    payload = F.map_concat("payload", F.create_map(F.lit("counterfactual_time_shift"), F.lit(delta)))
    return beliefs.select(F.concat(F.lit("cf_"), "belief_id").alias("belief_id"), F.col("belief_id").alias("support_id"), payload.alias("payload"), F.lit("active").alias("status"))


def conclusions(traces: DataFrame) -> DataFrame:
    """query_id, fact_id: what a trace concluded, each once, in order of the first firing."""
    first = traces.groupBy("query_id", "fact_id").agg(F.min(F.struct("fired_us", "event_id")).alias("at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("at"))).select("query_id", "fact_id", "rank")


def with_changed_status(records: DataFrame, key: str, changed: DataFrame, status: str) -> DataFrame:
    """The records with a new status where their key is among the changed ones: what a rewritten store holds."""
    hit = changed.select(F.col(key)).distinct().withColumn("_hit", F.lit(True))
    return records.join(hit, key, "left").withColumn("status", F.when(F.col("_hit"), status).otherwise(F.col("status"))).drop("_hit")


def within_budget(firings: DataFrame, budget_ms: float) -> DataFrame:
    """Firings with the overhead that their query has spent up to them, and whether they are dropped for it."""
    order = Window.partitionBy("query_id").orderBy("fired_us", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    spent = firings.withColumn("spent_ms", F.sum("overhead_ms").over(order))
    return spent.withColumn("dropped", F.col("spent_ms") > budget_ms)


def listed(beliefs: DataFrame, status: str) -> DataFrame:
    """belief_id, status of the beliefs that have it."""
    return beliefs.where(F.col("status") == status).select("belief_id", "status").distinct()
