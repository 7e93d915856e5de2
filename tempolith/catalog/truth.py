"""Traces, beliefs and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import tms
from ..sources import projection as p
from .base import op


@op("SELECT query_id, string_agg(rule_id, ',' ORDER BY fired_us, event_id) AS rules FROM fired GROUP BY query_id", graph=True)
def op_a3_rules_fired(spark: SparkSession, d: str) -> DataFrame:
    return tms.rules_fired(p.traces(spark, d))


@op("""WITH r AS (SELECT DISTINCT rule_id FROM fired), q AS (SELECT DISTINCT query_id FROM fired)
SELECT q.query_id, r.rule_id, CASE WHEN EXISTS (SELECT 1 FROM fired f WHERE f.query_id = q.query_id AND f.rule_id = r.rule_id) THEN 'fired' ELSE 'absent in trace' END AS status FROM q CROSS JOIN r""", graph=True)
def op_a3_why_not(spark: SparkSession, d: str) -> DataFrame:
    t = p.traces(spark, d)
    # the rules are the kinds of event, a handful
    return tms.why_not(t, t.select("query_id").distinct().crossJoin(t.select("rule_id").distinct()))


@op("SELECT input_fact AS fact_id, count(*) AS n FROM fired WHERE input_fact <> '' GROUP BY input_fact ORDER BY n DESC, fact_id LIMIT 10", graph=True)
def op_a4_influential_facts(spark: SparkSession, d: str) -> DataFrame:
    return tms.influential_facts(p.traces(spark, d))


@op("SELECT user_id AS query_id, event_type AS fact_id, count(DISTINCT value) AS n_values, count(*) AS n_rules FROM events WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT value) > 1")
def op_a5_contradictions(spark: SparkSession, d: str) -> DataFrame:
    e = p.read(spark, d, "events").select(F.col("user_id").alias("query_id"), F.col("event_type").alias("fact_id"), "value")
    return tms.contradictions(e)


@op("SELECT a.rule_id AS producer, b.rule_id AS consumer, count(DISTINCT a.query_id) AS n_queries FROM fired a JOIN fired b ON a.query_id = b.query_id AND replace(a.fact_id, 'concl_', '') = replace(b.rule_id, 'rule_', '') GROUP BY 1, 2", graph=True)
def op_j13_rule_dependency(spark: SparkSession, d: str) -> DataFrame:
    return tms.dependencies(p.traces(spark, d))


@op("SELECT query_id, count(*) AS n_firings, (max(fired_us) - min(fired_us)) / 1000.0 AS duration_ms FROM fired GROUP BY query_id", graph=True)
def op_r5_trace_duration(spark: SparkSession, d: str) -> DataFrame:
    return tms.durations(p.traces(spark, d))


@op("""WITH walk AS (SELECT belief_id AS start_id, support_id AS belief_id, 1 AS depth FROM belief WHERE support_id IS NOT NULL
UNION ALL SELECT w.start_id, b.support_id, w.depth + 1 FROM walk w JOIN belief b ON b.belief_id = w.belief_id WHERE b.support_id IS NOT NULL AND w.depth < 32)
SELECT start_id, belief_id, min(depth) AS depth FROM walk GROUP BY start_id, belief_id""", graph=True)
def op_g5_support_chain(spark: SparkSession, d: str) -> DataFrame:
    b = p.beliefs(spark, d)
    return tms.support_chain(b, b.select("belief_id"))


@op("""WITH first AS (SELECT conv_id, min(turn) AS t FROM conversations GROUP BY conv_id), gone AS (SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(t + 1 AS VARCHAR) AS belief_id FROM first WHERE conv_id % 2 = 0),
walk AS (SELECT belief_id FROM gone UNION SELECT b.belief_id FROM walk w JOIN belief b ON b.support_id = w.belief_id WHERE b.status = 'active')
SELECT DISTINCT belief_id, CASE WHEN belief_id IN (SELECT belief_id FROM gone) THEN 'retracted' WHEN belief_id IN (SELECT belief_id FROM walk) THEN 'dirty' ELSE status END AS status FROM belief""", graph=True)
def op_g6_retract(spark: SparkSession, d: str) -> DataFrame:
    """Retract the second turn of every conversation with an even id."""
    b = p.beliefs(spark, d)
    first = p.read(spark, d, "conversations").groupBy("conv_id").agg(F.min("turn").alias("t")).where("conv_id % 2 = 0")
    return tms.retract(b, first.select(F.concat(F.col("conv_id").cast("string"), F.lit(":"), (F.col("t") + 1).cast("string")).alias("belief_id")))


@op("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def op_s14_latest(spark: SparkSession, d: str) -> DataFrame:
    return tms.latest(p.read(spark, d, "events"), "user_id", F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", "event_type")


@op("SELECT count(*) AS n, CAST(max(octet_length(encode(props))) AS BIGINT) AS max_bytes, round(avg(octet_length(encode(props))), 4) AS mean_bytes FROM events")
def op_a6_store_stats(spark: SparkSession, d: str) -> DataFrame:
    return tms.store_stats(p.read(spark, d, "events").select(F.col("props").alias("record")))


@op("SELECT event_id FROM events WHERE octet_length(encode(props)) <= 10000")
def op_k2_size_guard(spark: SparkSession, d: str) -> DataFrame:
    return tms.guarded(p.read(spark, d, "events").select("event_id", "props")).select("event_id")


@op("SELECT DISTINCT l_orderkey AS result_id FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1)")
def op_j16_staleness(spark: SparkSession, d: str) -> DataFrame:
    """Orders are results that depend on their parts; the parts of size 1 were touched."""
    results = p.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("result_id")).agg(F.collect_set("l_partkey").alias("facts"))
    touched = p.read(spark, d, "part").where("p_size = 1").select(F.col("p_partkey").alias("fact_id"))
    return tms.stale_results(results, touched)


@op("SELECT 'trig_high_' || CAST(event_id AS VARCHAR) AS query_id, 'high' AS rule, event_id AS context_id FROM events WHERE value > 90 UNION ALL SELECT 'trig_purchase_' || CAST(event_id AS VARCHAR), 'purchase', event_id FROM events WHERE event_type = 'purchase' AND value > 50")
def op_t1_triggers(spark: SparkSession, d: str) -> DataFrame:
    e = p.read(spark, d, "events").withColumn("context_id", F.col("event_id"))
    return tms.fire_triggers(e, {"high": "value > 90", "purchase": "event_type = 'purchase' and value > 50"})
