"""Streaming operators: each query runs a stream over all that is available and reads what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import fresh_path
from ..sources import projection as p
from ..streaming import stateful as st
from .base import op


def _run(spark: SparkSession, stream: DataFrame, tag: str) -> DataFrame:
    return st.run_to_end(stream, fresh_path(spark, tag), fresh_path(spark, f"{tag}-state"))


#: What the watermark lets a stream say: up to ten minutes before the last event.
_MARK = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@op("SELECT 'trig_high_' || CAST(event_id AS VARCHAR) AS query_id, 'high' AS rule, event_id AS context_id FROM events WHERE value > 90")
def op_t1_trigger_stream(spark: SparkSession, d: str) -> DataFrame:
    e = st.event_stream(spark, d).withColumn("context_id", F.col("event_id"))
    return _run(spark, st.triggers(e, {"high": "value > 90"}), "triggers")


@op("SELECT DISTINCT l_orderkey AS result_id FROM lineitem JOIN events ON l_partkey = event_id WHERE value > 95")
def op_t2_staleness_stream(spark: SparkSession, d: str) -> DataFrame:
    """Events with high values touch the part of their number; orders are results that depend on their parts."""
    touched = st.event_stream(spark, d).where("value > 95").select(F.col("event_id").alias("fact_id"))
    results = p.read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("result_id")).agg(F.collect_set("l_partkey").alias("facts"))
    path = fresh_path(spark, "stale")
    st.mark_stale(touched, results, path, fresh_path(spark, "stale-state")).awaitTermination()
    return spark.read.schema("result_id long").parquet(path).select("result_id").distinct()


@op("SELECT event_id, user_id FROM events WHERE event_id % 4 < 2")
def op_t3_sampled_capture(spark: SparkSession, d: str) -> DataFrame:
    """Half of the firings, the same half in every run; the rule of the sample is told in SQL's terms here."""
    e = st.event_stream(spark, d).select("event_id", "user_id")
    return _run(spark, st.sampled(e, 50, F.col("event_id") % 4 * 25), "sampled")


@op("SELECT event_id, CAST(sum(1.5) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS DOUBLE) AS spent_ms, sum(1.5) OVER (PARTITION BY user_id ORDER BY ts, event_id) > 30 AS dropped FROM events")
def op_t3_overhead_budget(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.tms import within_budget

    f = p.traces(spark, d).withColumn("overhead_ms", F.lit(1.5))
    return within_budget(f, 30.0).select("event_id", "spent_ms", "dropped")


@op(f"""WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
SELECT user_id AS query_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS opened, count(*) AS n_firings FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= {_MARK}""")
def op_t4_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that the watermark has closed."""
    out = _run(spark, st.sessions(st.event_stream(spark, d)), "sessions")
    return out.select("query_id", F.date_format("opened", "yyyy-MM-dd HH:mm:ss").alias("opened"), "n_firings")


@op(f"""WITH w AS (SELECT user_id AS query_id, event_type AS fact_id, date_trunc('hour', ts) AS h, value FROM events)
SELECT query_id, fact_id, strftime(h, '%Y-%m-%d %H') AS hour, CAST(count(DISTINCT value) AS INT) AS n_values, count(*) AS n_rules FROM w WHERE h + INTERVAL 1 HOUR <= {_MARK} GROUP BY query_id, fact_id, h HAVING count(DISTINCT value) > 1""")
def op_t5_window_contradictions(spark: SparkSession, d: str) -> DataFrame:
    """Windows that the watermark has passed."""
    out = _run(spark, st.contradictions(st.event_stream(spark, d)), "contradictions")
    return out.select("query_id", "fact_id", F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "n_values", "n_rules")


@op("SELECT 'e' || CAST(event_id AS VARCHAR) AS edge_uid, CAST(1 AS BIGINT) AS n FROM events")
def op_t6_append_stream(spark: SparkSession, d: str) -> DataFrame:
    """Every edge is told twice within the lateness that is allowed, and appended once."""
    e = st.event_stream(spark, d)
    twice = e.select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("edge_uid"), "ts", F.explode(F.array(F.lit(0), F.lit(1))).alias("again"))
    out = _run(spark, st.new_edges(twice.select("edge_uid", F.col("ts").alias("ts"))), "append")
    return out.groupBy("edge_uid").agg(F.count(F.lit(1)).alias("n"))
