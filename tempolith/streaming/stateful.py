"""Streaming forms of triggers, contradictions, sessions, staleness and graph append.

Rules of lateness are this library's own: ten minutes of watermark by default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import tms

LATE = "10 minutes"


def event_stream(spark, sf_dir: str, per_trigger: int = 1) -> DataFrame:
    """The event table as a stream; its times carry no zone in the files."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def triggers(contexts: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Stateless: a query record for each rule that a context meets."""
    return tms.fire_triggers(contexts, rules)


def contradictions(events: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """For each window, query and fact: more than one distinct value."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), F.col("user_id").alias("query_id"), F.col("event_type").alias("fact_id"))
    found = g.agg(F.collect_set("value").alias("values"), F.count(F.lit(1)).alias("n_rules"))
    return found.where(F.size("values") > 1).select(F.col("window.start").alias("window_start"), "query_id", "fact_id", F.size("values").alias("n_values"), "n_rules")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = LATE) -> DataFrame:
    """Trace sessions: firings of a query with no longer gap between them."""
    g = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), F.col("user_id").alias("query_id"))
    return g.agg(F.count(F.lit(1)).alias("n_firings")).select(F.col("session_window.start").alias("opened"), F.col("session_window.end").alias("closed"), "query_id", "n_firings")


def sampled(events: DataFrame, percent: int, number=None, key: str = "event_id") -> DataFrame:
    """A sample of firings that is the same in every run: those whose number from 0 to 99 (a hash of the key, unless
    ``number`` gives one) is below ``percent``."""
    return events.where((F.pmod(F.xxhash64(key), F.lit(100)) if number is None else number) < percent)


def new_edges(edges: DataFrame, late: str = LATE) -> DataFrame:
    """Each edge once, as long as the state remembers it."""
    return edges.withWatermark("ts", late).dropDuplicatesWithinWatermark(["edge_uid"])


def mark_stale(touched: DataFrame, results: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes the ids of results that a touched fact (fact_id) makes stale, batch by batch."""

    def batch(df: DataFrame, epoch: int) -> None:
        tms.stale_results(results, df).withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return touched.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Everything that is available, as a table."""
    q = stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)
