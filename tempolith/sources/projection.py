"""A temporal knowledge graph from the star-schema tables.

Regions, nations, customers, suppliers and parts are nodes; membership gives
undated edges, order lines give dated ones (one edge for each pair, from its
first to its last year, with a support count).  ``GRAPH_SQL`` states the same
as common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """node_uid, label, category."""

    def kind(name: str, prefix: str, key: str, label: str, category: str) -> DataFrame:
        t = read(spark, sf_dir, name)
        return t.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("node_uid"), F.col(label).alias("label"), F.lit(category).alias("category"))

    return (
        kind("region", "R", "r_regionkey", "r_name", "location")
        .unionByName(kind("nation", "N", "n_nationkey", "n_name", "location"))
        .unionByName(kind("customer", "C", "c_custkey", "c_name", "person"))
        .unionByName(kind("supplier", "S", "s_suppkey", "s_name", "org"))
        .unionByName(kind("part", "P", "p_partkey", "p_name", "product"))
    )


EDGE_COLUMNS = ["edge_uid", "source_uid", "target_uid", "relation", "start_year", "end_year", "edge_type", "support_count"]


def _uid():
    return F.concat_ws("|", "relation", "source_uid", "target_uid").alias("edge_uid")


def _plain(df: DataFrame, source, relation: str, target) -> DataFrame:
    none = F.lit(None).cast("bigint")
    out = df.select(
        source.alias("source_uid"), target.alias("target_uid"), F.lit(relation).alias("relation"), none.alias("start_year"), none.alias("end_year"),
        F.lit("gold_fact").alias("edge_type"), F.lit(1).cast("bigint").alias("support_count"),
    )
    return out.select(_uid(), *EDGE_COLUMNS[1:])


def _dated(df: DataFrame, source, relation: str, target, when, by: str | None = None) -> DataFrame:
    """With ``by`` (target_uid, say), lines are dealt by that end alone, so what joins edges by it finds them in place."""
    rows = df.select(source.alias("source_uid"), target.alias("target_uid"), F.year(when).cast("bigint").alias("y"))
    rows = rows.repartition(by) if by else rows
    out = rows.groupBy("source_uid", "target_uid").agg(F.min("y").alias("start_year"), F.max("y").alias("end_year"), F.count(F.lit(1)).alias("support_count"))
    return out.withColumn("relation", F.lit(relation)).withColumn("edge_type", F.lit("base")).select(_uid(), *EDGE_COLUMNS[1:])


def _key(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def membership_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        _plain(read(spark, sf_dir, "nation"), _key("N", "n_nationkey"), "part_of", _key("R", "n_regionkey"))
        .unionByName(_plain(read(spark, sf_dir, "customer"), _key("C", "c_custkey"), "located_in", _key("N", "c_nationkey")))
        .unionByName(_plain(read(spark, sf_dir, "supplier"), _key("S", "s_suppkey"), "located_in", _key("N", "s_nationkey")))
    )


def supplied_edges(spark: SparkSession, sf_dir: str, by: str | None = None) -> DataFrame:
    return _dated(read(spark, sf_dir, "lineitem"), _key("S", "l_suppkey"), "supplied", _key("P", "l_partkey"), F.col("l_shipdate"), by)


def caused_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the customer's nation to the part, for returned lines."""
    lines = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_partkey", "l_shipdate")
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"]).join(customers, orders["o_custkey"] == customers["c_custkey"])
    return _dated(joined, _key("N", "c_nationkey"), "caused", _key("P", "l_partkey"), F.col("l_shipdate"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return membership_edges(spark, sf_dir).unionByName(supplied_edges(spark, sf_dir)).unionByName(caused_edges(spark, sf_dir))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule firings from the event table: query_id, rule_id, fact_id, value, fired_at."""
    e = read(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").cast("string").alias("query_id"),
        F.concat(F.lit("rule_"), "event_type").alias("rule_id"),
        F.concat(F.lit("fact_"), F.regexp_extract("props", r"(\d+)", 1)).alias("input_fact"),
        F.concat(F.lit("concl_"), "event_type").alias("fact_id"),
        F.round("value", 1).cast("string").alias("value"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("fired_us"),
        "event_id",
    )


def beliefs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beliefs from conversations: each turn supports the next one."""
    c = read(spark, sf_dir, "conversations")
    uid = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit(":"), t.cast("string"))
    first = c.groupBy("conv_id").agg(F.min("turn").alias("first_turn"))
    joined = c.join(first, "conv_id")
    return joined.select(
        uid(F.col("turn")).alias("belief_id"),
        F.when(F.col("turn") > F.col("first_turn"), uid(F.col("turn") - 1)).alias("support_id"),
        F.lit("active").alias("status"),
        "conv_id", "turn", "role",
    )


GRAPH_SQL = """
tkg_nodes AS (
  SELECT 'R' || CAST(r_regionkey AS VARCHAR) AS node_uid, r_name AS label, 'location' AS category FROM region
  UNION ALL SELECT 'N' || CAST(n_nationkey AS VARCHAR), n_name, 'location' FROM nation
  UNION ALL SELECT 'C' || CAST(c_custkey AS VARCHAR), c_name, 'person' FROM customer
  UNION ALL SELECT 'S' || CAST(s_suppkey AS VARCHAR), s_name, 'org' FROM supplier
  UNION ALL SELECT 'P' || CAST(p_partkey AS VARCHAR), p_name, 'product' FROM part
), dated AS (
  SELECT 'S' || CAST(l_suppkey AS VARCHAR) AS source_uid, 'supplied' AS relation, 'P' || CAST(l_partkey AS VARCHAR) AS target_uid, year(l_shipdate) AS y FROM lineitem
  UNION ALL
  SELECT 'N' || CAST(c_nationkey AS VARCHAR), 'caused', 'P' || CAST(l_partkey AS VARCHAR), year(l_shipdate)
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey WHERE l_returnflag = 'R'
), tkg_edges AS (
  SELECT relation || '|' || source_uid || '|' || target_uid AS edge_uid, source_uid, target_uid, relation,
         CAST(min(y) AS BIGINT) AS start_year, CAST(max(y) AS BIGINT) AS end_year, 'base' AS edge_type, count(*) AS support_count
  FROM dated GROUP BY source_uid, target_uid, relation
  UNION ALL SELECT 'part_of|N' || CAST(n_nationkey AS VARCHAR) || '|R' || CAST(n_regionkey AS VARCHAR), 'N' || CAST(n_nationkey AS VARCHAR), 'R' || CAST(n_regionkey AS VARCHAR), 'part_of', NULL, NULL, 'gold_fact', 1 FROM nation
  UNION ALL SELECT 'located_in|C' || CAST(c_custkey AS VARCHAR) || '|N' || CAST(c_nationkey AS VARCHAR), 'C' || CAST(c_custkey AS VARCHAR), 'N' || CAST(c_nationkey AS VARCHAR), 'located_in', NULL, NULL, 'gold_fact', 1 FROM customer
  UNION ALL SELECT 'located_in|S' || CAST(s_suppkey AS VARCHAR) || '|N' || CAST(s_nationkey AS VARCHAR), 'S' || CAST(s_suppkey AS VARCHAR), 'N' || CAST(s_nationkey AS VARCHAR), 'located_in', NULL, NULL, 'gold_fact', 1 FROM supplier
), fired AS (
  SELECT CAST(user_id AS VARCHAR) AS query_id, 'rule_' || event_type AS rule_id, 'fact_' || regexp_extract(props, '([0-9]+)', 1) AS input_fact,
         'concl_' || event_type AS fact_id, CAST(round(value, 1) AS VARCHAR) AS value, epoch_us(ts) AS fired_us, event_id
  FROM events
), belief AS (
  SELECT CAST(conv_id AS VARCHAR) || ':' || CAST(turn AS VARCHAR) AS belief_id,
         CASE WHEN turn > min(turn) OVER (PARTITION BY conv_id) THEN CAST(conv_id AS VARCHAR) || ':' || CAST(turn - 1 AS VARCHAR) END AS support_id,
         'active' AS status, conv_id, turn, role
  FROM conversations
)
"""
