"""Typed questions, asked of every entity at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import qa
from ..operators.graph import incident
from ..sources import projection as p
from .base import op
from .graph import IN_1998


@op(f"""SELECT q_id, rank, cause, edge_uid, support_count, start_year, end_year FROM (SELECT t.label AS q_id, s.label AS cause, e.edge_uid, e.support_count, e.start_year, e.end_year,
row_number() OVER (PARTITION BY t.label ORDER BY e.support_count DESC, e.edge_uid) AS rank
FROM tkg_edges e JOIN tkg_nodes t ON e.target_uid = t.node_uid JOIN tkg_nodes s ON e.source_uid = s.node_uid WHERE e.relation = 'caused' AND {IN_1998}) WHERE rank <= 5""", graph=True)
def op_g8_reason_of(spark: SparkSession, d: str) -> DataFrame:
    """Why did it happen to each product in 1998?"""
    labels = p.nodes(spark, d).where("category = 'product'").select("label").distinct()
    return qa.reason_of(labels.select(F.col("label").alias("q_id"), "label", F.lit(1998).alias("year")), p.caused_edges(spark, d), p.nodes(spark, d))


@op("""SELECT source_uid, target_uid, edge_uid, start_year AS year FROM (SELECT *, row_number() OVER (PARTITION BY source_uid, target_uid ORDER BY coalesce(start_year, 999999), support_count DESC, edge_uid) AS r FROM tkg_edges WHERE relation = 'caused') WHERE r = 1""", graph=True)
def op_g9_start_affecting(spark: SparkSession, d: str) -> DataFrame:
    return qa.start_affecting(p.edges(spark, d))


@op(f"""SELECT q_id, rank, edge_uid, support_count FROM (SELECT source_uid AS q_id, edge_uid, support_count, row_number() OVER (PARTITION BY source_uid ORDER BY support_count DESC, edge_uid) AS rank
FROM tkg_edges WHERE relation = 'supplied' AND {IN_1998}) WHERE rank <= 10""", graph=True)
def op_g10_state_at(spark: SparkSession, d: str) -> DataFrame:
    s = p.nodes(spark, d).where("category = 'org'")
    return qa.state_at(s.select(F.col("node_uid").alias("q_id"), "node_uid", F.lit(1998).alias("year")), p.edges(spark, d))


@op(f"""SELECT n.node_uid || '>' || q.node_uid AS q_id, count(e.edge_uid) > 0 AS holds, count(e.edge_uid) AS n_edges
FROM (SELECT node_uid FROM tkg_nodes WHERE node_uid LIKE 'N%') n CROSS JOIN (SELECT node_uid FROM tkg_nodes WHERE node_uid LIKE 'P%') q
LEFT JOIN (SELECT * FROM tkg_edges WHERE {IN_1998}) e ON e.source_uid = n.node_uid AND e.target_uid = q.node_uid GROUP BY n.node_uid, q.node_uid""", graph=True)
def op_g11_existence(spark: SparkSession, d: str) -> DataFrame:
    """For each nation (25 rows, fixed) and product: was there an effect in 1998?"""
    n = p.nodes(spark, d)
    nations = n.where("node_uid like 'N%'").select(F.col("node_uid").alias("a_uid"))
    products = n.where("category = 'product'").select(F.col("node_uid").alias("b_uid"))
    pairs = products.crossJoin(F.broadcast(nations)).select(F.concat_ws(">", "a_uid", "b_uid").alias("q_id"), "a_uid", "b_uid", F.lit(1998).alias("year"))
    return qa.existence(pairs, p.edges(spark, d))


_TOP = "SELECT *, row_number() OVER (PARTITION BY target_uid ORDER BY support_count DESC, edge_uid) AS r FROM tkg_edges WHERE start_year IS NOT NULL"


@op(f"SELECT target_uid, edge_uid, start_year AS year FROM (SELECT *, row_number() OVER (PARTITION BY target_uid ORDER BY start_year, support_count DESC, edge_uid) AS o FROM ({_TOP}) WHERE r <= 10) WHERE o = 1", graph=True)
def op_w7_first_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return qa.occurrence(p.edges(spark, d))


@op(f"SELECT target_uid, edge_uid, coalesce(end_year, start_year) AS year FROM (SELECT *, row_number() OVER (PARTITION BY target_uid ORDER BY coalesce(end_year, start_year) DESC, support_count DESC, edge_uid) AS o FROM ({_TOP}) WHERE r <= 10) WHERE o = 1", graph=True)
def op_w7_last_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return qa.occurrence(p.edges(spark, d), first=False)


@op("""WITH ends AS (SELECT source_uid AS uid, start_year, support_count, edge_uid FROM tkg_edges WHERE start_year IS NOT NULL UNION ALL SELECT target_uid, start_year, support_count, edge_uid FROM tkg_edges WHERE start_year IS NOT NULL),
best AS (SELECT uid, start_year AS y FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY support_count DESC, edge_uid) AS r FROM ends) WHERE r = 1),
pairs AS (SELECT p_partkey AS q_id, 'P' || CAST(p_partkey AS VARCHAR) AS a_uid, 'P' || CAST(p_partkey + 1 AS VARCHAR) AS b_uid FROM part)
SELECT q_id, a.y AS a_year, b.y AS b_year, CASE WHEN a.y < b.y THEN 'a' WHEN b.y < a.y THEN 'b' WHEN a.y = b.y THEN 'same' ELSE 'unknown' END AS earlier
FROM pairs LEFT JOIN best a ON a.uid = a_uid LEFT JOIN best b ON b.uid = b_uid""", graph=True)
def op_w8_ordering(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    pairs = p.read(spark, d, "part").select(k.alias("q_id"), F.concat(F.lit("P"), k.cast("string")).alias("a_uid"), F.concat(F.lit("P"), (k + 1).cast("string")).alias("b_uid"))
    return qa.ordering(pairs, p.edges(spark, d))


@op(f"SELECT relation, count(DISTINCT edge_uid) AS n FROM tkg_edges WHERE {IN_1998} GROUP BY relation", graph=True)
def op_a1_count_triples(spark: SparkSession, d: str) -> DataFrame:
    return qa.count_triples(p.edges(spark, d), 1998)


@op(f"""SELECT source_uid, relation, b_uid, c_uid, support_count FROM (SELECT a.source_uid, a.relation, a.target_uid AS b_uid, c.target_uid AS c_uid, c.support_count,
row_number() OVER (PARTITION BY a.source_uid, a.relation, a.target_uid ORDER BY c.support_count DESC, c.target_uid) AS r
FROM (SELECT * FROM tkg_edges WHERE {IN_1998}) a JOIN tkg_edges c ON c.source_uid = a.source_uid AND c.relation = a.relation AND c.target_uid <> a.target_uid) WHERE r = 1""", graph=True)
def op_j6_analogical(spark: SparkSession, d: str) -> DataFrame:
    return qa.analogical(p.edges(spark, d), 1998)


@op("""WITH t AS (SELECT 'N' || CAST(c_nationkey AS VARCHAR) AS role, 'C' || CAST(o_custkey AS VARCHAR) AS holder, min(o_orderdate) AS s, max(o_orderdate) AS e FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
terms AS (SELECT role, holder, CAST(epoch(s) // 86400 AS BIGINT) AS start_year, CAST(epoch(e) // 86400 AS BIGINT) AS end_year FROM t)
SELECT role, holder AS anchor, start_year, (SELECT max({'y': b.end_year, 'holder': b.holder}).holder FROM terms b WHERE b.role = a.role AND b.end_year <= a.start_year) AS predecessor,
(SELECT min({'y': b.start_year, 'holder': b.holder}).holder FROM terms b WHERE b.role = a.role AND b.start_year > a.start_year) AS successor FROM terms a""")
def op_j18_as_of(spark: SparkSession, d: str) -> DataFrame:
    o, c = p.read(spark, d, "orders"), p.read(spark, d, "customer")
    day = lambda x: F.datediff(x, F.lit("1970-01-01").cast("date")).cast("bigint")
    terms = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("role"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("holder"))
    terms = terms.agg(day(F.min("o_orderdate")).alias("start_year"), day(F.max("o_orderdate")).alias("end_year"))
    return qa.as_of(terms, terms)


@op(f"SELECT source_uid, edge_uid, CASE WHEN edge_type IN ('base', 'gold_fact') THEN 0 ELSE 1 END AS tier FROM tkg_edges e WHERE {IN_1998}", graph=True)
def op_p8_tiers(spark: SparkSession, d: str) -> DataFrame:
    from ..functions.timefn import overlaps_year

    held = p.edges(spark, d).where(overlaps_year(F.col("start_year"), F.col("end_year"), F.lit(1998)))
    return qa.tiered(held, ["source_uid"]).select("source_uid", "edge_uid", "tier")


@op("SELECT node_uid, relation, count(*) AS n FROM (SELECT source_uid AS node_uid, relation FROM tkg_edges UNION ALL SELECT target_uid, relation FROM tkg_edges) WHERE node_uid LIKE 'N%' GROUP BY node_uid, relation", graph=True)
def op_j5_incident_counts(spark: SparkSession, d: str) -> DataFrame:
    seeds = p.nodes(spark, d).where("node_uid like 'N%'").select("node_uid")
    return incident(p.edges(spark, d), seeds).groupBy("node_uid", "relation").agg(F.count(F.lit(1)).alias("n"))
