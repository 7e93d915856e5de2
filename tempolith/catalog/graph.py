"""Scans, predicates, joins and expansions on the projected graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.timefn import overlaps_year, within_range, year_priority
from ..operators import graph as g
from ..plans.nlg import edge_sentence, mermaid
from ..sources import projection as p
from ..vocabulary import CAUSAL, STRUCTURAL
from .base import op

OVERLAP = "(CASE WHEN start_year IS NOT NULL AND end_year IS NOT NULL THEN least(start_year, end_year) <= {y} AND {y} <= greatest(start_year, end_year) WHEN start_year IS NOT NULL THEN start_year = {y} WHEN end_year IS NOT NULL THEN end_year = {y} ELSE false END)"
IN_1998 = OVERLAP.format(y=1998)


@op("SELECT node_uid, label, CASE category WHEN 'person' THEN 'person' WHEN 'org' THEN 'org' WHEN 'location' THEN 'location' WHEN 'product' THEN 'product' ELSE 'concept' END AS category FROM tkg_nodes", graph=True)
def op_s3_scan_nodes(spark: SparkSession, d: str) -> DataFrame:
    return g.scan_nodes(p.nodes(spark, d))


@op("SELECT * FROM tkg_edges", graph=True)
def op_s4_scan_edges(spark: SparkSession, d: str) -> DataFrame:
    return g.scan_edges(p.edges(spark, d))


@op("SELECT lower(trim(label)) AS label_key, count(*) AS n_uids, min(node_uid) AS first_uid FROM tkg_nodes GROUP BY 1", graph=True)
def op_s5_label_map(spark: SparkSession, d: str) -> DataFrame:
    return p.nodes(spark, d).groupBy(F.lower(F.trim("label")).alias("label_key")).agg(F.count(F.lit(1)).alias("n_uids"), F.min("node_uid").alias("first_uid"))


@op(f"SELECT edge_uid, relation, start_year, end_year FROM tkg_edges WHERE {IN_1998}", graph=True)
def op_p3_overlaps_year(spark: SparkSession, d: str) -> DataFrame:
    return p.edges(spark, d).where(overlaps_year(F.col("start_year"), F.col("end_year"), F.lit(1998))).select("edge_uid", "relation", "start_year", "end_year")


@op("SELECT edge_uid FROM tkg_edges WHERE NOT (coalesce(coalesce(end_year, start_year) < 1996, false) OR coalesce(coalesce(start_year, end_year) > 1997, false))", graph=True)
def op_p4_range_filter(spark: SparkSession, d: str) -> DataFrame:
    return p.edges(spark, d).where(within_range(F.col("start_year"), F.col("end_year"), F.lit(1996), F.lit(1997))).select("edge_uid")


@op("SELECT DISTINCT edge_uid FROM tkg_edges WHERE source_uid IN (SELECT node_uid FROM tkg_nodes WHERE category = 'location') OR target_uid IN (SELECT node_uid FROM tkg_nodes WHERE category = 'location')", graph=True)
def op_p5_entity_membership(spark: SparkSession, d: str) -> DataFrame:
    seeds = p.nodes(spark, d).where("category = 'location'").select("node_uid")
    return g.incident(p.edges(spark, d), seeds).select("edge_uid").distinct()


@op("SELECT edge_uid, relation FROM tkg_edges WHERE contains(lower(relation), 'locat')", graph=True)
def op_p6_relation_hint(spark: SparkSession, d: str) -> DataFrame:
    return p.edges(spark, d).where(F.lower("relation").contains("locat")).select("edge_uid", "relation")


_STRUCT = ", ".join(f"'{x}'" for x in STRUCTURAL)
_CAUSE = ", ".join(f"'{x}'" for x in CAUSAL)


@op(f"SELECT relation, edge_type, count(*) AS n FROM tkg_edges WHERE relation NOT IN ({_STRUCT}) GROUP BY relation, edge_type", graph=True)
def op_p7_structural_exclusion(spark: SparkSession, d: str) -> DataFrame:
    return p.edges(spark, d).where(~F.col("relation").isin(*STRUCTURAL)).groupBy("relation", "edge_type").agg(F.count(F.lit(1)).alias("n"))


@op(f"SELECT edge_uid, relation, relation IN ({_CAUSE}) AS causal FROM tkg_edges", graph=True)
def op_p10_causal_predicate(spark: SparkSession, d: str) -> DataFrame:
    return p.edges(spark, d).select("edge_uid", "relation", F.col("relation").isin(*CAUSAL).alias("causal"))


@op("""SELECT edge_uid FROM (SELECT edge_uid, target_uid, end_year, count(*) FILTER (WHERE abs(start_year - 1997) <= 20) OVER (PARTITION BY target_uid) AS near, abs(start_year - 1997) <= 20 AS ok
FROM tkg_edges WHERE start_year IS NOT NULL) WHERE ok OR near < 3""", graph=True)
def op_p11_era_filter(spark: SparkSession, d: str) -> DataFrame:
    near = F.abs(F.col("start_year") - 1997) <= 20
    n = F.sum(near.cast("int")).over(Window.partitionBy("target_uid"))
    return p.edges(spark, d).where("start_year is not null").withColumn("n", n).where(near | (F.col("n") < 3)).select("edge_uid")


@op(f"SELECT edge_uid, CASE WHEN start_year IS NULL AND end_year IS NULL THEN 1 WHEN {IN_1998} THEN 0 WHEN least(abs(coalesce(start_year, end_year) - 1998), abs(coalesce(end_year, start_year) - 1998)) <= 1 THEN 2 ELSE 9 END AS priority FROM tkg_edges", graph=True)
def op_p14_year_priority(spark: SparkSession, d: str) -> DataFrame:
    return p.edges(spark, d).select("edge_uid", year_priority(F.col("start_year"), F.col("end_year"), 1998).alias("priority"))


@op("""SELECT e.edge_uid, s.label || ' [' || s.category || '] ' || e.relation || ' ' || t.label || ' [' || t.category || ']' ||
CASE WHEN start_year IS NULL THEN '' WHEN start_year = end_year THEN ' in ' || CAST(start_year AS VARCHAR) ELSE ' from ' || CAST(start_year AS VARCHAR) || ' to ' || CAST(end_year AS VARCHAR) END AS sentence
FROM tkg_edges e JOIN tkg_nodes s ON e.source_uid = s.node_uid JOIN tkg_nodes t ON e.target_uid = t.node_uid""", graph=True)
def op_p16_edge_sentence(spark: SparkSession, d: str) -> DataFrame:
    return edge_sentence(g.labelled(p.edges(spark, d), p.nodes(spark, d)))


@op("SELECT e.edge_uid, coalesce(s.label, e.source_uid) AS source_label, coalesce(t.label, e.target_uid) AS target_label FROM tkg_edges e LEFT JOIN tkg_nodes s ON e.source_uid = s.node_uid LEFT JOIN tkg_nodes t ON e.target_uid = t.node_uid", graph=True)
def op_j1_label_lookup(spark: SparkSession, d: str) -> DataFrame:
    return g.labelled(p.edges(spark, d), p.nodes(spark, d)).select("edge_uid", "source_label", "target_label")


@op("SELECT n.node_uid, (SELECT count(*) FROM tkg_edges e WHERE e.source_uid = n.node_uid) AS n_out, (SELECT count(*) FROM tkg_edges e WHERE e.target_uid = n.node_uid) AS n_in FROM tkg_nodes n", graph=True)
def op_j2_adjacency(spark: SparkSession, d: str) -> DataFrame:
    e = p.edges(spark, d)
    ends = e.select(F.explode(F.array(F.struct(F.col("source_uid").alias("node_uid"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("target_uid").alias("node_uid"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x"))
    deg = ends.groupBy("x.node_uid").agg(F.sum("x.o").alias("n_out"), F.sum("x.i").alias("n_in"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return p.nodes(spark, d).join(deg, "node_uid", "left").select("node_uid", zero("n_out"), zero("n_in"))


def _mentions(spark: SparkSession, d: str) -> DataFrame:
    parts = p.nodes(spark, d).where("category = 'product'")
    return parts.select(F.col("node_uid").alias("q_id"), F.upper("label").alias("mention"))


@op("""SELECT q_id, node_uid, label, rank FROM (SELECT q.node_uid AS q_id, n.node_uid, n.label, row_number() OVER (PARTITION BY q.node_uid ORDER BY n.node_uid) AS rank
FROM tkg_nodes q JOIN tkg_nodes n ON lower(trim(q.label)) = lower(trim(n.label)) WHERE q.category = 'product') WHERE rank <= 5""", graph=True)
def op_j3_exact_resolve(spark: SparkSession, d: str) -> DataFrame:
    return g.resolve(_mentions(spark, d), p.nodes(spark, d))


@op("""SELECT q_id, node_uid, label, rank FROM (SELECT q.q_id, n.node_uid, n.label, row_number() OVER (PARTITION BY q.q_id ORDER BY length(n.label), n.label, n.node_uid) AS rank
FROM (SELECT DISTINCT lower(split_part(label, ' ', 1)) AS q_id FROM tkg_nodes WHERE category = 'product') q JOIN tkg_nodes n
ON contains(' ' || lower(n.label) || ' ', ' ' || q.q_id || ' ')) WHERE rank <= 5""", graph=True)
def op_j4_substring_resolve(spark: SparkSession, d: str) -> DataFrame:
    words = p.nodes(spark, d).where("category = 'product'").select(F.lower(F.split_part("label", F.lit(" "), F.lit(1))).alias("q_id")).distinct()
    return g.resolve_by_part(words.withColumn("mention", F.col("q_id")), p.nodes(spark, d))


@op("""SELECT a.source_uid AS s, a.target_uid AS n, b.target_uid AS r FROM tkg_edges a JOIN tkg_edges b ON a.target_uid = b.source_uid AND a.relation = 'located_in' AND b.relation = 'part_of'""", graph=True)
def op_j7_pattern_match(spark: SparkSession, d: str) -> DataFrame:
    e = p.membership_edges(spark, d)
    return g.match_all(e, [{"source_uid": "$s", "relation": "located_in", "target_uid": "$n"}, {"source_uid": "$n", "relation": "part_of", "target_uid": "$r"}])


@op("SELECT DISTINCT 'supplies_region' AS relation, a.source_uid, b.target_uid FROM tkg_edges a JOIN tkg_edges b ON a.target_uid = b.source_uid AND a.relation = 'located_in' AND b.relation = 'part_of' WHERE a.source_uid LIKE 'S%'", graph=True)
def op_j8_transform(spark: SparkSession, d: str) -> DataFrame:
    out = op_j7_pattern_match(spark, d).where("s like 'S%'")
    return out.select(F.lit("supplies_region").alias("relation"), F.col("s").alias("source_uid"), F.col("r").alias("target_uid")).distinct()


@op("SELECT node_uid FROM tkg_nodes n WHERE category = 'product' AND NOT EXISTS (SELECT 1 FROM tkg_edges e WHERE e.target_uid = n.node_uid AND e.relation = 'caused')", graph=True)
def op_j15_uncovered(spark: SparkSession, d: str) -> DataFrame:
    n, c = p.nodes(spark, d).where("category = 'product'"), p.caused_edges(spark, d)
    return n.join(c, n["node_uid"] == c["target_uid"], "left_anti").select("node_uid")


@op("SELECT node_uid, count(*) AS degree FROM (SELECT source_uid AS node_uid FROM tkg_edges UNION ALL SELECT target_uid FROM tkg_edges) GROUP BY node_uid ORDER BY degree DESC, node_uid LIMIT 50", graph=True)
def op_a2_degree_top(spark: SparkSession, d: str) -> DataFrame:
    return g.degree(p.edges(spark, d)).orderBy(F.desc("degree"), "node_uid").limit(50)


@op("SELECT edge_type, relation, count(*) AS n, CAST(sum(support_count) AS BIGINT) AS support FROM tkg_edges GROUP BY edge_type, relation", graph=True)
def op_a26_build_report(spark: SparkSession, d: str) -> DataFrame:
    return p.edges(spark, d).groupBy("edge_type", "relation").agg(F.count(F.lit(1)).alias("n"), F.sum("support_count").alias("support"))


@op("""SELECT node_uid, edge_uid FROM (SELECT target_uid AS node_uid, edge_uid, row_number() OVER (PARTITION BY target_uid ORDER BY support_count DESC, edge_uid) AS r FROM tkg_edges) WHERE r <= 10""", graph=True)
def op_g1_one_hop(spark: SparkSession, d: str) -> DataFrame:
    e = p.edges(spark, d).select(F.col("target_uid").alias("node_uid"), "edge_uid", "support_count")
    return g.capped(e, ["node_uid"], [F.desc("support_count"), "edge_uid"], 10).select("node_uid", "edge_uid")


@op("""WITH seed AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_uid ORDER BY support_count DESC, edge_uid) AS r FROM tkg_edges WHERE relation = 'caused') WHERE r <= 5)
SELECT q_id, edge_uid FROM (SELECT s.source_uid AS q_id, e.edge_uid, row_number() OVER (PARTITION BY s.source_uid ORDER BY e.support_count DESC, e.edge_uid) AS r
FROM (SELECT DISTINCT source_uid, target_uid FROM seed) s JOIN tkg_edges e ON e.target_uid = s.target_uid AND e.source_uid <> s.source_uid) WHERE r <= 20""", graph=True)
def op_g2_two_hop(spark: SparkSession, d: str) -> DataFrame:
    e = p.edges(spark, d)
    seed = g.capped(p.caused_edges(spark, d), ["source_uid"], [F.desc("support_count"), "edge_uid"], 5).select(F.col("source_uid").alias("q_id"), "target_uid").distinct()
    more = e.join(seed, "target_uid").where("source_uid <> q_id")
    return g.capped(more, ["q_id"], [F.desc("support_count"), "edge_uid"], 20).select("q_id", "edge_uid")


@op("""WITH walk AS (SELECT source_uid AS start_uid, target_uid AS node_uid, 1 AS hops FROM tkg_edges WHERE relation IN ('located_in', 'part_of')
UNION ALL SELECT w.start_uid, e.target_uid, w.hops + 1 FROM walk w JOIN tkg_edges e ON e.source_uid = w.node_uid AND e.relation IN ('located_in', 'part_of') WHERE w.hops < 4)
SELECT start_uid, node_uid, min(hops) AS hops FROM walk GROUP BY start_uid, node_uid""", graph=True)
def op_g3_reach(spark: SparkSession, d: str) -> DataFrame:
    e = p.membership_edges(spark, d)
    return g.reach(e, e.select(F.col("source_uid").alias("node_uid")), 4)


@op("SELECT edge_uid, source_uid, y AS year, CASE WHEN start_year = end_year THEN 'within_year' ELSE 'spans_year' END AS relation FROM tkg_edges, unnest(generate_series(start_year, end_year)) AS t(y) WHERE start_year IS NOT NULL", graph=True)
def op_g14_year_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return g.year_hierarchy(p.edges(spark, d))


@op("""WITH l AS (SELECT DISTINCT label FROM tkg_nodes WHERE category = 'product'), w AS (SELECT DISTINCT split_part(label, ' ', 1) AS word FROM l), n AS (SELECT 'L:' || label AS uid, label FROM l UNION ALL SELECT 'W:' || word, word FROM w)
SELECT c.uid AS child_uid, q.uid AS parent_uid FROM n c JOIN n q ON starts_with(lower(c.label), lower(q.label) || ' ')""", graph=True)
def op_g15_entity_parents(spark: SparkSession, d: str) -> DataFrame:
    labels = p.nodes(spark, d).where("category = 'product'").select("label").distinct()
    words = labels.select(F.split_part("label", F.lit(" "), F.lit(1)).alias("label")).distinct()
    return g.entity_parents(labels.select(F.concat(F.lit("L:"), "label").alias("node_uid"), "label").unionByName(words.select(F.concat(F.lit("W:"), "label").alias("node_uid"), "label")))


@op("""WITH tags AS (SELECT DISTINCT p_type AS tag FROM part), tw AS (SELECT DISTINCT tag, lower(w) AS w FROM tags, unnest(string_split_regex(lower(tag), '[^a-z0-9]+')) AS t(w) WHERE length(w) >= 3),
nw AS (SELECT DISTINCT node_uid, w FROM tkg_nodes, unnest(string_split_regex(lower(trim(label)), '[^a-z0-9]+')) AS t(w) WHERE length(w) >= 3)
SELECT tag AS tag_uid, node_uid, count(*) AS shared FROM tw JOIN nw USING (w) GROUP BY tag, node_uid""", graph=True)
def op_g16_tag_relations(spark: SparkSession, d: str) -> DataFrame:
    tags = p.read(spark, d, "part").select(F.col("p_type").alias("tag")).distinct().withColumn("tag_uid", F.col("tag"))
    return g.tag_relations(tags, p.nodes(spark, d))


@op("""WITH bad AS (SELECT edge_uid, source_uid, CASE WHEN support_count % 3 = 0 THEN 'X' || target_uid ELSE target_uid END AS target_uid, CASE WHEN support_count % 2 = 0 THEN end_year + 1 ELSE start_year END AS start_year, end_year,
CASE WHEN support_count > 3 THEN -1 ELSE support_count END AS support_count FROM tkg_edges)
SELECT code, count(*) AS n FROM (SELECT 'edge_source_not_found' AS code FROM bad WHERE source_uid NOT IN (SELECT node_uid FROM tkg_nodes)
UNION ALL SELECT 'edge_target_not_found' FROM bad WHERE target_uid NOT IN (SELECT node_uid FROM tkg_nodes)
UNION ALL SELECT 'edge_interval_reversed' FROM bad WHERE start_year > end_year UNION ALL SELECT 'edge_negative_weight' FROM bad WHERE support_count < 0) GROUP BY code""", graph=True)
def op_g17_quality_checks(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("support_count")
    bad = p.edges(spark, d).withColumns({"target_uid": F.when(n % 3 == 0, F.concat(F.lit("X"), "target_uid")).otherwise(F.col("target_uid")), "start_year": F.when(n % 2 == 0, F.col("end_year") + 1).otherwise(F.col("start_year"))})
    bad = bad.withColumn("support_count", F.when(n > 3, F.lit(-1)).otherwise(n))
    return g.issues(bad, p.nodes(spark, d)).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@op("""WITH c AS (SELECT e.source_uid, e.edge_uid, '  ' || regexp_replace(s.label, '[^A-Za-z0-9_]', '_', 'g') || ' -->|' || relation || '| ' || regexp_replace(t.label, '[^A-Za-z0-9_]', '_', 'g') AS line, row_number() OVER (PARTITION BY e.source_uid ORDER BY support_count DESC, e.edge_uid) AS r
FROM tkg_edges e JOIN tkg_nodes s ON s.node_uid = e.source_uid JOIN tkg_nodes t ON t.node_uid = e.target_uid WHERE relation = 'caused') SELECT source_uid, 'graph TD' || chr(10) || string_agg(line, chr(10) ORDER BY r) AS diagram FROM c WHERE r <= 12 GROUP BY source_uid""", graph=True)
def op_k6_mermaid(spark: SparkSession, d: str) -> DataFrame:
    return mermaid(g.labelled(p.caused_edges(spark, d), p.nodes(spark, d)), "source_uid")
