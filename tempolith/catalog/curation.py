"""Curated evidence, targeted and semantic search, typed dispatch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import computed as co
from ..operators import dispatch
from ..operators import evidence as ev
from ..operators import graph as g
from ..operators import retrieval as r
from ..operators import search
from ..sources import projection as p
from .base import op
from .graph import IN_1998

# Each supplier asks about the two words of a part's name; its candidates are its 20 best supported edges.
_CUR = """WITH top AS (SELECT source_uid AS q_id, edge_uid, source_uid, target_uid, relation, start_year, end_year, edge_type, support_count, CAST(support_count AS DOUBLE) AS score, row_number() OVER (PARTITION BY source_uid ORDER BY support_count DESC, edge_uid) AS rank FROM tkg_edges WHERE relation = 'supplied'),
cand AS (SELECT top.*, s.label AS source_label, t.label AS target_label FROM top JOIN tkg_nodes s ON s.node_uid = top.source_uid JOIN tkg_nodes t ON t.node_uid = top.target_uid WHERE rank <= 20),
terms AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS q_id, pos, split_part(p_name, ' ', pos + 1) AS term FROM supplier JOIN part ON p_partkey = s_suppkey, (SELECT unnest([0, 1]) AS pos) w),
qs AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS q_id, CASE s_suppkey % 3 WHEN 0 THEN 'supplied_by' WHEN 1 THEN 'part_count' END AS relation_hint, CASE WHEN s_suppkey % 2 = 0 THEN 1993 + s_suppkey % 5 END AS year FROM supplier),
said AS (SELECT DISTINCT c.q_id, c.edge_uid, t.pos FROM cand c JOIN terms t ON t.q_id = c.q_id AND contains(lower(c.target_label), t.term))
"""


def _candidates(spark: SparkSession, d: str, most: int = 20) -> DataFrame:
    e = p.supplied_edges(spark, d).withColumn("q_id", F.col("source_uid")).withColumn("score", F.col("support_count").cast("double"))
    return g.labelled(r.top_k(e, most, F.desc("support_count"), "edge_uid"), p.nodes(spark, d))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    s, t = p.read(spark, d, "supplier"), p.read(spark, d, "part")
    words = s.join(t, s["s_suppkey"] == t["p_partkey"]).select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("q_id"), F.split("p_name", " ").alias("w"))
    return words.select("q_id", F.posexplode(F.slice("w", 1, 2)).alias("pos", "term"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return p.read(spark, d, "supplier").select(F.concat(F.lit("S"), k.cast("string")).alias("q_id"), F.when(k % 3 == 0, "supplied_by").when(k % 3 == 1, "part_count").alias("relation_hint"), F.when(k % 2 == 0, 1993 + k % 5).cast("bigint").alias("year"))


@op("""WITH w AS (SELECT DISTINCT split_part(label, ' ', 1) AS term FROM tkg_nodes WHERE category = 'product') SELECT term AS q_id, node_uid FROM w JOIN tkg_nodes n ON n.category = 'product' AND list_contains(string_split(lower(n.label), ' '), term)""", graph=True)
def op_p12_token_overlap(spark: SparkSession, d: str) -> DataFrame:
    n = p.nodes(spark, d).where("category = 'product'")
    terms = n.select(F.split_part("label", F.lit(" "), F.lit(1)).alias("term")).distinct().withColumn("q_id", F.col("term"))
    return ev.overlapping_labels(terms, n)


@op("""SELECT p_partkey, lower(p_name) LIKE '%' || split_part(lower(p_type), ' ', 3) || '%' OR list_contains(string_split(lower(p_name), ' '), split_part(p_name, ' ', 2)) AS overlaps FROM part""")
def op_p12_predicate(spark: SparkSession, d: str) -> DataFrame:
    return p.read(spark, d, "part").select("p_partkey", ev.token_overlap(F.col("p_name"), F.concat(F.lit("the "), F.split_part("p_name", F.lit(" "), F.lit(2)))).alias("overlaps"))


_EXACT = "coalesce(CASE WHEN start_year IS NOT NULL AND end_year IS NOT NULL THEN start_year <= year AND year <= end_year WHEN start_year IS NOT NULL THEN start_year = year END, false)"


@op(f"""{_CUR}, f AS (SELECT c.q_id, c.edge_uid, EXISTS (SELECT 1 FROM said s WHERE s.q_id = c.q_id AND s.edge_uid = c.edge_uid) OR coalesce(relation_hint = 'supplied_by', false) OR {_EXACT} AS ok FROM cand c JOIN qs USING (q_id))
SELECT q_id, edge_uid FROM (SELECT *, count(*) FILTER (WHERE ok) OVER (PARTITION BY q_id) AS n FROM f) WHERE ok OR n < 3""", graph=True)
def op_p13_prefilter(spark: SparkSession, d: str) -> DataFrame:
    return ev.prefilter(_candidates(spark, d), _terms(spark, d), _questions(spark, d)).select("q_id", "edge_uid")


@op("""SELECT p_partkey, CAST(CASE p_partkey % 6 WHEN 0 THEN 1997 WHEN 3 THEN 1949 WHEN 4 THEN 2001 WHEN 5 THEN 1990 END AS BIGINT) AS year FROM part""")
def op_p15_title_year(spark: SparkSession, d: str) -> DataFrame:
    """Years of titles, of games and of books are no anchors; a plan's year always is."""
    k, n = F.col("p_partkey") % 6, F.col("p_name")
    text = F.when(k == 0, F.concat(F.lit("Who sold "), n, F.lit(" in 1997?"))).when(k == 1, "Who wrote the 1984 novel?").when(k == 2, "Who hosted the 1980 Olympics?").when(k == 3, F.concat(F.lit("What led in 1949 to "), n, F.lit("?"))).when(k == 4, "Which film was shown in 2001?").otherwise("Who sings on the 1989 album?")
    return p.read(spark, d, "part").select("p_partkey", ev.target_year(text, F.when(k == 5, F.lit(1990))).alias("year"))


@op(f"""{_CUR} SELECT q_id, edge_uid, rank, 'Supplier' AS kind, CAST(least(10, support_count) AS INT) AS n_rows FROM cand""", graph=True)
def op_p17_evidence(spark: SparkSession, d: str) -> DataFrame:
    rows = F.transform(F.sequence(F.lit(1).cast("bigint"), "support_count"), lambda i: F.concat(F.lit("row"), i.cast("string")))
    out = ev.evidence(_candidates(spark, d).withColumn("source_row_ids", rows))
    return out.select("q_id", "evidence.edge_uid", "rank", F.split_part("evidence.source_label", F.lit("#"), F.lit(1)).alias("kind"), F.size("evidence.source_row_ids").alias("n_rows"))


@op(f"""{_CUR}, l AS (SELECT q_id, source_label AS label, rank, 0 AS k FROM cand UNION ALL SELECT q_id, target_label, rank, 1 FROM cand), f AS (SELECT q_id, label, min(rank * 2 + k) AS o FROM l GROUP BY q_id, label)
SELECT q_id, string_agg(label, '|' ORDER BY o) AS entities FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY o) AS n FROM f) WHERE n <= 6 GROUP BY q_id""", graph=True)
def op_p18_canonical_entities(spark: SparkSession, d: str) -> DataFrame:
    return ev.canonical_entities(_candidates(spark, d)).select("q_id", F.array_join("entities", "|").alias("entities"))


@op("""WITH s AS (SELECT o_custkey AS q_id, o_orderkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rank, CASE WHEN o_custkey % 3 = 0 OR o_orderkey % 2 = 0 THEN true ELSE false END AS date FROM orders)
SELECT q_id, CAST(k AS VARCHAR) AS node_uid FROM (SELECT *, count(*) FILTER (WHERE NOT date) OVER (PARTITION BY q_id) AS n FROM s) WHERE NOT date OR (n = 0 AND rank <= 10)""")
def op_p19_seed_exclusion(spark: SparkSession, d: str) -> DataFrame:
    k, q = F.col("o_orderkey"), F.col("o_custkey")
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey"))
    label = F.when((q % 3 == 0) & (k % 2 != 0), F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(F.concat(F.lit("order "), k.cast("string")))
    category = F.when((k % 2 == 0), "date").otherwise("event")
    nodes = p.read(spark, d, "orders").select(q.alias("q_id"), k.cast("string").alias("node_uid"), label.alias("label"), category.alias("category"), rank.alias("rank"))
    return ev.seeds(nodes).select("q_id", "node_uid")


@op("SELECT edge_uid FROM tkg_edges WHERE edge_type IN ('base', 'gold_fact') AND relation IN ('caused', 'part_of')", graph=True)
def op_p9_edge_types(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.qa import factual

    return factual(p.edges(spark, d)).where("relation in ('caused', 'part_of')").select("edge_uid")


@op(f"""{_CUR}, f AS (SELECT *, CASE WHEN rank % 2 = 0 THEN 'founded' ELSE 'led_by' END AS rel, CASE WHEN CAST(substr(q_id, 2) AS INT) % 2 = 0 THEN 'first_occurrence' ELSE 'state_at_time' END AS type FROM cand)
SELECT q_id, edge_uid, round(score / 100 + CASE WHEN (type = 'first_occurrence') = (rel = 'founded') THEN 0.15 ELSE 0.0 END + CASE WHEN rank % 5 = 0 THEN 0.05 ELSE 0.0 END, 6) AS score FROM f""", graph=True)
def op_w5_boosts(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d).withColumn("relation", F.when(F.col("rank") % 2 == 0, "founded").otherwise("led_by")).withColumn("score", F.col("score") / 100)
    q = _questions(spark, d).withColumn("query_type", F.when(F.substring("q_id", 2, 9).cast("int") % 2 == 0, "first_occurrence").otherwise("state_at_time"))
    places = c.where("rank % 5 = 0").select("q_id", F.col("target_uid").alias("node_uid"))
    return ev.boosted(c, q, places).select("q_id", "edge_uid", F.round("score", 6).alias("score"))


@op(f"""{_CUR}, f AS (SELECT c.q_id, c.edge_uid, c.rank, coalesce((SELECT min(pos) FROM said s WHERE s.q_id = c.q_id AND s.edge_uid = c.edge_uid), 9) AS pos FROM cand c),
k AS (SELECT *, row_number() OVER (PARTITION BY q_id, pos ORDER BY rank) AS n FROM f) SELECT q_id, edge_uid, rank FROM (SELECT q_id, edge_uid, row_number() OVER (PARTITION BY q_id ORDER BY pos, n) AS rank FROM k WHERE pos = 9 OR n <= 4) WHERE rank <= 18""", graph=True)
def op_w9_balanced(spark: SparkSession, d: str) -> DataFrame:
    return ev.balanced(_candidates(spark, d), _terms(spark, d)).select("q_id", "edge_uid", "rank")


@op(f"""{_CUR}, d AS (SELECT s.q_id, s.edge_uid, s.pos, row_number() OVER (PARTITION BY s.q_id, s.pos ORDER BY c.score DESC, c.edge_uid) AS n FROM said s JOIN cand c ON c.q_id = s.q_id AND c.edge_uid = s.edge_uid),
f AS (SELECT q_id, edge_uid, min(pos * 100 + n) AS o FROM d WHERE n <= 3 GROUP BY q_id, edge_uid), v AS (SELECT q_id, edge_uid, count(*) AS n FROM said GROUP BY q_id, edge_uid)
SELECT c.q_id, c.edge_uid, row_number() OVER (PARTITION BY c.q_id ORDER BY coalesce(f.o, 99999), coalesce(v.n, 0) DESC, c.score DESC, c.edge_uid) AS rank FROM cand c LEFT JOIN f ON f.q_id = c.q_id AND f.edge_uid = c.edge_uid LEFT JOIN v ON v.q_id = c.q_id AND v.edge_uid = c.edge_uid""", graph=True)
def op_w10_interleaved(spark: SparkSession, d: str) -> DataFrame:
    return ev.interleaved(_candidates(spark, d), _terms(spark, d)).select("q_id", "edge_uid", "rank")


_POOL = """, pool AS (SELECT top.q_id, top.edge_uid, top.score, t.label AS target_label FROM top JOIN tkg_nodes t ON t.node_uid = top.target_uid),
have AS (SELECT t.q_id, t.pos, count(s.edge_uid) AS n FROM terms t LEFT JOIN (SELECT said.* FROM said JOIN cand c ON c.q_id = said.q_id AND c.edge_uid = said.edge_uid WHERE c.rank <= 5) s ON s.q_id = t.q_id AND s.pos = t.pos WHERE length(t.term) >= 3 GROUP BY t.q_id, t.pos),
more AS (SELECT * FROM (SELECT pl.q_id, pl.edge_uid, row_number() OVER (PARTITION BY h.q_id, h.pos ORDER BY pl.score DESC, pl.edge_uid) AS n FROM have h JOIN terms t ON t.q_id = h.q_id AND t.pos = h.pos JOIN pool pl ON pl.q_id = h.q_id AND contains(lower(pl.target_label), t.term)
WHERE h.n < 3 AND pl.edge_uid NOT IN (SELECT edge_uid FROM cand WHERE rank <= 5)) WHERE n <= 5)"""


@op(f"{_CUR}{_POOL} SELECT q_id, edge_uid FROM cand WHERE rank <= 5 UNION SELECT q_id, edge_uid FROM more", graph=True)
def op_n13_rescue(spark: SparkSession, d: str) -> DataFrame:
    pool = _candidates(spark, d, 1 << 20)
    return ev.rescued(pool.where("rank <= 5"), _terms(spark, d), pool).select("q_id", "edge_uid")


_FITS = "(year IS NULL OR start_year <= year AND year <= end_year)"


@op(f"""{_CUR}, lack AS (SELECT t.q_id, t.pos FROM terms t WHERE length(term) > 2 AND NOT EXISTS (SELECT 1 FROM said s JOIN cand c ON c.q_id = s.q_id AND c.edge_uid = s.edge_uid WHERE s.q_id = t.q_id AND s.pos = t.pos AND c.rank <= 2)),
o AS (SELECT DISTINCT c.q_id, c.edge_uid, c.score FROM cand c JOIN qs USING (q_id) JOIN said s ON s.q_id = c.q_id AND s.edge_uid = c.edge_uid JOIN lack l ON l.q_id = s.q_id AND l.pos = s.pos WHERE c.rank > 2 AND {_FITS})
SELECT q_id, edge_uid FROM cand WHERE rank <= 2 UNION ALL SELECT q_id, edge_uid FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, edge_uid) AS n FROM o) WHERE n <= 4""", graph=True)
def op_n13_safety_net(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d)
    return ev.safety_net(c.where("rank <= 2").select("q_id", "edge_uid"), c, _terms(spark, d), _questions(spark, d))


@op(f"""{_CUR}, o AS (SELECT c.q_id, c.edge_uid, row_number() OVER (PARTITION BY c.q_id ORDER BY c.score DESC, c.edge_uid) AS n FROM cand c JOIN qs USING (q_id) WHERE c.rank > 2 AND {_FITS})
SELECT q_id, edge_uid FROM cand WHERE rank <= 2 UNION ALL SELECT o.q_id, o.edge_uid FROM o JOIN (SELECT q_id, count(*) AS m FROM cand WHERE rank <= 2 GROUP BY q_id) s ON s.q_id = o.q_id WHERE n + m <= 4""", graph=True)
def op_n13_min_fill(spark: SparkSession, d: str) -> DataFrame:
    c = _candidates(spark, d)
    return ev.filled(c.where("rank <= 2").select("q_id", "edge_uid"), c, _questions(spark, d))


@op(f"""{_CUR}, w AS (SELECT q_id, max(term) FILTER (WHERE pos = 0) AS word FROM terms GROUP BY q_id), x AS (SELECT c.q_id, source_label AS entity, 2.25 AS s FROM cand c WHERE rank <= 16 UNION ALL SELECT c.q_id, target_label, 1.25 + CASE WHEN length(word) >= 3 AND contains(lower(target_label), word) THEN 0.75 ELSE 0.0 END FROM cand c JOIN w USING (q_id) WHERE rank <= 16)
SELECT q_id, entity, score FROM (SELECT q_id, entity, sum(s) AS score, row_number() OVER (PARTITION BY q_id ORDER BY sum(s) DESC, entity) AS n FROM x GROUP BY q_id, entity) WHERE n <= 8""", graph=True)
def op_n11_candidate_entities(spark: SparkSession, d: str) -> DataFrame:
    q = _terms(spark, d).where("pos = 0").select("q_id", F.col("term").alias("text"))
    return ev.candidate_entities(_candidates(spark, d), q)


@op("""SELECT o_orderkey, o_totalprice < 60000 OR o_orderkey % 7 = 0 OR abs(year(o_orderdate) - 1960) > 30 AND o_orderkey % 2 = 0 AS weak FROM orders""")
def op_n12_weak_evidence(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    answer = F.when(k % 7 == 0, "Retrieval did not return supporting graph edges.").otherwise("Evidence: a b c.")
    year = F.when(k % 2 == 0, F.lit(1960))
    return p.read(spark, d, "orders").select("o_orderkey", ev.weak(F.col("o_totalprice") / 100000, answer, year, F.year("o_orderdate")).alias("weak"))


@op("""WITH h AS (SELECT c_custkey AS q_id, o_orderkey AS hit_id, CASE WHEN o_orderkey % 4 = 0 THEN 'No, it was not' ELSE 'in ' || CAST(year(o_orderdate) AS VARCHAR) END AS answer, (o_orderkey % 10) / 10.0 AS score, c_custkey % 2 = 0 AS entity FROM orders JOIN customer ON o_custkey = c_custkey),
f AS (SELECT * FROM h WHERE NOT entity OR (answer <> 'No, it was not' AND score >= 0.48)), y AS (SELECT *, contains(answer, '1996') AS has, max(CAST(contains(answer, '1996') AS INT)) OVER (PARTITION BY q_id) AS hits FROM f)
SELECT q_id, hit_id FROM y WHERE NOT entity OR has OR hits = 0""")
def op_r31_reference_hits(spark: SparkSession, d: str) -> DataFrame:
    o, c = p.read(spark, d, "orders"), p.read(spark, d, "customer")
    k = F.col("o_orderkey")
    hits = o.join(c, o["o_custkey"] == c["c_custkey"]).select(F.col("c_custkey").alias("q_id"), k.alias("hit_id"), F.lit("asked").alias("query"), F.when(k % 4 == 0, "No, it was not").otherwise(F.concat(F.lit("in "), F.year("o_orderdate").cast("string"))).alias("answer"), ((k % 10) / 10).alias("score"))
    q = c.select(F.col("c_custkey").alias("q_id"), F.when(F.col("c_custkey") % 2 == 0, "Who ordered in 1996?").otherwise("Did it happen?").alias("text"), F.lit(1996).alias("year"))
    return ev.reference_hits(hits, q).select("q_id", "hit_id")


# --- search ------------------------------------------------------------------


@op(f"""WITH e AS (SELECT e.edge_uid, e.source_uid, e.relation, t.label FROM tkg_edges e JOIN tkg_nodes t ON t.node_uid = e.target_uid WHERE {IN_1998} AND contains(lower(relation), 'suppl')), q AS (SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS q_id FROM supplier),
c AS (SELECT q.q_id, e.edge_uid, row_number() OVER (PARTITION BY q.q_id ORDER BY e.edge_uid) AS n FROM q JOIN e ON e.source_uid = q.q_id) SELECT q_id, count(*) AS n FROM c WHERE n <= 40 GROUP BY q_id""", graph=True)
def op_r23_semantic_search(spark: SparkSession, d: str) -> DataFrame:
    """Hybrid scores over edge sentences, then every filter: seeds, relation hint, year; the 40 best."""
    edges, nodes = p.supplied_edges(spark, d, by="target_uid"), p.nodes(spark, d)
    s = p.read(spark, d, "supplier")
    uid = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    asked = s.select(uid.alias("q_id"), F.split_part("s_name", F.lit("#"), F.lit(2)).alias("text"), F.lit("state_at_time").alias("query_type"), F.lit("SUPPL").alias("relation_hint"), F.lit(1998).cast("bigint").alias("year"), F.lit(None).cast("bigint").alias("start_year"), F.lit(None).cast("bigint").alias("end_year"))
    hits = search.search_edges(asked, edges, nodes, seeds=s.select(uid.alias("q_id"), uid.alias("node_uid")), sources=nodes.where("category = 'org'"))
    return hits.groupBy("q_id").agg(F.count(F.lit(1)).alias("n"))


@op("""WITH q AS (SELECT DISTINCT p_brand AS q_id FROM part), t AS (SELECT DISTINCT p_partkey AS id, p_brand, 'b' AS domain FROM part) SELECT q_id, count(*) AS n FROM (SELECT q_id, id, row_number() OVER (PARTITION BY q_id ORDER BY id) AS n FROM q JOIN t ON t.p_brand = q.q_id WHERE id % 2 = 0) WHERE n <= 10 GROUP BY q_id""")
def op_r24_row_search(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one domain that share a gram with the question, the ten best."""
    t = p.read(spark, d, "part")
    word = lambda c: F.regexp_replace(c, "[^A-Za-z0-9]", "")
    rows = t.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", word("p_brand"), F.concat(F.lit("x"), F.col("p_partkey").cast("string"))).alias("text"), F.when(F.col("p_partkey") % 2 == 0, "even").otherwise("odd").alias("domain"))
    asked = t.select(F.col("p_brand").alias("q_id"), word("p_brand").alias("text"), F.lit("even").alias("domain")).distinct()
    return search.search_rows(asked, rows).groupBy("q_id").agg(F.count(F.lit(1)).alias("n"))


@op()
def op_r22_targeted_retrieval(spark: SparkSession, d: str) -> DataFrame:
    s = p.read(spark, d, "supplier")
    asked = s.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("q_id"), F.array("s_name").alias("entities"), F.array(F.lit("supplied")).alias("relations"), F.lit(1998).cast("bigint").alias("year"))
    return search.retrieve(asked, p.edges(spark, d), p.nodes(spark, d)).select("q_id", "edge_uid", "rank", F.round("score", 6).alias("score"))


# --- dispatch ----------------------------------------------------------------

_KINDS = ("state_at_time", "existence_in_time", "first_occurrence", "latest_among_set", "temporal_count", "temporal_top_k", "temporal_path_existence", "reason_of", "start_affecting", "analogical_transfer", "unknown")


def _planned(spark: SparkSession, d: str) -> DataFrame:
    """Eleven kinds of question in turn, one for each customer."""
    c, n = p.read(spark, d, "customer"), p.read(spark, d, "nation")
    k = F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (k % 11 + 1).cast("int"))
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"])
    names = F.when(k % 11 == 6, F.array("c_name", F.col("n_name"))).when(k % 11 == 1, F.array("n_name", "c_name")).otherwise(F.array("c_name", "n_name"))
    return rows.select(k.alias("q_id"), kind.alias("query_type"), names.alias("entities"), F.lit(None).cast("bigint").alias("year"), F.lit(3).alias("k"), F.lit("?").alias("text"))


@op("""SELECT c_custkey AS q_id, CASE c_custkey % 11 WHEN 0 THEN 'state_at_time' WHEN 1 THEN 'existence_in_time' WHEN 2 THEN 'first_occurrence' WHEN 3 THEN 'latest_among_set' WHEN 4 THEN 'temporal_count' WHEN 5 THEN 'temporal_top_k' WHEN 6 THEN 'temporal_path_existence' WHEN 7 THEN 'reason_of' WHEN 8 THEN 'start_affecting' WHEN 9 THEN 'analogical_transfer' ELSE 'semantic_fallback' END AS question_type,
CASE c_custkey % 11 WHEN 0 THEN 0.45 WHEN 1 THEN 0.58 WHEN 2 THEN 0.24 WHEN 3 THEN 0.24 WHEN 4 THEN 0.7 WHEN 5 THEN 0.7 WHEN 6 THEN 0.75 WHEN 7 THEN 0.24 WHEN 8 THEN 0.2 WHEN 9 THEN 0.24 ELSE 0.48 END AS confidence,
CASE c_custkey % 11 WHEN 0 THEN 'State evidence: ' || c_name || ' located_in ' || n_name || '.' WHEN 6 THEN 'A path exists between the entities within 1 hops.' END AS answer FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def op_g13_typed_dispatch(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's only hit is that it is located in its nation; types that need more back off."""
    hits = p.membership_edges(spark, d).where("source_uid like 'C%'").select(F.substring("source_uid", 2, 20).cast("bigint").alias("q_id"), "edge_uid", F.lit(1.0).alias("score"))
    out = dispatch.answer(_planned(spark, d), p.nodes(spark, d), p.membership_edges(spark, d), hits)
    return out.select("q_id", "question_type", F.round("confidence", 6).alias("confidence"), F.when((F.col("q_id") % 11).isin(0, 6), F.col("answer")).alias("answer"))


@op("""WITH h AS (SELECT source_uid AS q_id, least(5, count(*)) AS n FROM tkg_edges WHERE relation = 'supplied' GROUP BY source_uid)
SELECT 'S' || CAST(s_suppkey AS VARCHAR) AS q_id, round(CASE WHEN n IS NULL THEN 0.1 ELSE least(0.45, 0.18 + 0.06 * n) END, 6) AS confidence FROM supplier LEFT JOIN h ON h.q_id = 'S' || CAST(s_suppkey AS VARCHAR)""", graph=True)
def op_g12_semantic_backoff(spark: SparkSession, d: str) -> DataFrame:
    """Questions for reasons without a year: only the hits of the search are left."""
    q = _questions(spark, d).select("q_id", F.lit("reason_of").alias("query_type"), F.array(F.lit("nobody")).alias("entities"), F.lit(None).cast("bigint").alias("year"), F.lit(5).alias("k"), F.lit("?").alias("text"))
    hits = _candidates(spark, d).select("q_id", "edge_uid", "score")
    return dispatch.answer(q, p.nodes(spark, d), p.supplied_edges(spark, d), hits).select("q_id", F.round("confidence", 6).alias("confidence"))


@op(f"""{_CUR}, s AS (SELECT q_id, string_agg(source_label || ' ' || relation || ' ' || target_label, '; ' ORDER BY rank) FILTER (WHERE rank <= 5) AS told, count(*) AS n FROM cand GROUP BY q_id)
SELECT qs.q_id, CASE WHEN told IS NULL THEN 'Retrieval did not return supporting graph edges.' ELSE 'Evidence' || CASE WHEN year IS NULL THEN '' ELSE ' in ' || CAST(year AS VARCHAR) END || ': ' || told || '.' END AS answer, round(CASE WHEN told IS NULL THEN 0.1 ELSE least(0.9, 0.3 + 0.1 * n) END, 6) AS confidence FROM qs LEFT JOIN s USING (q_id)""", graph=True)
def op_m6_curated_answers(spark: SparkSession, d: str) -> DataFrame:
    a = ev.answers(ev.displayed(_candidates(spark, d)), _questions(spark, d))
    return a.select("q_id", F.regexp_replace("answer", r" Key entities: .*$", "").alias("answer"), F.round("confidence", 6).alias("confidence"))


# --- computed answers --------------------------------------------------------

_TELL = """(SELECT p_partkey AS q_id, split_part(p_name, ' ', 2) AS a, p_brand AS b, 1990 + p_size % 7 AS ya, 1990 + p_partkey % 5 AS yb FROM part)"""


def _told(spark: SparkSession, d: str) -> DataFrame:
    """Two dated lines about each part: one on a word of its name, one on its brand."""
    t = p.read(spark, d, "part")
    word = F.split_part("p_name", F.lit(" "), F.lit(2))
    line = lambda s, r, o, y, e=None: F.struct(s.alias("source_label"), F.lit(r).alias("relation"), o.alias("target_label"), y.cast("bigint").alias("start_year"), (F.lit(None) if e is None else e).cast("bigint").alias("end_year"))
    brand = F.replace("p_brand", F.lit("#"), F.lit(""))
    ya, yb = 1990 + F.col("p_size") % 7, 1990 + F.col("p_partkey") % 5
    lines = F.array(line(word, "sold_in", F.lit("Market"), ya), line(brand, "founded", F.lit("Market"), yb), line(F.concat(F.lit("Holder "), brand), "head_of", F.concat(word, F.lit(" board")), ya, ya + 2))
    return t.select(F.col("p_partkey").alias("q_id"), F.explode(lines).alias("l")).select("q_id", "l.*")


def _two(spark: SparkSession, d: str) -> DataFrame:
    return p.read(spark, d, "part").select(F.col("p_partkey").alias("q_id"), F.concat(F.lit("the "), F.split_part("p_name", F.lit(" "), F.lit(2))).alias("a"), F.replace("p_brand", F.lit("#"), F.lit("")).alias("b"), (F.col("p_partkey") % 2 == 0).alias("later"), F.lit("x").alias("text"))


@op(f"SELECT q_id, CASE WHEN ya <= yb THEN 'Yes' ELSE 'No' END AS yes_no, CASE WHEN (ya <= yb) = (q_id % 2 = 0) THEN replace(b, '#', '') ELSE 'the ' || a END AS name FROM {_TELL}")
def op_n10_orderings(spark: SparkSession, d: str) -> DataFrame:
    q, e = _two(spark, d), _told(spark, d).where("relation <> 'head_of'")
    yes = co.ordering_yes_no(q, e).withColumnRenamed("answer", "yes_no")
    return yes.join(co.ordering_name(q, e).withColumnRenamed("answer", "name"), "q_id")


@op(f"SELECT q_id, CASE WHEN ya <= 1994 AND 1994 <= ya + 2 THEN 'Holder ' || replace(b, '#', '') END AS holder, CAST(yb AS VARCHAR) AS year FROM {_TELL}")
def op_n10_holders_and_years(spark: SparkSession, d: str) -> DataFrame:
    e, q = _told(spark, d), _two(spark, d)
    who = co.role_holder(q.select("q_id", F.concat(F.lit("Who led "), "a", F.lit(" board?")).alias("text"), F.lit(1994).alias("year")), e, ["head_of"])
    when = co.what_year(q.select("q_id", F.concat(F.lit("When was "), "b", F.lit(" founded?")).alias("text")), e, ["founded"])
    return who.withColumnRenamed("answer", "holder").join(when.withColumnRenamed("answer", "year"), "q_id")


@op("""WITH l AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS line FROM orders), m AS (SELECT max(line) AS last FROM l), w AS (SELECT CAST(round(i * last / 6.0) AS BIGINT) AS line FROM m, range(7) t(i))
SELECT 'kept' AS what, line FROM w UNION ALL SELECT 'left', max(line) - 7 FROM l""")
def op_g18_line_sampling(spark: SparkSession, d: str) -> DataFrame:
    o = p.read(spark, d, "orders").select("o_orderkey")
    lines = o.withColumn("line", (F.row_number().over(Window.orderBy("o_orderkey")) - 1).cast("bigint"))
    seven = co.spread_lines(lines, 7)
    rest = co.without_lines(lines, seven)
    return seven.select(F.lit("kept").alias("what"), "line").unionByName(rest.agg(F.max("line").alias("line")).select(F.lit("left").alias("what"), "line"))
