"""Facts in words: the template library, routing, paths, justifications, text helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.fidelity import bucket
from ..operators import graph as g
from ..operators import tms
from ..plans import nlg, paths
from ..sources import facts as fx
from ..plans.templates import LIBRARY
from ..sources import projection as p
from .base import op

#: Kinds of fact in turn, by order key.
_KINDS = ("point_in_time", "interval", "sequence", "causality", "overlap", "precedence", "containment", "recurrence")


def _facts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    who, priority = F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")), F.lower("o_orderpriority")
    year = lambda n: (F.year("o_orderdate") + n).cast("string")
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (k % 8 + 1).cast("int"))
    events = F.slice(F.array(F.lit("the order came"), F.concat(F.lit("it was "), priority), F.lit("the parts were found"), F.lit("it shipped")), 1, (1 + F.floor(k / 8) % 4).cast("int"))
    return p.read(spark, d, "orders").select(
        k.alias("id"), kind.alias("fact_type"), F.when(k % 16 < 8, who).alias("entity"), F.when(k % 3 == 0, "was placed").otherwise("sale").alias("event"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        year(0).alias("start_date"), F.when(k % 40 != 1, year(2)).alias("end_date"), F.when(k % 5 == 0, "two years").alias("duration"), events.alias("events"), F.lit("this year").alias("time_span"), year(0).alias("time_period"),
        F.concat(F.lit("the "), priority).alias("cause"), F.lit("a delay").alias("effect"), who.alias("first"), priority.alias("second"), who.alias("inner"), year(0).alias("outer"), F.lit("month").alias("frequency"), (k % 9).cast("int").alias("count"),
    )


_F = """WITH f AS (SELECT o_orderkey AS id, o_orderkey AS k, CASE WHEN o_orderkey % 16 < 8 THEN 'Customer ' || CAST(o_custkey AS VARCHAR) END AS entity, 'Customer ' || CAST(o_custkey AS VARCHAR) AS who, CASE WHEN o_orderkey % 3 = 0 THEN 'was placed' ELSE 'sale' END AS event,
strftime(o_orderdate, '%Y-%m-%d') AS date, CAST(year(o_orderdate) AS VARCHAR) AS y0, CASE WHEN o_orderkey % 40 <> 1 THEN CAST(year(o_orderdate) + 2 AS VARCHAR) END AS y2, lower(o_orderpriority) AS pr,
['the order came', 'it was ' || lower(o_orderpriority), 'the parts were found', 'it shipped'][1:CAST(1 + o_orderkey // 8 % 4 AS INT)] AS ev FROM orders),
c AS (SELECT *, CASE WHEN entity IS NOT NULL THEN entity || ' ' || event WHEN event = 'was placed' THEN event ELSE 'the sale happened' END AS clause, CASE WHEN entity IS NOT NULL THEN entity WHEN event = 'sale' THEN 'the sale' ELSE event END AS subject,
CASE len(ev) WHEN 1 THEN [ev[1], ev[1], ev[1]] WHEN 2 THEN [ev[1], ev[2], ev[2]] ELSE ev END AS three FROM f)
"""
_UP = lambda x: f"upper(substr({x}, 1, 1)) || substr({x}, 2)"


@op(f"""{_F} SELECT id, CASE k % 8 WHEN 0 THEN {_UP("clause || ' on ' || date || '.'")} WHEN 1 THEN {_UP("subject || ' lasted from ' || y0 || ' to ' || y2 || '.'")} WHEN 2 THEN three[1] || '. ' || three[2] || '. ' || three[3] || '. Key facts: the order came.'
WHEN 3 THEN 'the ' || pr || '. Then a delay. Key facts: the ' || pr || '.' WHEN 4 THEN array_to_string(ev, ' and ') || ' together. Key facts: the order came.' WHEN 5 THEN who || ' happened before ' || pr || '.' WHEN 6 THEN who || ' occurred within ' || y0 || '.' ELSE event || ' happens every month.' END AS text,
CASE WHEN k % 8 = 1 AND y2 IS NULL THEN 'missing end_date' END AS error FROM c""")
def op_r17_first_template(spark: SparkSession, d: str) -> DataFrame:
    return nlg.first_template(_facts(spark, d)).select("id", "text", "error")


@op("""SELECT CASE o_orderkey % 8 WHEN 0 THEN 'point_in_time' WHEN 1 THEN 'interval' WHEN 2 THEN 'sequence' WHEN 3 THEN 'causality' WHEN 4 THEN 'overlap' WHEN 5 THEN 'precedence' WHEN 6 THEN 'containment' ELSE 'recurrence' END AS fact_type,
CAST(sum(CASE WHEN o_orderkey % 8 = 1 AND o_orderkey % 40 = 1 THEN 0 ELSE CASE WHEN o_orderkey % 8 <= 2 THEN 20 WHEN o_orderkey % 8 <= 4 THEN 23 ELSE 5 END END) AS BIGINT) AS n_texts, CAST(count(DISTINCT CASE WHEN o_orderkey % 8 = 1 AND o_orderkey % 40 = 1 THEN o_orderkey END) AS BIGINT) AS n_failed FROM orders GROUP BY 1""")
def op_a21_render_all(spark: SparkSession, d: str) -> DataFrame:
    """All templates of all facts: how many texts each kind gives, and how many facts fail."""
    r = nlg.render(_facts(spark, d))
    return r.groupBy("fact_type").agg(F.count("text").alias("n_texts"), F.count_distinct(F.when(F.col("error").isNotNull(), F.col("id"))).alias("n_failed"))


_CLARITY = ", ".join(f"('{k}', {sum(t[2] for t in ts) / len(ts):.6f}, {len(ts)})" for k, ts in LIBRARY.items())


@op(f"SELECT fact_type, CAST(templates AS BIGINT) AS templates, round(clarity, 4) AS clarity FROM (VALUES {_CLARITY}) t(fact_type, clarity, templates)")
def op_a21_template_report(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.evals import template_report

    return template_report(nlg.readable(nlg.render(_facts(spark, d)))).select("fact_type", "templates", "clarity")


@op("SELECT round(avg(CASE WHEN f > 50 THEN 1.0 ELSE 0.0 END), 6) AS coverage, count(*) AS kinds FROM (SELECT l_shipmode AS kind, avg(q) AS f FROM (SELECT l_returnflag || l_linestatus AS l_shipmode, l_quantity * 2 AS q FROM lineitem) GROUP BY 1)")
def op_r29_type_coverage(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.evals import type_coverage

    return type_coverage(p.read(spark, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("kind"), (F.col("l_quantity") * 2).alias("flesch")), 50.0)


@op(f"""{_F} SELECT id, CASE WHEN k % 8 IN (2, 4) THEN NULL END AS missing_events, CASE WHEN k % 8 = 1 AND y2 IS NULL THEN 'end_date' ELSE '' END AS missing FROM c""".replace("CASE WHEN k % 8 IN (2, 4) THEN NULL END AS missing_events, ", ""))
def op_r15_fact_validation(spark: SparkSession, d: str) -> DataFrame:
    return nlg.missing_fields(_facts(spark, d))


@op(f"""{_F} SELECT id, CASE k % 8 WHEN 0 THEN coalesce(entity, 'It') || ' ' || event || ' / ' || date WHEN 1 THEN coalesce(entity, 'It') || ' ' || event || ' / ' END AS text,
CASE k % 8 WHEN 0 THEN NULL WHEN 1 THEN 'missing date' WHEN 2 THEN 'missing date,entity,event' WHEN 3 THEN 'missing date,entity,event' WHEN 4 THEN 'missing date,entity,event' WHEN 5 THEN 'unsupported kind precedence' WHEN 6 THEN 'unsupported kind containment' ELSE 'unsupported kind recurrence' END AS error FROM c""".replace(" WHEN 1 THEN coalesce(entity, 'It') || ' ' || event || ' / '", ""))
def op_r16_generic_render(spark: SparkSession, d: str) -> DataFrame:
    return nlg.generic(_facts(spark, d), "{entity} {event} / {date}")


@op(f"""{_F}, s AS (SELECT *, least(0.0, 0) AS z FROM c) SELECT id, ' Key facts: ' || CASE k % 8 WHEN 3 THEN 'the ' || pr || ' | a delay' ELSE CASE len(ev) WHEN 1 THEN 'the order came | ' || CASE k % 8 WHEN 4 THEN y0 ELSE 'this year' END ELSE 'the order came | ' || ev[-1] END END || '.' AS hint FROM s WHERE k % 8 IN (2, 3, 4)""")
def op_r18_anchor_count(spark: SparkSession, d: str) -> DataFrame:
    """Two key facts in place of one."""
    r = nlg.render(_facts(spark, d), anchors=2).where("template = 0 and fact_type in ('sequence', 'causality', 'overlap')")
    return r.select("id", F.regexp_extract("text", r"( Key facts: .*)$", 1).alias("hint"))


@op("""WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 40 <> 1 THEN 1 ELSE 0 END + CASE WHEN 1 + o_orderkey // 8 % 4 > 2 THEN 2 ELSE 0 END AS complexity FROM orders) SELECT id, complexity, CASE WHEN complexity = 0 THEN 'template' WHEN complexity <= 2 THEN 'polish' ELSE 'llm' END AS strategy FROM s""")
def op_r19_strategy(spark: SparkSession, d: str) -> DataFrame:
    return nlg.strategy(_facts(spark, d))


@op(f"""{_F}, s AS (SELECT id, CASE WHEN k % 40 <> 1 THEN 1 ELSE 0 END + CASE WHEN len(ev) > 2 THEN 2 ELSE 0 END AS n, k % 8 = 1 AND y2 IS NULL AS bad FROM c)
SELECT id, CASE WHEN n BETWEEN 1 AND 2 THEN 'polished' ELSE 'template' END AS strategy, CASE WHEN n BETWEEN 1 AND 2 THEN 0.85 ELSE 0.9 END AS confidence, bad AS failed FROM s""")
def op_r19_generate(spark: SparkSession, d: str) -> DataFrame:
    """With a stand-in for the polishing model."""
    out = nlg.generate(_facts(spark, d), polish=F.upper)
    return out.select("id", "strategy", "confidence", F.col("error").isNotNull().alias("failed"))


@op()
def op_r28_best_template(spark: SparkSession, d: str) -> DataFrame:
    return nlg.best_template(_facts(spark, d))


@op("""WITH s AS (SELECT p_partkey, p_size / 50.0 AS q, (p_partkey % 100) / 100.0 AS c FROM part) SELECT p_partkey, q BETWEEN 0.4 AND 0.7 AND c > 0.7 AS polish, round(least(q, c), 6) AS confidence, round(CASE WHEN q BETWEEN 0.4 AND 0.7 AND c > 0.7 THEN least(0.95, q + 0.2) ELSE q END, 6) AS estimate FROM s""")
def op_m13_routing(spark: SparkSession, d: str) -> DataFrame:
    r = nlg.routing(F.col("p_size") / F.lit(50.0), (F.col("p_partkey") % 100) / F.lit(100.0))
    return p.read(spark, d, "part").select("p_partkey", r.alias("r")).select("p_partkey", "r.polish", F.round("r.confidence", 6).alias("confidence"), F.round("r.estimate", 6).alias("estimate"))


# --- text helpers ------------------------------------------------------------


@op("""SELECT p_partkey, array_to_string(string_split(p_name || ' ' || p_type || ' of ' || p_brand, ' ')[1:4], ' ') AS cut, CASE WHEN p_partkey % 2 = 0 THEN split_part(p_name, ' ', 1) || ' and ' || split_part(p_name, ' ', 2) ELSE split_part(p_name, ' ', 1) || ', ' || split_part(p_name, ' ', 2) || ', and ' || p_brand END AS listed,
least(20, CAST(len(string_split(p_name || ' ' || p_type, ' ')) AS INT)) AS tokens FROM part""")
def op_f10_truncate_and_lists(spark: SparkSession, d: str) -> DataFrame:
    word = lambda n: F.split_part("p_name", F.lit(" "), F.lit(n))
    items = F.when(F.col("p_partkey") % 2 == 0, F.array(word(1), word(2))).otherwise(F.array(word(1), word(2), F.col("p_brand")))
    whole = F.concat_ws(" ", "p_name", "p_type", F.lit("of"), "p_brand")
    return p.read(spark, d, "part").select("p_partkey", t.truncate(whole, 4).alias("cut"), nlg.format_list(items).alias("listed"), t.token_estimate(F.concat_ws(" ", "p_name", "p_type")).alias("tokens"))


@op("""SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'in' WHEN 1 THEN 'on' WHEN 2 THEN 'in' WHEN 3 THEN 'in' ELSE 'on' END AS prep FROM orders""")
def op_f12_preposition(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey") % 5
    date = F.when(k == 0, F.date_format("o_orderdate", "yyyy")).when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).when(k == 2, F.date_format("o_orderdate", "MMMM yyyy")).when(k == 3, F.concat(F.lit("Q"), F.quarter("o_orderdate").cast("string"), F.lit(" "), F.date_format("o_orderdate", "yyyy"))).otherwise(F.date_format("o_orderdate", "MMMM d, yyyy"))
    return p.read(spark, d, "orders").select("o_orderkey", nlg.preposition(date).alias("prep"))


@op(f"{_F} SELECT id, clause, subject FROM c")
def op_f13_event_clause(spark: SparkSession, d: str) -> DataFrame:
    return _facts(spark, d).select("id", nlg.event_clause(F.col("entity"), F.col("event")).alias("clause"), nlg.event_subject(F.col("entity"), F.col("event")).alias("subject"))


@op("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'at ' || CAST(year(o_orderdate) AS VARCHAR) || ' This highlights the main temporal relationship.' WHEN 1 THEN 'Summary: at ' || CAST(year(o_orderdate) AS VARCHAR) ELSE 'at ' || CAST(year(o_orderdate) AS VARCHAR) END AS styled,
'At decade granularity, at ' || CAST(year(o_orderdate) // 10 AS VARCHAR) || '0s' AS decade FROM orders""")
def op_f15_styles(spark: SparkSession, d: str) -> DataFrame:
    k, text = F.col("o_orderkey") % 3, F.concat(F.lit("at "), F.year("o_orderdate").cast("string"))
    style = F.when(k == 0, "hybrid").when(k == 1, "seq2seq").otherwise("template")
    return p.read(spark, d, "orders").select("o_orderkey", t.stylised(text, style).alias("styled"), t.at_granularity(text, F.lit("decades")).alias("decade"))


@op("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'Yes' WHEN 1 THEN p_name WHEN 2 THEN '2001' WHEN 3 THEN p_name ELSE 'a b c d e f g h' END AS answer FROM part""")
def op_f6_clean_answer(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey") % 5, F.col("p_name")
    raw = F.when(k == 0, F.concat(F.lit("<think>hm\nso</think> yes, it was "), n)).when(k == 1, F.concat(F.lit("The answer is: '"), n, F.lit("'."))).when(k == 2, "Answer: 2001-03-04").when(k == 3, F.concat(n, F.lit("\nand more"))).otherwise("a b c d e f g h i j k l")
    return p.read(spark, d, "part").select("p_partkey", t.clean_answer(raw).alias("answer"))


@op("SELECT p_partkey, replace(p_name, ' ', '%20') || '%2F%23' AS encoded FROM part")
def op_f20_percent_encode(spark: SparkSession, d: str) -> DataFrame:
    return p.read(spark, d, "part").select("p_partkey", t.percent_encoded(F.concat("p_name", F.lit("/#"))).alias("encoded"))


@op("""SELECT o_orderkey, 'Customer ' || CAST(o_custkey AS VARCHAR) || ' placed order' || CASE WHEN o_orderkey % 2 = 0 THEN ' during ' || CAST(year(o_orderdate) AS VARCHAR) ELSE '' END AS fact,
CASE o_orderkey % 3 WHEN 0 THEN 'no change' WHEN 1 THEN 'predicate changed from ''placed'' to ''cancelled''' ELSE 'object changed from ''order'' to ''two orders''' || CASE WHEN o_orderkey % 2 = 0 THEN '; timeframe changed from ''' || CAST(year(o_orderdate) AS VARCHAR) || ''' to ''None''' ELSE '' END END AS delta FROM orders""")
def op_y4_counterfactual_delta(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    who, year = F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")), F.when(k % 2 == 0, F.year("o_orderdate").cast("string"))
    fact = {"subject": who, "predicate": F.lit("placed"), "object": F.lit("order"), "timeframe": year}
    other = fact | {"predicate": F.when(k % 3 == 1, "cancelled").otherwise("placed"), "object": F.when(k % 3 == 2, "two orders").otherwise("order"), "timeframe": F.when(k % 3 != 2, year)}
    return p.read(spark, d, "orders").select("o_orderkey", nlg.fact_text(*fact.values()).alias("fact"), nlg.delta_text(fact, other).alias("delta"))


# --- paths -------------------------------------------------------------------

_STEPS = """(SELECT c_custkey AS id, c_name AS a, n_name AS b, r_name AS c FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _paths(spark: SparkSession, d: str) -> DataFrame:
    """The way from each customer to its region, as found in the graph."""
    c, n = p.read(spark, d, "customer"), p.read(spark, d, "nation")
    pairs = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("q_id"), F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("start_uid"), F.concat(F.lit("R"), F.col("n_regionkey").cast("string")).alias("end_uid"))
    return g.path_steps(g.witness_paths(p.membership_edges(spark, d), pairs), p.membership_edges(spark, d), p.nodes(spark, d))


@op("""SELECT c_custkey AS q_id, 2 AS hops, 'C' || CAST(c_custkey AS VARCHAR) || '>N' || CAST(c_nationkey AS VARCHAR) || '>R' || CAST(n_regionkey AS VARCHAR) AS path FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT -c_custkey - 1, NULL, NULL FROM customer""")
def op_g4_witness_path(spark: SparkSession, d: str) -> DataFrame:
    """Paths that exist, and against the edges' direction, where there is none."""
    c, n = p.read(spark, d, "customer"), p.read(spark, d, "nation")
    uid = lambda x, col: F.concat(F.lit(x), F.col(col).cast("string"))
    there = c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.col("c_custkey").alias("q_id"), uid("C", "c_custkey").alias("start_uid"), uid("R", "n_regionkey").alias("end_uid"))
    back = there.select((-F.col("q_id") - 1).alias("q_id"), F.col("end_uid").alias("start_uid"), F.col("start_uid").alias("end_uid"))
    found = g.witness_paths(p.membership_edges(spark, d), there.unionByName(back))
    return found.select("q_id", "hops", F.array_join("nodes", ">").alias("path"))


@op(f"""SELECT id AS q_id, 'Connection from ' || a || ' to ' || c || ' via located_in, part_of.' AS summary, a || ' -[located_in]-> ' || b || ' | ' || b || ' -[part_of]-> ' || c AS path, a || ' located_in ' || b || '; ' || b || ' part_of ' || c AS justification FROM {_STEPS}""")
def op_g19_path_explanation(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("steps")
    return _paths(spark, d).select("q_id", paths.summary(s).alias("summary"), paths.path_text(s).alias("path"), paths.justification(s).alias("justification"))


@op(f"""WITH s AS (SELECT id, a || ' -[located_in]-> ' || b || ' | ' || b || ' -[part_of]-> ' || c AS p, 'Connection from ' || a || ' to ' || c || ' via located_in, part_of.' AS m FROM {_STEPS})
SELECT id AS q_id, 'Here is the timeline in plain terms. Step by step: ' || p || '. It means ' || m || ' That is the key takeaway.' AS novice, 'Tracing the dependency path: Event flow: ' || p || '. Impact: ' || m || ' Summary complete. Evidence chain: e1, e2.' AS finance, 'Timeline overview: Path ' || p || '. ' || m AS plain FROM s""")
def op_g19_narratives(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("steps")
    return _paths(spark, d).select("q_id", paths.narrative(s, "novice").alias("novice"), paths.narrative(s, "expert", "finance", F.array(F.lit("e1"), F.lit("e2"))).alias("finance"), paths.narrative(s).alias("plain"))


@op(f"SELECT id AS q_id, a || ' located_in ' || b || ' then ' || b || ' part_of ' || c || '.' AS body FROM {_STEPS}")
def op_s13_path_clauses(spark: SparkSession, d: str) -> DataFrame:
    told = paths.compact(F.col("steps"), F.col("q_id").cast("string"))
    return _paths(spark, d).select("q_id", F.regexp_replace(told, "^[^:]*: ", "").alias("body"))


# --- beliefs in words --------------------------------------------------------


@op("""SELECT belief_id, 'Belief ' || belief_id || ' is supported by ' || coalesce(support_id, 'none') || '. Evidence: ' || CASE WHEN role = 'user' THEN '[turn] ' || role || ' (w=0.5)' ELSE 'no direct evidence' END || '.' AS text FROM belief""", graph=True)
def op_g20_belief_text(spark: SparkSession, d: str) -> DataFrame:
    b = p.beliefs(spark, d)
    supports = F.array_compact(F.array("support_id"))
    one = F.struct(F.lit("turn").alias("source"), F.col("role").alias("snippet"), F.lit(0.5).alias("weight"))
    return b.select("belief_id", paths.belief_text(F.col("belief_id"), supports, F.filter(F.array(one), lambda e: e["snippet"] == "user")).alias("text"))


@op("""WITH e AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events)
SELECT CAST(user_id AS VARCHAR) AS claim_id, max(event_type) FILTER (WHERE r = 1) AS claim, max(least(1.0, greatest(0.0, value / 100))) FILTER (WHERE r = 1) AS confidence, count(*) AS n_evidence, string_agg(event_type, ',' ORDER BY event_id) AS evidence FROM e GROUP BY user_id""")
def op_r2_belief_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Claims told again and again: the last wording and confidence stay, evidence adds up."""
    e = p.read(spark, d, "events")
    told = e.select(F.col("user_id").cast("string").alias("claim_id"), F.col("event_type").alias("claim"), (F.col("value") / 100).alias("confidence"), F.col("event_id").alias("seq"),
                    F.array(F.struct(F.lit("log").alias("source"), F.col("event_type").alias("snippet"), F.lit(1.0).alias("weight"), F.lit(None).cast("string").alias("time"))).alias("evidence"))
    out = tms.upsert_claims(told)
    return out.select("claim_id", "claim", "confidence", F.size("evidence").cast("bigint").alias("n_evidence"), F.array_join(F.transform("evidence", lambda x: x["snippet"]), ",").alias("evidence"))


@op("""SELECT event_id, 'Claim ''' || event_type || ''' (conf ' || CASE WHEN event_id % 2 = 0 THEN '0.50' ELSE '1.00' END || ')' || CASE WHEN event_id % 3 = 0 THEN ' with no evidence.' ELSE ': [log @t1] seen (w=0.5)' END AS text FROM events""")
def op_r2_claim_text(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id")
    one = F.array(F.struct(F.lit("log").alias("source"), F.lit("seen").alias("snippet"), F.lit(0.5).alias("weight"), F.lit("t1").alias("time")))
    some = F.when(k % 3 != 0, one)
    return p.read(spark, d, "events").select("event_id", paths.claim_text(F.col("event_type"), F.when(k % 2 == 0, 0.5).otherwise(1.0), some).alias("text"))


# --- records to facts --------------------------------------------------------

_REC = """(SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'point' WHEN 1 THEN 'range' WHEN 2 THEN 'causal' WHEN 3 THEN 'sequence' WHEN 4 THEN 'overlap' ELSE 'era' END AS scope, 'Customer ' || CAST(o_custkey AS VARCHAR) AS who, strftime(o_orderdate, '%Y-%m-%d') AS s,
strftime(CAST(o_orderdate AS DATE) + 30, '%Y-%m-%d') AS e, o_orderpriority AS what FROM orders)"""


def _records(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    scope = F.element_at(F.array(*map(F.lit, ("point", "range", "causal", "sequence", "overlap", "era"))), (k % 6 + 1).cast("int"))
    who, none = F.concat(F.lit("Customer "), F.col("o_custkey").cast("string")), F.lit(None).cast("string")
    s, e = F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format(F.date_add("o_orderdate", 30), "yyyy-MM-dd")
    fact = lambda rel, obj: F.struct(who.alias("subject"), F.lit(rel).alias("relation"), obj.alias("object"), none.alias("value"), s.alias("start"), e.alias("end"))
    return p.read(spark, d, "orders").select(k.alias("id"), scope.alias("time_scope"), F.array(fact("placed", F.col("o_orderpriority")), fact("received", F.lit("parts"))).alias("gold_facts"))


@op(f"""SELECT id, CASE scope WHEN 'point' THEN 'point_in_time' WHEN 'range' THEN 'interval' WHEN 'causal' THEN 'causality' WHEN 'sequence' THEN 'sequence' ELSE 'overlap' END AS fact_type, CASE WHEN scope IN ('point', 'range') THEN who END AS entity, CASE WHEN scope = 'point' THEN s END AS date,
CASE WHEN scope = 'causal' THEN what END AS effect, CASE scope WHEN 'sequence' THEN who || ' placed ' || what || '; ' || who || ' received parts' WHEN 'overlap' THEN who || '; ' || what END AS events, CASE WHEN scope = 'overlap' THEN s || '–' || e END AS time_period FROM {_REC} WHERE scope <> 'era'""")
def op_n15_record_facts(spark: SparkSession, d: str) -> DataFrame:
    return fx.from_records(_records(spark, d)).select("id", "fact_type", "entity", "date", "effect", F.array_join("events", "; ").alias("events"), "time_period")


@op(f"""WITH q AS (SELECT id, scope, who, CAST(substr(s, 1, 4) AS VARCHAR) AS y FROM {_REC}) SELECT CAST(id AS VARCHAR) || '.q' || n AS question_id, kind AS question_type, answer AS correct_answer FROM (
SELECT id, '01' AS n, 'mcq' AS kind, y AS answer FROM q UNION ALL SELECT id, '02', 'fill_blank', who FROM q UNION ALL SELECT id, '03', CASE scope WHEN 'sequence' THEN 'timeline' WHEN 'causal' THEN 'inference' ELSE 'mcq' END, CASE WHEN scope IN ('sequence', 'causal') THEN NULL ELSE 'Statement A (author this)' END FROM q)""")
def op_n14_comprehension_questions(spark: SparkSession, d: str) -> DataFrame:
    return fx.comprehension_questions(_records(spark, d), 3).select("question_id", "question_type", "correct_answer")


@op(f"SELECT scope, CASE scope WHEN 'range' THEN 'interval' WHEN 'era' THEN 'other' ELSE scope END AS bucket, count(*) AS n FROM {_REC} GROUP BY 1, 2")
def op_n15_buckets(spark: SparkSession, d: str) -> DataFrame:
    return _records(spark, d).groupBy(F.col("time_scope").alias("scope"), bucket(F.col("time_scope")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
