"""Fidelity, preservation and coverage scores, and set operations, over rows read off the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fidelity as f
from ..functions.scores import accuracy
from ..operators import evals
from ..sources import projection as p
from .base import op

# A fact of each order and a text that tells it more or less faithfully.
_TOLD = """(SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'causality' WHEN 1 THEN 'interval' WHEN 2 THEN 'sequence' ELSE 'point' END AS kind, 'Customer ' || CAST(o_custkey AS VARCHAR) AS entity,
'ordered ' || strftime(o_orderdate, '%Y-%m-%d') AS fact, CASE o_orderkey % 5 WHEN 0 THEN 'Customer ' || CAST(o_custkey AS VARCHAR) || ' ordered in ' || CAST(year(o_orderdate) AS VARCHAR)
WHEN 1 THEN 'The customer ordered then in ' || CAST(year(o_orderdate) + 1 AS VARCHAR) WHEN 2 THEN 'During ' || CAST(year(o_orderdate) AS VARCHAR) || ' it led to more'
WHEN 3 THEN 'Nothing is known' ELSE 'Customer ' || CAST(o_custkey AS VARCHAR) || ' waited from ' || CAST(year(o_orderdate) AS VARCHAR) || ' to ' || CAST(year(o_orderdate) + 2 AS VARCHAR) END AS text FROM orders)"""


def _told(spark: SparkSession, d: str) -> DataFrame:
    k, y = F.col("o_orderkey"), F.year("o_orderdate")
    who = F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))
    kind = F.when(k % 4 == 0, "causality").when(k % 4 == 1, "interval").when(k % 4 == 2, "sequence").otherwise("point")
    text = (
        F.when(k % 5 == 0, F.concat(who, F.lit(" ordered in "), y.cast("string"))).when(k % 5 == 1, F.concat(F.lit("The customer ordered then in "), (y + 1).cast("string")))
        .when(k % 5 == 2, F.concat(F.lit("During "), y.cast("string"), F.lit(" it led to more"))).when(k % 5 == 3, "Nothing is known")
        .otherwise(F.concat(who, F.lit(" waited from "), y.cast("string"), F.lit(" to "), (y + 2).cast("string")))
    )
    return p.read(spark, d, "orders").select(k.alias("id"), kind.alias("kind"), who.alias("entity"), F.concat(F.lit("ordered "), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("fact"), text.alias("text"))


_YEARS = "list_distinct(list_transform(regexp_extract_all({x}, '\\b(1[0-9]{{3}}|2[0-9]{{3}})\\b'), lambda y: CAST(y AS BIGINT)))"
_HAS = lambda words: "(" + " OR ".join(f"contains(lower(text), '{w}')" for w in words) + ")"
_PRESERVED = f"""(SELECT *, least(1.0, len(list_filter({_YEARS.format(x="fact")}, lambda y: contains(text, CAST(y AS VARCHAR)))) / len({_YEARS.format(x="fact")}) + CASE WHEN {_HAS(f.TEMPORAL_WORDS)} THEN 0.1 ELSE 0.0 END) AS date_score,
CASE WHEN contains(lower(text), lower(entity)) THEN 1.0 WHEN contains(lower(text), 'customer') OR contains(lower(text), split_part(entity, ' ', 2)) THEN 0.7 ELSE 0.0 END AS entity_score,
CASE kind WHEN 'causality' THEN CASE WHEN {_HAS(f.RELATION_WORDS["causal"])} THEN 1.0 ELSE 0.3 END WHEN 'interval' THEN CASE WHEN {_HAS(f.RELATION_WORDS["interval"])} THEN 1.0 ELSE 0.3 END
WHEN 'sequence' THEN CASE WHEN {_HAS(f.RELATION_WORDS["sequence"])} THEN 1.0 ELSE 0.3 END ELSE 0.7 END AS relation_score,
len(list_filter({_YEARS.format(x="text")}, lambda y: NOT list_contains({_YEARS.format(x="fact")}, y))) > 0 AS hallucinated FROM {_TOLD})"""


def _preserved(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("text")
    return _told(spark, d).select(
        "id", "kind", "text", f.date_preservation(F.col("fact"), text).alias("date_score"), f.entity_preservation(F.col("entity"), text).alias("entity_score"),
        f.relation_preservation(F.col("kind"), text).alias("relation_score"), f.hallucinated(F.col("fact"), text).alias("hallucinated"),
    )


@op(f"SELECT id, round(date_score, 6) AS date_score, entity_score, relation_score, hallucinated FROM {_PRESERVED}")
def op_m8_preservation(spark: SparkSession, d: str) -> DataFrame:
    return _preserved(spark, d).select("id", F.round("date_score", 6).alias("date_score"), "entity_score", "relation_score", "hallucinated")


_OVERALL = "(0.4 * date_score + 0.3 * entity_score + 0.3 * relation_score) * CASE WHEN hallucinated THEN 0.5 ELSE 1.0 END"


def _scored(spark: SparkSession, d: str) -> DataFrame:
    s = _preserved(spark, d)
    return s.withColumn("overall", accuracy(F.col("date_score"), F.col("entity_score"), F.col("relation_score"), F.col("hallucinated")))


@op(f"SELECT round(avg(date_score), 6) AS date_score, round(avg(entity_score), 6) AS entity_score, round(avg(relation_score), 6) AS relation_score, round(avg(CAST(hallucinated AS INT)), 6) AS hallucination_rate, round(avg({_OVERALL}), 6) AS overall FROM {_PRESERVED}")
def op_a16_accuracy(spark: SparkSession, d: str) -> DataFrame:
    return evals.accuracy_means(_scored(spark, d))


@op(f"""WITH s AS (SELECT kind, CASE WHEN id % 3 = 0 THEN 'polished' ELSE 'template' END AS source, {_OVERALL} AS overall FROM {_PRESERVED})
SELECT kind, round(avg(overall), 6) AS overall, round(avg(overall) FILTER (WHERE source = 'template'), 6) AS template_accuracy, round(avg(overall) FILTER (WHERE source = 'polished'), 6) AS polished_accuracy,
round(avg(overall) FILTER (WHERE source = 'template') - avg(overall) FILTER (WHERE source = 'polished'), 6) AS gap FROM s GROUP BY kind""")
def op_a22_accuracy_by_type(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d).withColumn("source", F.when(F.col("id") % 3 == 0, "polished").otherwise("template"))
    return evals.accuracy_by_type(s)


# Gold facts of each order: its lines' dates, in order of date.
_GOLD = """(SELECT o_orderkey AS id, 'customer ' || CAST(o_custkey AS VARCHAR) AS who, o_orderpriority AS what, strftime(o_orderdate, '%Y-%m-%d') AS day, year(o_orderdate) AS y,
CASE o_orderkey % 3 WHEN 0 THEN 'Customer ' || CAST(o_custkey AS VARCHAR) || ' placed it in ' || CAST(year(o_orderdate) AS VARCHAR) WHEN 1 THEN 'It was ' || o_orderpriority || ' in 1901 and ' || CAST(year(o_orderdate) AS VARCHAR) ELSE 'unknown' END AS text FROM orders)"""


def _gold(spark: SparkSession, d: str) -> DataFrame:
    k, y = F.col("o_orderkey"), F.year("o_orderdate").cast("string")
    who = F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))
    text = F.when(k % 3 == 0, F.concat(who, F.lit(" placed it in "), y)).when(k % 3 == 1, F.concat(F.lit("It was "), "o_orderpriority", F.lit(" in 1901 and "), y)).otherwise("unknown")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    fact = F.struct(who.alias("subject"), F.lit("placed").alias("relation"), F.col("o_orderpriority").alias("object"), F.lit("12.5").alias("value"), day.alias("start"), F.lit(None).cast("string").alias("end"))
    return p.read(spark, d, "orders").select(k.alias("id"), F.array(fact, fact).alias("facts"), text.alias("text"), F.year("o_orderdate").cast("bigint").alias("y"))


_IN = lambda x: f"CAST(contains(lower(text), {x}) AS INT)"


@op(f"""SELECT id, 4 AS n_atoms, round(({_IN("who")} + {_IN("lower(what)")} + {_IN("'placed'")} + {_IN("CAST(y AS VARCHAR)")}) / 4.0, 6) AS recall, round(({_IN("who")} + {_IN("lower(what)")}) / 2.0, 6) AS coverage,
round(coalesce(len(list_filter({_YEARS.format(x="text")}, lambda z: z <> y)) / nullif(len({_YEARS.format(x="text")}), 0), 0.0), 6) AS extra FROM {_GOLD}""")
def op_m9_fact_recall(spark: SparkSession, d: str) -> DataFrame:
    g, text = _gold(spark, d), F.col("text")
    atoms = f.fact_atoms(F.col("facts"))
    return g.select(
        "id", F.size(atoms).alias("n_atoms"), F.round(f.mentioned(atoms, text), 6).alias("recall"), F.round(f.mentioned(f.fact_entities(F.col("facts")), text), 6).alias("coverage"),
        F.round(f.extra_year_ratio(text, F.array("y")), 6).alias("extra"),
    )


# Ranges of each order: gold from the order to 30 days later; told with both ends moved.
_TIER = lambda x: f"CASE WHEN abs({x}) <= 1 THEN 1.0 WHEN abs({x}) <= 7 THEN 0.8 ELSE 0.0 END"
_A, _B = "(o_orderkey % 11)", "(o_orderkey % 13 - 6)"


@op(f"""WITH s AS (SELECT o_orderkey AS id, 0.5 * ({_TIER(_A)} + {_TIER(_B)}) AS b, CASE WHEN o_orderkey % 2 = 0 THEN least(abs({_B} - {_A}), abs(o_orderkey % 40 - 30)) ELSE abs({_B} - {_A}) END AS diff FROM orders)
SELECT id, b AS boundary, {_TIER("diff")} AS duration FROM s""")
def op_m10_interval_accuracy(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    rows = p.read(spark, d, "orders").select(
        k.alias("id"), F.array(F.struct(day.alias("s"), F.date_add(day, 30).alias("e"))).alias("gold"),
        f.pair_ranges(F.array(F.date_add(day, (30 + k % 13 - 6).cast("int")), F.date_add(day, (k % 11).cast("int")))).alias("found"),
        F.when(k % 2 == 0, F.array((k % 40).cast("double"))).otherwise(F.array().cast("array<double>")).alias("days"),
    )
    return rows.select("id", f.boundary_accuracy(F.col("found"), F.col("gold")).alias("boundary"), f.duration_correctness(F.col("found"), F.col("days"), F.col("gold")).alias("duration"))


@op("""WITH s AS (SELECT p_partkey AS id, split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, p_partkey % 3 AS k FROM part), t AS (SELECT id, a, b, CASE k WHEN 0 THEN 'first ' || a || ' then ' || b WHEN 1 THEN 'the ' || b || ' and the ' || a ELSE 'only ' || a END AS text FROM s)
SELECT id, CASE WHEN a = b OR instr(text, a) = 0 OR instr(text, b) = 0 THEN CASE WHEN a = b THEN NULL ELSE 0.0 END WHEN instr(text, a) < instr(text, b) THEN 1.0 ELSE 0.0 END AS ordering FROM t""")
def op_w15_sequence_order(spark: SparkSession, d: str) -> DataFrame:
    k, word = F.col("p_partkey"), lambda n: F.split_part("p_name", F.lit(" "), F.lit(n))
    a, b = word(1), word(2)
    text = F.when(k % 3 == 0, F.concat(F.lit("first "), a, F.lit(" then "), b)).when(k % 3 == 1, F.concat(F.lit("the "), b, F.lit(" and the "), a)).otherwise(F.concat(F.lit("only "), a))
    rows = p.read(spark, d, "part").select(k.alias("id"), F.array_distinct(F.array(a, b)).alias("items"), text.alias("text"))
    return rows.select("id", f.order_accuracy(F.col("items"), F.col("text")).alias("ordering"))


_Y = lambda n: f"(1990 + (o_orderkey + {n}) % 4)"


@op(f"""WITH s AS (SELECT o_orderkey AS id, [{_Y(0)}, {_Y(1)}, {_Y(2)}] AS a, [{_Y(1)}, 1990 + o_orderkey % 3, {_Y(2)}] AS b FROM orders),
c AS (SELECT id, max(len(m.x)) AS n FROM s, (SELECT unnest([[1],[2],[3],[1,2],[1,3],[2,3],[1,2,3]]) AS x) m, (SELECT unnest([[1],[2],[3],[1,2],[1,3],[2,3],[1,2,3]]) AS z) q
WHERE len(m.x) = len(q.z) AND list_transform(m.x, lambda i: a[i]) = list_transform(q.z, lambda i: b[i]) GROUP BY id)
SELECT s.id, CAST(coalesce(c.n, 0) AS INT) AS lcs FROM s LEFT JOIN c ON s.id = c.id""")
def op_w16_year_lcs(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    y = lambda n: 1990 + (k + n) % 4
    return p.read(spark, d, "orders").select(k.alias("id"), f.lcs_length(F.array(y(0), y(1), y(2)), F.array(y(1), 1990 + k % 3, y(2))).alias("lcs"))


@op("""SELECT l_orderkey, l_linenumber, round(CASE l_linenumber % 3 WHEN 0 THEN l_quantity WHEN 1 THEN (l_quantity + l_discount) / 2 ELSE (l_quantity + l_discount + l_tax) / 3 END, 6) AS quality FROM lineitem""")
def op_m12_quality_proxy(spark: SparkSession, d: str) -> DataFrame:
    n, none = F.col("l_linenumber") % 3, F.lit(None).cast("double")
    a = F.when(n >= 1, F.col("l_discount")).otherwise(F.lit(float("nan")))
    return p.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(f.mean_of_present(F.col("l_quantity"), a, F.when(n == 2, F.col("l_tax")).otherwise(none)), 6).alias("quality"))


@op("""SELECT p_brand, count(*) AS n, count(CASE WHEN p_size % 4 IN (0, 3) THEN 1 END) AS n_values, round(avg(CASE p_size % 4 WHEN 0 THEN p_retailprice WHEN 3 THEN 1.5 END), 6) AS mean FROM part GROUP BY p_brand""")
def op_r11_safe_floats(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size") % 4
    raw = F.when(s == 0, F.col("p_retailprice").cast("string")).when(s == 1, "n/a").when(s == 2, "NaN").otherwise("1.5")
    v = p.read(spark, d, "part").select("p_brand", f.safe_float(raw).alias("v"))
    return v.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count("v").alias("n_values"), F.round(F.avg("v"), 6).alias("mean"))


@op("""WITH r AS (SELECT o_orderstatus AS condition, o_totalprice AS m, CASE WHEN o_orderkey % 2 = 0 THEN o_shippriority END AS x FROM (SELECT *, o_custkey % 7 AS o_shippriority FROM orders))
SELECT condition, count(*) AS n, round(avg((m + coalesce(x, 0)) / CASE WHEN x IS NULL THEN 1 ELSE 2 END), 4) AS tlx, round(avg(x), 6) AS effort FROM r GROUP BY condition""")
def op_a14_cognitive_load(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("o_orderkey") % 2 == 0, F.col("o_custkey") % 7)
    rows = p.read(spark, d, "orders").select(F.col("o_orderstatus").alias("condition"), F.col("o_totalprice").alias("tlx_mental"), x.alias("tlx_effort"), x.alias("mental_effort"))
    return evals.cognitive_load(rows, ["tlx_mental", "tlx_effort"], "mental_effort")


@op("""WITH s AS (SELECT o_orderpriority AS domain, avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 1) / avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0) - 1 AS gain, avg(o_custkey) FILTER (WHERE o_orderkey % 2 = 1) - avg(o_custkey) FILTER (WHERE o_orderkey % 2 = 0) AS delta FROM orders GROUP BY 1)
SELECT domain, gain >= 0.20 AS success, delta >= 0.3 AS confidence, CAST(NULL AS BOOLEAN) AS time, 0.9 >= 0.7 AS agreement FROM s""")
def op_a25_success_criteria(spark: SparkSession, d: str) -> DataFrame:
    with_it, without = F.col("o_orderkey") % 2 == 1, F.col("o_orderkey") % 2 == 0
    mean = lambda c, w: F.avg(F.when(w, F.col(c)))
    s = p.read(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("domain")).agg(
        (mean("o_totalprice", with_it) / mean("o_totalprice", without) - 1).alias("success"), (mean("o_custkey", with_it) - mean("o_custkey", without)).alias("confidence"),
        F.lit(None).cast("double").alias("time"), F.lit(0.9).alias("agreement"),
    )
    return evals.success_criteria(s)


@op("""WITH r AS (SELECT o_orderkey AS id, 1 + o_orderkey % 3 AS n_gold, CAST(o_orderkey % 2 = 0 AS INT) AS first_ok FROM orders)
SELECT round(sum(CASE WHEN n_gold >= 2 THEN first_ok + 1 ELSE first_ok END) / sum(least(2, n_gold)), 6) AS accuracy, CAST(sum(least(2, n_gold)) AS BIGINT) AS total FROM r""")
def op_a20_normalisation_accuracy(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    rows = p.read(spark, d, "orders").select(F.array(day, F.lit("P3D")).alias("predicted"), F.slice(F.array(F.when(k % 2 == 0, day).otherwise("no"), F.lit("P3D"), F.lit("x")), 1, (1 + k % 3).cast("int")).alias("gold"))
    return evals.positional_accuracy(rows)


@op("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(CASE WHEN o_custkey % 3 = 0 THEN 1.0 ELSE 0.0 END), 6) AS exact, round(avg(CASE WHEN o_custkey % 3 < 2 THEN 1.0 ELSE 0.0 END), 6) AS contains, round(avg(o_totalprice), 4) AS latency FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority))""")
def op_a17_qa_metrics(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("o_custkey") % 3
    rows = p.read(spark, d, "orders").select("o_orderstatus", "o_orderpriority", (c == 0).cast("double").alias("exact"), (c < 2).cast("double").alias("contains"), F.col("o_totalprice").alias("latency"))
    return evals.qa_metrics(rows, "o_orderstatus", "o_orderpriority")


@op("""WITH s AS (SELECT p_partkey, string_split(p_name, ' ') AS a, string_split(lower(p_type), ' ') AS b FROM part)
SELECT p_partkey, CAST(len(list_intersect(a, b)) AS INT) AS shared, CAST(len(list_filter(list_distinct(a), lambda x: NOT list_contains(b, x))) AS INT) AS only_a, CAST(len(list_distinct(list_concat(a, b))) AS INT) AS all_words, len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AS subset FROM s""")
def op_u2_word_sets(spark: SparkSession, d: str) -> DataFrame:
    """Intersection, difference, union and subset of the words of a part's name and type."""
    a, b = F.split("p_name", " "), F.split(F.lower("p_type"), " ")
    return p.read(spark, d, "part").select("p_partkey", F.size(F.array_intersect(a, b)).alias("shared"), F.size(F.array_except(a, b)).alias("only_a"), F.size(F.array_union(a, b)).alias("all_words"), (F.size(F.array_except(a, b)) == 0).alias("subset"))


@op("""WITH w AS (SELECT p_partkey, u.w, u.i FROM part, (SELECT unnest(generate_series(1, 6)) AS i) g, LATERAL (SELECT string_split(p_name || ' ' || lower(p_type) || ' ' || p_name, ' ')[g.i] AS w, g.i AS i) u WHERE u.w IS NOT NULL),
f AS (SELECT p_partkey, w, min(i) AS i FROM w GROUP BY p_partkey, w) SELECT p_partkey, string_agg(w, ' ' ORDER BY i) AS words FROM f GROUP BY p_partkey""")
def op_u4_ordered_unique(spark: SparkSession, d: str) -> DataFrame:
    words = F.slice(F.split(F.concat_ws(" ", "p_name", F.lower("p_type"), "p_name"), " "), 1, 6)
    return p.read(spark, d, "part").select("p_partkey", F.array_join(F.array_distinct(words), " ").alias("words"))


@op("""SELECT uid, min(route) AS route FROM (SELECT source_uid AS uid, 1 AS route FROM tkg_edges WHERE relation = 'caused' UNION ALL SELECT target_uid, 2 FROM tkg_edges WHERE relation = 'part_of' UNION ALL SELECT source_uid, 3 FROM tkg_edges WHERE relation = 'located_in') GROUP BY uid""", graph=True)
def op_u1_union_routes(spark: SparkSession, d: str) -> DataFrame:
    """Uids of three routes, each under the first route that has it."""
    e = p.membership_edges(spark, d)
    routes = [p.caused_edges(spark, d).select(F.col("source_uid").alias("uid")), e.where("relation = 'part_of'").select(F.col("target_uid").alias("uid")), e.where("relation = 'located_in'").select(F.col("source_uid").alias("uid"))]
    return evals.first_route(routes)


@op("""WITH s AS (SELECT p_partkey, regexp_replace(lower(p_name), '[^a-z0-9]+', '_', 'g') AS x, regexp_replace(lower(CASE p_partkey % 4 WHEN 0 THEN 'The ' || p_name WHEN 1 THEN split_part(p_name, ' ', 1) WHEN 2 THEN p_name || ' big new red thing' ELSE 'something else entirely' END), '[^a-z0-9]+', '_', 'g') AS y0 FROM part),
t AS (SELECT p_partkey, x, regexp_replace(y0, '^(the|a|an)_', '') AS y FROM s), w AS (SELECT p_partkey, x, y, list_distinct(string_split(x, '_')) AS p, list_distinct(string_split(y, '_')) AS g FROM t)
SELECT p_partkey, x = y OR len(list_intersect(p, g)) IN (len(p), len(g)) OR len(list_intersect(p, g)) / len(list_distinct(list_concat(p, g))) >= 0.5 AS matches FROM w""")
def op_m11_slot_match(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey") % 4, F.col("p_name")
    other = F.when(k == 0, F.concat(F.lit("The "), n)).when(k == 1, F.split_part(n, F.lit(" "), F.lit(1))).when(k == 2, F.concat(n, F.lit(" big new red thing"))).otherwise("something else entirely")
    return p.read(spark, d, "part").select("p_partkey", f.slots_match(n, other).alias("matches"))


@op("SELECT p_partkey, p_partkey % 3 <> 1 AS covers FROM part")
def op_u5_slot_cover(spark: SparkSession, d: str) -> DataFrame:
    k, word = F.col("p_partkey") % 3, F.concat(F.lit("value "), F.col("p_partkey").cast("string"))
    gold = F.create_map(F.lit("entity"), word, F.lit("date"), F.lit("1999"))
    mine = F.when(k == 0, F.create_map(F.lit("entity"), F.concat(F.lit("the "), word))).when(k == 1, F.create_map(F.lit("event"), word)).otherwise(F.create_map(F.lit("entity"), word, F.lit("date"), F.lit("2000")))
    return p.read(spark, d, "part").select("p_partkey", f.slots_cover(mine, gold, F.lit("date")).alias("covers"))


_SCOPE = "(SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'Point' WHEN 1 THEN ' timestamp ' WHEN 2 THEN 'duration' WHEN 3 THEN 'ordering' WHEN 4 THEN 'causality' WHEN 5 THEN 'OVERLAP' ELSE 'era' END AS scope FROM orders)"


@op(f"SELECT scope, CASE lower(trim(scope)) WHEN 'point' THEN 'point' WHEN 'timestamp' THEN 'point' WHEN 'duration' THEN 'interval' WHEN 'ordering' THEN 'sequence' WHEN 'causality' THEN 'causal' WHEN 'overlap' THEN 'overlap' ELSE 'other' END AS bucket, count(*) AS n FROM {_SCOPE} GROUP BY 1, 2")
def op_p21_buckets(spark: SparkSession, d: str) -> DataFrame:
    scope = F.element_at(F.array(*map(F.lit, ("Point", " timestamp ", "duration", "ordering", "causality", "OVERLAP", "era"))), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return p.read(spark, d, "orders").select(scope.alias("scope")).groupBy("scope", f.bucket(F.col("scope")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@op("""WITH t AS (SELECT l_orderkey AS id, l_linenumber AS item, year(l_shipdate) AS y FROM lineitem)
SELECT a.id, a.item AS a_item, b.item AS b_item, a.y <> b.y AS contradicts FROM t a JOIN t b ON a.id = b.id AND a.item < b.item""")
def op_p20_contradicting_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of explanations of a scenario (a handful each) whose years are apart."""
    y = F.year("l_shipdate").cast("string")
    rows = p.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("item"), F.concat(F.lit("it shipped in "), y).alias("text"))
    return evals.pair_scores(rows).select("id", "a_item", "b_item", "contradicts")


@op("""WITH t AS (SELECT l_orderkey AS id, l_linenumber AS item, [split_part(p_name, ' ', 1), split_part(p_name, ' ', 2)] AS w FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT a.id, count(*) AS pairs, round(avg(len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w)))), 6) AS overlap FROM t a JOIN t b ON a.id = b.id AND a.item < b.item GROUP BY a.id""")
def op_j14_scenario_overlap(spark: SparkSession, d: str) -> DataFrame:
    lines, parts = p.read(spark, d, "lineitem"), p.read(spark, d, "part")
    rows = lines.join(parts, lines["l_partkey"] == parts["p_partkey"]).select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("item"), F.col("p_name").alias("text"))
    return evals.pair_scores(rows).groupBy("id").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("overlap"), 6).alias("overlap"))


@op("""SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 1.0 ELSE 0.0 END AS has_year, p_size % 3 = 0 AND p_partkey % 2 = 0 AS supported FROM part""")
def op_r30_support_check(spark: SparkSession, d: str) -> DataFrame:
    from ..plans.nlg import content_years, supported

    fact = F.concat(F.lit("engine number"), F.col("p_partkey").cast("string"), F.lit(" built 1987"))
    said = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("The engine number"), F.col("p_partkey").cast("string"))).otherwise(F.lit("The engine"))
    text = F.when(F.col("p_size") % 3 == 0, F.concat(said, F.lit(" from 1987"))).otherwise(said)
    return p.read(spark, d, "part").select("p_partkey", (F.size(content_years(text)) > 0).cast("double").alias("has_year"), supported(fact, text).alias("supported"))
