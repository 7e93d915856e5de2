"""Evaluation aggregates over runs that are read off the order lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import accuracy, likert_unit
from ..operators import evals
from ..sources import projection as p
from .base import op

_RUNS = "(SELECT l_returnflag AS method, l_linenumber AS level, l_quantity AS latency_ms FROM lineitem)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    return p.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_linenumber").alias("level"), F.col("l_quantity").alias("latency_ms"))


_RANK = "list_sort(list(latency_ms))[CAST(round_even((count(*) - 1) * {s}, 0) AS BIGINT) + 1]"


@op(f"SELECT method, level, count(*) AS n, round(avg(latency_ms), 4) AS mean_ms, {_RANK.format(s=0.5)} AS p50_ms, {_RANK.format(s=0.95)} AS p95_ms, round(1000.0 / avg(latency_ms), 4) AS throughput FROM {_RUNS} GROUP BY GROUPING SETS ((method), (method, level))")
def op_a7_efficiency(spark: SparkSession, d: str) -> DataFrame:
    return evals.efficiency(_runs(spark, d))


@op(f"SELECT method, round(stddev_pop(latency_ms), 4) AS sd, list_sort(list(latency_ms))[CAST(floor(count(*) * 0.5) AS BIGINT) + 1] AS p50, list_sort(list(latency_ms))[CAST(floor(count(*) * 0.95) AS BIGINT) + 1] AS p95 FROM {_RUNS} GROUP BY method")
def op_r29_run_metrics(spark: SparkSession, d: str) -> DataFrame:
    return evals.run_metrics(_runs(spark, d))


@op("SELECT l_returnflag AS method, round(avg(l_discount), 6) AS update_accuracy, round(avg(CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0.0 END), 6) AS contradiction_rate FROM lineitem GROUP BY l_returnflag")
def op_a9_consistency(spark: SparkSession, d: str) -> DataFrame:
    return evals.consistency(p.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("method"), F.col("l_discount").alias("update_accuracy"), (F.col("l_tax") > 0.04).alias("contradicted")))


@op("""WITH r AS (SELECT CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_brand END AS style, p_retailprice AS value FROM part)
SELECT 'overall' AS style, round(coalesce(avg(value) FILTER (WHERE style IS NULL), avg(value)), 6) AS value FROM r UNION ALL SELECT style, round(avg(value), 6) FROM r WHERE style IS NOT NULL GROUP BY style""")
def op_a10_coherence(spark: SparkSession, d: str) -> DataFrame:
    return evals.coherence(p.read(spark, d, "part").select(F.when(F.col("p_size") % 5 != 0, F.col("p_brand")).alias("style"), F.col("p_retailprice").alias("value")))


@op("SELECT p_type, count(*) AS n, round(avg(p_size), 6) AS p_size, round(avg(p_retailprice), 6) AS p_retailprice FROM part GROUP BY p_type")
def op_a11_granularity(spark: SparkSession, d: str) -> DataFrame:
    return evals.grouped_means(p.read(spark, d, "part"), ["p_type"], ["p_size", "p_retailprice"])


@op("SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 6) AS o_totalprice FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority))")
def op_a12_comprehension(spark: SparkSession, d: str) -> DataFrame:
    return evals.cube_means(p.read(spark, d, "orders"), "o_orderstatus", "o_orderpriority", "o_totalprice")


@op("""WITH s AS (SELECT o_orderpriority AS domain, avg(CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0.0 END END) AS b, avg(CASE WHEN o_orderkey % 2 = 1 THEN CASE WHEN o_totalprice > 100000 THEN 1.0 ELSE 0.0 END END) AS o FROM orders GROUP BY o_orderpriority)
SELECT domain, round(b, 6) AS base, round(o, 6) AS other, round((o - b) / nullif(b, 0), 6) AS gain FROM s""")
def op_a13_utility(spark: SparkSession, d: str) -> DataFrame:
    rows = p.read(spark, d, "orders").select(F.col("o_orderpriority").alias("domain"), F.when(F.col("o_orderkey") % 2 == 0, "plain").otherwise("explained").alias("condition"), (F.col("o_totalprice") > 100000).alias("success"))
    return evals.improvement(rows, "plain", "explained")


@op("SELECT l_linestatus, metric, round(avg(value), 6) AS mean FROM (SELECT l_linestatus, 'l_quantity' AS metric, l_quantity AS value FROM lineitem UNION ALL SELECT l_linestatus, 'l_discount', l_discount FROM lineitem UNION ALL SELECT l_linestatus, 'l_tax', l_tax FROM lineitem) GROUP BY l_linestatus, metric")
def op_a15_all_means(spark: SparkSession, d: str) -> DataFrame:
    return evals.all_means(p.read(spark, d, "lineitem").select("l_linestatus", "l_quantity", "l_discount", "l_tax"), "l_linestatus", ["l_quantity", "l_discount", "l_tax"])


_LABELS = """WITH g AS (SELECT doc_id AS id, CASE quality WHEN 1 THEN 'good' ELSE 'poor' END AS label FROM labels), p AS (SELECT doc_id AS id, CASE WHEN n_chars > 800 THEN 'good' ELSE 'poor' END AS label FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)),
c AS (SELECT coalesce(g.label, p.label) AS label, count(*) FILTER (WHERE g.id IS NOT NULL AND p.id IS NOT NULL) AS tp, count(*) FILTER (WHERE g.id IS NULL) AS fp, count(*) FILTER (WHERE p.id IS NULL) AS fn FROM g FULL JOIN p ON g.id = p.id AND g.label = p.label GROUP BY 1)"""


def _counts(spark: SparkSession, d: str) -> DataFrame:
    gold = p.read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label"))
    docs = p.read(spark, d, "documents").select(F.col("doc_id").alias("id"), F.when(F.col("n_chars") > 800, "good").otherwise("poor").alias("label"))
    return evals.label_counts(gold, docs.join(gold.select("id"), "id", "left_semi"))


@op(f"{_LABELS} SELECT label, tp, fp, fn, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0), 6) AS f1 FROM c")
def op_a19_label_f1(spark: SparkSession, d: str) -> DataFrame:
    return evals.f1(_counts(spark, d))


@op(f"{_LABELS} SELECT round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS micro_f1, round(avg(2 * tp / (2 * tp + fp + fn)), 6) AS macro_f1 FROM c")
def op_a19_micro_macro(spark: SparkSession, d: str) -> DataFrame:
    return evals.micro_macro(_counts(spark, d))


@op("""WITH r AS (SELECT o_orderkey AS id, list_distinct(list(l_partkey % 50)) AS gold, list_distinct(list(l_suppkey % 50)) AS predicted FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey)
SELECT round(avg(2 * len(list_intersect(gold, predicted)) / (len(gold) + len(predicted))), 6) AS span_f1 FROM r""")
def op_a18_span_f1(spark: SparkSession, d: str) -> DataFrame:
    rows = p.read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(F.col("l_partkey") % 50).alias("gold"), F.collect_set(F.col("l_suppkey") % 50).alias("predicted"))
    return evals.span_f1(rows)


@op("SELECT o_orderpriority, round(avg(CASE WHEN o_totalprice > 50000 AND o_orderkey % 4 > 0 THEN 1.0 ELSE 0.0 END), 6) AS pass_rate FROM orders GROUP BY o_orderpriority")
def op_a23_pass_rate(spark: SparkSession, d: str) -> DataFrame:
    ok = ((F.col("o_totalprice") > 50000) & (F.col("o_orderkey") % 4 > 0)).cast("double")
    return p.read(spark, d, "orders").groupBy("o_orderpriority").agg(F.round(F.avg(ok), 6).alias("pass_rate"))


@op("""WITH c AS (SELECT o_orderkey AS query_id, o_orderstatus <> 'F' AS i, o_orderkey % 5 = 0 AS f, o_totalprice > 150000 AS l FROM orders)
SELECT query_id, NOT (i OR f OR l) AS ok, array_to_string(list_filter([CASE WHEN i THEN 'intent' END, CASE WHEN f THEN 'facts' END, CASE WHEN l THEN 'latency' END], lambda x: x IS NOT NULL), ',') AS reasons FROM c""")
def op_a24_harness(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    cases = p.read(spark, d, "orders").select(
        k.alias("query_id"), F.col("o_orderstatus").alias("intent"), F.lit("F").alias("want_intent"), F.array(F.lit("a"), F.when(k % 5 != 0, F.lit("b")).otherwise(F.lit("c"))).alias("facts"),
        F.array(F.lit("a"), F.lit("b")).alias("required"), F.col("o_totalprice").alias("latency_ms"), F.lit(150000.0).alias("budget_ms"),
    )
    return evals.harness(cases)


@op("""WITH t AS (SELECT l_orderkey AS id, l_linenumber AS item, year(l_shipdate) AS s, year(l_shipdate) + l_linenumber % 2 AS e FROM lineitem)
SELECT id, count(*) * (count(*) - 1) // 2 AS pairs, (SELECT count(*) FROM t a JOIN t b ON a.id = b.id AND a.e < b.s WHERE a.id = t.id) AS contradicting FROM t GROUP BY id""")
def op_j14_scenario_pairs(spark: SparkSession, d: str) -> DataFrame:
    y = F.year("l_shipdate").cast("bigint")
    return evals.scenario_pairs(p.read(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("item"), y.alias("start_year"), (y + F.col("l_linenumber") % 2).alias("end_year")))


@op("SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 5 THEN (p_size - 1) / 4 ELSE greatest(0.0, least(1.0, p_size)) END AS unit, round((0.4 * (p_size / 50.0) + 0.3 * 0.5 + 0.3 * 1.0) * CASE WHEN p_size > 40 THEN 0.5 ELSE 1.0 END, 6) AS accuracy, 1 + least(4, p_size // 3) AS level FROM part")
def op_m7_unit_scores(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("p_size")
    return p.read(spark, d, "part").select("p_partkey", likert_unit(s).cast("double").alias("unit"), F.round(accuracy(s / 50.0, F.lit(0.5), F.lit(1.0), s > 40), 6).alias("accuracy"), (1 + F.least(F.lit(4), F.floor(s / 3))).cast("int").alias("level"))
