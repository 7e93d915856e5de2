"""Evaluation aggregates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.fidelity import lcs_length, mean_of_present, safe_float
from ..functions.text import tokens
from ..functions.timefn import years_in


def at_ranks(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """keys, and for each name the value at a rank (from 0) that a function of the group's size gives.

    Equal values are counted first, so a group is ordered by its distinct values
    with their counts; no group's rows are gathered.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = counts.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    placed = counts.withColumn("_upto", F.sum("_c").over(upto)).join(size, keys)
    at = lambda f: F.greatest(F.lit(0), F.least(f(F.col("_n")), F.col("_n") - 1))
    return placed.groupBy(*keys).agg(*[F.min(F.when(F.col("_upto") > at(f), F.col(value))).alias(name) for name, f in ranks.items()])


def nearest_rank(share: float) -> Callable[[Column], Column]:
    """The rounded (half to even) place."""
    return lambda n: F.bround((n - 1) * share).cast("bigint")


def floor_rank(share: float) -> Callable[[Column], Column]:
    return lambda n: F.floor(n * share).cast("bigint")


def efficiency(runs: DataFrame) -> DataFrame:
    """By method, and by method and level: latency figures and throughput."""
    figures = [F.count(F.lit(1)).alias("n"), F.round(F.avg("latency_ms"), 4).alias("mean_ms"), F.round(1000.0 / F.avg("latency_ms"), 4).alias("throughput")]
    ranks = {"p50_ms": nearest_rank(0.50), "p95_ms": nearest_rank(0.95)}
    none = F.lit(None).cast(dict(runs.dtypes)["level"])
    by_method = runs.groupBy("method").agg(*figures).join(at_ranks(runs, ["method"], "latency_ms", ranks), "method").withColumn("level", none)
    by_both = runs.groupBy("method", "level").agg(*figures).join(at_ranks(runs, ["method", "level"], "latency_ms", ranks), ["method", "level"])
    return by_method.unionByName(by_both).select("method", "level", "n", "mean_ms", "p50_ms", "p95_ms", "throughput")


def run_metrics(runs: DataFrame) -> DataFrame:
    ranks = at_ranks(runs, ["method"], "latency_ms", {"p50": floor_rank(0.5), "p95": floor_rank(0.95)})
    return runs.groupBy("method").agg(F.round(F.stddev_pop("latency_ms"), 4).alias("sd")).join(ranks, "method")


def consistency(rows: DataFrame) -> DataFrame:
    return rows.groupBy("method").agg(F.round(F.avg("update_accuracy"), 6).alias("update_accuracy"), F.round(F.avg(F.col("contradicted").cast("double")), 6).alias("contradiction_rate"))


def coherence(rows: DataFrame) -> DataFrame:
    """Overall from rows without a style if there are any, else from all; and by style."""
    plain = F.avg(F.when(F.col("style").isNull(), F.col("value")))
    overall = rows.agg(F.round(F.coalesce(plain, F.avg("value")), 6).alias("value")).select(F.lit("overall").alias("style"), "value")
    by = rows.where("style is not null").groupBy("style").agg(F.round(F.avg("value"), 6).alias("value"))
    return overall.unionByName(by)


def grouped_means(rows: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg(F.col(v).cast("double")), 6).alias(v) for v in values])


def cube_means(rows: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """Overall, by ``a`` and by ``b``."""
    g = rows.groupingSets([[], [a], [b]], a, b)
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col(value).cast("double")), 6).alias(value))


def improvement(rows: DataFrame, base: str, other: str) -> DataFrame:
    """Success by condition and the relative gain of one over the other; null if the base is 0."""
    s = rows.groupBy("domain").pivot("condition", [base, other]).agg(F.avg(F.col("success").cast("double")))
    return s.select("domain", F.round(base, 6).alias("base"), F.round(other, 6).alias("other"), F.round(F.try_divide(F.col(other) - F.col(base), F.col(base)), 6).alias("gain"))


def all_means(rows: DataFrame, key: str, metrics: list[str]) -> DataFrame:
    long = rows.unpivot([key], metrics, "metric", "value")
    return long.where("value is not null").groupBy(key, "metric").agg(F.round(F.avg("value"), 6).alias("mean"))


def label_counts(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """label, tp, fp, fn of (id, label) tables."""
    both = gold.withColumn("g", F.lit(1)).join(predicted.withColumn("p", F.lit(1)), ["id", "label"], "full")
    n = lambda c: F.sum(c.cast("bigint"))
    return both.groupBy("label").agg(
        n(F.col("g").isNotNull() & F.col("p").isNotNull()).alias("tp"),
        n(F.col("g").isNull()).alias("fp"),
        n(F.col("p").isNull()).alias("fn"),
    )


def f1(counts: DataFrame) -> DataFrame:
    bottom = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    return counts.select("label", "tp", "fp", "fn", F.round(F.coalesce(F.try_divide(2 * F.col("tp"), bottom), F.lit(0.0)), 6).alias("f1"))


def micro_macro(counts: DataFrame) -> DataFrame:
    bottom = 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")
    micro = F.coalesce(F.try_divide(2 * F.sum("tp"), bottom), F.lit(0.0))
    own = F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    return counts.agg(F.round(micro, 6).alias("micro_f1"), F.round(F.avg(own), 6).alias("macro_f1"))


def span_f1(rows: DataFrame) -> DataFrame:
    """Mean over examples of the F1 of exact spans (arrays gold and predicted)."""
    hit = F.size(F.array_intersect("gold", "predicted"))
    total = F.size("gold") + F.size("predicted")
    return rows.agg(F.round(F.avg(F.when(total == 0, 1.0).otherwise(F.try_divide(2 * hit, total))), 6).alias("span_f1"))


def harness(cases: DataFrame) -> DataFrame:
    """(query_id, intent, want_intent, facts, required, latency_ms, budget_ms) -> ok and the reasons against."""
    reasons = F.array_compact(
        F.array(
            F.when(F.col("intent") != F.col("want_intent"), F.lit("intent")),
            F.when(F.size(F.array_except("required", "facts")) > 0, F.lit("facts")),
            F.when(F.col("latency_ms") > F.col("budget_ms"), F.lit("latency")),
        )
    )
    return cases.select("query_id", (F.size(reasons) == 0).alias("ok"), F.array_join(reasons, ",").alias("reasons"))


def scenario_pairs(rows: DataFrame) -> DataFrame:
    """Of each scenario (id, item, start_year, end_year): pairs of items and how many contradict (their years are disjoint).

    A scenario is a handful of explanations; pairs come from counting, in order
    of start, how many earlier intervals ended before: an ordered pass, no product.
    """
    n = rows.groupBy("id").agg(F.count(F.lit(1)).alias("items"))
    lo, hi = F.least("start_year", "end_year"), F.greatest("start_year", "end_year")
    marks = rows.select("id", lo.alias("at"), F.lit(1).alias("opens")).unionByName(rows.select("id", hi.alias("at"), F.lit(0).alias("opens")))
    by_year = marks.groupBy("id", "at").agg(F.sum("opens").alias("opened"), F.sum(1 - F.col("opens")).alias("ended"))
    before = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    apart = by_year.withColumn("over", F.coalesce(F.sum("ended").over(before), F.lit(0))).groupBy("id").agg(F.sum(F.col("opened") * F.col("over")).alias("contradicting"))
    return n.join(apart, "id").select("id", (F.col("items") * (F.col("items") - 1) / 2).cast("bigint").alias("pairs"), F.col("contradicting").cast("bigint").alias("contradicting"))


def accuracy_means(scored: DataFrame) -> DataFrame:
    """The five means of scored texts (date_score, entity_score, relation_score, hallucinated, overall)."""
    mean = lambda c: F.round(F.avg(F.col(c).cast("double")), 6)
    return scored.agg(*[mean(c).alias(c) for c in ("date_score", "entity_score", "relation_score")], mean("hallucinated").alias("hallucination_rate"), mean("overall").alias("overall"))


def accuracy_by_type(scored: DataFrame) -> DataFrame:
    """By kind: overall accuracy, that of templates and of polished texts, and the gap between both."""
    of = lambda s: F.avg(F.when(F.col("source") == s, F.col("overall")))
    out = scored.groupBy("kind").agg(F.avg("overall").alias("o"), of("template").alias("t"), of("polished").alias("p"))
    return out.select("kind", F.round("o", 6).alias("overall"), F.round("t", 6).alias("template_accuracy"), F.round("p", 6).alias("polished_accuracy"), F.round(F.col("t") - F.col("p"), 6).alias("gap"))


def cognitive_load(rows: DataFrame, parts: list[str], effort: str) -> DataFrame:
    """By condition: the mean of each row's mean of the load parts that it has, and the mean effort."""
    tlx = mean_of_present(*[F.col(c) for c in parts])
    return rows.groupBy("condition").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(tlx), 4).alias("tlx"), F.round(F.avg(safe_float(F.col(effort))), 6).alias("effort"))


#: What a study has to show: relative success, confidence in points, relative time saved, agreement of experts.
CRITERIA = {"success": 0.20, "confidence": 0.30, "time": 0.15, "agreement": 0.70}


def success_criteria(summary: DataFrame) -> DataFrame:
    """domain and a verdict for each criterion; null where there is no figure."""
    return summary.select("domain", *[(F.col(c) >= least).alias(c) for c, least in CRITERIA.items()])


def positional_accuracy(rows: DataFrame) -> DataFrame:
    """Of arrays predicted and gold, compared place by place up to the shorter: accuracy and places."""
    n = F.least(F.size("predicted"), F.size("gold"))
    hits = F.size(F.filter(F.arrays_zip(F.slice("predicted", F.lit(1), n).alias("a"), F.slice("gold", F.lit(1), n).alias("b")), lambda x: x["a"].eqNullSafe(x["b"])))
    out = rows.agg(F.sum(hits).alias("hits"), F.sum(n).alias("total"))
    return out.select(F.round(F.coalesce(F.try_divide("hits", "total"), F.lit(0.0)), 6).alias("accuracy"), "total")


def qa_metrics(rows: DataFrame, a: str, b: str) -> DataFrame:
    """Overall, by ``a`` and by ``b``: answers, exact and contained ones, mean latency."""
    g = rows.groupingSets([[], [a], [b]], a, b)
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("exact"), 6).alias("exact"), F.round(F.avg("contains"), 6).alias("contains"), F.round(F.avg("latency"), 4).alias("latency"))


def first_route(routes: list[DataFrame]) -> DataFrame:
    """uid, route: each uid once, under the first of the routes (tables of uids) that has it."""
    every = None
    for k, r in enumerate(routes, 1):
        one = r.select("uid", F.lit(k).alias("route"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("uid").agg(F.min("route").alias("route"))


def pair_scores(rows: DataFrame) -> DataFrame:
    """Pairs of the explanations of a scenario (id, item, text): do their years contradict, how many
    words do they share, how far do their years run in one order.  A scenario has a handful."""
    told = rows.withColumn("words", F.array_distinct(tokens(F.col("text")))).withColumn("years", years_in(F.col("text")))
    side = lambda s: told.select("id", *[F.col(c).alias(f"{s}_{c}") for c in ("item", "words", "years")])
    both = side("a").join(side("b"), "id").where("a_item < b_item")
    apart = (F.array_max("a_years") < F.array_min("b_years")) | (F.array_max("b_years") < F.array_min("a_years"))
    union = F.size(F.array_union("a_words", "b_words"))
    return both.select(
        "id", "a_item", "b_item", F.coalesce(apart, F.lit(False)).alias("contradicts"),
        F.when(union == 0, 0.0).otherwise(F.try_divide(F.size(F.array_intersect("a_words", "b_words")), union)).alias("overlap"),
        F.coalesce(F.try_divide(lcs_length(F.col("a_years"), F.col("b_years")), F.greatest(F.size("a_years"), F.size("b_years"))), F.lit(0.0)).alias("year_order"),
    )


def type_coverage(texts: DataFrame, least: float = 70.0) -> DataFrame:
    """Of texts (kind, flesch): the share of kinds whose mean readability is above ``least``."""
    kinds = texts.groupBy("kind").agg(F.avg("flesch").alias("f"))
    return kinds.agg(F.round(F.avg((F.col("f") > least).cast("double")), 6).alias("coverage"), F.count(F.lit(1)).alias("kinds"))


def template_report(rendered: DataFrame) -> DataFrame:
    """Of all templates' texts (fact_type, template_id, confidence, text, flesch, density): by kind templates, texts,
    mean clarity out of five, mean readability and density, and the shares above 45 and above 50."""
    share = lambda least: F.round(F.avg((F.col("flesch") > least).cast("double")), 6)
    mean = lambda c: F.round(F.avg(c), 4)
    return rendered.groupBy("fact_type").agg(F.count_distinct("template_id").alias("templates"), F.count(F.lit(1)).alias("texts"), mean(F.col("confidence") * 5).alias("clarity"), mean("flesch").alias("flesch"), mean("density").alias("density"), share(45).alias("above_45"), share(50).alias("above_50"))
