"""Typed temporal questions over the graph, each for a table of questions.

A question table has q_id and what the type needs (label, year, ...); every
answer keeps q_id, so one job answers all questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefn import overlaps_year
from ..vocabulary import AFFECTING, CAUSAL, FACTUAL_TYPES, STRUCTURAL
from .graph import incident

def _in_year(year):
    return overlaps_year(F.col("start_year"), F.col("end_year"), year)


def factual(edges: DataFrame) -> DataFrame:
    """Base edges and gold facts."""
    return edges.where(F.col("edge_type").isin(*FACTUAL_TYPES))


def reason_of(questions: DataFrame, edges: DataFrame, nodes: DataFrame, k: int = 5) -> DataFrame:
    """(q_id, label, year) -> the causes of what bears the label, best supported first."""
    targets = questions.join(nodes.select(F.col("node_uid").alias("target_uid"), "label"), "label")
    causes = factual(edges).where(F.col("relation").isin(*CAUSAL))
    hit = causes.join(targets, "target_uid").where(_in_year(F.col("year")))
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("support_count"), "edge_uid"))
    out = hit.withColumn("rank", rank).where(F.col("rank") <= k)
    source = nodes.select(F.col("node_uid").alias("source_uid"), F.col("label").alias("cause"))
    return out.join(source, "source_uid").select("q_id", "rank", "cause", "edge_uid", "support_count", "start_year", "end_year")


def start_affecting(edges: DataFrame) -> DataFrame:
    """The first year in which each source affected each target."""
    hit = edges.where(F.col("relation").isin(*AFFECTING))
    order = Window.partitionBy("source_uid", "target_uid").orderBy(F.coalesce("start_year", F.lit(999999)), F.desc("support_count"), "edge_uid")
    first = hit.withColumn("r", F.row_number().over(order)).where("r = 1")
    return first.select("source_uid", "target_uid", "edge_uid", F.col("start_year").alias("year"))


def tiered(edges: DataFrame, by: list[str]) -> DataFrame:
    """Of each group the best tier only: base or gold facts, else any fact, else everything."""
    structural = F.col("relation").isin(*STRUCTURAL)
    tier = F.when(F.col("edge_type").isin(*FACTUAL_TYPES) & ~structural, 0).when(~structural, 1).otherwise(2)
    told = edges.withColumn("tier", tier)
    # the best tier is a minimum, combined before the shuffle: no group has to meet in one task
    best = told.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min("tier").alias("best"))
    same = [told[c].eqNullSafe(best[f"_{c}"]) for c in by]
    return told.join(best, [*same, told["tier"] == best["best"]], "left_semi")


def state_at(questions: DataFrame, edges: DataFrame, k: int = 10) -> DataFrame:
    """(q_id, node_uid, year) -> the facts that held then, by support."""
    hit = incident(edges, questions).where(_in_year(F.col("year")))
    hit = tiered(hit, ["q_id"])
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("support_count"), "edge_uid"))
    return hit.withColumn("rank", rank).where(F.col("rank") <= k).select("q_id", "rank", "edge_uid", "support_count")


def existence(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(q_id, a_uid, b_uid, year) -> whether an edge between both, either way, held then."""
    held = edges.select("source_uid", "target_uid", "start_year", "end_year")
    one = pairs.join(held, (pairs["a_uid"] == held["source_uid"]) & (pairs["b_uid"] == held["target_uid"]))
    two = pairs.join(held, (pairs["b_uid"] == held["source_uid"]) & (pairs["a_uid"] == held["target_uid"]))
    found = one.unionByName(two).where(_in_year(F.col("year"))).groupBy("q_id").agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(found, "q_id", "left").select("q_id", (F.coalesce("n", F.lit(0)) > 0).alias("holds"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n_edges"))


def occurrence(edges: DataFrame, first: bool = True, k: int = 10) -> DataFrame:
    """For each target: of its ``k`` best supported dated edges the earliest (or latest)."""
    dated = edges.where("start_year is not null")
    best = Window.partitionBy("target_uid").orderBy(F.desc("support_count"), "edge_uid")
    top = dated.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k)
    when = F.col("start_year") if first else F.coalesce("end_year", "start_year")
    order = Window.partitionBy("target_uid").orderBy(when.asc() if first else when.desc(), F.desc("support_count"), "edge_uid")
    return top.withColumn("o", F.row_number().over(order)).where("o = 1").select("target_uid", "edge_uid", when.alias("year"))


def ordering(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """(q_id, a_uid, b_uid) -> which of both is dated earlier, by the best supported dated edge of each."""
    dated = edges.where("start_year is not null")
    ends = dated.select(F.explode(F.array("source_uid", "target_uid")).alias("uid"), "start_year", "support_count", "edge_uid")
    best = ends.groupBy("uid").agg(F.min(F.struct((-F.col("support_count")).alias("s"), "edge_uid", "start_year")).alias("b")).select("uid", F.col("b.start_year").alias("year"))
    out = pairs.join(best.select(F.col("uid").alias("a_uid"), F.col("year").alias("a_year")), "a_uid", "left")
    out = out.join(best.select(F.col("uid").alias("b_uid"), F.col("year").alias("b_year")), "b_uid", "left")
    verdict = F.when(F.col("a_year") < F.col("b_year"), "a").when(F.col("b_year") < F.col("a_year"), "b").when(F.col("a_year") == F.col("b_year"), "same").otherwise("unknown")
    return out.select("q_id", "a_year", "b_year", verdict.alias("earlier"))


def count_triples(edges: DataFrame, year: int) -> DataFrame:
    """relation, n: distinct triples that held in the year."""
    return edges.where(_in_year(F.lit(year))).groupBy("relation").agg(F.countDistinct(F.struct("source_uid", "target_uid", "relation")).alias("n"))


def analogical(edges: DataFrame, year: int) -> DataFrame:
    """For each edge A-B that held in the year: A's best supported other edge of the same relation."""
    ref = edges.where(_in_year(F.lit(year))).select("source_uid", F.lower("relation").alias("rel"), F.col("target_uid").alias("b_uid"))
    other = edges.select("source_uid", F.lower("relation").alias("rel"), F.col("target_uid").alias("c_uid"), "support_count", "edge_uid")
    # the two best of a source and relation suffice: at most one of them is the reference itself
    best = Window.partitionBy("source_uid", "rel").orderBy(F.desc("support_count"), "c_uid")
    two = other.withColumn("r", F.row_number().over(best)).where("r <= 2")
    pairs = ref.join(two, ["source_uid", "rel"]).where("b_uid <> c_uid")
    pick = pairs.groupBy("source_uid", "rel", "b_uid").agg(F.min(F.struct("r", "c_uid", "support_count")).alias("p"))
    return pick.select("source_uid", F.col("rel").alias("relation"), "b_uid", F.col("p.c_uid").alias("c_uid"), F.col("p.support_count").alias("support_count"))


def as_of(anchors: DataFrame, terms: DataFrame, width: int = 32) -> DataFrame:
    """Predecessor and successor of each anchor term (role, holder, start_year, end_year):
    the holder whose term ended latest by its start, and who started earliest after it.

    A role's time line is cut into stretches of ``width``.  Each stretch is one
    ordered pass of its own; what lies before (or after) it comes from the best of
    the other stretches, a row for each, so no task holds the terms of a role.
    """
    asked = anchors.select("role", F.col("holder").alias("anchor"), F.col("start_year").alias("at"))

    def nearest(when: str, after: bool) -> DataFrame:
        known = terms.select("role", F.lit(None).cast("string").alias("anchor"), F.col(when).alias("at"), F.struct(F.col(when).alias("y"), "holder").alias("t"))
        none = F.lit(None).cast(dict(known.dtypes)["t"])
        both = known.unionByName(asked.withColumn("t", none)).withColumn("stretch", F.floor(F.col("at") / width))
        best = F.min if after else F.max
        asks = F.col("anchor").isNotNull()
        # of equal times, ends count for an anchor and starts do not
        order = [F.desc("at"), F.desc(asks)] if after else ["at", asks]
        own = Window.partitionBy("role", "stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        found = both.withColumn("own", best("t").over(own)).where(asks)
        beyond = Window.partitionBy("role").orderBy(F.desc("stretch") if after else "stretch").rowsBetween(Window.unboundedPreceding, -1)
        carried = both.groupBy("role", "stretch").agg(best("t").alias("t")).select("role", "stretch", best("t").over(beyond).alias("carried"))
        return found.join(carried, ["role", "stretch"]).select("role", "anchor", "at", F.coalesce("own", "carried").getField("holder").alias("holder"))

    before = nearest("end_year", False).withColumnRenamed("holder", "predecessor")
    later = nearest("start_year", True).withColumnRenamed("holder", "successor")
    return before.join(later, ["role", "anchor", "at"]).withColumnRenamed("at", "start_year")
