"""Every question to the operator of its type: a table of planned questions becomes a table of answers.

Questions: q_id, query_type, entities (array), year, k, max_hops, text.  Each type is a branch over
the questions of that type, all branches are one plan; what a branch leaves open falls
back on the hits of a search (q_id, edge_uid, score).  Answers: q_id, question_type, answer,
confidence, n_evidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.timefn import overlaps_year
from ..vocabulary import AFFECTING, CAUSAL, FACTUAL_TYPES, STRUCTURAL
from .graph import labelled, resolve, witness_paths

# Names of the types that each branch answers.
TYPES = {
    "state": ("state_at_time", "state_during_interval", "within_interval", "overlap_query"),
    "existence": ("existence_in_time",),
    "first": ("first_occurrence", "earliest_among_set"),
    "last": ("last_occurrence", "latest_among_set"),
    "count": ("temporal_count", "frequency_query"),
    "top": ("temporal_top_k", "trend_evolution"),
    "path": ("temporal_path_existence", "time_respecting_path", "earliest_arrival_path"),
    "reason": ("reason_of",),
    "start": ("start_affecting",),
    "analogy": ("analogical_transfer",),
}


def _in_year(year: Column) -> Column:
    return year.isNull() | overlaps_year(F.col("start_year"), F.col("end_year"), year)


def _period(year: Column) -> Column:
    return F.when(year.isNotNull(), F.concat(F.lit(" in "), year.cast("string"))).otherwise("")


class Dispatch:
    def __init__(self, nodes: DataFrame, edges: DataFrame, hits: DataFrame, questions: DataFrame):
        self.nodes, self.edges = nodes, labelled(edges, nodes)
        self.questions = questions
        self.hits = hits.join(self.edges, "edge_uid").join(questions.select("q_id", "year", "k", "query_type"), "q_id")
        asked = questions.select("q_id", F.posexplode("entities").alias("pos", "mention")).withColumn("mention_id", F.struct("q_id", "pos"))
        found = resolve(asked.select(F.col("mention_id").alias("q_id"), "mention"), nodes)
        self.named = found.select("q_id.q_id", "q_id.pos", "node_uid")

    def of(self, branch: str) -> DataFrame:
        return self.questions.where(F.col("query_type").isin(*TYPES[branch]))

    def at(self, pos: int, name: str) -> DataFrame:
        return self.named.where(F.col("pos") == pos).select("q_id", F.col("node_uid").alias(name))

    def _answers(self, rows: DataFrame, kind: Column | str, text: Column, confidence: Column, n: Column) -> DataFrame:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return rows.select("q_id", kind.alias("question_type"), text.alias("answer"), confidence.cast("double").alias("confidence"), n.cast("bigint").alias("n_evidence"))

    def _best(self, rows: DataFrame, order: list, most: int, line: Column) -> DataFrame:
        """The ``most`` best rows of each question as one: n, and their lines in order."""
        top = rows.withColumn("_r", F.row_number().over(Window.partitionBy("q_id").orderBy(*order))).where(F.col("_r") <= most)
        lines = F.transform(F.array_sort(F.collect_list(F.struct("_r", line.alias("t")))), lambda x: x["t"])
        return top.groupBy("q_id").agg(F.count(F.lit(1)).alias("n"), lines.alias("lines"))

    def state(self) -> DataFrame:
        seeds = self.named.select("q_id", F.col("node_uid").alias("seed")).distinct()
        some = seeds.select("q_id").distinct().withColumn("_named", F.lit(True))
        rows = self.hits.join(self.of("state").select("q_id"), "q_id", "left_semi").where(_in_year(F.col("year")))
        ends = rows.select("q_id", "edge_uid", F.explode(F.array("source_uid", "target_uid")).alias("seed")).join(seeds, ["q_id", "seed"], "left_semi").select("q_id", "edge_uid").distinct().withColumn("_seeded", F.lit(True))
        rows = rows.join(ends, ["q_id", "edge_uid"], "left").join(some, "q_id", "left").where(F.col("_seeded") | F.col("_named").isNull())
        factual = ~F.lower("relation").isin(*STRUCTURAL)
        tier = F.when(factual & F.col("edge_type").isin(*FACTUAL_TYPES), 0).when(factual, 1).otherwise(2)
        best = F.min("tier").over(Window.partitionBy("q_id"))
        rows = rows.withColumn("tier", tier).withColumn("best", best).where("tier = best")
        top = self._best(rows, [F.desc("score"), "edge_uid"], 6, F.concat_ws(" ", "source_label", "relation", "target_label"))
        top = top.join(rows.groupBy("q_id").agg(F.min("tier").alias("tier")), "q_id").join(self.of("state"), "q_id")
        told = F.concat(F.lit("State evidence"), _period(F.col("year")), F.lit(": "), F.array_join(F.slice("lines", 1, 3), "; "), F.lit("."))
        text = F.when(F.col("tier") < 2, told).otherwise(F.concat(F.lit("Only structural links found"), _period(F.col("year")), F.lit(" (no factual relations).")))
        return self._answers(top, "state_at_time", text, F.when(F.col("tier") < 2, F.least(F.lit(0.9), 0.35 + 0.1 * F.col("n"))).otherwise(0.25), F.col("n"))

    def existence(self) -> DataFrame:
        pairs = self.of("existence").join(self.at(0, "a"), "q_id").join(self.at(1, "b"), "q_id").select("q_id", "year", "a", "b")
        ways = pairs.select("q_id", "year", F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("t")), F.struct(F.col("b").alias("s"), F.col("a").alias("t")))).alias("w")).select("q_id", "year", F.col("w.s").alias("source_uid"), F.col("w.t").alias("target_uid")).distinct()
        hit = self.edges.join(ways, ["source_uid", "target_uid"]).where(_in_year(F.col("year")))
        top = self._best(hit, [F.desc("support_count"), "edge_uid"], 5, F.concat_ws(" ", "source_label", "relation", "target_label"))
        rows = self.of("existence").join(pairs.select("q_id").distinct(), "q_id", "left_semi").join(top, "q_id", "left")
        n = F.coalesce("n", F.lit(0))
        yes = F.concat(F.lit("Yes, there is graph evidence connecting the entities"), _period(F.col("year")), F.lit(". Evidence: "), F.array_join(F.slice("lines", 1, 3), "; "), F.lit("."))
        no = F.concat(F.lit("No direct graph evidence connects the entities"), _period(F.col("year")), F.lit("."))
        return self._answers(rows, "existence_in_time", F.when(n > 0, yes).otherwise(no), F.when(n > 0, F.least(F.lit(0.95), 0.5 + 0.08 * n)).otherwise(0.2), n)

    def occurrence(self, branch: str) -> DataFrame:
        early = branch == "first"
        dated = self.hits.join(self.of(branch).select("q_id"), "q_id", "left_semi").withColumn("y", F.coalesce("start_year", "end_year")).where("y is not null")
        pool = dated.withColumn("_p", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "edge_uid"))).where("_p <= 10")
        order = [F.col("y").asc() if early else F.col("y").desc(), F.desc("score"), "edge_uid"]
        line = F.concat(F.col("y").cast("string"), F.lit(": "), F.concat_ws(" ", "source_label", "relation", "target_label"))
        top = self._best(pool, order, 5, line)
        text = F.concat(F.lit("Earliest" if early else "Latest"), F.lit(" matching event appears at "), F.element_at("lines", 1), F.lit("."))
        return self._answers(top, "first_occurrence" if early else "last_occurrence", text, F.lit(0.75), F.col("n"))

    def count(self) -> DataFrame:
        rows = self.hits.join(self.of("count").select("q_id"), "q_id", "left_semi").where(_in_year(F.col("year")))
        seed = self.at(0, "seed")
        ends = rows.select("q_id", "edge_uid", F.explode(F.array("source_uid", "target_uid")).alias("seed")).join(seed, ["q_id", "seed"], "left_semi").select("q_id", "edge_uid").distinct().withColumn("_in", F.lit(True))
        named = seed.select("q_id").distinct().withColumn("_named", F.lit(True))
        rows = rows.join(ends, ["q_id", "edge_uid"], "left").join(named, "q_id", "left").where(F.col("_in") | F.col("_named").isNull())
        n = rows.groupBy("q_id").agg(F.count_distinct(F.struct("source_uid", "target_uid", "relation")).alias("n"))
        out = self.of("count").join(n, "q_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
        text = F.concat(F.lit("Count result"), _period(F.col("year")), F.lit(": "), F.col("n").cast("string"), F.lit(" matching relation instances."))
        return self._answers(out, "temporal_count", text, F.when(F.col("n") > 0, 0.7).otherwise(0.2), F.least("n", F.lit(5)))

    def top(self) -> DataFrame:
        rows = self.hits.join(self.of("top").select("q_id"), "q_id", "left_semi").where(_in_year(F.col("year")))
        ends = rows.select("q_id", "k", F.explode(F.array(F.struct(F.col("source_uid").alias("u"), F.col("source_label").alias("l")), F.struct(F.col("target_uid").alias("u"), F.col("target_label").alias("l")))).alias("x"))
        degree = ends.groupBy("q_id", "x.u", "x.l").agg(F.count(F.lit(1)).alias("n"), F.max("k").alias("k"))
        order = Window.partitionBy("q_id").orderBy(F.desc("n"), "u")
        best = degree.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= F.greatest(F.lit(1), F.coalesce("k", F.lit(5))))
        lines = F.transform(F.array_sort(F.collect_list(F.struct("_r", F.concat("l", F.lit(" ("), F.col("n").cast("string"), F.lit(")")).alias("t")))), lambda x: x["t"])
        told = best.groupBy("q_id").agg(lines.alias("lines"))
        text = F.concat(F.lit("Top-"), F.size("lines").cast("string"), F.lit(" entities: "), F.array_join("lines", ", "), F.lit("."))
        return self._answers(told, "temporal_top_k", text, F.lit(0.7), F.size("lines"))

    def path(self) -> DataFrame:
        asked = self.of("path")
        pairs = asked.join(self.at(0, "start_uid"), "q_id").join(self.at(1, "end_uid"), "q_id").select(F.struct("q_id", "start_uid", "end_uid").alias("q_id"), "start_uid", "end_uid", "year")
        plain = self.edges.select("edge_uid", "source_uid", "target_uid", "start_year", "end_year")
        # questions that name a year walk the edges that hold in it
        found = witness_paths(plain, pairs.where("year is null").drop("year")).unionByName(self._dated_paths(plain, pairs.where("year is not null")))
        best = found.groupBy(F.col("q_id.q_id").alias("q_id")).agg(F.min("hops").alias("hops"))
        rows = asked.join(best, "q_id")
        yes = F.concat(F.lit("A path exists between the entities"), _period(F.col("year")), F.lit(" within "), F.col("hops").cast("string"), F.lit(" hops."))
        no = F.concat(F.lit("No path evidence found between the entities"), _period(F.col("year")), F.lit("."))
        return self._answers(rows, "temporal_path_existence", F.when(F.col("hops").isNotNull(), yes).otherwise(no), F.when(F.col("hops").isNotNull(), 0.75).otherwise(0.3), F.coalesce("hops", F.lit(0)))

    def _dated_paths(self, edges: DataFrame, pairs: DataFrame) -> DataFrame:
        """A question's walk over the edges of its year: the year is part of every node."""
        years = pairs.select("year").distinct()
        in_year = edges.join(F.broadcast(years), overlaps_year(F.col("start_year"), F.col("end_year"), F.col("year")))
        key = lambda c: F.concat_ws("@", c, F.col("year").cast("string"))
        own = in_year.select("edge_uid", key("source_uid").alias("source_uid"), key("target_uid").alias("target_uid"))
        return witness_paths(own, pairs.select("q_id", key("start_uid").alias("start_uid"), key("end_uid").alias("end_uid")))

    def reason(self) -> DataFrame:
        asked = self.of("reason").where("year is not null").join(self.at(0, "target_uid"), "q_id")
        causes = self.edges.where(F.col("relation").isin(*CAUSAL) & F.col("edge_type").isin(*FACTUAL_TYPES))
        hit = causes.join(asked.select("q_id", "target_uid", "year"), "target_uid").where(_in_year(F.col("year")))
        top = self._best(hit, [F.desc("support_count"), "edge_uid"], 5, F.col("source_label"))
        rows = asked.select("q_id", "year", "entities").distinct().join(top, "q_id", "left")
        n, name = F.coalesce("n", F.lit(0)), F.element_at("entities", 1)
        yes = F.concat(F.lit("Likely reasons for '"), name, F.lit("'"), _period(F.col("year")), F.lit(": "), F.array_join(F.array_distinct("lines"), ", "), F.lit("."))
        no = F.concat(F.lit("No causal evidence found for '"), name, F.lit("'"), _period(F.col("year")), F.lit("."))
        return self._answers(rows, "reason_of", F.when(n > 0, yes).otherwise(no), F.when(n > 0, F.least(F.lit(0.95), 0.45 + 0.1 * n)).otherwise(0.15), n)

    def start(self) -> DataFrame:
        asked = self.of("start").join(self.at(0, "source_uid"), "q_id").join(self.at(1, "target_uid"), "q_id")
        effects = self.edges.where(F.col("relation").isin(*AFFECTING) & F.col("edge_type").isin(*FACTUAL_TYPES))
        hit = effects.join(asked.select("q_id", "source_uid", "target_uid"), ["source_uid", "target_uid"])
        when = F.coalesce("start_year", "end_year").cast("string")
        top = self._best(hit, [F.coalesce("start_year", F.lit(999999)), F.desc("support_count"), "edge_uid"], 5, F.struct(F.coalesce(when, F.lit("unknown")).alias("t"), F.col("start_year").isNotNull().alias("d")))
        rows = asked.select("q_id", "entities").distinct().join(top, "q_id", "left")
        first, say = F.element_at("lines", 1), lambda i: F.concat(F.lit("'"), F.element_at("entities", i), F.lit("'"))
        yes = F.concat(say(1), F.lit(" appears to start affecting "), say(2), F.lit(" around "), first["t"], F.lit("."))
        no = F.concat(F.lit("No affecting edge found between "), say(1), F.lit(" and "), say(2), F.lit("."))
        return self._answers(rows, "start_affecting", F.when(F.col("n").isNotNull(), yes).otherwise(no), F.when(F.col("n").isNull(), 0.2).when(first["d"], 0.75).otherwise(0.45), F.coalesce("n", F.lit(0)))

    def analogy(self) -> DataFrame:
        asked = self.of("analogy").where("year is not null and size(entities) >= 3").select("q_id", "year", "entities")
        ends = asked.join(self.at(0, "source_uid"), "q_id").join(self.at(1, "b"), "q_id").join(self.at(2, "c"), "q_id")
        own = self.edges.where(F.col("edge_type").isin(*FACTUAL_TYPES))
        ref = own.join(ends.select("q_id", "year", "source_uid", F.col("b").alias("target_uid"), "c"), ["source_uid", "target_uid"]).where(_in_year(F.col("year")))
        ref = ref.select("q_id", "source_uid", "c", F.lower("relation").alias("rel")).distinct()
        other = own.select("source_uid", F.col("target_uid").alias("c"), F.lower("relation").alias("rel"), "relation", "support_count", "edge_uid", F.coalesce("start_year", "end_year").cast("string").alias("w"))
        line = F.concat(F.col("relation"), F.lit("@"), F.coalesce("w", F.lit("unknown time")))
        top = self._best(other.join(ref, ["source_uid", "c", "rel"]), [F.desc("support_count"), "edge_uid"], 1, line)
        rows = asked.join(ends.select("q_id").distinct(), "q_id", "left_semi").join(ref.groupBy("q_id").agg(F.count(F.lit(1)).alias("refs")), "q_id", "left").join(top, "q_id", "left")
        say = lambda i: F.concat(F.lit("'"), F.element_at("entities", i), F.lit("'"))
        got = F.split(F.element_at("lines", 1), "@")
        yes = F.concat(F.lit("A similar event happened: "), say(1), F.lit(" "), got[0], F.lit(" "), say(3), F.lit(" (time: "), got[1], F.lit(")."))
        no = F.concat(F.lit("No direct evidence that what "), say(1), F.lit(" did to "), say(2), _period(F.col("year")), F.lit(" also happened to "), say(3), F.lit("."))
        sure = F.when(F.col("refs").isNull(), 0.1).when(F.col("n").isNull(), 0.3).otherwise(0.8)
        return self._answers(rows, "analogical_transfer", F.when(F.col("n").isNotNull(), yes).otherwise(no), sure, F.coalesce("n", F.lit(0)) + F.col("refs").isNotNull().cast("int"))

    def backoff(self, answered: DataFrame) -> DataFrame:
        """For questions without an answer: the five best hits at low confidence; of an unknown type at middling."""
        left = self.questions.join(answered.select("q_id"), "q_id", "left_anti")
        known = F.col("query_type").isin(*[t for ts in TYPES.values() for t in ts])
        top = self._best(self.hits, [F.desc("score"), "edge_uid"], 5, F.concat_ws(" ", "source_label", "relation", "target_label"))
        rows = left.join(top, "q_id", "left")
        n = F.coalesce("n", F.lit(0))
        kind = F.when(known, F.col("query_type")).when(n > 0, "semantic_fallback").otherwise("unsupported")
        text = F.when(n > 0, F.concat(F.lit("Best-effort semantic evidence: "), F.array_join("lines", "; "), F.lit("."))).when(known, "Retrieval did not return supporting graph edges.").otherwise("This question maps to no supported temporal operator.")
        sure = F.when(known & (n > 0), F.least(F.lit(0.45), 0.18 + 0.06 * n)).when(known, 0.1).when(n > 0, F.least(F.lit(0.8), 0.4 + 0.08 * n)).otherwise(0.0)
        return self._answers(rows, kind, text, sure, n)

    def answers(self) -> DataFrame:
        branches: list[Callable[[], DataFrame]] = [self.state, self.existence, lambda: self.occurrence("first"), lambda: self.occurrence("last"), self.count, self.top, self.path, self.reason, self.start, self.analogy]
        out = branches[0]()
        for b in branches[1:]:
            out = out.unionByName(b())
        return out.unionByName(self.backoff(out))


def answer(questions: DataFrame, nodes: DataFrame, edges: DataFrame, hits: DataFrame) -> DataFrame:
    """q_id, question_type, answer, confidence, n_evidence: one row for each question."""
    return Dispatch(nodes, edges, hits, questions).answers()
