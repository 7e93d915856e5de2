"""A session over one graph and its stores, with named operations for interpreters.

State is DataFrames: records are appended as files and read as views, so the
same operations serve one record or a table of them.  ``OPERATIONS`` maps the names
that interpreters use to methods; :mod:`tempolith.programs` runs programs over them.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import fidelity
from .functions.scores import accuracy
from .functions.text import density, flesch
from .operators import dispatch, evidence, graph, qa, search, tms
from .operators.evals import accuracy_means
from .plans import nlg, paths, planner, understanding
from .session import fresh_path, written
from .sources import jsonl

TRACE = "query_id string, rule_id string, input_fact string, fact_id string, value string, fired_us long, event_id long"
BELIEF = "belief_id string, support_id string, status string"
CLAIM = "claim_id string, claim string, confidence double, seq long, evidence array<struct<source:string,snippet:string,weight:double,time:string>>"
STORES = {"firings": TRACE, "beliefs": BELIEF, "claims": CLAIM}
# Names by which callers know the kinds of fact.
FACT_TYPES = {"point_in_time": "point_in_time", "point": "point_in_time", "interval": "interval", "sequence": "sequence", "causality": "causality", "overlap": "overlap"}


def fact_type(name: str) -> str:
    key = (name or "").strip().lower()
    if key not in FACT_TYPES:
        raise ValueError(f"unknown fact type {name!r}; known are {', '.join(sorted(FACT_TYPES))}")
    return FACT_TYPES[key]


@dataclass
class Config:
    """Settings of a session; each may come from an environment variable TEMPOLITH_<NAME>."""

    anchors: int = 1
    max_hops: int = 4
    evidence: int = 18
    polish: Callable[[Column], Column] | None = None
    write: Callable[[Column], Column] | None = None
    extra: dict[str, str] = field(default_factory=dict)

    @classmethod
    def from_environment(cls) -> "Config":
        get = lambda name, default: int(os.environ.get(f"TEMPOLITH_{name.upper()}", default))
        return cls(anchors=max(1, get("anchors", 1)), max_hops=get("max_hops", 4), evidence=get("evidence", 18))


class Engine:
    def __init__(self, spark: SparkSession, nodes: DataFrame, edges: DataFrame, config: Config | None = None):
        self.spark, self.nodes, self.edges = spark, nodes, edges
        self.config = config or Config.from_environment()
        self.reset()

    def reset(self) -> None:
        self.stores = {name: fresh_path(self.spark, name) for name in STORES}
        self.firings, self.beliefs, self.claims = (self.spark.createDataFrame([], schema) for schema in STORES.values())
        self.trace_id: str | None = None
        self.last: DataFrame | None = None

    def _append(self, name: str, rows: DataFrame) -> DataFrame:
        """Add files to a store; what it holds already is neither read nor written again."""
        schema = STORES[name]
        whole = self.spark.createDataFrame([], schema).unionByName(rows, allowMissingColumns=True)
        whole.write.mode("append").parquet(self.stores[name])
        return self.spark.read.schema(schema).parquet(self.stores[name])

    # --- truth maintenance ---

    def start_trace(self, query_id: str | None = None) -> str:
        """The id under which firings without one are recorded from now on."""
        self.trace_id = query_id or f"trace-{uuid.uuid4().hex[:8]}"
        return self.trace_id

    def record_rules(self, firings: DataFrame) -> None:
        """Append firings; those without a query belong to the open trace, those without a time to now."""
        now = int(time.time() * 1e6)
        filled = firings
        for name, value in (("query_id", F.lit(self.trace_id)), ("fired_us", F.lit(now).cast("long")), ("event_id", F.monotonically_increasing_id())):
            filled = filled.withColumn(name, F.coalesce(F.col(name), value) if name in firings.columns else value)
        self.firings = self._append("firings", filled)

    def add_beliefs(self, beliefs: DataFrame) -> None:
        self.beliefs = self._append("beliefs", beliefs.withColumn("status", F.coalesce("status", F.lit("active")) if "status" in beliefs.columns else F.lit("active")))

    def add_supports(self, supports: DataFrame) -> None:
        new = tms.add_support(self.beliefs, supports).join(self.beliefs.select("belief_id", "support_id"), ["belief_id", "support_id"], "left_anti")
        self.beliefs = self._append("beliefs", new)

    def tell_claims(self, claims: DataFrame) -> None:
        self.claims = self._append("claims", claims)

    def justify_claims(self) -> DataFrame:
        c = tms.upsert_claims(self.claims)
        return c.select("claim_id", paths.claim_text(F.col("claim"), F.col("confidence"), F.col("evidence")).alias("text"))

    def top_claims(self, k: int = 5) -> DataFrame:
        return tms.upsert_claims(self.claims).orderBy(F.desc("confidence"), "claim_id").limit(k)

    def rules_fired(self) -> DataFrame:
        return tms.rules_fired(self.firings)

    def why_not(self, expected: DataFrame) -> DataFrame:
        return tms.why_not(self.firings, expected)

    def contradictions(self) -> DataFrame:
        return tms.contradictions(self.firings)

    def influential_facts(self, k: int = 10) -> DataFrame:
        return tms.influential_facts(self.firings, k)

    def conclusions(self) -> DataFrame:
        return tms.conclusions(self.firings)

    def explain_trace(self, targets: DataFrame) -> DataFrame:
        """(query_id, fact_id) -> text: how the facts were derived; a message for those that were not."""
        told = tms.explain_fact(self.justification_paths(targets))
        return targets.join(told, ["query_id", "fact_id"], "left").withColumn("text", F.coalesce("text", F.lit("no rule concludes this fact")))

    def justification_paths(self, targets: DataFrame) -> DataFrame:
        return tms.justification_paths(self.firings, targets)

    def explain_belief(self, wanted: DataFrame) -> DataFrame:
        """(belief_id) -> text: what each belief rests on."""
        supports = self.beliefs.where("support_id is not null").groupBy("belief_id").agg(F.sort_array(F.collect_set("support_id")).alias("supports"))
        known = self.beliefs.select("belief_id").distinct().join(supports, "belief_id", "left")
        none = F.from_json(F.lit("[]"), "array<struct<source:string,snippet:string,weight:double>>")
        told = known.select("belief_id", paths.belief_text(F.col("belief_id"), F.col("supports"), none).alias("text"))
        return wanted.join(told, "belief_id", "left").withColumn("text", F.coalesce("text", F.lit("Belief not found.")))

    def support_chain(self, starts: DataFrame) -> DataFrame:
        return tms.support_chain(self.beliefs, starts)

    def retract(self, retracted: DataFrame) -> DataFrame:
        state = tms.retract(self.beliefs, retracted)
        new = written(self.beliefs.drop("status").join(state, "belief_id"), "beliefs")
        # a change of status rewrites the store; later beliefs are appended to the new one
        self.stores["beliefs"], self.beliefs = new._tempolith_path, new
        return state

    def with_status(self, status: str) -> DataFrame:
        return self.beliefs.where(F.col("status") == status).select("belief_id").distinct()

    def active_beliefs(self) -> DataFrame:
        return self.with_status("active")

    def dirty_beliefs(self) -> DataFrame:
        return self.with_status("dirty")

    def counterfactual_shift(self, beliefs: DataFrame, delta: str) -> DataFrame:
        """Beliefs (belief_id, payload) moved in time: each new belief depends on the original and is stored."""
        moved = tms.shifted(beliefs, delta)
        self.add_beliefs(moved.select("belief_id", "support_id", "status"))
        return moved

    def counterfactual(self, facts: DataFrame) -> DataFrame:
        """(id, subject, predicate, object, timeframe, and the same with alt_) -> factual, counterfactual, delta."""
        names = ("subject", "predicate", "object", "timeframe")
        fact, other = ({n: F.col(f"{prefix}{n}") for n in names} for prefix in ("", "alt_"))
        alt = nlg.fact_text(*other.values())
        said = F.concat(F.lit("If instead "), alt, F.lit(", then the outcome would diverge from the factual path."))
        return facts.select("id", nlg.fact_text(*fact.values()).alias("factual"), said.alias("counterfactual"), nlg.delta_text(fact, other).alias("delta"))

    # --- texts ---

    def render(self, facts: DataFrame) -> DataFrame:
        """Each fact by the strategy that its complexity asks for."""
        return nlg.generate(facts, None, self.config.polish, self.config.write)

    def render_by(self, facts: DataFrame, strategy: str) -> DataFrame:
        return nlg.generate(facts, strategy, self.config.polish, self.config.write)

    def best(self, facts: DataFrame) -> DataFrame:
        return nlg.best_template(facts)

    def readability(self, texts: DataFrame) -> DataFrame:
        return texts.select("*", flesch(F.col("text")).alias("flesch"), density(F.col("text")).alias("density"))

    def evaluate(self, told: DataFrame) -> DataFrame:
        """(id, kind, entity, fact, text) -> how much of each fact its text keeps, and what it adds."""
        text = F.col("text")
        parts = told.select("id", fidelity.date_preservation(F.col("fact"), text).alias("date_score"), fidelity.entity_preservation(F.col("entity"), text).alias("entity_score"), fidelity.relation_preservation(F.col("kind"), text).alias("relation_score"), fidelity.hallucinated(F.col("fact"), text).alias("hallucinated"))
        return parts.withColumn("overall", accuracy(F.col("date_score"), F.col("entity_score"), F.col("relation_score"), F.col("hallucinated")))

    def evaluate_and_save(self, told: DataFrame, path: str) -> DataFrame:
        """The scores as JSON lines beside their means, which are returned."""
        scores = self.evaluate(told)
        jsonl.write(scores, f"{path}/scores", "overwrite")
        means = accuracy_means(self.spark.read.schema(scores.schema).json(f"{path}/scores"))
        jsonl.write(means, f"{path}/means", "overwrite")
        return means

    # --- graph ---

    def plan(self, questions: DataFrame) -> DataFrame:
        """(q_id, text) -> plans: type, entities, year; questions that answer themselves say so."""
        text = F.col("text")
        base = planner.plan(questions).join(questions, "q_id")
        kind = F.when(understanding.self_contained(text), "self_contained").otherwise(F.col("query_type"))
        return base.select("q_id", "text", kind.alias("query_type"), understanding.entities(text).alias("entities"), "year", F.lit(5).alias("k"), "confidence")

    def answer(self, questions: DataFrame) -> DataFrame:
        """(q_id, text) -> q_id, question_type, answer, confidence, n_evidence; the evidence is kept for the next calls."""
        plans = written(self.plan(questions), "plans")
        asked = plans.select("q_id", "entities", F.array().cast("array<string>").alias("relations"), "year")
        self.last = written(search.retrieve(asked, self.edges, self.nodes, self.config.evidence), "evidence")
        return dispatch.answer(plans, self.nodes, self.edges, self.last.select("q_id", "edge_uid", "score"))

    def _evidence(self) -> DataFrame:
        if self.last is None:
            raise ValueError("no question has been asked")
        return self.last.join(graph.labelled(self.edges, self.nodes), "edge_uid")

    def evidence(self) -> DataFrame:
        """What the last questions' answers rest on, as sentences."""
        e = self._evidence()
        return e.select("q_id", "rank", "edge_uid").join(nlg.edge_sentence(e.dropDuplicates(["edge_uid"])), "edge_uid").select("q_id", "rank", "sentence")

    def evidence_atoms(self) -> DataFrame:
        return self._evidence().select("q_id", "rank", "source_label", "relation", "target_label", F.coalesce(F.col("start_year").cast("string"), F.lit("")).alias("time"))

    def confidence(self) -> DataFrame:
        """The confidence of the curated answers to the last questions."""
        e = self._evidence()
        return evidence.answers(evidence.displayed(e), e.select("q_id").distinct().withColumn("year", F.lit(None).cast("bigint"))).select("q_id", "confidence")

    def state_at(self, questions: DataFrame) -> DataFrame:
        return qa.state_at(questions, self.edges)

    def match(self, patterns: list[dict[str, str]]) -> DataFrame:
        return graph.match_all(self.edges, patterns)

    def mermaid(self, by: str = "q_id") -> DataFrame:
        """A diagram for each of the last questions, or for each value of an edge's column."""
        return nlg.mermaid(self._evidence() if by == "q_id" else graph.labelled(self.edges, self.nodes), by)

    def edges_from_json(self, rows: DataFrame) -> DataFrame:
        return jsonl.edges_from_json(rows)

    def _steps(self, pairs: DataFrame) -> DataFrame:
        found = graph.witness_paths(self.edges, pairs, self.config.max_hops)
        return found.select("q_id").join(graph.path_steps(found, self.edges, self.nodes), "q_id", "left")

    def explain_path(self, pairs: DataFrame) -> DataFrame:
        """(q_id, start_uid, end_uid) -> summary, path, justification of a shortest path; an error where there is none."""
        s = F.col("steps")
        told = self._steps(pairs).withColumn("error", F.when(s.isNull(), "no path found").otherwise(paths.path_error(s)))
        ok = F.col("error").isNull()
        return told.select("q_id", *[F.when(ok, f(s)).alias(n) for n, f in (("summary", paths.summary), ("path", paths.path_text), ("justification", paths.justification))], "error")

    def explain_path_styled(self, pairs: DataFrame, style: str = "neutral", domain: str = "general") -> DataFrame:
        return self._steps(pairs).where("steps is not null").select("q_id", paths.narrative(F.col("steps"), style, domain).alias("narrative"))

    def explain_path_as_belief(self, pairs: DataFrame, supports: list[str] | None = None) -> DataFrame:
        """The narrative of each path, recorded as a belief that rests on the given ones and on the path itself."""
        held = F.array(*map(F.lit, supports)) if supports else F.array().cast("array<string>")
        s = F.col("steps")
        own = F.array(F.struct(F.lit("graph_path").alias("source"), paths.justification(s).alias("snippet"), F.lit(1.0).alias("weight")))
        key = F.concat(F.lit("path_"), F.col("q_id").cast("string"))
        told = written(self._steps(pairs).where("steps is not null").select("q_id", key.alias("belief_id"), paths.narrative(s, evidence=held).alias("narrative"), paths.belief_text(key, held, own).alias("justification")), "told")
        each = told.select("belief_id", F.explode_outer(held).alias("support_id"))
        self.add_beliefs(each)
        return told

    def reach(self, starts: DataFrame, max_hops: int = 4, year: int | None = None) -> DataFrame:
        return graph.reach(self.edges, starts, max_hops, year)


OPERATIONS: dict[str, Callable] = {
    "temporal-reset!": Engine.reset,
    "nlg-fact": Engine.render,
    "nlg-fact-strategy": Engine.render_by,
    "nlg-readability": Engine.readability,
    "nlg-eval": Engine.evaluate,
    "tms-start-trace": Engine.start_trace,
    "tms-add-belief": Engine.add_beliefs,
    "tms-record-rule": Engine.record_rules,
    "tms-record-rule-facts": Engine.record_rules,
    "tms-rules-fired": Engine.rules_fired,
    "tms-why-not": Engine.why_not,
    "tms-explain-trace": Engine.explain_trace,
    "tms-contradictions": Engine.contradictions,
    "tms-influential-facts": Engine.influential_facts,
    "tms-explain": Engine.explain_belief,
    "tms-support-chain": Engine.support_chain,
    "tms-active-beliefs": Engine.active_beliefs,
    "tms-dirty-beliefs": Engine.dirty_beliefs,
    "tms-retract!": Engine.retract,
    "tms-justification-path": Engine.justification_paths,
    "tms-counterfactual-shift": Engine.counterfactual_shift,
    "graph-answer": Engine.answer,
    "graph-evidence": Engine.evidence,
    "graph-evidence-atoms": Engine.evidence_atoms,
    "edges-from-json": Engine.edges_from_json,
    "graph-confidence": Engine.confidence,
    "graph-mermaid": Engine.mermaid,
    "graph-explain-path": Engine.explain_path,
    "graph-explain-path-as-belief": Engine.explain_path_as_belief,
    "graph-explain-path-styled": Engine.explain_path_styled,
    "counterfactual": Engine.counterfactual,
}
