"""Places where a language or embedding model may be put in, and what is done without one.

A hook is a function from a batch of texts to a batch of answers; it runs in Arrow batches on the executors,
with retries.  Where no hook is given or it fails for good, the deterministic default holds.
"""

from __future__ import annotations

import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .session import map_batches

Batch = Callable[[list[str]], list]


def with_retries(f: Batch, times: int = 3, wait: float = 0.5) -> Batch:
    def call(texts: list[str]) -> list:
        for k in range(times):
            try:
                return f(texts)
            except Exception:
                if k + 1 == times:
                    raise
                time.sleep(wait * 2**k)
        return []

    return call


@dataclass
class Endpoint:
    """A service that takes {"input": [texts]} and gives {"data": [answers]} in JSON."""

    url: str
    timeout: float = 30.0

    def __call__(self, texts: list[str]) -> list:
        request = urllib.request.Request(self.url, json.dumps({"input": texts}).encode(), {"Content-Type": "application/json"})
        with urllib.request.urlopen(request, timeout=self.timeout) as reply:
            return json.load(reply)["data"]

    def available(self) -> bool:
        try:
            self([])
        except Exception:
            return False
        return True


def ask(rows: DataFrame, hook: Batch | None, column: str = "prompt", times: int = 3) -> DataFrame:
    """``rows`` (id, prompt) with the hook's answer, null without a hook or where it failed, and the error."""
    if hook is None:
        return rows.select("id", F.lit(None).cast("string").alias("answer"), F.lit(None).cast("string").alias("error"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        call = with_retries(hook, times)
        for pdf in batches:
            try:
                answers, error = [None if a is None else str(a) for a in call(pdf["prompt"].tolist())], None
                if len(answers) != len(pdf):
                    raise ValueError(f"{len(answers)} answers to {len(pdf)} texts")
            except Exception as e:  # the batch keeps its place; its rows say why they have no answer
                answers, error = [None] * len(pdf), f"{type(e).__name__}: {e}"
            yield pd.DataFrame({"id": pdf["id"], "answer": answers, "error": error})

    return map_batches(rows.select(F.col("id").cast("long").alias("id"), F.col(column).alias("prompt")), run, "id long, answer string, error string")


def embed(texts: DataFrame, hook: Callable[[list[str]], list[list[list[float]]]]) -> DataFrame:
    """(id, text) -> id, embedding: the hook's vectors of a text's tokens, pooled by their mean, of unit length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for pdf in batches:
            out = []
            for tokens in hook(pdf["text"].fillna("").tolist()):
                v = np.asarray(tokens, float).mean(axis=0)
                out.append((v / (np.linalg.norm(v) or 1.0)).tolist())
            yield pd.DataFrame({"id": pdf["id"], "embedding": out})

    return map_batches(texts.select(F.col("id").cast("long").alias("id"), "text"), run, "id long, embedding array<double>")


def evidence_prompt(ranked: DataFrame, questions: DataFrame, most: int = 18) -> DataFrame:
    """id, prompt: each question (q_id, text) above its evidence (q_id, rank, sentence, start_year), earliest first."""
    lines = ranked.where(F.col("rank") <= most).groupBy("q_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("start_year", F.lit(9999)).alias("y"), "rank", "sentence"))), lambda x: F.concat(F.lit("- "), x["sentence"])).alias("lines"))
    body = F.when(F.size("lines") > 0, F.concat(F.lit("Evidence:\n"), F.array_join("lines", "\n"), F.lit("\n"))).otherwise("Answer from your own knowledge.\n")
    yes_no = F.lower("text").rlike(r"^(?:was|were|did|does|is|are|has|have)\b")
    form = F.when(yes_no, "Output exactly Yes or No.").otherwise("Output only the name or short phrase.")
    return questions.join(lines, "q_id", "left").select(F.col("q_id").alias("id"), F.concat(F.lit("Question: "), "text", F.lit("\n"), F.coalesce(body, F.lit("Answer from your own knowledge.\n")), form).alias("prompt"))


def judged(rows: DataFrame, hook: Batch | None) -> DataFrame:
    """(id, prompt) -> id, scores: a map of scores from 0 to 1 that a judge gives in JSON; empty where it gives none."""
    raw = F.from_json("answer", "map<string,double>")
    scores = F.transform_values(raw, lambda _, v: F.when((v == F.floor(v)) & v.between(1, 5), (v - 1) / 4).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))))
    return ask(rows, hook).select("id", F.coalesce(scores, F.create_map().cast("map<string,double>")).alias("scores"))


def filtered(candidates: DataFrame, picks: DataFrame | None = None, most: int = 5) -> DataFrame:
    """Candidates (q_id, edge_uid, score) that a model picked (q_id, edge_uid), or for questions without picks the ``most`` best."""
    best = candidates.withColumn("_r", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "edge_uid")))
    if picks is None:
        return best.where(F.col("_r") <= most).drop("_r")
    spoke = picks.select("q_id").distinct().withColumn("_spoke", F.lit(True))
    hit = picks.select("q_id", "edge_uid").distinct().withColumn("_hit", F.lit(True))
    rows = best.join(hit, ["q_id", "edge_uid"], "left").join(spoke, "q_id", "left")
    return rows.where(F.col("_hit") | (F.col("_spoke").isNull() & (F.col("_r") <= most))).drop("_r", "_hit", "_spoke")


def evaluated_batch(facts: DataFrame, texts: DataFrame) -> DataFrame:
    """Facts and texts (both with id) side by side; an id that one of them lacks is an error at run time."""
    both = facts.withColumn("_f", F.lit(1)).join(texts.withColumn("_t", F.lit(1)), "id", "full")
    whole = F.col("_f").isNotNull() & F.col("_t").isNotNull()
    return both.where(F.when(whole, F.lit(True)).otherwise(F.raise_error(F.lit("facts and texts do not match")).cast("boolean"))).drop("_f", "_t")
