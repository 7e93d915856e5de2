"""Lexical and vector retrieval, fusion and diversification."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import cosine
from ..functions.text import let, tokens, word_pairs
from ..session import ship

#: Weight of the lexical score by type of question; the rest is the dense score's.
SPARSE_WEIGHT = {"temporal_count": 0.15, "reason_of": 0.25, "first_occurrence": 0.20, "temporal_path_existence": 0.10}
DEFAULT_SPARSE_WEIGHT = 0.30


def with_relation_similarity(edges: DataFrame, hits: DataFrame) -> DataFrame:
    """Edges with the similarity of their relation: the best score that a search gave it (relation, score), else 0."""
    best = hits.groupBy(F.lower(F.trim("relation")).alias("_r")).agg(F.max("score").alias("similarity"))
    return edges.join(best, F.lower(F.trim(edges["relation"])) == best["_r"], "left").drop("_r").fillna(0.0, ["similarity"])


def grams(text: Column, most: int = 2) -> Column:
    """Words, and pairs of neighbours."""
    words = tokens(text)
    return words if most == 1 else let(words, lambda ws: F.concat(ws, word_pairs(ws)))


def postings(docs: DataFrame, most: int = 2) -> DataFrame:
    """id, term, tf from (id, text)."""
    return docs.select("id", F.explode(grams(F.col("text"), most)).alias("term")).groupBy("id", "term").agg(F.count(F.lit(1)).alias("tf"))


def tfidf(docs: DataFrame, most: int = 2, sublinear: bool = False, max_df: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(weights, idf): id, term, weight with unit length for each id; term, df, idf."""
    post = postings(docs, most)
    total = docs.agg(F.count(F.lit(1)).alias("n"))  # one row
    idf = post.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(total))
    if max_df is not None:
        idf = idf.where(F.col("df") <= max_df * F.col("n"))
    idf = idf.select("term", "df", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    tf = 1 + F.log("tf") if sublinear else F.col("tf").cast("double")
    raw = post.join(idf, "term").select("id", "term", (tf * F.col("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("id")))
    return raw.select("id", "term", (F.col("w") / length).alias("weight")), idf


def tfidf_scores(queries: DataFrame, docs: DataFrame, most: int = 2, **options) -> DataFrame:
    """q_id, id, score: cosine of queries (q_id, text) with docs (id, text), positive ones."""
    weights, idf = tfidf(docs, most, **options)
    q = postings(queries.select(F.col("q_id").alias("id"), "text"), most).withColumnRenamed("id", "q_id").join(idf, "term")
    tf = 1 + F.log("tf") if options.get("sublinear") else F.col("tf").cast("double")
    q = q.withColumn("w", tf * F.col("idf"))
    q = q.select("q_id", "term", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("q_id")))).alias("q_weight"))
    return q.join(weights, "term").groupBy("q_id", "id").agg(F.sum(F.col("q_weight") * F.col("weight")).alias("score"))


def bm25_scores(queries: DataFrame, docs: DataFrame, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> DataFrame:
    """q_id, id, score of BM25 Okapi; negative idf becomes ``epsilon`` times the mean idf."""
    post = postings(docs, 1)
    size = post.groupBy("id").agg(F.sum("tf").alias("dl"))
    totals = size.agg(F.avg("dl").alias("avgdl")).crossJoin(docs.agg(F.count(F.lit(1)).alias("n")))  # one row
    df = post.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(totals))
    df = df.withColumn("raw", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    mean = df.agg(F.avg("raw").alias("mean_idf"))  # one row
    df = df.crossJoin(F.broadcast(mean)).select("term", "avgdl", F.when(F.col("raw") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
    q = queries.select("q_id", F.explode(tokens(F.col("text"))).alias("term"))
    hit = q.join(df, "term").join(post, "term").join(size, "id")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return hit.groupBy("q_id", "id").agg(F.sum(part).alias("score"))


def over_max(scores: DataFrame) -> DataFrame:
    """Scores over the best of their question; the best is combined before it is shuffled."""
    top = scores.groupBy(F.col("q_id").alias("_q")).agg(F.max("score").alias("_top"))
    joined = scores.join(top, scores["q_id"].eqNullSafe(top["_q"]))
    return joined.withColumn("score", F.when(F.col("_top") > 0, F.col("score") / F.col("_top")).otherwise(F.lit(0.0))).drop("_q", "_top")


def min_max(scores: DataFrame) -> DataFrame:
    """Scores between the worst (0) and the best (1) of their question; 1 where all are equal."""
    ends = scores.groupBy(F.col("q_id").alias("_q")).agg(F.min("score").alias("_lo"), F.max("score").alias("_hi"))
    joined = scores.join(ends, scores["q_id"].eqNullSafe(ends["_q"]))
    level = F.when(F.col("_hi") > F.col("_lo"), (F.col("score") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(F.lit(1.0))
    return joined.withColumn("score", level).drop("_q", "_lo", "_hi")


def top_k(scores: DataFrame, k: int, *order) -> DataFrame:
    """The ``k`` best of each question, with their rank."""
    rank = F.row_number().over(Window.partitionBy("q_id").orderBy(*order))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)


#: Up to so many query vectors are sent to every task.
QUERIES = 10_000


def vector_scores(queries: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of every query vector (q_id, q_embedding) with every vector (id, embedding).

    Queries are a stated set, counted first: a few are sent to every task, so the vectors are read once and
    never shuffled; more are met block by block.  A rank that is asked for next is applied before the shuffle.
    """
    few = queries.limit(QUERIES + 1).count() <= QUERIES
    asked = F.broadcast(queries) if few else queries
    return vectors.crossJoin(asked).select("q_id", "id", cosine(F.col("q_embedding"), F.col("embedding")).alias("score"))


def hybrid(dense: DataFrame, sparse: DataFrame, sparse_weight: float = DEFAULT_SPARSE_WEIGHT) -> DataFrame:
    d, s = dense.withColumnRenamed("score", "dense"), sparse.withColumnRenamed("score", "sparse")
    both = d.join(s, ["q_id", "id"], "full")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return both.select("q_id", "id", ((1 - sparse_weight) * zero(F.col("dense")) + sparse_weight * zero(F.col("sparse"))).alias("score"))


def sparse_weight(query_type: Column) -> Column:
    """The lexical weight that a type of question has."""
    weight = F.lit(DEFAULT_SPARSE_WEIGHT)
    for kind, w in SPARSE_WEIGHT.items():
        weight = F.when(query_type == kind, w).otherwise(weight)
    return weight


def hybrid_by_type(dense: DataFrame, sparse: DataFrame, questions: DataFrame) -> DataFrame:
    """:func:`hybrid` with the lexical weight that a question's type (q_id, query_type) has."""
    d, s = dense.withColumnRenamed("score", "dense"), sparse.withColumnRenamed("score", "sparse")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    both = d.join(s, ["q_id", "id"], "full").join(questions.select("q_id", sparse_weight(F.col("query_type")).alias("_w")), "q_id")
    return both.select("q_id", "id", ((1 - F.col("_w")) * zero(F.col("dense")) + F.col("_w") * zero(F.col("sparse"))).alias("score"))


def rrf(a: DataFrame, b: DataFrame, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of two scored lists; an item that a list lacks ranks k behind its end.
    The lists are results of searches (:func:`top_k`), so a question has a bounded number of items."""

    def ranked(df: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("q_id")
        return df.select("q_id", "id", F.row_number().over(w.orderBy(F.desc("score"), "id")).alias(f"rank_{name}"), F.count(F.lit(1)).over(w).alias(f"n_{name}"))

    both = ranked(a, "a").join(ranked(b, "b"), ["q_id", "id"], "full")
    w = Window.partitionBy("q_id")
    rank = lambda n: F.coalesce(F.col(f"rank_{n}"), F.coalesce(F.max(f"n_{n}").over(w), F.lit(0)) + k)
    return both.select("q_id", "id", (1 / (k + rank("a")) + 1 / (k + rank("b"))).alias("score"))


def cluster_cap(ranked: DataFrame, cap: int) -> DataFrame:
    """At most ``cap`` edges of a question for each source and relation, the best by score."""
    w = Window.partitionBy("q_id", "source_uid", "relation").orderBy(F.desc("score"), "edge_uid")
    return ranked.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= cap).drop("_r")


def mmr(candidates: DataFrame, k: int, balance: float = 0.65) -> DataFrame:
    """Greedy diversification of each question's candidates (q_id, edge_uid, source_uid,
    relation, target_uid, score, priority): q_id, edge_uid, rank.

    A candidate list is the bounded result of a search, one group for each question.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "edge_uid"], ascending=[False, True]).reset_index(drop=True)
        score = pdf["score"].to_numpy(float)
        spread = score.max() - score.min()
        level = (score - score.min()) / spread if spread > 0 else np.ones(len(score))
        parts = [(pdf[c].to_numpy(), w) for c, w in (("relation", 0.4), ("target_uid", 0.3), ("source_uid", 0.3))]
        nearest, free, chosen = np.zeros(len(pdf)), np.ones(len(pdf), bool), []
        while free.any() and len(chosen) < k:
            value = np.where(free, balance * level - (1 - balance) * nearest - 10.0 * pdf["priority"].to_numpy(float), -np.inf)
            best = int(value.argmax())
            chosen.append(best)
            free[best] = False
            nearest = np.maximum(nearest, sum(w * (x == x[best]) for x, w in parts))
        out = pdf.iloc[chosen][["q_id", "edge_uid"]].copy()
        out["rank"] = range(1, len(chosen) + 1)
        return out

    ship(candidates.sparkSession)
    q_type = dict(candidates.dtypes)["q_id"]
    return candidates.groupBy("q_id").applyInPandas(run, f"q_id {q_type}, edge_uid string, rank int")


