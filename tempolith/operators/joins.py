"""Joins of evaluation tables, and joins on time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def gold_predictions(gold: DataFrame, predicted: DataFrame, key: str = "id") -> DataFrame:
    """Gold rows with the prediction of the same id; ids that one side lacks are left out."""
    p = predicted.select(key, *[F.col(c).alias(f"predicted_{c}") for c in predicted.columns if c != key])
    return gold.join(p, key)


def scored_responses(responses: DataFrame, tasks: DataFrame, questions: DataFrame) -> DataFrame:
    """Responses (explanation_id, question_id, question_type, answer, score, domain, bucket), with what they lack
    from tasks (explanation_id, domain, bucket) and, for questions with one right answer, a score from
    questions (explanation_id, question_id, correct_answer); scores are held to 0..1."""
    t = tasks.select("explanation_id", F.col("domain").alias("_d"), F.col("bucket").alias("_b")).dropDuplicates(["explanation_id"])
    q = questions.select("explanation_id", "question_id", F.col("correct_answer").alias("_c")).dropDuplicates(["explanation_id", "question_id"])
    rows = responses.join(t, "explanation_id", "left").join(q, ["explanation_id", "question_id"], "left")
    given = F.trim(F.coalesce("answer", F.lit("")))
    own = F.when(F.col("question_type").isin("mcq", "fill_blank") & F.col("_c").isNotNull(), ((given != "") & (given == F.trim("_c"))).cast("double"))
    score = F.coalesce("score", own)
    return rows.withColumns({"domain": F.coalesce("domain", "_d"), "bucket": F.coalesce("bucket", "_b"), "score": F.when(score.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))}).drop("_d", "_b", "_c")


def annotated(rows: DataFrame, notes: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """Rows with columns of annotations by id, as numbers; an annotation that is no number is none.
    ``columns``: name in the result -> name in the annotations."""
    n = notes.dropDuplicates([key]).select(key, *[F.col(c).try_cast("double").alias(f"_{name}") for name, c in columns.items()])
    out = rows.join(n, key, "left")
    have = set(rows.columns)
    fill = {name: F.coalesce(F.col(f"_{name}"), F.col(name)) if name in have else F.col(f"_{name}") for name in columns}
    return out.withColumns(fill).drop(*[f"_{name}" for name in columns])


def within_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], at: str = "at", start: str = "start_year", end: str = "end_year", width: int = 16) -> DataFrame:
    """Points (keys, at) with the intervals (keys, start, end, ...) of the same keys that hold them.

    An interval is listed under each stretch of ``width`` that it touches, a point under its own, so the join is on
    equal keys and stretches, and a key with many rows is spread over its stretches; long intervals
    are listed once for a coarser width, ``width`` times as wide, and so on, which a point looks up as well.
    """
    lo, hi = F.least(F.col(start), F.col(end)), F.greatest(F.col(start), F.col(end))
    length = hi - lo + 1
    # the level at which an interval touches at most `width` stretches
    level = F.when(length <= width * width, 0).when(length <= width**4, 1).when(length <= width**7, 2).otherwise(3)
    step = lambda k: F.pow(F.lit(float(width)), 3 * k + 1)
    rows = intervals.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_level", level)
    rows = rows.withColumn("_stretch", F.explode(F.sequence(F.floor(lo / step(F.col("_level"))), F.floor(hi / step(F.col("_level"))))))
    asked = points.withColumn("_level", F.explode(F.array(*[F.lit(k) for k in range(4)]))).withColumn("_stretch", F.floor(F.col(at) / step(F.col("_level"))))
    hit = asked.join(rows, [*keys, "_level", "_stretch"])
    return hit.where((lo <= F.col(at)) & (F.col(at) <= hi)).drop("_level", "_stretch")
