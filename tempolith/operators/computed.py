"""Answers that follow from evidence without a model: orders of two things, holders of a role, years.

Evidence: rows (q_id, source_label, target_label, relation, start_year, end_year).  Questions say what they need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Relations that tell which of both ends came first.
SOURCE_FIRST, TARGET_FIRST = ("preceded", "followed_by"), ("preceded_by", "follows")
#: Years that a term without an end is taken to last.
OPEN_TERM = 25


def hint_words(text: Column) -> Column:
    """Words of three letters and more that may tell two things apart."""
    idle = ("the", "was", "were", "did", "does", "and", "for", "with", "from", "that", "this", "before", "after", "first", "happen", "happened", "come", "came", "earlier", "later", "which", "what", "who")
    return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]{3,}"), F.lit(0)), lambda w: ~w.isin(*idle)))


def _own(a: Column, b: Column) -> Column:
    """The words of one side that the other lacks, or all of them if it lacks none."""
    own = F.array_except(a, b)
    return F.when(F.size(own) > 0, own).otherwise(a)


def _sides(evidence: DataFrame, questions: DataFrame) -> DataFrame:
    """questions with the first year of each side, of lines that speak of that side only."""
    a, b = hint_words(F.col("a")), hint_words(F.col("b"))
    q = questions.select("*", _own(a, b).alias("_a"), _own(b, a).alias("_b"))
    words = F.split(F.lower(F.concat_ws(" ", "source_label", "relation", "target_label")), r"[^a-z0-9]+")
    lines = evidence.where("start_year is not null").select("q_id", words.alias("_w"), "start_year").join(q.select("q_id", "_a", "_b"), "q_id")
    on_a, on_b = F.arrays_overlap("_w", "_a"), F.arrays_overlap("_w", "_b")
    first = lines.groupBy("q_id").agg(F.min(F.when(on_a & ~on_b, F.col("start_year"))).alias("a_year"), F.min(F.when(on_b & ~on_a, F.col("start_year"))).alias("b_year"))
    return questions.join(first, "q_id", "left")


def ordering_yes_no(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(q_id, a, b) "was a before b?" -> q_id, answer: Yes, No, or null where a side has no year."""
    s = _sides(evidence, questions)
    return s.select("q_id", F.when(F.col("a_year") <= F.col("b_year"), "Yes").when(F.col("a_year") > F.col("b_year"), "No").alias("answer"))


def ordering_name(questions: DataFrame, evidence: DataFrame) -> DataFrame:
    """(q_id, a, b, later) "which came first (or later), a or b?" -> q_id, answer: by a relation between both that
    tells their order, else by their first years."""
    s = _sides(evidence, questions)
    a, b = hint_words(F.col("a")), hint_words(F.col("b"))
    q = questions.select("q_id", _own(a, b).alias("_a"), _own(b, a).alias("_b"))
    words = lambda c: F.split(F.lower(c), r"[^a-z0-9]+")
    rel = F.regexp_replace(F.replace(F.lower("relation"), F.lit(" "), F.lit("_")), "[^a-z_]", "")
    told = evidence.select("q_id", rel.alias("r"), words("source_label").alias("s"), words("target_label").alias("t")).where(F.col("r").isin(*SOURCE_FIRST, *TARGET_FIRST)).join(q, "q_id")
    on = lambda end, side: F.arrays_overlap(end, side)
    forth, back = on("s", "_a") & on("t", "_b"), on("s", "_b") & on("t", "_a")
    a_first = F.when(forth, F.col("r").isin(*SOURCE_FIRST)).when(back, F.col("r").isin(*TARGET_FIRST))
    known = told.groupBy("q_id").agg(F.max(a_first).alias("_first"))
    rows = s.join(known, "q_id", "left")
    first = F.coalesce("_first", F.col("a_year") <= F.col("b_year"))
    return rows.select("q_id", F.when(first.isNotNull(), F.when(first == F.col("later"), F.col("b")).otherwise(F.col("a"))).alias("answer"))


def role_holder(questions: DataFrame, evidence: DataFrame, relations: list[str]) -> DataFrame:
    """(q_id, text, year) -> q_id, answer: the source of the role relation whose term holds the year and whose target
    shares a word with the question; of several the one that began first."""
    q = questions.select("q_id", hint_words(F.col("text")).alias("_q"), "year")
    rows = evidence.where(F.col("relation").isin(*relations) & F.col("start_year").isNotNull()).join(q, "q_id")
    fits = F.arrays_overlap(F.split(F.lower("target_label"), r"[^a-z0-9]+"), F.col("_q"))
    until = F.coalesce("end_year", F.when(F.col("start_year") <= F.col("year"), F.col("start_year") + OPEN_TERM).otherwise(F.col("start_year")))
    held = rows.where(fits & (F.col("start_year") <= F.col("year")) & (F.col("year") <= until))
    best = held.groupBy("q_id").agg(F.min(F.struct("start_year", "source_label")).alias("b"))
    return questions.select("q_id").join(best, "q_id", "left").select("q_id", F.col("b.source_label").alias("answer"))


def what_year(questions: DataFrame, evidence: DataFrame, relations: list[str]) -> DataFrame:
    """(q_id, text) -> q_id, answer: the only year that the named relations give to what the question speaks of, if there is just one."""
    q = questions.select("q_id", hint_words(F.col("text")).alias("_q"))
    rows = evidence.where(F.col("relation").isin(*relations)).join(q, "q_id").where(F.arrays_overlap(F.split(F.lower("source_label"), r"[^a-z0-9]+"), F.col("_q")))
    year = F.coalesce(F.regexp_extract("target_label", r"^(\d{4})", 1).try_cast("bigint"), F.col("start_year"))
    years = rows.select("q_id", year.alias("y")).where("y is not null").groupBy("q_id").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    return questions.select("q_id").join(years, "q_id", "left").select("q_id", F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).alias("answer"))


def spread_lines(lines: DataFrame, n: int, ordinal: str = "line") -> DataFrame:
    """``n`` lines spread evenly over a numbered table (0, 1, ...), the first and the last among them."""
    total = lines.agg(F.max(ordinal).alias("_last"))  # one row
    step = F.lit(max(1, n - 1))
    wanted = total.select(F.explode(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.round(i * F.col("_last") / step).cast("bigint")))).alias(ordinal))
    return lines.join(F.broadcast(wanted), ordinal, "left_semi")


def without_lines(lines: DataFrame, gone: DataFrame, ordinal: str = "line") -> DataFrame:
    """The lines that are left, numbered anew in their order; the new number comes from counts of those that are gone."""
    g = gone.select(ordinal).distinct()
    left = lines.join(g, ordinal, "left_anti")
    # how many that are gone lie before each line: an ordered pass over stretches of lines
    width = 65_536
    marks = left.select(F.col(ordinal).alias("_o"), F.lit(0).alias("_g")).unionByName(g.select(F.col(ordinal).alias("_o"), F.lit(1).alias("_g"))).withColumn("_s", F.floor(F.col("_o") / width))
    own = Window.partitionBy("_s").orderBy("_o").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    base = marks.groupBy("_s").agg(F.sum("_g").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")  # a row for each stretch
    counted = marks.withColumn("_own", F.sum("_g").over(own)).where("_g = 0").join(base, "_s").select(F.col("_o").alias(ordinal), (F.col("_o") - F.col("_own") - F.col("_base")).alias("_new"))
    return left.join(counted, ordinal).withColumn(ordinal, F.col("_new")).drop("_new")
