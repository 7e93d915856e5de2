"""From ranked edges to curated evidence, for a table of questions at once.

Candidates are rows (q_id, edge_uid, source_label, target_label, relation, start_year,
end_year, edge_type, score, ...), the bounded result of a search; question terms
are rows (q_id, pos, term).  Nothing branches on a count that the driver takes: a
fallback ("all, if fewer than three remain") is a count per question in the same plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm
from ..functions.timefn import overlaps_year
from ..vocabulary import FACTUAL_TYPES

# Relations that answer a type of question, and the bonus for them and for places.
FAVOURED = {
    "state_at_time": ("led_by", "head_of_state", "president_of", "governed_by", "served_as", "ruled_by"),
    "first_occurrence": ("founded", "established", "launched", "premiered", "series_premiere", "introduced"),
}
FAVOUR, PLACE = 0.15, 0.05
# Relations that link tags and are never shown.
HIDDEN = ("tag_related_to", "inferred_tag")
# Words behind a year that make it part of a title, and verbs that tell when a work came out.
_TITLE = r"(?i)^(?:novel|book|poem|play|film|movie|song|album|game|series|show|olympics|olympic games|world cup|championship|ep|single)"
_WRITTEN = r"(?i)\b(?:written|published|released|written by|based on)\b"
_YEAR = r"\b(1\d{3}|2\d{3})\b"
_DATE_LABEL = r"^-?\d{1,4}(?:-\d{2}){0,2}$"


def token_overlap(label: Column, term: Column) -> Column:
    """One contains the other, or a word of the term of more than two letters is a word of the label."""
    a, b = F.lower(label), F.lower(term)
    words = F.filter(F.split(b, r"\s+"), lambda w: F.length(w) > 2)
    return a.contains(b) | b.contains(a) | F.arrays_overlap(words, F.split(a, r"\s+"))


def overlapping_labels(terms: DataFrame, nodes: DataFrame) -> DataFrame:
    """(q_id, term) -> q_id, node_uid of labels that overlap the term.

    Terms and labels meet by their words (an equi-join on postings), and by whole value for
    terms that are part of one word's label; the predicate itself comes after.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(norm(F.col(c)), r"\s+"), lambda w: w != ""))
    t = terms.select("q_id", "term", F.explode(words("term")).alias("word"))
    n = nodes.select("node_uid", "label", F.explode(words("label")).alias("word"))
    return t.join(n, "word").where(token_overlap(F.col("label"), F.col("term"))).select("q_id", "node_uid").distinct()


def mentions(candidates: DataFrame, terms: DataFrame) -> DataFrame:
    """q_id, edge_uid, pos, term: which term of its question each candidate mentions at one of its ends."""
    hit = candidates.join(terms, "q_id").where(token_overlap(F.col("source_label"), F.col("term")) | token_overlap(F.col("target_label"), F.col("term")))
    return hit.select("q_id", "edge_uid", "pos", "term").distinct()


def _hint_overlap(relation: Column, hint: Column) -> Column:
    words = lambda c: F.split(F.replace(F.lower(c), F.lit("_"), F.lit(" ")), r"\s+")
    return F.coalesce(F.arrays_overlap(F.filter(words(hint), lambda w: F.length(w) > 2), words(relation)), F.lit(False))


def date_exact(year: Column) -> Column:
    """The years of an edge hold the target; with no end, its start is the target."""
    s, e = F.col("start_year"), F.col("end_year")
    return F.coalesce(F.when(s.isNotNull() & e.isNotNull(), (s <= year) & (year <= e)).when(s.isNotNull(), s == year), F.lit(False))


def prefilter(candidates: DataFrame, terms: DataFrame, questions: DataFrame, least: int = 3) -> DataFrame:
    """Candidates that mention a term, bear the question's relation hint, or are dated exactly in its
    year; all of a question's if fewer than ``least`` do.  Questions: q_id, relation_hint, year."""
    told = mentions(candidates, terms).select("q_id", "edge_uid").distinct().withColumn("_told", F.lit(True))
    rows = candidates.join(questions.select("q_id", "relation_hint", F.col("year").alias("_year")), "q_id").join(told, ["q_id", "edge_uid"], "left")
    passes = F.col("_told").isNotNull() | _hint_overlap(F.col("relation"), F.col("relation_hint")) | date_exact(F.col("_year"))
    rows = rows.withColumn("_ok", passes)
    n = F.count_if("_ok").over(Window.partitionBy("q_id"))
    return rows.withColumn("_n", n).where(F.col("_ok") | (F.col("_n") < least)).drop("_told", "_year", "_ok", "_n", "relation_hint")


def title_year(text: Column, year: Column) -> Column:
    """Is a year in a text the name of a work or of games rather than a time?"""
    at = F.instr(text, year)
    after = F.substring(F.trim(F.substr(text, at + F.length(year))), 1, 30)
    before = F.trim(F.left(text, F.greatest(at - 1, F.lit(0))))
    near = F.right(before, F.lit(30)).rlike(_TITLE) | after.rlike(_TITLE)
    return after.rlike(_TITLE) | (text.rlike(_WRITTEN) & near)


def target_year(text: Column, planned: Column) -> Column:
    """The year that a plan names, or the first in the text unless it is part of a title."""
    first = F.regexp_extract(text, _YEAR, 1)
    return F.coalesce(planned.cast("bigint"), F.when((first != "") & ~title_year(text, first), first.try_cast("bigint")))


def boosted(fused: DataFrame, questions: DataFrame, places: DataFrame | None = None) -> DataFrame:
    """Fused scores with a bonus for relations that a question's type favours, and for edges at its
    places (q_id, node_uid) where they are given."""
    liked = F.lit(False)
    for kind, relations in FAVOURED.items():
        liked = liked | ((F.col("_type") == kind) & F.col("relation").isin(*relations))
    rows = fused.join(questions.select("q_id", F.col("query_type").alias("_type")), "q_id")
    bonus = F.when(liked, FAVOUR).otherwise(0.0)
    if places is not None:
        here = places.select("q_id", "node_uid").distinct()
        at = rows.select("q_id", "edge_uid", F.explode(F.array("source_uid", "target_uid")).alias("node_uid")).join(here, ["q_id", "node_uid"], "left_semi")
        rows = rows.join(at.select("q_id", "edge_uid").distinct().withColumn("_here", F.lit(True)), ["q_id", "edge_uid"], "left")
        bonus = bonus + F.when(F.col("_here"), PLACE).otherwise(0.0)
    return rows.withColumn("score", F.col("score") + bonus).drop("_type", "_here")


def displayed(edges: DataFrame) -> DataFrame:
    """Of each question base and gold facts that are not hidden; if there are none, all that are not hidden; else all."""
    shown = ~F.lower("relation").isin(*HIDDEN)
    tier = F.when(shown & F.col("edge_type").isin(*FACTUAL_TYPES), 0).when(shown, 1).otherwise(2)
    best = F.min("_tier").over(Window.partitionBy("q_id"))
    return edges.withColumn("_tier", tier).withColumn("_best", best).where("_tier = _best").drop("_tier", "_best")


def balanced(edges: DataFrame, terms: DataFrame, per_term: int = 4, most: int = 18) -> DataFrame:
    """Of the ranked edges of each question (with rank) at most ``per_term`` for each term, an edge under the first
    term that it mentions, then those that mention none, ``most`` in all; with the new rank."""
    first = mentions(edges, terms).groupBy("q_id", "edge_uid").agg(F.min("pos").alias("pos"))
    rows = edges.join(first, ["q_id", "edge_uid"], "left").withColumn("pos", F.coalesce("pos", F.lit(1 << 30)))
    place = F.row_number().over(Window.partitionBy("q_id", "pos").orderBy("rank"))
    kept = rows.withColumn("_k", place).where((F.col("pos") == 1 << 30) | (F.col("_k") <= per_term))
    new = F.row_number().over(Window.partitionBy("q_id").orderBy("pos", "_k"))
    return kept.withColumn("rank", new).where(F.col("rank") <= most).drop("pos", "_k")


def interleaved(edges: DataFrame, terms: DataFrame, each: int = 3) -> DataFrame:
    """Edges with a rank that begins with the ``each`` best dated ones of each term, in order of the terms; the
    others follow by the terms that they mention and their score."""
    told = mentions(edges, terms)
    dated = told.join(edges.where("start_year is not null").select("q_id", "edge_uid", "score"), ["q_id", "edge_uid"])
    top = dated.withColumn("_k", F.row_number().over(Window.partitionBy("q_id", "pos").orderBy(F.desc("score"), "edge_uid"))).where(F.col("_k") <= each)
    first = top.groupBy("q_id", "edge_uid").agg(F.min(F.struct("pos", "_k")).alias("_at"))
    covers = told.groupBy("q_id", "edge_uid").agg(F.count(F.lit(1)).alias("_covers"))
    rows = edges.join(first, ["q_id", "edge_uid"], "left").join(covers, ["q_id", "edge_uid"], "left")
    order = Window.partitionBy("q_id").orderBy(F.col("_at").asc_nulls_last(), F.desc(F.coalesce("_covers", F.lit(0))), F.desc("score"), "edge_uid")
    return rows.withColumn("rank", F.row_number().over(order)).drop("_at", "_covers")


def rescued(candidates: DataFrame, terms: DataFrame, pool: DataFrame, least: int = 3, most: int = 5) -> DataFrame:
    """Candidates, and for each term that fewer than ``least`` dated ones mention up to ``most`` dated edges
    of the pool (q_id, ...) that mention it, best first; each edge once."""
    dated = candidates.where("start_year is not null")
    have = mentions(dated, terms).groupBy("q_id", "pos").agg(F.count(F.lit(1)).alias("_n"))
    poor = terms.where("length(term) >= 3").join(have, ["q_id", "pos"], "left").where(F.coalesce("_n", F.lit(0)) < least).select("q_id", "pos", "term")
    fresh = pool.where("start_year is not null").join(candidates.select("q_id", "edge_uid"), ["q_id", "edge_uid"], "left_anti")
    hit = mentions(fresh, poor).join(fresh, ["q_id", "edge_uid"])
    best = hit.withColumn("_k", F.row_number().over(Window.partitionBy("q_id", "pos").orderBy(F.desc("score"), "edge_uid"))).where(F.col("_k") <= most)
    return candidates.unionByName(best.dropDuplicates(["q_id", "edge_uid"]).select(*candidates.columns))


def _near(year: Column, slack: int) -> Column:
    s, e = F.col("start_year"), F.col("end_year")
    return F.when(year.isNull() | s.isNull(), F.lit(True)).when(e.isNotNull(), (s <= year) & (year <= e)).otherwise(F.abs(s - year) <= slack)


def safety_net(selected: DataFrame, candidates: DataFrame, terms: DataFrame, questions: DataFrame, most: int = 4) -> DataFrame:
    """q_id, edge_uid: the selected edges, and up to ``most`` candidates that fit the year and mention a term that none of the selected does."""
    covered = mentions(candidates.join(selected, ["q_id", "edge_uid"], "left_semi"), terms).select("q_id", "pos").distinct()
    lacking = terms.where("length(term) > 2").join(covered, ["q_id", "pos"], "left_anti")
    open_ = candidates.join(selected, ["q_id", "edge_uid"], "left_anti").join(questions.select("q_id", F.col("year").alias("_year")), "q_id").where(_near(F.col("_year"), 2))
    more = mentions(open_, lacking).select("q_id", "edge_uid").distinct().join(open_.select("q_id", "edge_uid", "score"), ["q_id", "edge_uid"])
    more = more.withColumn("_k", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "edge_uid"))).where(F.col("_k") <= most)
    return selected.select("q_id", "edge_uid").unionByName(more.select("q_id", "edge_uid"))


def filled(selected: DataFrame, candidates: DataFrame, questions: DataFrame, least: int = 4) -> DataFrame:
    """q_id, edge_uid: the selected edges, and as many of the best candidates that fit the year as bring a question to ``least``."""
    n = selected.groupBy("q_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = candidates.join(selected, ["q_id", "edge_uid"], "left_anti").join(questions.select("q_id", F.col("year").alias("_year")), "q_id").join(n, "q_id", "left").where(_near(F.col("_year"), 2))
    year = F.col("_year")
    away = F.least(F.abs(F.col("start_year") - year), F.abs(F.coalesce("end_year", "start_year") - year))
    priority = F.when(year.isNull() | overlaps_year(F.col("start_year"), F.col("end_year"), year), 0).when(F.col("start_year").isNull(), 1).when(away <= 1, 2).otherwise(9)
    order = Window.partitionBy("q_id").orderBy(priority, F.desc("score"), "edge_uid")
    more = rows.withColumn("_k", F.row_number().over(order)).where(F.col("_k") + F.coalesce("_n", F.lit(0)) <= least)
    return selected.select("q_id", "edge_uid").unionByName(more.select("q_id", "edge_uid"))


def seeds(nodes: DataFrame, most: int = 10) -> DataFrame:
    """Of the resolved nodes of each question (q_id, node_uid, label, category, rank) those that are no dates; the first ``most`` if all are."""
    date = (F.col("category") == "date") | F.trim("label").rlike(_DATE_LABEL)
    n = F.count_if(~F.col("_date")).over(Window.partitionBy("q_id"))
    rows = nodes.withColumn("_date", date).withColumn("_n", n)
    return rows.where(~F.col("_date") | ((F.col("_n") == 0) & (F.col("rank") <= most))).drop("_date", "_n")


def canonical_entities(edges: DataFrame, most: int = 6) -> DataFrame:
    """q_id, entities: distinct labels of ranked edges in order, neither dates nor numbers."""
    ends = edges.select("q_id", "rank", F.posexplode(F.array(F.struct(F.col("source_label").alias("label"), F.col("source_category").alias("category")), F.struct(F.col("target_label").alias("label"), F.col("target_category").alias("category")))).alias("k", "x"))
    named = ends.where(~F.col("x.category").isin("date", "year") & ~F.col("x.label").rlike(r"^\d+$"))
    first = named.groupBy("q_id", F.col("x.label").alias("label")).agg(F.min(F.struct("rank", "k")).alias("at"))
    best = first.withColumn("_k", F.row_number().over(Window.partitionBy("q_id").orderBy("at"))).where(F.col("_k") <= most)
    return best.groupBy("q_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "label"))), lambda x: x["label"]).alias("entities"))


def evidence(edges: DataFrame, most: int = 10) -> DataFrame:
    """q_id, rank, evidence: what is shown of an edge, with its first ``most`` source rows."""
    fields = ["edge_uid", "source_label", "source_category", "target_label", "target_category", "relation", "start_year", "end_year", "edge_type", "support_count"]
    return edges.select("q_id", "rank", F.struct(*fields, F.slice("source_row_ids", 1, most).alias("source_row_ids")).alias("evidence"))


def answers(ranked: DataFrame, questions: DataFrame) -> DataFrame:
    """q_id, answer, confidence from curated edges (with rank and labels): five of them in words, their entities, and
    the confidence that follows from how many are facts; questions without edges say so."""
    five = ranked.where("rank <= 5").select("q_id", F.struct("rank", F.concat_ws(" ", "source_label", "relation", "target_label").alias("t")).alias("x"))
    told = five.groupBy("q_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "; ").alias("told"))
    factual = ranked.groupBy("q_id").agg(F.count_if(F.col("edge_type").isin(*FACTUAL_TYPES) & ~F.lower("relation").isin(*HIDDEN)).alias("n"))
    rows = questions.join(told, "q_id", "left").join(canonical_entities(ranked), "q_id", "left").join(factual, "q_id", "left")
    when = F.when(F.col("year").isNotNull(), F.concat(F.lit(" in "), F.col("year").cast("string"))).otherwise("")
    names = F.when(F.size("entities") > 0, F.concat(F.lit(" Key entities: "), F.array_join("entities", ", "), F.lit("."))).otherwise("")
    text = F.concat(F.lit("Evidence"), when, F.lit(": "), F.col("told"), F.lit("."), names)
    return rows.select("q_id", F.coalesce(text, F.lit("Retrieval did not return supporting graph edges.")).alias("answer"), F.when(F.col("told").isNull(), 0.1).otherwise(F.least(F.lit(0.9), 0.3 + 0.1 * F.col("n"))).alias("confidence"))


def weak(confidence: Column, answer: Column, year: Column, nearest: Column) -> Column:
    """Evidence that is not to be trusted: low confidence, an answer that says so, or all of it over thirty years off."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    said = low.contains("no factual relations") | low.contains("best-effort semantic") | low.contains("retrieval did not return")
    return (confidence < 0.6) | said | F.coalesce(F.abs(nearest - year) > 30, F.lit(False))


def candidate_entities(shown: DataFrame, questions: DataFrame, most: int = 8, depth: int = 16) -> DataFrame:
    """q_id, entity, score: the ends of the first ``depth`` edges, sources before targets, more for words
    that the question (q_id, text) has and for dated edges."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]{3,}"), F.lit(0)))
    rows = shown.where(F.col("rank") <= depth).join(questions.select("q_id", words.alias("_words")), "q_id")
    dated = F.when(F.col("start_year").isNotNull(), 0.25).otherwise(0.0)
    ends = rows.select("q_id", "_words", dated.alias("d"), F.explode(F.array(F.struct(F.col("source_label").alias("e"), F.lit(2.0).alias("b")), F.struct(F.col("target_label").alias("e"), F.lit(1.0).alias("b")))).alias("x"))
    said = F.exists("_words", lambda w: F.lower(F.col("x.e")).contains(w))
    scored = ends.groupBy("q_id", F.col("x.e").alias("entity")).agg(F.sum(F.col("x.b") + F.col("d") + F.when(said, 0.75).otherwise(0.0)).alias("score"))
    best = scored.withColumn("_k", F.row_number().over(Window.partitionBy("q_id").orderBy(F.desc("score"), "entity")))
    return best.where(F.col("_k") <= most).drop("_k")


def reference_hits(hits: DataFrame, questions: DataFrame, least: float = 0.48) -> DataFrame:
    """Hits (q_id, hit_id, query, answer, score) of entity questions (q_id, text, year): no bare yes or no, similar
    enough, and only those that name the year if any does.  Hits of other questions stay as they are."""
    rows = hits.join(questions.select("q_id", F.lower(F.trim("text")).alias("_q"), F.col("year").cast("string").alias("_y")), "q_id")
    entity = F.col("_q").rlike(r"^(?:who|which|what|whose|whom) ")
    yes_no = F.lower(F.trim(F.coalesce("answer", F.lit("")))).rlike(r"^(?:yes|no)(?:[ ,.]|$)")
    rows = rows.withColumn("_e", entity).where(~F.col("_e") | (~yes_no & (F.col("score") >= least)))
    names = F.coalesce(F.concat_ws(" ", "query", "answer").contains(F.col("_y")), F.lit(False))
    rows = rows.withColumn("_has", names).withColumn("_any", F.max(F.col("_has")).over(Window.partitionBy("q_id")))
    return rows.where(~F.col("_e") | F.col("_has") | ~F.col("_any")).drop("_q", "_y", "_e", "_has", "_any")
