"""Exact deduplication with a heavy-hitter split (DataFrame functions only).

1. Each text becomes a SHA-256 digest of its text without white space.
2. A Misra-Gries sketch (``approx_top_k``, the mergeable frequent-items summary
   that Spark ships) names digests that may be frequent: a bounded list, and
   every digest with more than ``rows / SKETCH_SLOTS`` rows is on it.
3. Those candidates are *verified* by an exact count; winner and size of each
   frequent group form a table of at most ``HEAVY_DIGESTS`` rows, which is
   broadcast, so the rows of hot groups are settled where they are read.
4. All other digests are dealt by an ordinary shuffle; none of their groups can
   hold more than the sketch's error share of the rows.

Defined results: null text is the empty text; texts that are empty after
removal of white space equal one another; of equal texts the longest original
(code points), then the smallest ``doc_id`` stays, null ids last; rows that are
repeated outright are members like any other, and of several rows with the
winner's id and length, the flag ``kept`` is true for exactly one.  An empty
table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import WS_CHARS, written

#: Bound of the broadcast table, and of the counters in the sketch.
HEAVY_DIGESTS = 1024
SKETCH_SLOTS = 16384


def _digests(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    bare = F.translate(text, WS_CHARS, "")
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(bare.cast("binary"), 256)).alias("digest"),
        F.length(text).alias("n"),
        # tells rows apart that are equal in everything else
        F.monotonically_increasing_id().alias("row"),
    )


def _rank():
    """Order of preference inside a group, smallest first."""
    return F.struct((-F.col("n")).alias("n"), F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("doc_id"), F.col("row").alias("row"))


def heavy_winners(digests: DataFrame) -> DataFrame:
    """Verified winners of the frequent digests, at most HEAVY_DIGESTS rows."""
    sketch = digests.agg(F.expr(f"approx_top_k(hex(digest), {HEAVY_DIGESTS}, {SKETCH_SLOTS})").alias("top"))
    candidates = sketch.select(F.explode("top").alias("t")).where(F.col("t.count") > 1).select(F.unhex(F.col("t.item")).alias("digest"))
    return (
        digests.join(F.broadcast(candidates), "digest", "left_semi")
        .groupBy("digest")
        .agg(F.min(_rank()).alias("best"), F.count(F.lit(1)).alias("group_size"))
        .where(F.col("group_size") > 1)
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    digests = written(_digests(docs, id_col, text_col), "digests")
    heavy = written(heavy_winners(digests), "heavy")
    near = F.broadcast(heavy)
    out = lambda df: df.select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
    settled = out(digests.join(near, "digest"))
    group = Window.partitionBy("digest")
    rest = out(
        digests.join(near.select("digest"), "digest", "left_anti")
        .withColumn("best", F.min(_rank()).over(group))
        .withColumn("group_size", F.count(F.lit(1)).over(group))
    )
    return settled.unionByName(rest)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that lose to an equal text, columns unchanged.

    Verdicts come from digests alone; those of hot groups are settled by the broadcast
    table.  A row that loses is found again by its digest, length and id in an anti
    join, which shuffles every text once.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"),
        F.col(id_col).cast("long").alias("doc_id"),
        F.unhex(F.sha2(F.translate(text, WS_CHARS, "").cast("binary"), 256)).alias("digest"),
        F.length(text).alias("n"),
    )
    verdict = exact_winners(docs, id_col, text_col)
    losers = verdict.where(~F.col("kept")).select("doc_id", "digest", "n", F.lit(True).alias("lost")).distinct()
    ties = verdict.where("kept").select("doc_id", "digest", "n", F.lit(True).alias("won"))
    same = [keyed[c].eqNullSafe(losers[c]) for c in ("doc_id", "digest", "n")]
    clear = keyed.join(losers, same, "left_anti")
    # a winner that is repeated row for row is also on the losers' list: one of its rows stays
    both = losers.select("doc_id", "digest", "n").intersect(ties.select("doc_id", "digest", "n"))
    again = keyed.join(both, [keyed[c].eqNullSafe(both[c]) for c in ("doc_id", "digest", "n")], "left_semi").dropDuplicates(["doc_id", "digest", "n"])
    return clear.unionByName(again).select(*[F.col("whole").getField(c).alias(c) for c in docs.columns])


def exact_winners(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    digests = written(_digests(docs, id_col, text_col), "digests")
    near = F.broadcast(written(heavy_winners(digests), "heavy"))
    group = Window.partitionBy("digest")
    hot = digests.join(near.select("digest", "best"), "digest")
    rest = digests.join(near.select("digest"), "digest", "left_anti").withColumn("best", F.min(_rank()).over(group))
    both = hot.unionByName(rest.select(*hot.columns))
    return written(both.select("doc_id", "digest", "n", (F.col("row") == F.col("best.row")).alias("kept")), "verdicts")


SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents
), g AS (
  SELECT doc_id, h,
         first_value(doc_id) OVER (PARTITION BY h ORDER BY length(t) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY h) AS group_size
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM g
"""
