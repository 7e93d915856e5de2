"""Mixing sources to target weights by drawing fixed-length blocks.

* Every source's words, in a pseudorandom order of its documents, form one
  stream, cut into blocks of ``BLOCK`` words.  A document's place in the stream
  comes from a two-level prefix sum (documents within hash buckets, buckets
  within sources), so no task ever holds a source.
* The mix is a number of output shards of ``SHARD`` slots.  The sources of a
  shard's slots are a multinomial draw; the draws of all shards are reconciled
  with the targets without tolerance, that is, drawn on the condition that every
  source's slots over all shards are its rounded target.  Multinomial draws under
  that condition are a multivariate hypergeometric split of the slots: between
  halves of the shards, halves of those and so on, with a key for each split, so a
  shard finds its part alone.
* The t-th slot of a source takes the block that a keyed pseudorandom
  permutation (a Feistel network, walked until it falls inside the range; a new
  key each epoch) assigns to it, so a source is used up evenly, and no block is
  taken more often than there are epochs: at most ``MAX_EPOCHS``, as no target is
  above that many times its source.
* Slots are joined to the documents' blocks by (source, block index).

Targets: sources in order of code points, null last, get weights 5, 2, 1, 5, ...
of all words; a target stops at three times its source's words and the excess
is shared out again by weight, until none is above.

Defined results: null or blank text has size 0 and is taken 0 times; repeated
rows are documents of their own; ties in a stream's order are broken by id, size
and place in the input; very long texts span many blocks, of which each is taken
or not by itself; an empty table gives an empty result; extra columns are
ignored, whatever their names.  Everything is keyed by ``seed``: reruns agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import map_batches
from .shared import WORD_RE, shuffle_parts, written

BLOCK, SHARD = 64, 4096
WEIGHTS = (5.0, 2.0, 1.0)
MAX_EPOCHS = 3
#: Hash buckets of a source's stream: rows of each, about, and how many there are at least.
BUCKET_ROWS, BUCKETS = 50_000, 1024
_M = (1 << 64) - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, a bijection of 64-bit words."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def permuted(index: np.ndarray, n: np.ndarray, key: np.ndarray) -> np.ndarray:
    """For each position the image of ``index`` (below ``n``) under the permutation of
    range(n) that ``key`` names: four Feistel rounds on the smallest even number of
    bits that holds n, repeated while the image is not below n."""
    index, n, key = np.broadcast_arrays(np.asarray(index, np.uint64), np.asarray(n, np.uint64), np.asarray(key, np.uint64))
    bits = np.ceil(np.log2(np.maximum(n, 2).astype(float)) + 1e-9).astype(np.uint64)
    half = (bits + np.uint64(1)) // np.uint64(2)
    low = (np.uint64(1) << half) - np.uint64(1)
    out = index.copy()
    todo = np.arange(len(out))
    while len(todo):
        h, mask, k = half[todo], low[todo], key[todo]
        left, right = out[todo] >> h, out[todo] & mask
        for r in range(4):
            with np.errstate(over="ignore"):
                f = mix64(right ^ (k + np.uint64((0x9E3779B97F4A7C15 * (r + 1)) & _M)))
            left, right = right, (left ^ f) & mask
        out[todo] = (left << h) | right
        todo = todo[out[todo] >= n[todo]]
    return out.astype(np.int64)


def targets(sources: DataFrame) -> DataFrame:
    """From (source, source_size), one row per source: with weight and target.

    The reshares end after at most as many steps as sources; a step settles all
    sources above their bound at once, in one window over the sources, a table
    of one small row for each.
    """
    everywhere = Window.partitionBy()
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    cycle = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))) + 1).cast("int"))
    rows = sources.withColumn("weight", cycle).withColumn("most", F.lit(float(MAX_EPOCHS)) * F.col("source_size"))
    # A source is capped iff its bound per weight is below the final level; levels come from the sources sorted by that ratio.
    rows = rows.withColumn("ratio", F.col("most") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("used", F.coalesce(F.sum("most").over(before), F.lit(0.0))).withColumn("heavier", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    rows = rows.withColumn("all", F.sum("source_size").over(everywhere)).withColumn("weights", F.sum("weight").over(everywhere))
    # the level if exactly the sources before this one are capped
    rows = rows.withColumn("level", (F.col("all") - F.col("used")) / (F.col("weights") - F.col("heavier")))
    rows = rows.withColumn("capped", F.col("ratio") <= F.col("level"))
    final = F.min(F.when(~F.col("capped"), F.struct("ratio", "level"))).over(everywhere)
    return rows.withColumn("target", F.when(F.col("capped"), F.col("most")).otherwise(F.col("weight") * F.coalesce(final["level"], F.lit(0.0)))).select(
        "source", "source_size", "weight", "target"
    )


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, row) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD_RE)).cast("long").alias("size"),
        F.xxhash64(F.coalesce(F.col(id_col).cast("long"), F.lit(-1)), F.lit(11)).alias("place"),
        row.alias("row"),
    )


def _streams(docs: DataFrame, plan: DataFrame, buckets: int) -> DataFrame:
    """Each document with words, its source's number and its first word's place in the source's stream."""
    rows = docs.where("size > 0").withColumn("bucket", F.pmod("place", F.lit(buckets)))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("words").over(order), F.lit(0)))
    sums = sums.join(plan.select(F.col("source").alias("p_source"), "number"), F.col("source").eqNullSafe(F.col("p_source")))
    inner = Window.partitionBy("source", "bucket").orderBy("place", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("before", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    s = sums.select(F.col("source").alias("s_source"), F.col("bucket").alias("s_bucket"), "base", "number")
    joined = rows.join(s, rows["source"].eqNullSafe(s["s_source"]) & (rows["bucket"] == s["s_bucket"]))
    return joined.select("row", "doc_id", "size", "number", (F.col("base") + F.col("before")).alias("start"))


def rounded(wanted: list[float]) -> list[int]:
    """Whole numbers next to the wanted ones, with their rounded sum (largest remainders first)."""
    low = [int(w + 1e-6) for w in wanted]
    lack = int(round(sum(wanted))) - sum(low)
    for i in sorted(range(len(low)), key=lambda i: low[i] - wanted[i])[: max(0, lack)]:
        low[i] += 1
    return low


#: The generator's exact draw ends here; larger numbers are drawn from its normal limit.
EXACT = 1_000_000_000


def hypergeometric(chance: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of ``n`` things taken from good and bad ones are good."""
    if good + bad < EXACT:
        return int(chance.hypergeometric(good, bad, n))
    share, total = good / (good + bad), good + bad
    spread = (n * share * (1 - share) * (total - n) / max(1, total - 1)) ** 0.5
    return int(min(good, n, max(0, n - bad, round(chance.normal(n * share, spread)))))


def split(rest: np.ndarray, lo: int, hi: int, room: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``rest`` (slots of each source) in shards lo to hi - 1, with ``room`` for each shard
    but the last, the parts of the first and the second half."""
    n = ((lo + hi) // 2 - lo) * room
    chance = np.random.Generator(np.random.Philox(key=[seed, (lo << 32) + hi]))
    first, left = np.zeros_like(rest), int(rest.sum())
    for i in np.flatnonzero(rest):
        left -= int(rest[i])
        first[i] = hypergeometric(chance, int(rest[i]), left, n)
        n -= int(first[i])
    return first, rest - first


def draw(shards: DataFrame, sources: list[tuple[int, int]], slots: int, shard: int, seed: int) -> DataFrame:
    """From rows (id), one for each shard: shard, number (of the source), slots drawn, and
    the source's slots in the shards before (first).

    ``sources``: number and slots of each source, ``slots`` in sum.
    """
    numbers, total = np.array([n for n, _ in sources]), np.array([t for _, t in sources], dtype="int64")
    n_shards = -(-slots // shard)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path = [(0, n_shards, total, np.zeros_like(total))]
        for pdf in batches:
            for k in pdf["id"].tolist():
                # the splits that lead to shard k; shards of a task share most of them
                while not path[-1][0] <= k < path[-1][1]:
                    path.pop()
                while path[-1][1] - path[-1][0] > 1:
                    lo, hi, rest, before = path[-1]
                    at = (lo + hi) // 2
                    first, second = split(rest, lo, hi, shard, seed)
                    path.append((lo, at, first, before) if k < at else (at, hi, second, before + first))
                drawn, before = path[-1][2:]
                yield pd.DataFrame({"shard": k, "number": numbers, "drawn": drawn, "first": before})[drawn > 0]

    return map_batches(shards, run, "shard long, number int, drawn long, first long")


Mix = tuple[DataFrame, DataFrame, DataFrame, DataFrame]


def _mix(sized: DataFrame, seed: int, block: int, shard: int) -> Mix:
    """(sized, plan, streams, uses): uses has a row for each slot of the mix."""
    spark = sized.sparkSession
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n"))
    plan = targets(sums.drop("n"))
    plan = written(plan.withColumn("number", (F.row_number().over(Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))) - 1)), "plan")
    buckets = max(BUCKETS, -(-sized.count() // BUCKET_ROWS))
    streams = written(_streams(sized, plan, buckets), "streams")

    # one row for each source, never one for each document, comes to the driver
    rows = [(r["number"], -(-r["source_size"] // block), r["target"], r["source_size"]) for r in plan.where("source_size > 0").orderBy("number").collect()]
    given = rounded([t * n / s for _, n, t, s in rows])  # never over MAX_EPOCHS * n, as no target is
    slots = sum(given)
    blocks = {k: n for k, n, _, _ in rows}
    share = [(k, g) for (k, *_), g in zip(rows, given, strict=True)]
    drawn = draw(spark.range(0, -(-slots // shard), 1, max(1, min(shuffle_parts(spark), -(-slots // shard)))), share, slots, shard, seed)

    def slot_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s, number, count, first in zip(pdf["shard"], pdf["number"], pdf["drawn"], pdf["first"], strict=True):
                n = blocks[number]
                t = np.arange(first, first + count, dtype=np.int64)
                key = mix64(np.uint64(seed) * np.uint64(1 << 32) + (t // n).astype(np.uint64) * np.uint64(1 << 20) + np.uint64(number))
                yield pd.DataFrame({"shard": s, "slot": t, "number": number, "block": permuted(t % n, n, key)})

    return sized, plan, streams, map_batches(drawn, slot_blocks, "shard long, slot long, number int, block long")


def _taken_blocks(streams: DataFrame, uses: DataFrame, block: int) -> DataFrame:
    """The documents' blocks joined to the slots by index: row, first and last word in it, times it is taken."""
    times = uses.groupBy("number", "block").agg(F.count(F.lit(1)).alias("times"))
    first, last = F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block)
    parts = streams.select("row", "number", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    lo, hi = F.greatest(F.lit(0), F.col("block") * block - F.col("start")), F.least("size", (F.col("block") + 1) * block - F.col("start"))
    return parts.join(times.hint("merge"), ["number", "block"]).select("row", lo.alias("lo"), hi.alias("hi"), "times")


def mix(docs: DataFrame, seed: int = 42, block: int = BLOCK, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> tuple[DataFrame, DataFrame]:
    """(documents, uses): documents has a row for each row of ``docs`` (doc_id, row, size,
    source, source_size, target, taken); uses lists the mix itself, a row for each slot
    (shard, slot of the source, number of the source, block)."""
    sized = written(_sized(docs, id_col, text_col, source_col, F.monotonically_increasing_id()), "sized")
    sized, plan, streams, uses = _mix(sized, seed, block, shard)
    words = (F.col("hi") - F.col("lo")) * F.col("times")
    taken = _taken_blocks(streams, uses, block).groupBy("row").agg(F.sum(words).alias("taken"))
    documents = sized.join(taken.hint("merge"), "row", "left")
    p = plan.select(F.col("source").alias("p_source"), "source_size", "target")
    documents = documents.join(p, F.col("source").eqNullSafe(F.col("p_source")))
    return documents.select("doc_id", "row", "size", "source", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")), uses


def mixed(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken: a row for each row of ``docs``."""
    return mix(docs, **options)[0].select("doc_id", "size", "source_size", "target", "taken")


def _stretches(blocks: DataFrame) -> DataFrame:
    """row, lo, hi: the words of each epoch, where neighbouring blocks are one stretch."""
    each = blocks.withColumn("epoch", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    order = Window.partitionBy("row", "epoch").orderBy("lo")
    each = each.withColumn("new", F.coalesce((F.lag("hi").over(order) != F.col("lo")).cast("int"), F.lit(1)))
    each = each.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return each.groupBy("row", "epoch", "island").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).select("row", "lo", "hi")


def resampled(docs: DataFrame, seed: int = 42, block: int = BLOCK, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars") -> DataFrame:
    """The mix itself, with the columns of ``docs``: the blocks that the slots take, joined to
    the documents' texts.  Blocks of a document that follow each other in one epoch are one row, so
    a document that an epoch takes whole is one row with its text as it was; of others each
    stretch of taken words is a row.  ``chars_col``, if there is one, is the length of the text.
    A row without words has no blocks and no row here.  Rows that share an id stay apart."""
    names = docs.columns
    whole = F.struct(*[F.col(f"`{c}`") for c in names]).alias("whole")
    base = written(docs.select(whole, F.monotonically_increasing_id().alias("row")), "rows")
    fields = base.select("row", *[F.col("whole").getField(c).alias(c) for c in dict.fromkeys((id_col, text_col, source_col))])
    sized = written(_sized(fields, id_col, text_col, source_col, F.col("row")), "sized")
    _, _, streams, uses = _mix(sized, seed, block, shard)
    spans = _stretches(_taken_blocks(streams, uses, block)).groupBy("row").agg(F.sort_array(F.collect_list(F.struct("lo", "hi"))).alias("spans"))
    found = base.join(spans.join(sized.where("size > 0").select("row", "size"), "row").hint("merge"), "row")
    text = F.col("whole").getField(text_col)

    def cut(words: Column) -> Column:
        """Each stretch as text; the words of a document are found once."""
        part = lambda s: F.array_join(F.slice(words, (s["lo"] + 1).cast("int"), (s["hi"] - s["lo"]).cast("int")), "")
        whole_text = lambda s: (s["lo"] == 0) & (s["hi"] == F.col("size"))
        return F.transform("spans", lambda s: F.when(whole_text(s), text).otherwise(F.regexp_replace(part(s), r"[\x20\x09-\x0D]+$", "")))

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*"), F.lit(0))
    all_whole = F.forall("spans", lambda s: (s["lo"] == 0) & (s["hi"] == F.col("size")))
    pieces = F.when(all_whole, F.transform("spans", lambda s: text)).otherwise(F.transform(F.array(words), cut)[0])
    rest = [c for c in names if c not in (text_col, chars_col)]
    found = found.select(*[F.col("whole").getField(c).alias(f"r{i}") for i, c in enumerate(rest)], F.explode(pieces).alias("taken"))
    types = dict(docs.dtypes)
    new = {text_col: F.col("taken"), chars_col: F.length("taken").cast(types.get(chars_col, "long"))} | {c: F.col(f"r{i}") for i, c in enumerate(rest)}
    return found.select(*[new[c].alias(c) for c in names])
