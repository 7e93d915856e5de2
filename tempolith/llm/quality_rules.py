"""Document quality rules with host-level verdicts (DataFrame functions only).

Each document gets counts and hard rules of its own.  A second, softer set of
rules is aggregated by host (the ``source`` column): failures per host are
shrunk towards the corpus by an empirical beta prior (method of moments over
the hosts' rates), so that a host with three documents is not condemned by two
of them.  What remains of a host is its beta posterior, and two verdicts come
from it, joined back to the host's documents:

* *suspect*: the posterior's lower quartile is above the prior's mean, so odds are
  three to one that the host fails more often than the corpus does.  Its documents
  have to pass the soft rules as well; documents of other hosts are forgiven a
  soft failure;
* *bad*: the posterior's first percentile is above ``BAD_RATE``.  All documents of
  the host go.

Defined results: null text has no words and fails; a null host is a host of its
own; repeated rows count each time; ties do not matter (verdicts come from counts).
An empty table gives an empty result.  Extra columns are ignored, whatever their names.

Long texts: a text is one row, its words one array; repeated windows are found
by comparing the number of distinct window hashes first, and only texts that have
repeats pay for a sort.  Windows that share a hash are compared as words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD_RE, WS_RE, written

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: Soft rules: share of symbols in the characters of words, share of repeated lines, mean length of words.
SOFT_SYMBOL_SHARE, SOFT_DUP_LINE_SHARE, SOFT_WORD_CHARS = 0.1, 0.3, (2.0, 16.0)
#: Standard deviations below a posterior's mean of its lower quartile and its first percentile, and the failure rate of bad hosts.
SUSPECT_Z, BAD_Z, BAD_RATE = 0.674, 2.326, 0.5
#: Host tables up to so many rows are broadcast; above, the join shuffles.
BROADCAST_HOSTS = 100_000


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    n = F.size(words)

    def covered(hashes: Column) -> Column:
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
            return F.filter(s, lambda x, i: same(x, F.get(s, i - 1)) | same(x, F.get(s, i + 1)))

        def spelt(s: Column) -> Column:
            # windows that share a hash meet again by their words
            return F.array_sort(F.transform(s, lambda x: F.struct(F.array_join(F.slice(words, x["i"] + 1, WINDOW), " ").alias("h"), x["i"].alias("i"))))

        def starts(s: Column) -> Column:
            return F.sort_array(F.transform(repeated(s), lambda x: x["i"]))

        def length(st: Column) -> Column:
            return F.aggregate(
                st,
                F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-WINDOW).cast("long").alias("end")),
                lambda a, i: F.struct(
                    (a["sum"] + F.least(F.lit(WINDOW).cast("long"), i + F.lit(WINDOW) - a["end"])).alias("sum"),
                    (i + F.lit(WINDOW)).cast("long").alias("end"),
                ),
                lambda a: a["sum"],
            )

        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(
            _let(_let(_let(_let(order, repeated), spelt), starts), length)
        )

    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    return F.when(n <= WINDOW, F.lit(0).cast("long")).otherwise(_let(windows, covered))


def with_rules(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` (whose columns must not begin with ``q_``) with the counts in one struct ``q_rules``."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def counts(words: Column) -> Column:
        lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD_RE))
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            (F.length(text) - F.regexp_count(text, F.lit(WS_RE))).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
            _let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
            _let(lines, lambda a: F.size(a)).cast("long").alias("n_lines"),
            _repeat_words(words).alias("n_repeat_words"),
        )

    words = F.regexp_extract_all(text, F.lit(WORD_RE), F.lit(0))
    return docs.withColumn("q_rules", _let(words, counts))


def base_failed(r: Column) -> Column:
    return (r["n_words"] < MIN_WORDS) | (100 * r["n_repeat_words"] > MAX_REPEAT_PERCENT * r["n_words"])


def soft_failed(r: Column) -> Column:
    mean = F.try_divide(r["word_chars"], r["n_words"])
    return (
        base_failed(r)
        | (r["n_symbols"] > SOFT_SYMBOL_SHARE * r["word_chars"])
        | (r["n_dup_lines"] > SOFT_DUP_LINE_SHARE * r["n_lines"])
        | (mean < SOFT_WORD_CHARS[0])
        | (mean > SOFT_WORD_CHARS[1])
    )


def host_verdicts(rules: DataFrame) -> DataFrame:
    """From rows (host, failed): host, docs, fails, shrunk_rate, suspect, bad.  One row per host."""
    hosts = rules.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("failed").cast("long")).alias("fails"))
    hosts = written(hosts.withColumn("rate", F.col("fails") / F.col("docs")), "hosts")
    # beta prior by moments over the hosts: mean and strength
    prior = hosts.agg(F.avg("rate").alias("m"), F.var_samp("rate").alias("v")).select(
        F.least(F.greatest("m", F.lit(1e-4)), F.lit(1 - 1e-4)).alias("m"), F.col("v")
    )
    strength = F.least(F.greatest(F.coalesce(F.try_divide(F.col("m") * (1 - F.col("m")), F.col("v")) - 1, F.lit(100.0)), F.lit(2.0)), F.lit(1000.0))
    prior = prior.select("m", strength.alias("k"))  # one row
    a, n = F.col("fails") + F.col("m") * F.col("k"), F.col("docs") + F.col("k")
    # mean and deviation of the beta posterior
    mean, spread = a / n, F.sqrt(a * (n - a) / (n * n * (n + 1)))
    out = hosts.join(F.broadcast(prior)).withColumn("shrunk_rate", mean)
    return out.withColumn("suspect", mean - SUSPECT_Z * spread > F.col("m")).withColumn("bad", mean - BAD_Z * spread > BAD_RATE)


def _with_hosts(df: DataFrame, hosts: DataFrame) -> DataFrame:
    """``df`` (with column q_host) joined to the verdicts: q_suspect and q_bad, never null."""
    known = hosts.where("suspect or bad").select(F.col("host").alias("q_known"), F.col("suspect").alias("q_suspect"), F.col("bad").alias("q_bad"))
    if known.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        known = F.broadcast(known)
    joined = df.join(known, F.col("q_host").eqNullSafe(F.col("q_known")), "left").drop("q_known")
    return joined.withColumns({c: F.coalesce(c, F.lit(False)) for c in ("q_suspect", "q_bad")})


def _verdict(base: Column, soft: Column) -> Column:
    return ~base & ~F.col("q_bad") & ~(F.col("q_suspect") & soft)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: the counts, base_failed, kept."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(host_col).alias("q_host"))
    r = F.col("q_rules")
    rules = with_rules(slim).select("doc_id", "q_host", "q_rules", base_failed(r).alias("base_failed"), soft_failed(r).alias("failed"))
    rules = written(rules, "rules")
    hosts = written(host_verdicts(rules.select(F.col("q_host").alias("host"), "failed")), "verdicts")
    return _with_hosts(rules, hosts).select(
        "doc_id",
        *[F.col(f"q_rules.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
        "base_failed",
        _verdict(F.col("base_failed"), F.col("failed")).alias("kept"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """``docs`` without rejected rows, columns unchanged.  Rows that pass the hard rules are
    written once with their soft verdict, so the rules run once and no text is shuffled."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole")
    slim = with_rules(docs.select(F.col(text_col).alias("text"), F.col(host_col).alias("q_host"), whole))
    r = F.col("q_rules")
    base = base_failed(r)
    # a row that fails the hard rules counts for its host, but its columns need not be kept
    judged = slim.select("q_host", F.when(~base, F.col("whole")).alias("whole"), base.alias("base"), soft_failed(r).alias("failed"))
    judged = written(judged, "judged")
    hosts = written(host_verdicts(judged.select(F.col("q_host").alias("host"), "failed")), "verdicts")
    kept = _with_hosts(judged.where("not base"), hosts).where(_verdict(F.lit(False), F.col("failed")))
    return kept.select(*[F.col("whole").getField(c).alias(c) for c in docs.columns])


SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT doc_id, i, list_slice(words, i, i + 7) AS win
  FROM w, unnest(range(1, greatest(len(words) - 6, 1))) AS r(i)
), rep AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM win) WHERE c >= 2
), cov AS (
  SELECT doc_id, sum(least(8, coalesce(nxt - i, 8))) AS n
  FROM (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nxt FROM rep) GROUP BY doc_id
), c AS (
  SELECT w.doc_id, w.source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)
), f AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c
), s AS (
  SELECT *, base_failed OR n_symbols > 0.1 * word_chars OR n_dup_lines > 0.3 * n_lines
         OR word_chars / n_words < 2.0 OR word_chars / n_words > 16.0 AS failed FROM f
), h AS (
  SELECT source, count(*) AS docs, sum(CAST(failed AS INT)) AS fails, sum(CAST(failed AS INT)) / count(*) AS rate FROM s GROUP BY source
), p AS (
  SELECT m, least(greatest(coalesce(m * (1 - m) / nullif(v, 0) - 1, 100.0), 2.0), 1000.0) AS k
  FROM (SELECT least(greatest(avg(rate), 1e-4), 1 - 1e-4) AS m, var_samp(rate) AS v FROM h)
), b AS (
  SELECT source, m, fails + m * k AS a, docs + k AS n FROM h, p
), l AS (
  SELECT source, m, a / n AS mean, sqrt(a * (n - a) / (n * n * (n + 1))) AS spread FROM b
), v AS (
  SELECT source, mean - 0.674 * spread > m AS suspect, mean - 2.326 * spread > 0.5 AS bad FROM l
)
SELECT s.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT v.bad AND NOT (v.suspect AND s.failed) AS kept
FROM s JOIN v ON s.source IS NOT DISTINCT FROM v.source
"""
