"""Column functions on texts and dates, templates, plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions import timefn as tf
from ..functions import timex
from ..functions.timex import temporal_expressions
from ..plans import planner
from ..sources import projection as p
from ..vocabulary import MARKERS
from .base import op

_RAW = """CASE o_orderkey % 8 WHEN 0 THEN CAST(year(o_orderdate) AS VARCHAR) WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m') WHEN 3 THEN CAST(year(o_orderdate) AS VARCHAR) || '-Q' || CAST(quarter(o_orderdate) AS VARCHAR)
WHEN 4 THEN '-0' || CAST(o_orderkey % 900 + 100 AS VARCHAR) WHEN 5 THEN CAST(year(o_orderdate) AS VARCHAR) || '-H' || CAST((quarter(o_orderdate) + 1) // 2 AS VARCHAR) WHEN 6 THEN strftime(o_orderdate, '%Y-%m-%d') || 'T12:18:00' ELSE 'late ' || CAST(year(o_orderdate) // 10 AS VARCHAR) || '0s' END"""


def _raw(spark: SparkSession, d: str) -> DataFrame:
    o = p.read(spark, d, "orders")
    day, y, k = F.col("o_orderdate"), F.year("o_orderdate").cast("string"), F.col("o_orderkey")
    q = F.quarter(day)
    forms = [y, F.date_format(day, "yyyy-MM-dd"), F.date_format(day, "yyyy-MM"), F.concat(y, F.lit("-Q"), q.cast("string")), F.concat(F.lit("-0"), (k % 900 + 100).cast("string")), F.concat(y, F.lit("-H"), F.floor((q + 1) / 2).cast("string")), F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit("T12:18:00"))]
    raw = F.concat(F.lit("late "), F.substring(y, 1, 3), F.lit("0s"))
    for i, f in enumerate(forms):
        raw = F.when(k % 8 == i, f).otherwise(raw)
    return o.select("o_orderkey", raw.alias("raw"))


@op(f"WITH r AS (SELECT o_orderkey, {_RAW} AS raw FROM orders) SELECT o_orderkey, raw, CASE WHEN regexp_full_match(raw, '-?[0-9]{{1,12}}') THEN CAST(raw AS BIGINT) WHEN regexp_full_match(raw, '-?[0-9]{{1,12}}-[0-9]{{2}}-[0-9]{{2}}') THEN CAST(regexp_extract(raw, '^(-?[0-9]+)-[0-9]{{2}}-[0-9]{{2}}$', 1) AS BIGINT) END AS year FROM r")
def op_p1_parse_year(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("o_orderkey", "raw", tf.parse_year(F.col("raw")).alias("year"))


@op(f"WITH r AS (SELECT o_orderkey, {_RAW} AS raw FROM orders) SELECT o_orderkey, CASE WHEN regexp_matches(raw, '^[0-9]{{4}}') THEN CAST(substr(raw, 1, 4) AS BIGINT) END AS year FROM r")
def op_p2_edge_year4(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("o_orderkey", tf.edge_year4(F.col("raw")).alias("year"))


@op(f"""WITH r AS (SELECT o_orderkey, {_RAW} AS raw FROM orders) SELECT o_orderkey, CASE WHEN regexp_full_match(raw, '[0-9]{{4}}-[0-9]{{2}}') THEN raw || '-01' WHEN regexp_full_match(raw, '-?[0-9]{{1,12}}') THEN CAST(CAST(raw AS BIGINT) AS VARCHAR)
WHEN regexp_full_match(raw, '-?[0-9]{{1,6}}-[0-9]{{2}}-[0-9]{{2}}') THEN raw WHEN regexp_matches(raw, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T') THEN substr(raw, 1, 10)
WHEN regexp_full_match(raw, '[0-9]{{4}}-Q[1-4]') THEN substr(raw, 1, 4) || '-' || lpad(CAST(CAST(substr(raw, 7, 1) AS INT) * 3 - 2 AS VARCHAR), 2, '0') || '-01'
WHEN regexp_full_match(raw, '[0-9]{{4}}-H[12]') THEN substr(raw, 1, 4) || '-' || lpad(CAST(CAST(substr(raw, 7, 1) AS INT) * 6 - 5 AS VARCHAR), 2, '0') || '-01' ELSE substr(raw, 6, 3) || '8-01-01' END AS value FROM r""")
def op_d12_parse_temporal(spark: SparkSession, d: str) -> DataFrame:
    return _raw(spark, d).select("o_orderkey", tf.parse_temporal(F.col("raw")).alias("value"))


@op("SELECT o_orderkey, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INT) AS days, CAST(o_orderdate AS DATE) - CAST(7 * (o_orderkey % 5) AS INT) AS weeks, CAST(CAST(o_orderdate AS DATE) + to_months(CAST(o_orderkey % 14 AS INT)) AS DATE) AS months, CAST(CAST(o_orderdate AS DATE) - INTERVAL 1 YEAR AS DATE) AS years FROM orders")
def op_d4_relative_dates(spark: SparkSession, d: str) -> DataFrame:
    ref, k = F.to_date("o_orderdate"), F.col("o_orderkey")
    say = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return p.read(spark, d, "orders").select(
        "o_orderkey", tf.relative_date(ref, say(k % 30, " days")).alias("days"), tf.relative_date(ref, say(k % 5, " weeks ago")).alias("weeks"), tf.relative_date(ref, say(k % 14, " months")).alias("months"), tf.relative_date(ref, F.lit("last year")).alias("years"),
    )


@op("""WITH r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, isodow(o_orderdate) - 1 AS w, CAST(o_orderkey % 7 AS INT) AS k FROM orders)
SELECT o_orderkey, d - CAST(CASE WHEN (w - k + 7) % 7 = 0 THEN 7 ELSE (w - k + 7) % 7 END AS INT) AS last_day, d + CAST(CASE WHEN (k - w + 7) % 7 = 0 THEN 7 ELSE (k - w + 7) % 7 END AS INT) AS next_day FROM r""")
def op_d5_weekdays(spark: SparkSession, d: str) -> DataFrame:
    ref, k = F.to_date("o_orderdate"), (F.col("o_orderkey") % 7).cast("int")
    return p.read(spark, d, "orders").select("o_orderkey", tf.weekday_date(ref, k, F.lit(True)).alias("last_day"), tf.weekday_date(ref, k, F.lit(False)).alias("next_day"))


@op("SELECT o_orderkey, lpad(CAST(CASE WHEN o_orderkey % 2 = 0 THEN (o_orderkey % 12 + 1) % 12 + 12 ELSE (o_orderkey % 12 + 1) % 12 END AS VARCHAR), 2, '0') || ':' || lpad(CAST(o_orderkey % 60 AS VARCHAR), 2, '0') AS clock FROM orders")
def op_d3_clock(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return p.read(spark, d, "orders").select("o_orderkey", tf.clock(k % 12 + 1, k % 60, F.when(k % 2 == 0, "pm").otherwise("am")).alias("clock"))


@op("SELECT l_orderkey, l_linenumber, round(l_linenumber * 365.0 + (l_orderkey % 12) * 30.0 + (l_orderkey % 24) * 3600.0 / 86400.0, 6) AS days FROM lineitem")
def op_d8_duration_days(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("l_orderkey")
    iso = F.concat(F.lit("P"), F.col("l_linenumber").cast("string"), F.lit("Y"), (k % 12).cast("string"), F.lit("MT"), (k % 24).cast("string"), F.lit("H"))
    return p.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(tf.duration_days(iso), 6).alias("days"))


@op("SELECT o_orderkey, CASE WHEN abs(o_orderkey % 23 - 11) <= 1 THEN 1.0 WHEN abs(o_orderkey % 23 - 11) <= 7 THEN 0.8 ELSE 0.0 END AS tier FROM orders")
def op_d10_date_tier(spark: SparkSession, d: str) -> DataFrame:
    ref = F.to_date("o_orderdate")
    other = F.date_add(ref, (F.col("o_orderkey") % 23 - 11).cast("int"))
    return p.read(spark, d, "orders").select("o_orderkey", tf.date_tier(F.datediff(other, ref)).alias("tier"))


@op("SELECT doc_id, CAST(len(regexp_extract_all(text, '\\b(1[0-9]{3}|2[0-9]{3})\\b')) AS INT) AS n_years, CAST(list_min(list_transform(regexp_extract_all(text, '\\b(1[0-9]{3}|2[0-9]{3})\\b'), lambda x: CAST(x AS BIGINT))) AS BIGINT) AS first_year FROM documents")
def op_d11_years(spark: SparkSession, d: str) -> DataFrame:
    y = tf.years_in(F.regexp_replace("text", r"[^\x00-\x7F]", "x"))
    return p.read(spark, d, "documents").select("doc_id", F.size(y).alias("n_years"), F.array_min(y).alias("first_year"))


@op("""SELECT DISTINCT label, lower(trim(label)) AS norm, regexp_replace(regexp_replace(lower(trim(label)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS snake, regexp_replace(label, '[^A-Za-z0-9_]', '_', 'g') AS mermaid FROM tkg_nodes""", graph=True)
def op_f1_labels(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("label")
    return p.nodes(spark, d).select("label", t.norm(x).alias("norm"), t.snake(x).alias("snake"), t.mermaid_id(x).alias("mermaid")).distinct()


_ANSWER = "regexp_replace(trim(regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '^((the|a|an) ){{1,4}}', '')"
_A, _B = _ANSWER.format(x="'The ' || p_name || '!'"), _ANSWER.format(x="CASE WHEN p_partkey % 3 = 0 THEN split_part(p_name, ' ', 1) ELSE p_name END")


@op(f"SELECT p_partkey, {_A} AS answer, CAST(CAST({_A} = {_B} AS INT) AS DOUBLE) AS exact, CAST(CAST(contains({_A}, {_B}) OR contains({_B}, {_A}) AS INT) AS DOUBLE) AS within FROM part")
def op_f5_answer_scores(spark: SparkSession, d: str) -> DataFrame:
    a = F.concat(F.lit("The "), "p_name", F.lit("!"))
    b = F.when(F.col("p_partkey") % 3 == 0, F.split_part("p_name", F.lit(" "), F.lit(1))).otherwise(F.col("p_name"))
    return p.read(spark, d, "part").select("p_partkey", t.answer_form(a).alias("answer"), t.exact_score(a, b).alias("exact"), t.contains_score(a, b).alias("within"))



@op("""WITH w AS (SELECT doc_id, text, list_filter(string_split_regex(trim(text), '\\s+'), lambda x: x <> '') AS ws, greatest(len(string_split_regex(trim(text), '[.!?]+')) - 1, 1) AS sents FROM documents),
s AS (SELECT doc_id, len(ws) AS n, sents, list_transform(list_filter(list_transform(ws, lambda x: regexp_replace(lower(x), '[^a-z]', '', 'g')), lambda x: x <> ''), lambda x: len(regexp_extract_all(x, '[aeiou]+'))) AS syl FROM w),
c AS (SELECT doc_id, n, sents, CASE WHEN len(syl) = 0 THEN 0 ELSE list_sum(syl) + CASE WHEN syl[1] = 0 THEN 1 ELSE 0 END END AS total FROM s)
SELECT doc_id, round(CASE WHEN n = 0 THEN 50.0 ELSE greatest(0.0, least(100.0, 206.835 - 1.015 * (n / sents) - 84.6 * (total / n))) END, 4) AS flesch, round(CASE WHEN n = 0 THEN 0.0 ELSE least(1.0, total / (n * 1.5)) END, 6) AS density FROM c""")
def op_f7_flesch(spark: SparkSession, d: str) -> DataFrame:
    told = p.read(spark, d, "documents").select("doc_id", t.readability(F.col("text")).alias("r"))
    return told.select("doc_id", F.round("r.flesch", 4).alias("flesch"), F.round("r.density", 6).alias("density"))


_MARK = ", ".join("(" + " OR ".join(f"contains(lower(text), '{m}')" for m in ms) + f") AS {k}" for k, ms in MARKERS.items())


@op(f"SELECT doc_id, {_MARK} FROM documents")
def op_f16_markers(spark: SparkSession, d: str) -> DataFrame:
    return p.read(spark, d, "documents").select("doc_id", *[t.has_marker(F.col("text"), k).alias(k) for k in MARKERS])


_REF = "CAST(o_orderdate AS DATE)"
_ISO = lambda x: f"strftime({x}, '%Y-%m-%d')"
#: Texts of twelve kinds of expression, and what SQL says that they mean.
_FORMS = [
    ("It was ordered on {long}.", _ISO(_REF)), ("It was ordered on {iso}.", _ISO(_REF)), ("They met yesterday.", _ISO(f"{_REF} - 1")), ("They meet tomorrow at 3pm.", _ISO(f"{_REF} + 1") + " || 'T15:00'"),
    ("It came last week.", _ISO(f"{_REF} - 7")), ("It comes in 10 days.", _ISO(f"{_REF} + 10")), ("It left two weeks ago.", _ISO(f"{_REF} - 14")), ("They meet every monday.", "'every-monday'"),
    ("They meet at 14:30.", "'14:30'"), ("It took 3 days.", "'P3D'"), ("It took 1 hour 30 minutes.", "'PT1H30M'"), ("They rest around noon.", "'12:00'"),
]
_N = len(_FORMS)


def _told_times(spark: SparkSession, d: str) -> DataFrame:
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % _N
    text = F.element_at(F.array(*[F.lit(x) for x, _ in _FORMS]), (k + 1).cast("int"))
    text = F.replace(F.replace(text, F.lit("{long}"), F.date_format(day, "MMMM d, yyyy")), F.lit("{iso}"), F.date_format(day, "yyyy-MM-dd"))
    return p.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text"), F.to_date(day).alias("reference"))


_SAID = "CASE o_orderkey % " + str(_N) + " " + " ".join(f"WHEN {i} THEN {x}" for i, (_, x) in enumerate(_FORMS)) + " END"


@op(f"SELECT o_orderkey AS id, {_SAID} AS value, CASE WHEN o_orderkey % {_N} <= 6 THEN 'DATE' WHEN o_orderkey % {_N} = 7 THEN 'SET' WHEN o_orderkey % {_N} IN (8, 11) THEN 'TIME' ELSE 'DURATION' END AS type FROM orders")
def op_d1_timex(spark: SparkSession, d: str) -> DataFrame:
    """Expressions in texts, found and normalised."""
    return temporal_expressions(_told_times(spark, d)).select("id", "value", "type")


@op(f"SELECT o_orderkey AS id, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE {_SAID} END AS value, CASE WHEN o_orderkey % 13 = 0 THEN 'unhandled_expression' ELSE '' END AS errors FROM orders")
def op_d2_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts as expressions; every thirteenth says nothing of time."""
    t = _told_times(spark, d).withColumn("text", F.when(F.col("id") % 13 == 0, "no time at all").otherwise(F.col("text"))).withColumn("type", F.lit(None).cast("string"))
    return timex.normalise(t).select("id", "value", F.array_join("errors", ",").alias("errors"))


_E = "(SELECT o_orderkey AS id, o_orderkey % 6 AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, o_orderdate AS t FROM orders)"


@op(f"""SELECT id, CASE k WHEN 0 THEN strftime(t, '%Y-%m') WHEN 1 THEN strftime(t, '%Y-%m') || '-05/' || strftime(t, '%Y-%m') || '-07' WHEN 2 THEN strftime(t, '%Y-%m-%d') || '/' || strftime(CAST(t AS DATE) + 9, '%Y-%m-%d')
WHEN 3 THEN strftime(t, '%Y-%m-%d') || 'T09:15' WHEN 4 THEN strftime(t, '%Y-%m') || '-03' ELSE CAST(y AS VARCHAR) END AS value FROM {_E}""")
def op_d6_named_dates(spark: SparkSession, d: str) -> DataFrame:
    """Months, ranges within a month, ranges of days, days with a time, ordinal days, years."""
    day, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    month, year, iso = F.date_format(day, "MMMM"), F.date_format(day, "yyyy"), F.date_format(day, "yyyy-MM-dd")
    say = lambda *xs: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in xs])
    forms = [say(month, " ", year), say(month, " 5-7, ", year), say(iso, " to ", F.date_format(F.date_add(day, 9), "yyyy-MM-dd")), say(iso, " 09:15"), say(month, " 3rd, ", year), say("in ", year)]
    text = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        text = F.when(k == i, f).otherwise(text)
    t = p.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text"), F.to_date(day).alias("reference"))
    return temporal_expressions(t).select("id", "value")


@op("""SELECT l_orderkey AS id, CAST(l_linenumber AS INT) AS n, CASE l_linenumber % 4 WHEN 0 THEN 'P' || CAST(l_linenumber AS VARCHAR) || 'Y2M' WHEN 1 THEN 'PT' || CAST(l_linenumber AS VARCHAR) || 'H15M' WHEN 2 THEN 'P3W' ELSE 'P' || CAST(l_linenumber AS VARCHAR) || 'DT6H' END AS value,
round(CASE l_linenumber % 4 WHEN 0 THEN l_linenumber * 365 + 60 WHEN 1 THEN (l_linenumber * 60 + 15) / 1440.0 WHEN 2 THEN 21 ELSE l_linenumber + 0.25 END, 6) AS days FROM lineitem""")
def op_d7_durations(spark: SparkSession, d: str) -> DataFrame:
    n, k = F.col("l_linenumber").cast("string"), F.col("l_linenumber") % 4
    text = F.when(k == 0, F.concat(n, F.lit(" years and 2 months"))).when(k == 1, F.concat(n, F.lit("h15m"))).when(k == 2, F.lit("three weeks")).otherwise(F.concat(n, F.lit(" days 6 hours")))
    rows = p.read(spark, d, "lineitem").select((F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("id"), text.alias("text"), F.lit("DURATION").alias("type"), F.lit("2020-01-01").alias("reference"))
    out = timex.normalise(rows)
    return out.select(F.floor(F.col("id") / 100).alias("id"), (F.col("id") % 100).cast("int").alias("n"), "value", F.round(tf.duration_days(F.col("value")), 6).alias("days"))


@op("""SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'every-tuesday' WHEN 1 THEN 'twice-a-week' WHEN 2 THEN 'MO' WHEN 3 THEN '00:00' ELSE 'every-year' END AS value FROM orders""")
def op_d9_fuzzy_and_recurring(spark: SparkSession, d: str) -> DataFrame:
    text = F.element_at(F.array(*map(F.lit, ("every Tuesday", "twice a week", "in the morning", "around midnight", "every year"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return timex.normalise(p.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text"), F.lit(None).cast("string").alias("type"), F.to_date("o_orderdate").alias("reference"))).select("id", "value")


@op("""SELECT o_orderkey AS id, strftime(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 2 AS INT), '%Y-%m-%d') || 'T' || lpad(CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 12 + 12 ELSE o_orderkey % 12 END AS VARCHAR), 2, '0') || ':05' AS value FROM orders""")
def op_r7_relative_with_clock(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    hour = F.when(k % 12 == 0, 12).otherwise(k % 12).cast("string")
    text = F.concat(F.when(k % 2 == 0, "today").otherwise("tomorrow"), F.lit(" at "), hour, F.lit(":05 "), F.when(k % 3 == 0, "pm").otherwise("am"))
    return timex.normalise(p.read(spark, d, "orders").select(k.alias("id"), text.alias("text"), F.lit("DATE").alias("type"), F.to_date("o_orderdate").alias("reference"))).select("id", "value")


@op("""SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS dates, strftime(o_orderdate, '%Y-%m-%d') || '/' || strftime(CAST(o_orderdate AS DATE) + 3, '%Y-%m-%d') AS ranges, 'P3D' AS durations, CAST(3 AS INT) AS n_years FROM orders""")
def op_r10_mentions(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate")
    iso = F.date_format(day, "yyyy-MM-dd")
    text = F.concat(F.lit("On "), iso, F.lit(" it began; from "), iso, F.lit(" to "), F.date_format(F.date_add(day, 3), "yyyy-MM-dd"), F.lit(" it lasted, 3 days in all."))
    m = timex.mentions(p.read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), text.alias("text"), F.to_date(day).alias("reference")))
    return m.select("id", *[F.array_join(c, ",").alias(c) for c in ("dates", "ranges", "durations")], F.size("years").alias("n_years"))


@op("""SELECT o_orderkey AS id, strftime(CAST(o_orderdate AS DATE) - 1, '%Y-%m-%d') || ',12:00,' || strftime(CAST(o_orderdate AS DATE) + 7, '%Y-%m-%d') AS resolved FROM orders""")
def op_r8_context(spark: SparkSession, d: str) -> DataFrame:
    """A document's expressions one after another, against one reference."""
    docs = p.read(spark, d, "orders").select(F.col("o_orderkey").alias("doc"), F.posexplode(F.array(F.lit("yesterday"), F.lit("noon"), F.lit("next week"))).alias("k", "text"), F.to_date("o_orderdate").alias("reference"))
    out = timex.normalise(docs.select((F.col("doc") * 3 + F.col("k")).alias("id"), "text", F.lit(None).cast("string").alias("type"), "reference"))
    one = F.struct(F.col("id").alias("id"), "value")
    return out.groupBy(F.floor(F.col("id") / 3).alias("id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["value"]), ",").alias("resolved"))


_Q = """(SELECT p_partkey AS q_id, CASE p_partkey % 9 WHEN 0 THEN 'What likely caused ' || p_name || ' around 1998?' WHEN 1 THEN 'When did ' || p_name || ' first start?' WHEN 2 THEN 'How many suppliers had ' || p_name || ' in 1997?'
WHEN 3 THEN 'Is there a path to ' || p_name || '?' WHEN 4 THEN 'Which came first, ' || p_name || ' or none?' WHEN 5 THEN 'Was ' || p_name || ' ordered in 1996?' WHEN 6 THEN 'If x rose, will ' || p_name || ' fall?' WHEN 7 THEN 'Who supplied ''1989'' in 2014?' ELSE 'Which was earlier, a or b?' END AS text FROM part)"""


def _questions(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("p_partkey"), F.col("p_name")
    say = lambda a, b: F.concat(F.lit(a), n, F.lit(b))
    forms = [say("What likely caused ", " around 1998?"), say("When did ", " first start?"), say("How many suppliers had ", " in 1997?"), say("Is there a path to ", "?"), say("Which came first, ", " or none?"), say("Was ", " ordered in 1996?"), say("If x rose, will ", " fall?"), F.lit("Who supplied '1989' in 2014?")]
    text = F.lit("Which was earlier, a or b?")
    for i, f in enumerate(forms):
        text = F.when(k % 9 == i, f).otherwise(text)
    return p.read(spark, d, "part").select(k.alias("q_id"), text.alias("text"))


@op(f"""SELECT q_id, CASE q_id % 9 WHEN 0 THEN 'reason_of' WHEN 1 THEN 'first_occurrence' WHEN 2 THEN 'temporal_count' WHEN 3 THEN 'temporal_path_existence' WHEN 4 THEN 'first_occurrence' WHEN 5 THEN 'existence_in_time' WHEN 6 THEN 'analogical_transfer' WHEN 7 THEN 'state_at_time' ELSE 'first_occurrence' END AS query_type,
CAST(CASE q_id % 9 WHEN 0 THEN 1998 WHEN 2 THEN 1997 WHEN 5 THEN 1996 WHEN 7 THEN 2014 END AS BIGINT) AS year, 0.4 AS confidence FROM {_Q}""")
def op_n1_planner(spark: SparkSession, d: str) -> DataFrame:
    return planner.plan(_questions(spark, d))


def _frames(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    brand, kind = planner.slot(F.col("p_brand")), planner.slot(F.col("p_type"))
    slots = F.when(k % 3 == 0, F.create_map(F.lit("metric"), brand, F.lit("period"), F.concat(F.lit("2023-Q"), (k % 4 + 1).cast("string")))).when(k % 3 == 1, F.create_map(F.lit("cause"), brand, F.lit("effect"), kind)).otherwise(F.create_map(F.lit("entity"), kind))
    intent = F.when(k % 3 == 0, "AGG").when(k % 3 == 1, "CAUSAL").otherwise("POINT")
    return p.read(spark, d, "part").select(k.alias("id"), intent.alias("intent"), slots.alias("slots"))


_SLOT = "regexp_replace(regexp_replace(lower(trim({x})), '[^a-z0-9\\-]+', '_', 'g'), '^_+|_+$', '', 'g')"
_BRAND, _KIND = _SLOT.format(x="p_brand"), _SLOT.format(x="p_type")


@op(f"""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'AGG(metric=''' || {_BRAND} || ''', period=''2023-Q' || CAST(p_partkey % 4 + 1 AS VARCHAR) || ''')' WHEN 1 THEN 'CAUSAL(cause=''' || {_BRAND} || ''', effect=''' || {_KIND} || ''')' ELSE 'POINT(entity=''' || {_KIND} || ''')' END AS query FROM part""")
def op_n6_canonical(spark: SparkSession, d: str) -> DataFrame:
    return planner.canonical(_frames(spark, d))


@op(f"SELECT p_partkey AS id, CAST(CASE p_partkey % 3 WHEN 2 THEN 1 ELSE 2 END AS INT) AS n_slots, CASE p_partkey % 3 WHEN 0 THEN {_BRAND} END AS metric FROM part")
def op_y2_parse_slots(spark: SparkSession, d: str) -> DataFrame:
    m = planner.parse_slots(F.col("query"))
    return planner.canonical(_frames(spark, d)).select("id", F.size(m).alias("n_slots"), F.try_element_at(m, F.lit("metric")).alias("metric"))
