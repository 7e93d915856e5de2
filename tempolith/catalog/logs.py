"""Sources, sinks, joins of evaluation tables, stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import joins, tms
from ..session import fresh_path
from ..sources import jsonl, readers
from ..sources import projection as p
from .base import op


def _cust(spark: SparkSession, d: str) -> DataFrame:
    return p.read(spark, d, "customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("node_uid"), F.col("c_name").alias("label"), F.lit("person").alias("category"))


@op("SELECT 'C' || CAST(c_custkey AS VARCHAR) AS node_uid, c_name AS label, 'person' AS category FROM customer")
def op_s1_strict_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """Written as JSON lines and read back; a bad line would be an error."""
    path = fresh_path(spark, "nodes")
    jsonl.write(_cust(spark, d), path)
    return jsonl.read_strict(spark, path, jsonl.NODE).select("node_uid", "label", "category")


@op("SELECT 'C' || CAST(c_custkey AS VARCHAR) AS node_uid, c_name AS label FROM customer WHERE c_custkey % 3 < 2")
def op_s2_lenient_jsonl(spark: SparkSession, d: str) -> DataFrame:
    """A third of the lines is broken, another begins with a byte-order mark."""
    path, k = fresh_path(spark, "lines"), F.substring("node_uid", 2, 20).cast("bigint")
    line = F.to_json(F.struct("node_uid", "label", "category"))
    text = F.when(k % 3 == 0, F.concat(F.lit("﻿"), line)).when(k % 3 == 1, line).when(k % 2 == 0, "[1, 2]").otherwise("{broken")
    _cust(spark, d).select(text.alias("value")).write.text(path)
    return jsonl.read_lenient(spark, path, jsonl.NODE).select("node_uid", "label")


def _rows(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    uids = F.array(F.concat(F.lit("C"), F.col("o_custkey").cast("string")), F.lit("X"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")))
    return p.read(spark, d, "orders").select(k.cast("string").alias("id"), F.when(k % 5 != 0, F.concat(F.lit("order of "), F.col("o_custkey").cast("string"))).otherwise("  ").alias("query"), F.col("o_orderstatus").alias("domain"), F.when(k % 2 == 0, F.array("o_orderpriority")).alias("tags"), uids.alias("node_uids"))


@op("SELECT CAST(o_orderkey AS VARCHAR) AS id, 'order of ' || CAST(o_custkey AS VARCHAR) || ' ' || CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE '' END || ' ' || o_orderstatus AS text FROM orders WHERE o_orderkey % 5 <> 0")
def op_s6_row_documents(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.row_documents(_rows(spark, d)).select("id", "text")


@op("SELECT CAST(o_orderkey AS VARCHAR) AS id, u AS uid, CAST(p AS INT) AS pos FROM orders, (SELECT unnest([0, 1]) AS p), LATERAL (SELECT CASE p WHEN 0 THEN 'C' || CAST(o_custkey AS VARCHAR) ELSE 'X' END AS u)")
def op_j9_linked_uids(spark: SparkSession, d: str) -> DataFrame:
    return jsonl.linked_uids(_rows(spark, d), "node_uids")


@op("SELECT o_custkey AS key, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def op_s7_qa_index(spark: SparkSession, d: str) -> DataFrame:
    return readers.qa_index(p.read(spark, d, "orders").select(F.col("o_custkey").alias("key"), "o_orderkey"), "key", "o_orderkey")


@op("SELECT vec_id, CAST(len(embedding) AS INT) AS width FROM embeddings")
def op_s8_dense_scan(spark: SparkSession, d: str) -> DataFrame:
    """Two generations of a matrix in a folder: the one written last counts, and its rows must be of one length."""
    path, v = fresh_path(spark, "vectors"), p.read(spark, d, "embeddings")
    v.withColumn("vec_id", -F.col("vec_id")).coalesce(1).write.parquet(f"{path}/a")
    v.coalesce(1).write.parquet(f"{path}/b")
    return readers.checked(readers.newest(spark, path, "part-")).select("vec_id", F.size("embedding").alias("width"))


@op("SELECT false AS matches, count(*) FILTER (WHERE vec_id % 10 = 0) AS missing, CAST(0 AS BIGINT) AS extra FROM embeddings")
def op_s9_cache_check(spark: SparkSession, d: str) -> DataFrame:
    v = p.read(spark, d, "embeddings")
    return readers.cache_matches(v.where("vec_id % 10 <> 0"), v, "vec_id")


@op("SELECT vec_id FROM embeddings")
def op_k4_staged_append(spark: SparkSession, d: str) -> DataFrame:
    """A cache saved in one step, then once more with the keys that it lacks."""
    path, v = fresh_path(spark, "cache"), p.read(spark, d, "embeddings")
    readers.save_staged(v.where("vec_id % 10 <> 0"), path)
    old = spark.read.parquet(path)
    readers.save_staged(old.unionByName(readers.appended(old, v.unionByName(v), "vec_id")), path)
    return spark.read.parquet(path).select("vec_id")


@op("SELECT c_custkey AS id, 2 * c_acctbal AS score FROM customer WHERE c_custkey % 4 <> 3 UNION ALL SELECT c_custkey, c_acctbal FROM customer")
def op_s10_response_files(spark: SparkSession, d: str) -> DataFrame:
    """The same responses as CSV, where a fourth of the rows has a bad number, and as JSON lines."""
    path, c = fresh_path(spark, "responses"), p.read(spark, d, "customer")
    score = F.when(F.col("c_custkey") % 4 == 3, "bad").otherwise(F.format_string("%.4f", 2 * F.col("c_acctbal")))
    c.select(F.col("c_custkey").alias("id"), score.alias("score")).write.option("header", True).csv(f"{path}.csv")
    c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("score")).write.json(f"{path}.jsonl")
    schema = "id long, score double"
    # all columns are asked for, else the bad ones would not be noticed
    table = readers.read_responses(spark, f"{path}.csv", schema).where("score is not null")
    return table.unionByName(readers.read_responses(spark, f"{path}.jsonl", schema))


@op("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'p' WHEN 1 THEN 'g' WHEN 2 THEN p_name END AS prediction FROM part")
def op_s11_predictions(spark: SparkSession, d: str) -> DataFrame:
    k, none, t = F.col("p_partkey") % 4, F.lit(None).cast("string"), p.read(spark, d, "part")
    told = t.where(k != 2).select(F.col("p_partkey").cast("string").alias("id"), F.when(k == 0, "p").alias("prediction"), F.when(k <= 1, "g").alias("generated_text"), none.alias("text"))
    more = t.where(k == 2).select(F.concat(F.lit("key"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_name").alias("prediction"), none.alias("generated_text"), none.alias("text"))
    cases = t.select(F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("key"), F.col("p_partkey").cast("string")).alias("other"))
    return readers.with_predictions(cases, told.unionByName(more), "id", "other").select(F.col("id").cast("bigint").alias("id"), "prediction")


@op("SELECT o_orderkey AS id, 'on ' || strftime(o_orderdate, '%Y-%m-%d') AS text, strftime(o_orderdate, '%Y-%m-%d') AS span, 'DATE' AS type FROM orders")
def op_s12_timex_dataset(spark: SparkSession, d: str) -> DataFrame:
    """Annotated texts as a file, read back, with the text of each gold span."""
    path, day = fresh_path(spark, "timex"), F.date_format("o_orderdate", "yyyy-MM-dd")
    span = F.struct(F.lit(3).alias("start"), F.lit(13).alias("end"), F.lit("DATE").alias("type"))
    p.read(spark, d, "orders").select(F.concat(F.lit("on "), day).alias("text"), F.array(span).alias("gold_spans"), F.array(day).alias("gold_normalized"), F.col("o_orderkey").cast("string").alias("reference_time")).write.json(path)
    rows = spark.read.schema(readers.TIMEX).json(path)
    from ..functions.timex import span_texts

    s = span_texts(F.col("text"), F.col("gold_spans"))[0]
    return rows.select(F.col("reference_time").cast("bigint").alias("id"), "text", s["text"].alias("span"), s["type"].alias("type"))


@op("SELECT CAST(user_id AS VARCHAR) AS query_id, count(*) AS n, CAST(0.0 AS DOUBLE) AS overhead FROM events GROUP BY user_id")
def op_s15_trace_files(spark: SparkSession, d: str) -> DataFrame:
    """Traces dumped as lines and read back, missing fields at their defaults, one row for each firing."""
    path, t = fresh_path(spark, "traces"), p.traces(spark, d)
    one = F.struct("rule_id", F.array(F.struct(F.col("input_fact").alias("fact_id"), "value")).alias("inputs"), F.struct("fact_id", "value").alias("conclusion"), (F.col("fired_us") / 1e6).alias("fired_at"))
    jsonl.write(t.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("event_id", one.alias("r")))).alias("x")).select("query_id", F.transform("x", lambda x: x["r"]).alias("rule_traces")), path)
    traces = readers.read_traces(spark, path)
    n = readers.firings(traces).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(traces.select("query_id", F.col("instrumentation_overhead_ms").alias("overhead")), "query_id")


@op("SELECT id, CASE id % 5 WHEN 0 THEN 'point_in_time' WHEN 1 THEN 'interval' WHEN 2 THEN 'sequence' WHEN 3 THEN 'causality' ELSE 'overlap' END AS fact_type FROM range(500) t(id)")
def op_s16_examples(spark: SparkSession, d: str) -> DataFrame:
    return readers.examples(spark, 500).select("id", "fact_type")


@op("SELECT 'q' || CAST(i AS VARCHAR) AS query_id, CAST(5 AS BIGINT) AS n FROM range(200) t(i)")
def op_s17_synthetic_traces(spark: SparkSession, d: str) -> DataFrame:
    return readers.synthetic_firings(spark, 200).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


@op("SELECT o_orderkey AS line FROM orders WHERE o_orderkey > (SELECT max(o_orderkey) FROM orders WHERE o_orderkey % 100 = 7 AND o_orderkey < (SELECT max(o_orderkey) // 2 FROM orders))")
def op_s18_append_start(spark: SparkSession, d: str) -> DataFrame:
    lines = p.read(spark, d, "orders").select(F.col("o_orderkey").alias("line"), F.col("o_orderkey").cast("string").alias("source_id"))
    half = lines.agg(F.floor(F.max("line") / 2).alias("h"))
    done = lines.join(F.broadcast(half)).where("line % 100 = 7 and line < h").select("source_id")
    return readers.after_last(lines, done).select("line")


@op("SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'stale' ELSE 'active' END AS status FROM events")
def op_k3_status_rewrite(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "results")
    e = p.read(spark, d, "events").select("event_id", F.lit("active").alias("status"))
    readers.save_staged(tms.with_changed_status(e, "event_id", e.where("event_id % 7 = 0"), "stale"), path)
    return spark.read.parquet(path)


@op("SELECT CAST(user_id AS VARCHAR) AS query_id, 'rule_' || event_type AS rule_id, count(*) AS n FROM events GROUP BY 1, 2")
def op_k5_trace_dump(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "dump")
    p.traces(spark, d).select(F.to_json(F.struct("query_id", "rule_id", "fact_id", "value")).alias("value")).write.text(path)
    back = spark.read.schema("query_id string, rule_id string").json(path)
    return back.groupBy("query_id", "rule_id").agg(F.count(F.lit(1)).alias("n"))


@op("SELECT c_custkey AS scenario_id, c_mktsegment AS style, CAST(NULL AS DOUBLE) AS score FROM customer")
def op_k7_score_templates(spark: SparkSession, d: str) -> DataFrame:
    """An empty score sheet as CSV, read back as it will be when it is filled in."""
    path = f"{fresh_path(spark, 'sheet')}.csv"
    p.read(spark, d, "customer").select(F.col("c_custkey").alias("scenario_id"), F.col("c_mktsegment").alias("style"), F.lit(None).cast("string").alias("score")).write.option("header", True).csv(path)
    return readers.read_responses(spark, path, "scenario_id long, style string, score double")


@op("SELECT o_orderstatus AS model, round(avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 0), 4) AS graph, round(avg(o_totalprice) FILTER (WHERE o_orderkey % 2 = 1), 4) AS plain FROM orders GROUP BY 1")
def op_k8_run_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Summaries of runs, one file each, as a matrix of models by modes."""
    path, o = fresh_path(spark, "summaries"), p.read(spark, d, "orders")
    mode = F.when(F.col("o_orderkey") % 2 == 0, "graph").otherwise("plain")
    o.groupBy(F.col("o_orderstatus").alias("model"), mode.alias("mode")).agg(F.avg("o_totalprice").alias("exact")).write.partitionBy("mode").json(path)
    runs = spark.read.schema("model string, exact double, mode string").json(path)
    return runs.groupBy("model").pivot("mode", ["graph", "plain"]).agg(F.round(F.first("exact"), 4))


# --- joins -------------------------------------------------------------------


@op("SELECT l.doc_id AS id, quality = CASE WHEN n_chars > 800 THEN 1 ELSE 0 END AS right FROM labels l JOIN documents d ON l.doc_id = d.doc_id WHERE l.doc_id % 3 > 0")
def op_j10_gold_predictions(spark: SparkSession, d: str) -> DataFrame:
    gold = p.read(spark, d, "labels").select(F.col("doc_id").alias("id"), "quality")
    told = p.read(spark, d, "documents").where("doc_id % 3 > 0").select(F.col("doc_id").alias("id"), (F.col("n_chars") > 800).cast("int").alias("quality"))
    return joins.gold_predictions(gold, told).select("id", (F.col("quality") == F.col("predicted_quality")).alias("right"))


@op("""SELECT l_orderkey AS explanation_id, l_linenumber AS question_id, o_orderstatus AS domain, CASE WHEN l_linenumber % 3 = 0 THEN least(1.0, l_quantity / 25) WHEN l_linenumber % 3 = 1 THEN CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END END AS score FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def op_j11_scored_responses(spark: SparkSession, d: str) -> DataFrame:
    k, none = F.col("l_linenumber") % 3, F.lit(None)
    lines, o = p.read(spark, d, "lineitem"), p.read(spark, d, "orders")
    r = lines.select(F.col("l_orderkey").alias("explanation_id"), F.col("l_linenumber").alias("question_id"), F.when(k == 1, "mcq").otherwise("timeline").alias("question_type"), F.concat(F.lit(" "), "l_returnflag").alias("answer"), F.when(k == 0, F.col("l_quantity") / 25).alias("score"), none.cast("string").alias("domain"), F.lit("b").alias("bucket"))
    tasks = o.select(F.col("o_orderkey").alias("explanation_id"), F.col("o_orderstatus").alias("domain"), F.lit("x").alias("bucket"))
    asked = lines.select(F.col("l_orderkey").alias("explanation_id"), F.col("l_linenumber").alias("question_id"), F.lit("R").alias("correct_answer"))
    return joins.scored_responses(r, tasks, asked).join(tasks.select("explanation_id"), "explanation_id", "left_semi").select("explanation_id", "question_id", "domain", "score")


@op("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_size AS DOUBLE) WHEN p_partkey % 3 = 1 THEN p_retailprice END AS score FROM part")
def op_j12_annotations(spark: SparkSession, d: str) -> DataFrame:
    t, k = p.read(spark, d, "part"), F.col("p_partkey") % 3
    rows = t.select(F.col("p_partkey").alias("id"), F.when(k == 1, F.col("p_retailprice")).alias("score"))
    notes = t.where(k != 2).select(F.col("p_partkey").alias("id"), F.when(k == 0, F.col("p_size").cast("string")).otherwise("n/a").alias("rated"))
    return joins.annotated(rows, notes, "id", {"score": "rated"})


@op("SELECT e.source_uid, y AS at, count(*) AS n FROM tkg_edges e, (SELECT unnest([1993, 1996, 1998]) AS y) WHERE e.relation = 'supplied' AND start_year <= y AND y <= end_year GROUP BY 1, 2", graph=True)
def op_j17_interval_join(spark: SparkSession, d: str) -> DataFrame:
    e = p.supplied_edges(spark, d)
    points = e.select("source_uid").distinct().withColumn("at", F.explode(F.array(*[F.lit(y).cast("bigint") for y in (1993, 1996, 1998)])))
    return joins.within_intervals(points, e.select("source_uid", "edge_uid", "start_year", "end_year"), ["source_uid"]).groupBy("source_uid", "at").agg(F.count(F.lit(1)).alias("n"))


# --- provenance, beliefs, stores ---------------------------------------------


@op("SELECT 'supplied|S' || CAST(l_suppkey AS VARCHAR) || '|P' || CAST(l_partkey AS VARCHAR) AS edge_uid, count(*) AS support_count, list_aggregate(list_sort(list_distinct(list(CAST(l_orderkey AS VARCHAR)))), 'string_agg', ',') AS rows FROM lineitem GROUP BY 1")
def op_a27_provenance(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the same triple as one, with how often it was told and by which rows."""
    told = p.read(spark, d, "lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("source_uid"), F.lit("supplied").alias("relation"), F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("target_uid"), F.col("l_orderkey").cast("string").alias("row_id"))
    from ..operators.graph import merged

    return merged(told).select("edge_uid", "support_count", F.array_join("source_row_ids", ",").alias("rows"))


@op("SELECT belief_id, 'dirty' AS status FROM belief WHERE conv_id % 3 = 0 UNION ALL SELECT belief_id, 'active' FROM belief WHERE conv_id % 3 <> 0", graph=True)
def op_a28_belief_listings(spark: SparkSession, d: str) -> DataFrame:
    b = p.beliefs(spark, d).withColumn("status", F.when(F.col("conv_id") % 3 == 0, "dirty").otherwise("active"))
    return tms.listed(b, "dirty").unionByName(tms.listed(b, "active"))


@op("SELECT DISTINCT belief_id, support_id FROM (SELECT belief_id, support_id FROM belief UNION ALL SELECT belief_id, CAST(conv_id AS VARCHAR) || ':base' FROM belief WHERE turn % 2 = 0)", graph=True)
def op_r1_add_support(spark: SparkSession, d: str) -> DataFrame:
    b = p.beliefs(spark, d)
    more = b.where("turn % 2 = 0").select("belief_id", F.concat(F.col("conv_id").cast("string"), F.lit(":base")).alias("support_id"))
    more = more.unionByName(more).unionByName(more.limit(1).select(F.lit("nobody").alias("belief_id"), "support_id"))
    return tms.add_support(b, more).select("belief_id", "support_id")


@op("SELECT 'cf_' || belief_id AS belief_id, belief_id AS support_id, role || '>one year later' AS payload FROM belief", graph=True)
def op_y5_time_shift(spark: SparkSession, d: str) -> DataFrame:
    b = p.beliefs(spark, d).withColumn("payload", F.create_map(F.lit("role"), F.col("role")))
    out = tms.shifted(b, "one year later")
    return out.select("belief_id", "support_id", F.concat_ws(">", F.col("payload")["role"], F.col("payload")["counterfactual_time_shift"]).alias("payload"))


@op("SELECT event_type AS intent, count(*) AS n, max(event_id) AS last FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY 1")
def op_r3_store_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Query records told again and again: the last of each id, listed by intent."""
    e = p.read(spark, d, "events").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("query_id"), F.col("event_type").alias("intent"), "event_id")
    return tms.latest(e, "query_id", F.desc("event_id")).groupBy("intent").agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last"))


@op("SELECT event_id, coalesce(CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT), 0) AS k, 'active' AS status FROM events")
def op_r4_record_defaults(spark: SparkSession, d: str) -> DataFrame:
    """Serialised records read back, with defaults for what they lack."""
    r = F.from_json("props", "k bigint, status string")
    return p.read(spark, d, "events").select("event_id", F.coalesce(r["k"], F.lit(0)).alias("k"), F.coalesce(r["status"], F.lit("active")).alias("status"))


@op("SELECT DISTINCT CAST(user_id AS VARCHAR) AS query_id, 'concl_' || event_type AS fact_id FROM events")
def op_r6_conclusions(spark: SparkSession, d: str) -> DataFrame:
    return tms.conclusions(p.traces(spark, d)).select("query_id", "fact_id")


_FIRE = """(SELECT 'q' || CAST(c_custkey AS VARCHAR) AS q, unnest(['r1', 'r2', 'r3']) AS r, unnest(['a', 'b', 'x']) AS i, unnest(['b', 'c', 'c']) AS o FROM customer)"""


def _firings(spark: SparkSession, d: str) -> DataFrame:
    each = F.explode(F.array(*[F.struct(F.lit(r).alias("rule_id"), F.lit(i).alias("input_fact"), F.lit(o).alias("fact_id")) for r, i, o in (("r1", "a", "b"), ("r2", "b", "c"), ("r3", "x", "c"))]))
    return p.read(spark, d, "customer").select(F.concat(F.lit("q"), F.col("c_custkey").cast("string")).alias("query_id"), each.alias("f")).select("query_id", "f.*")


@op(f"SELECT a.q AS query_id, 'c' AS fact_id, CASE WHEN b.r IS NULL THEN a.r ELSE a.r || '>' || b.r END AS path FROM {_FIRE} a LEFT JOIN {_FIRE} b ON b.q = a.q AND b.o = a.i WHERE a.o = 'c'")
def op_g7_justification_paths(spark: SparkSession, d: str) -> DataFrame:
    f = _firings(spark, d)
    found = tms.justification_paths(f, f.where("fact_id = 'c'").select("query_id", "fact_id").distinct())
    return found.select("query_id", "fact_id", F.array_join("path", ">").alias("path"))


@op(f"SELECT DISTINCT q AS query_id, 'r2 | r1 || r3' AS text FROM {_FIRE}")
def op_r6_explain_fact(spark: SparkSession, d: str) -> DataFrame:
    f = _firings(spark, d)
    return tms.explain_fact(tms.justification_paths(f, f.where("fact_id = 'c'").select("query_id", "fact_id").distinct())).select("query_id", "text")


@op("SELECT event_id, least(10, support) AS n FROM (SELECT event_id, event_id % 20 AS support FROM events)")
def op_y6_slice_provenance(spark: SparkSession, d: str) -> DataFrame:
    ids = F.slice(F.sequence(F.lit(0), F.lit(19)), F.lit(1), (F.col("event_id") % 20).cast("int"))
    return p.read(spark, d, "events").select("event_id", F.size(F.slice(ids, 1, 10)).cast("bigint").alias("n"))


@op("""SELECT c_custkey AS id, CASE c_custkey % 3 WHEN 0 THEN 'C' WHEN 1 THEN 'a' ELSE c_name END AS source, CASE c_custkey % 3 WHEN 1 THEN 'r' ELSE 'located_in' END AS relation, CASE c_custkey % 3 WHEN 0 THEN 'N' WHEN 1 THEN 'b' ELSE 'there' END AS target, CASE c_custkey % 3 WHEN 2 THEN '1999' ELSE '' END AS time FROM customer""")
def op_y1_edges_from_json(spark: SparkSession, d: str) -> DataFrame:
    """Edges as arrays, short ones too, and as objects under several names."""
    k = F.col("c_custkey") % 3
    one = F.to_json(F.array(F.struct(F.col("c_name").alias("src"), F.lit("located_in").alias("rel"), F.lit("there").alias("tgt"), F.lit("1999").alias("year"))))
    text = F.when(k == 0, '[["C", "located_in", "N"]]').when(k == 1, '[{"source": "a", "relation": "r", "target": "b"}]').otherwise(one)
    return jsonl.edges_from_json(p.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), text.alias("json")))


@op("SELECT event_id, '{\"event_id\":' || CAST(event_id AS VARCHAR) || ',\"day\":\"' || strftime(ts, '%Y-%m-%d') || '\",\"kind\":\"' || event_type || '\"}' AS json FROM events")
def op_y3_serialise(spark: SparkSession, d: str) -> DataFrame:
    return p.read(spark, d, "events").select("event_id", F.to_json(F.struct("event_id", F.to_date("ts").alias("day"), F.col("event_type").alias("kind"))).alias("json"))
