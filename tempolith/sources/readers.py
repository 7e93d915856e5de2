"""Readers of evaluation files, caches and data sets, and generators of examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.templates import LIBRARY

TRACE = (
    "query_id string, started_at double, completed_at double, instrumentation_overhead_ms double, dropped boolean, over_budget boolean, meta map<string,string>, "
    "rule_traces array<struct<rule_id:string,rule_name:string,inputs:array<struct<fact_id:string,value:string>>,conclusion:struct<fact_id:string,value:string>,fired_at:double,confidence:double,latency_ms:double>>"
)
TIMEX = "text string, gold_spans array<struct<start:int,end:int,type:string>>, gold_normalized array<string>, reference_time string"
PATH = "id string, steps array<struct<subject:string,relation:string,obj:string,time:string>>"
#: Names under which a prediction may be found, in order.
PREDICTION = ("prediction", "generated_text", "output", "text")


def read_responses(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a CSV file with a header or of JSON lines, by the path's suffix; rows that do not parse are dropped."""
    if path.rstrip("/").endswith(".csv"):
        return spark.read.schema(schema).option("header", True).option("mode", "DROPMALFORMED").csv(path)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def read_objects(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file that holds one object or an array of them, over as many lines as it likes."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """Traces, one object to a file (``.json``) or one to a line; null and missing fields get their defaults."""
    rows = read_objects(spark, path, TRACE) if path.rstrip("/").endswith(".json") else spark.read.schema(TRACE).json(path)
    return with_defaults(rows.where("query_id is not null"))


def with_defaults(traces: DataFrame) -> DataFrame:
    return traces.withColumns(
        {
            "instrumentation_overhead_ms": F.coalesce("instrumentation_overhead_ms", F.lit(0.0)),
            "dropped": F.coalesce("dropped", F.lit(False)),
            "over_budget": F.coalesce("over_budget", F.lit(False)),
            "meta": F.coalesce("meta", F.create_map().cast("map<string,string>")),
            "rule_traces": F.when(F.col("rule_traces").isNull(), F.from_json(F.lit("[]"), dict((n, t) for n, t in traces.dtypes)["rule_traces"])).otherwise(F.col("rule_traces")),
        }
    )


def firings(traces: DataFrame) -> DataFrame:
    """One row for each rule and input: query_id, rule_id, input_fact, fact_id, value, fired_at, latency_ms."""
    rows = traces.select("query_id", F.explode("rule_traces").alias("r"))
    return rows.select("query_id", "r.rule_id", F.explode_outer("r.inputs").alias("i"), F.col("r.conclusion.fact_id").alias("fact_id"), F.col("r.conclusion.value").alias("value"), "r.fired_at", "r.latency_ms").withColumn("input_fact", F.col("i.fact_id")).drop("i")


def prediction(rows: DataFrame) -> Column:
    """The first name of PREDICTION that a row has and that is not null."""
    have = [F.col(c).cast("string") for c in PREDICTION if c in rows.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def with_predictions(cases: DataFrame, predictions: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Cases with their prediction by key, or by a second key where the first finds none."""
    told = predictions.select(F.col(key).alias("_k"), prediction(predictions).alias("_p")).where("_p is not null").dropDuplicates(["_k"])
    out = cases.join(told, cases[key] == told["_k"], "left").drop("_k").withColumnRenamed("_p", "prediction")
    if other:
        more = told.select(F.col("_k").alias("_k2"), F.col("_p").alias("_p2"))
        out = out.join(more, out[other] == more["_k2"], "left").withColumn("prediction", F.coalesce("prediction", "_p2")).drop("_k2", "_p2")
    return out


def qa_index(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One record for each key, the last in order."""
    return rows.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_r = 1").drop("_r")


# --- vectors -----------------------------------------------------------------


def newest(spark: SparkSession, folder: str, prefix: str) -> DataFrame:
    """The rows of the file of a folder whose name begins with ``prefix`` and that changed last."""
    rows = spark.read.option("pathGlobFilter", f"{prefix}*").option("recursiveFileLookup", True).parquet(folder).select("*", F.struct(F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_path").alias("f")).alias("_at"))
    last = rows.agg(F.max("_at").alias("_last"))  # one row
    return rows.join(F.broadcast(last), F.col("_at") == F.col("_last")).drop("_at", "_last")


def checked(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """Vectors, all of one length; another one is an error at run time."""
    size = F.size(column)
    width = vectors.agg(F.max(size).alias("_w"))  # one row
    rows = vectors.join(F.broadcast(width))
    return rows.where(F.when(size == F.col("_w"), F.lit(True)).otherwise(F.raise_error(F.lit("vectors of unlike length")).cast("boolean"))).drop("_w")


def cache_matches(cached: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """One row: matches (does a cache hold exactly the wanted keys, each once), missing, extra."""
    a, b = cached.groupBy(key).agg(F.count(F.lit(1)).alias("n")), wanted.select(key).distinct().withColumn("w", F.lit(True))
    both = a.join(b, key, "full")
    counts = both.agg(F.count_if(F.col("n").isNull()).alias("missing"), F.count_if(F.col("w").isNull()).alias("extra"), F.count_if(F.col("n") > 1).alias("twice"))
    return counts.select(((F.col("missing") + F.col("extra") + F.col("twice")) == 0).alias("matches"), "missing", "extra")


def appended(cached: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """The rows to append to a cache: those whose key it does not hold yet, each once."""
    return new.join(cached.select(key), key, "left_anti").dropDuplicates([key])


def save_staged(rows: DataFrame, path: str) -> None:
    """Write beside the path, then take its place in one rename, so a reader sees the old table or the new one."""
    spark = rows.sparkSession
    rows.write.mode("overwrite").parquet(f"{path}.staged")
    jvm = spark._jvm.org.apache.hadoop.fs.Path
    fs = jvm(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.exists(jvm(path)):
        fs.rename(jvm(path), jvm(f"{path}.old"))
    if not fs.rename(jvm(f"{path}.staged"), jvm(path)):
        raise OSError(f"{path} could not be replaced")
    fs.delete(jvm(f"{path}.old"), True)


# --- logs that grow ----------------------------------------------------------


def after_last(lines: DataFrame, written: DataFrame, key: str = "source_id", line: str = "line") -> DataFrame:
    """The lines of a source that come after the last one whose key is written already; all if none is."""
    done = lines.join(written.select(key).distinct(), key, "left_semi").agg(F.coalesce(F.max(line), F.lit(-1)).alias("_last"))  # one row
    return lines.join(F.broadcast(done)).where(F.col(line) > F.col("_last")).drop("_last")


# --- generated examples ------------------------------------------------------

#: A few facts of each kind, taken in turn.
EXAMPLES: dict[str, list[dict[str, object]]] = {
    "point_in_time": [
        {"entity": "The north bridge", "event": "was opened", "date": "1932-03-19"}, {"entity": "The survey ship", "event": "reached port", "date": "1841"}, {"entity": "The observatory", "event": "saw first light", "date": "July 1960"},
    ],
    "interval": [
        {"entity": "The canal works", "event": "lasted", "start_date": "1881", "end_date": "1894", "duration": "13 years"}, {"entity": "The long drought", "event": "lasted", "start_date": "1895", "end_date": "1903", "duration": "8 years"},
    ],
    "sequence": [{"events": ["the mine closed", "the town shrank", "the railway stopped"], "time_span": "a decade"}, {"events": ["the fair was planned", "the halls were built"], "timestamps": ["1850", "1851"]}],
    "causality": [{"cause": "the late frost", "effect": "a poor harvest", "certainty": "likely"}, {"cause": "the new tariff", "effect": "fewer imports", "mechanism": "higher prices"}],
    "overlap": [{"events": ["the strike", "the flood"], "time_period": "the spring of 1911"}, {"events": ["the census", "the election", "the fair"], "time_period": "1901"}],
}


def examples(spark: SparkSession, n: int, kind: str | None = None) -> DataFrame:
    """``n`` facts (of one kind, or of all in turn) that go round the fixed examples: id and the fields of a fact."""
    kinds = [kind] if kind else list(EXAMPLES)
    fields = {"entity": "string", "event": "string", "date": "string", "start_date": "string", "end_date": "string", "duration": "string", "events": "array<string>", "timestamps": "array<string>", "time_span": "string", "time_period": "string", "cause": "string", "effect": "string", "mechanism": "string", "certainty": "string"}
    table = [(k, j, len(EXAMPLES[name]), name, *[e.get(f) for f in fields]) for k, name in enumerate(kinds) for j, e in enumerate(EXAMPLES[name])]
    known = spark.createDataFrame(table, "k int, j int, size int, fact_type string, " + ", ".join(f"{f} {t}" for f, t in fields.items()))
    rows = spark.range(n).withColumn("_k", (F.col("id") % len(kinds)).cast("int")).withColumn("_turn", F.floor(F.col("id") / len(kinds)))
    return rows.join(F.broadcast(known), (rows["_k"] == known["k"]) & (F.col("_turn") % known["size"] == known["j"])).select("id", "fact_type", *fields)


def synthetic_firings(spark: SparkSession, queries: int, per_query: int = 5, facts: int = 50, seed: int = 7) -> DataFrame:
    """Rule firings of made-up queries, the same for every run: query_id, rule_id, input_fact, fact_id, value, fired_us, event_id."""
    pick = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n)).cast("string")
    rows = spark.range(queries * per_query)
    return rows.select(
        F.concat(F.lit("q"), F.floor(F.col("id") / per_query).cast("string")).alias("query_id"), F.concat(F.lit("rule_"), pick(1, 12)).alias("rule_id"), F.concat(F.lit("f"), pick(2, facts)).alias("input_fact"),
        F.concat(F.lit("f"), pick(3, facts)).alias("fact_id"), pick(4, 3).alias("value"), (F.col("id") * 1000).alias("fired_us"), F.col("id").alias("event_id"),
    )


KINDS = tuple(LIBRARY)
