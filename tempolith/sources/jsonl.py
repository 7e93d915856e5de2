"""JSON-lines sources and sinks, strict and lenient, and append logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = "node_uid string, label string, category string, normalized_label string, source_count int, source_row_ids array<string>"
EDGE = "edge_uid string, source_uid string, target_uid string, relation string, start string, end string, edge_type string, support_count bigint, source_row_ids array<string>"
TAG = "tag_uid string, tag string, normalized_tag string, source_count int, source_row_ids array<string>"
ROW = "id string, source_id string, query string, domain string, tags array<string>, normalized_tags array<string>, node_uids array<string>, edge_uids array<string>, tag_uids array<string>"


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Blank lines are skipped; a line that is no JSON object is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Byte-order marks are stripped; lines that are no JSON objects are skipped."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line"))
    parsed = lines.select(F.from_json("line", f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    return parsed.where("r is not null and r._bad is null").select("r.*").drop("_bad")


def row_documents(rows: DataFrame) -> DataFrame:
    """Rows with a query, and their search text: query, tags, domain."""
    text = F.concat_ws(" ", F.col("query"), F.array_join(F.coalesce("tags", F.array().cast("array<string>")), " "), F.col("domain"))
    return rows.where("trim(coalesce(query, '')) <> ''").withColumn("text", text)


def linked_uids(rows: DataFrame, column: str) -> DataFrame:
    """uid, pos: distinct linked uids in the order in which they first occur."""
    return rows.select("id", F.posexplode(column).alias("pos", "uid")).groupBy("id", "uid").agg(F.min("pos").alias("pos"))


def write(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(path)


def append_log(df: DataFrame, path: str, most: int = 10_000) -> None:
    """Append records; one that serialises to more than ``most`` bytes is an error."""
    from ..operators.tms import guarded

    guarded(df, most).write.mode("append").json(path)


def edges_from_json(rows: DataFrame) -> DataFrame:
    """(id, json) -> id, source, relation, target, time: a row for each edge of a JSON array.  An edge is an array of
    up to four texts or an object, whose fields go by several names; what it lacks is empty, and what is no edge is left out."""
    each = rows.select("id", F.explode(F.try_parse_json("json").cast("array<variant>")).alias("v"))
    names = {"source": ("source", "src", "subject"), "relation": ("relation", "rel", "predicate"), "target": ("target", "tgt", "object"), "time": ("time", "year", "start")}
    field = lambda path: F.try_variant_get("v", path, "string")
    cols = [F.coalesce(field(f"$[{i}]"), *[field(f"$.{n}") for n in ns], F.lit("")).alias(c) for i, (c, ns) in enumerate(names.items())]
    return each.select("id", *cols).where("source <> '' and target <> ''")
