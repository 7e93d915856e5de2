"""Meta-queries over a file of traces: ``python -m tempolith TRACES COMMAND ...``; one JSON object a line."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import tms
from .session import local_session
from .sources import readers


def run(spark: SparkSession, path: str, command: str, **options) -> DataFrame:
    """The rows that a command prints."""
    f = readers.firings(readers.read_traces(spark, path)).withColumn("fired_us", (F.col("fired_at") * 1e6).cast("long")).withColumn("event_id", F.monotonically_increasing_id())
    if command == "list-rules":
        return tms.rules_fired(f.dropDuplicates(["query_id", "rule_id", "fired_us"]))
    if command == "explain-fact":
        asked = f.select("query_id").distinct().withColumn("fact_id", F.lit(options["fact"]))
        return tms.explain_fact(tms.justification_paths(f, asked))
    if command == "contradictions":
        return tms.contradictions(f)
    if command == "influential":
        return tms.influential_facts(f, options.get("top_k", 5))
    if command == "why-not":
        rules = spark.createDataFrame([(r,) for r in options["rule"]], "rule_id string")
        return tms.why_not(f, f.select("query_id").distinct().crossJoin(F.broadcast(rules)))
    raise ValueError(f"unknown command {command}")


def main(argv: list[str]) -> None:
    parser = argparse.ArgumentParser(prog="tempolith", description=__doc__)
    parser.add_argument("traces")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("list-rules")
    commands.add_parser("explain-fact").add_argument("fact")
    commands.add_parser("contradictions")
    commands.add_parser("influential").add_argument("--top-k", type=int, default=5)
    commands.add_parser("why-not").add_argument("rule", nargs="+")
    options = vars(parser.parse_args(argv))
    spark = local_session(name="meta")
    for row in run(spark, options.pop("traces"), options.pop("command"), **options).toJSON().toLocalIterator():
        print(row)
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
