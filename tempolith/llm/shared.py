"""What the operators of this subpackage have in common: inputs, written
intermediate tables, and byte helpers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import drop_written, fresh_path, shared_dir, written

__all__ = ["WORD_RE", "WS_CHARS", "WS_RE", "drop_written", "fresh_path", "shared_dir", "shuffle_parts", "table", "written"]

#: The white space of the contracts: blank and the five ASCII controls from tab to carriage return.
WS_CHARS = " \t\n\x0b\f\r"
WORD_RE = r"[^\x20\x09-\x0D]+"
WS_RE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
