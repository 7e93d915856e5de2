"""The queries of this subpackage and their SQL, for ``__spark_entry__``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import chunk_dedup, exact_dedup, license_scan, mixing, near_dedup, packing, quality_rules, site_tree, suffix_dedup, warc
from .shared import table

Query = Callable[[SparkSession, str], DataFrame]


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op3_warc_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.capture_round_trip(table(spark, sf_dir, "pages"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def vocabulary() -> str:
    """The tokenizer file of the packing contract."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"), vocabulary())


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(table(spark, sf_dir, "documents"), shingle=2)


def op10_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunk_dedup.chunk_dedup(table(spark, sf_dir, "documents"))


def op7_site_tree_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return site_tree.extract_text(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_best_fit_packing, op2_license_scan, op3_warc_captures, op4_suffix_dedup, op5_exact_dedup, op6_source_mixing, op7_site_tree_text, op8_quality_rules, op9_near_dedup, op10_chunk_dedup)}
ORACLES: dict[str, str] = {"op3_warc_captures": warc.SQL, "op5_exact_dedup": exact_dedup.SQL, "op8_quality_rules": quality_rules.SQL}
