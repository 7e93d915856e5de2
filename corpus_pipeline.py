"""From raw documents to packed training sequences.

Each stage takes what its predecessor kept, as a table with the columns of
``documents``; the last returns a row for each packed piece.

1. Quality rules reject rows (hard rules; soft rules in suspect hosts; bad hosts).
2. Of equal texts, white space aside, one row stays.
3. Of near duplicates (five words, similarity 0.8) one row stays.
4. The mix: each source's blocks as often as the draw takes them, as rows with the documents' own
   columns (``n_chars`` is the length of the row's text); a source below its share loses blocks, one above it repeats them.
5. Best-fit packing of every row's tokens.

Defined results: null and blank texts fail the quality rules, so none gets further; rows repeated outright are
equal texts; null ids stay null throughout; rows that share an id are documents of their own; a null source is a
source; very long texts are treated whole in every stage; ties are broken as the stages' operators say; an empty
table gives an empty result; extra columns, whatever their names, are kept up to the packing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tempolith.llm import exact_dedup, mixing, near_dedup, packing, quality_rules, registry
from tempolith.llm.shared import table, written


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.keep_good(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.resampled(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(docs, registry.vocabulary())


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("near_dedup", near), ("source_mixing", mix), ("best_fit_packing", pack)]

#: Near duplicates, the seeded draws and the packing have no SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
