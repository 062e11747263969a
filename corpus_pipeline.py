"""A training-data pipeline over ``documents``: each stage works on all that the one before it kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corrobora.llm import line_crf, pii, pivotal_mix, simhash, suffix_pieces
from corrobora.llm.common import fresh_name, model_bytes, table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def small_batches(spark: SparkSession) -> None:
    """Texts go to Python by a few MB at a time: a worker keeps the memory that its largest batch took.

    A plan reads these settings when it runs, so they stay set in the session.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 * 1024 * 1024))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose lines are mostly boilerplate, go."""
    small_batches(spark)
    field = line_crf.fit(docs, table(spark, sf_dir, "labels"))
    verdict = fresh_name(docs, "verdict")
    return line_crf.judge(docs, field, name=verdict).where(f"{verdict}.kept").drop(verdict)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    small_batches(spark)
    return simhash.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gives way to its kind."""
    return pii.redacted(docs, pii.fit(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it."""
    return pivotal_mix.mixed(docs, weights=(3, 1, 2), share=1.5, cap=2.0)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, and the ids of the text."""
    small_batches(spark)
    return suffix_pieces.encoded(docs, model_bytes("piece_bpe_32k.model"))


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("piece_ids", piece_ids),
]

# A pseudo-random draw, trained models and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
