"""Corpus pipeline: quality rules, near-duplicates, benchmark leaks, secrets, source mix.

Each stage is a thin call of its operator over all that the stage before kept.
The first four return the columns of ``documents``; the last returns every kept
document with its copies in the mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rewrite_lake.llm import decontaminate, minhash_join, mixing, quality_rules, secret_scan
from rewrite_lake.llm.common import materialize, read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays (five-word shingles, 0.8)."""
    return minhash_join.drop_near_duplicates(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Live credentials are masked; the documents stay."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies per document, for the sources' target weights."""
    return mixing.mix(docs)


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks),
          ("secret_scan", secrets), ("source_mix", mix)]

#: Near-duplicate groups are components over set similarity, leaks a search: no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written and read again."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
