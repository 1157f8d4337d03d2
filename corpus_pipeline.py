"""Corpus pipeline: five stages over `documents`, each written as Parquet and read again.

Each stage works on all that its predecessor kept, and its decisions take effect: documents
of low quality go, frequent lines go, one document of each near-duplicate group stays,
documents holding benchmark passages go, and the last stage selects the training mix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontam, linededup, quality, queries, simhash
from tidemark.llm.common import documents, table
from tidemark.session import materialize


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the classifier accepts (score of 0.3 or more)."""
    scored = quality.classify(docs, table(spark, sf_dir, "labels"), threshold=0.3)
    return scored.where(F.col("predicted") == 1).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines found in 10 or more documents; n_chars follows the text."""
    cleaned = linededup.drop_frequent_lines(docs, min_docs=10, min_chars=1)
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each SimHash group (3-word shingles, 2 bits)."""
    return simhash.one_per_group(docs, shingle=3, max_bits=2).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark passage."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Selects the training mix; adds domain, epoch, n_tokens and n_taken."""
    return queries.mixed(docs)


STAGES = [("quality_classifier", quality_filter), ("line_dedup", line_dedup), ("simhash_near_dedup", near_dedup),
          ("benchmark_decontamination", decontaminate), ("source_mix", source_mix)]

#: A fitted classifier and SimHash components can't be stated in SQL; tests/llm holds the brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
