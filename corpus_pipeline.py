"""Corpus pipeline: quality rules, language ID, n-gram Jaccard join, substring dedup and packing, in this order.

Each stage is written as Parquet and reread by the caller; ``run`` does so through the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vireo.llm import jaccard, langid, packing, quality, substrings
from vireo.llm.common import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base check and the certified cutoffs."""
    return quality.quality_stage(spark, docs, sf_dir)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return langid.language_stage(spark, docs, sf_dir)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, similarity 0.8)."""
    return jaccard.jaccard_stage(spark, docs, sf_dir)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of 50 words or more that a smaller document has."""
    return substrings.substring_stage(spark, docs, sf_dir)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 1024 tokens."""
    return packing.packing_stage(spark, docs, sf_dir)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("substring_dedup", substring_dedup),
    ("sequence_packing", sequence_packing),
]
#: The stages learn cutoffs, classifiers and packings, which SQL can't express; tests hold them against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut(docs)
    return docs
