"""A corpus from raw documents to tokens, in five stages; each works on what the one before it kept.

Every stage takes the documents that are left and gives those that stay, with all their columns; the
last one gives their tokens. Between stages the documents are a Parquet table in the shared folder, so
a lost executor costs tasks of one stage, and no stage sees another's plan. Every row is decided by
itself: a null or repeated doc_id neither saves a row nor takes another one with it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wayfreight.llm import bpe, decontaminate, exact_dedup, jaccard, quality
from wayfreight.llm.common import source, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score of 0.3 or more)."""
    return quality.drop_poor(docs, source(spark, sf_dir, "labels"), each_row=True)


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, but for the case of A-Z, the one with the largest doc_id."""
    return exact_dedup.drop_exact_copies(docs, each_row=True)


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of five-word shingles, the smallest doc_id."""
    return jaccard.keep_one_of_each(docs, size=5, percent=80, each_row=True)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark (weighted similarity of 0.8 or more)."""
    return decontaminate.drop_contaminated(docs, source(spark, sf_dir, "benchmark"), every_length=True, each_row=True)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document that is left."""
    return bpe.bpe_round_trip(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality", good_quality),
    ("exact_dedup", first_copies),
    ("near_dedup", one_of_similar),
    ("decontaminate", without_benchmark),
    ("tokens", tokens),
]

#: SQL can express neither the classifier nor the tokenizer; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = source(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
