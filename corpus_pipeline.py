"""A corpus pipeline: quality rules, near copies, repeated passages, mixing, pieces."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postscope.llm.jaccard import jaccard_components, one_of_each
from postscope.llm.mixing import mixed_documents
from postscope.llm.pieces import piece_digests
from postscope.llm.quality import clean_documents, quality_rules
from postscope.llm.queries import piece_model
from postscope.llm.shared import shared_path
from postscope.llm.suffix_trees import documents_without_repeats, remove_repeated_words


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; lines over their host's limit are cut from the others."""
    return clean_documents(docs, quality_rules(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies the document with the smallest id stays (shingles of five words, 0.8)."""
    return one_of_each(docs, jaccard_components(docs, shingle=5, percent=80))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words and more stay in the document with the smallest id only."""
    return documents_without_repeats(docs, remove_repeated_words(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document."""
    return piece_digests(docs, piece_model())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_quality),
    ("jaccard_join", drop_near_copies),
    ("suffix_trees", cut_repeats),
    ("mix_sources", mix),
    ("pieces", encode),
]

#: Pieces cannot be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
