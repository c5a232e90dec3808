"""One query per operator over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postscope.llm.centroids import cluster_vectors
from postscope.llm.exact import exact_duplicates
from postscope.llm.jaccard import jaccard_components
from postscope.llm.langid import identify_language
from postscope.llm.mixing import mix_sources
from postscope.llm.packing import pack_tokens
from postscope.llm.phrases import mine_phrases
from postscope.llm.pieces import piece_digests
from postscope.llm.quality import quality_rules
from postscope.llm.radix import remove_repeated_bytes
from postscope.llm.suffix_trees import remove_repeated_words
from postscope.llm.vectors import near_vectors
from postscope.llm.warc import warc_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> bytes:
    """The public model, read on the driver and sent to the tasks."""
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        return file.read()


def byte_ranks() -> tuple[bytes, str]:
    """The public byte-level vocabulary as ranks, and the pattern that splits text before them."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        return file.read(), public_tokenizers.PATTERN


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).drop("removed_lines", "row_hash")


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc_round_trip(table(spark, sf_dir, "pages"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


@query
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


@query
def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(table(spark, sf_dir, "documents"), piece_model())


@query
def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


@query
def op6_radix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents")).drop("kept")


@query
def op8_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    removed = remove_repeated_words(table(spark, sf_dir, "documents"))
    return removed.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op2_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


@query
def op3_pack_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = byte_ranks()
    return pack_tokens(table(spark, sf_dir, "documents"), ranks, pattern)


@query
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


@query
def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


@query
def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(table(spark, sf_dir, "documents"))
