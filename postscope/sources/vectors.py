"""Embedding vectors keyed by post, and the checks around reading and writing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def vector_mismatches(posts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Ids that do not have exactly one post and one vector.

    One aggregate over both id columns, combined on the map side, finds posts
    without vector, vectors without post and repeated ids in a single shuffle.
    """
    sides = posts.select("post_id", F.lit(1).alias("p"), F.lit(0).alias("v")).unionByName(
        vectors.select("post_id", F.lit(0).alias("p"), F.lit(1).alias("v"))
    )
    counts = sides.groupBy("post_id").agg(
        F.sum("p").alias("n_posts"), F.sum("v").alias("n_vectors")
    )
    return counts.filter((F.col("n_posts") != 1) | (F.col("n_vectors") != 1))


def require_matching(posts: DataFrame, vectors: DataFrame) -> None:
    """Raise if any post lacks its vector or any vector its post."""
    sample = vector_mismatches(posts, vectors).limit(5).collect()
    if sample:
        ids = ", ".join(str(row.post_id) for row in sample)
        raise ValueError(f"posts and vectors do not match one to one, for example at {ids}")


def load_embeddings(spark: SparkSession, path: str, posts: DataFrame) -> DataFrame:
    """Vectors from Parquet, rejected unless they match the posts one to one."""
    vectors = spark.read.parquet(path)
    require_matching(posts, vectors)
    return vectors


def write_embeddings(vectors: DataFrame, path: str, posts: DataFrame) -> None:
    """Save vectors as Parquet once every post is known to have its vector."""
    require_matching(posts, vectors)
    vectors.write.mode("errorifexists").parquet(path)


def write_vectors_table(vectors: DataFrame, table: str, buckets: int) -> None:
    """Save vectors bucketed by ``post_id``, to be joined with posts saved alike."""
    (
        vectors.write.mode("errorifexists")
        .format("parquet")
        .bucketBy(buckets, "post_id")
        .sortBy("post_id")
        .saveAsTable(table)
    )
