"""Who posts where: the network of the busiest authors and their communities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postscope import fixed_values as fv

# An author list up to this length is small enough to be sent to every task.
_BROADCAST_AUTHORS = 100_000


def top_authors(posts: DataFrame, n: int = fv.TOP_AUTHORS) -> DataFrame:
    return (
        posts.filter(F.col("author").isNotNull())
        .groupBy("author")
        .agg(F.count(F.lit(1)).alias("posts"))
        .orderBy(F.desc("posts"), "author")
        .limit(n)
    )


def semi_join_top_authors(posts: DataFrame, n: int = fv.TOP_AUTHORS) -> DataFrame:
    """Posts of the n busiest authors; the list of n names goes to the posts."""
    authors = top_authors(posts, n).select("author")
    if n <= _BROADCAST_AUTHORS:
        authors = F.broadcast(authors)
    return posts.join(authors, "author", "left_semi")


def network_edges(posts: DataFrame, n: int = fv.TOP_AUTHORS) -> DataFrame:
    """Author-community pairs of the busiest authors, with the number of posts behind each."""
    return (
        semi_join_top_authors(posts, n)
        .filter(F.col("subreddit").isNotNull())
        .groupBy("author", "subreddit")
        .agg(F.count(F.lit(1)).alias("posts"))
    )


def network_nodes(edges: DataFrame) -> DataFrame:
    """Authors at a fixed size, communities sized by their number of authors."""
    authors = edges.select("author").distinct().select(
        F.col("author").alias("node"),
        F.lit("Author").alias("node_type"),
        F.lit(fv.AUTHOR_NODE_SIZE).alias("size"),
    )
    size = fv.SUBREDDIT_NODE_BASE + F.count(F.lit(1)) * fv.SUBREDDIT_NODE_STEP
    communities = edges.groupBy(F.col("subreddit").alias("node")).agg(size.alias("size")).select(
        "node", F.lit("Subreddit").alias("node_type"), "size"
    )
    return authors.unionByName(communities)


def network_counts(edges: DataFrame) -> DataFrame:
    """One row: communities, authors and connections of the network."""
    return edges.agg(
        F.count_distinct("subreddit").alias("subreddits"),
        F.count_distinct("author").alias("authors"),
        F.count(F.lit(1)).alias("connections"),
    )
