"""Topic clusters of titles, their profiles and their map."""

from __future__ import annotations

from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postscope import fixed_values as fv
from postscope.operators.filters import enough_titles, filter_nonblank_title
from postscope.operators.ingest import column_or
from postscope.operators.keywords import prune_vocabulary, tfidf_vectors, tokenize_ngrams
from postscope.scratch import written

# Vectors of one partition while clusters are trained.
_TRAIN_ROWS = 50_000
# Vectors that starts trained side by side hold in all.
_HELD_ROWS = 8_000_000


def cluster_count_rule(
    titles: int | Column, max_clusters: int = fv.TOPIC_MAX_CLUSTERS
) -> int | Column:
    """One cluster per eight titles, at least two, at most ``max_clusters``."""
    if isinstance(titles, Column):
        wanted = F.floor(titles / fv.TOPIC_POSTS_PER_CLUSTER)
        return F.greatest(F.lit(2), F.least(F.lit(max_clusters), wanted)).cast("int")
    return max(2, min(max_clusters, titles // fv.TOPIC_POSTS_PER_CLUSTER))


def topic_vectors(
    posts: DataFrame,
    stop_words: Sequence[str] | None = None,
    max_features: int = fv.TOPIC_MAX_FEATURES,
) -> tuple[DataFrame, list[str]] | None:
    """TF-IDF vectors of the non-blank titles and the term of each of their positions.

    None below five titles or without any term. Training and map pass over the vectors many
    times, so they are written once; titles are not joined and split again for each pass.
    """
    if not enough_titles(posts):
        return None
    terms = tokenize_ngrams(filter_nonblank_title(posts), stop_words, clean=None)
    vocabulary = prune_vocabulary(terms, min_df=1, max_df=1.0, max_features=max_features)
    vectors, names = tfidf_vectors(terms, vocabulary)
    return (written(vectors, "topic-vectors"), names) if names else None


def topic_model(
    vectors: DataFrame,
    max_clusters: int = fv.TOPIC_MAX_CLUSTERS,
    starts: int = fv.TOPIC_STARTS,
    seed: int = fv.TOPIC_SEED,
    parallelism: int = 4,
) -> KMeansModel:
    """The best of several k-means starts over ``(post_id, features)``.

    Rows are dealt and ordered by ``post_id`` into a number of partitions that follows
    from their count, so that starts, and with them labels, do not depend on how the data
    is laid out. They are kept on disk for the time of the training; a lost block is computed
    again. A start reads them once and holds them as objects, on disk where memory is short,
    for its many passes; as many starts go side by side as hold a bounded number of rows.
    """
    rows = vectors.count()
    parts = rows // _TRAIN_ROWS + 1
    kept = vectors.select("post_id", "features").repartition(parts, "post_id").sortWithinPartitions("post_id")
    kept = kept.persist(StorageLevel.DISK_ONLY)
    try:
        k = cluster_count_rule(rows, max_clusters)
        # KMeans holds what it is given only if that is not persisted itself. It would else
        # decode every vector in each of its passes.
        features = kept.select("features")

        def train(start: int):
            return KMeans(
                k=k, seed=seed + start, featuresCol="features", predictionCol="cluster_id"
            ).fit(features)

        # The starts are independent jobs over the same kept vectors.
        together = max(1, min(parallelism, starts, _HELD_ROWS // max(1, rows)))
        with ThreadPool(together) as pool:
            models = pool.map(inheritable_thread_target(kept.sparkSession)(train), range(starts))
        return min(models, key=lambda model: model.summary.trainingCost)
    finally:
        kept.unpersist()


def topic_clusters(vectors: DataFrame, **options) -> DataFrame:
    """The vectors with their ``cluster_id``; options are those of ``topic_model``."""
    return topic_model(vectors, **options).transform(vectors)


def cluster_label(cluster: Column) -> Column:
    return F.concat(F.lit("Cluster "), cluster.cast("string"))


def cluster_top_terms(
    weights: DataFrame, labels: DataFrame, n: int = fv.TOPIC_TERMS
) -> DataFrame:
    """``(cluster_id, rank, term, weight)``: terms with the highest mean weight per cluster.

    The mean is over all posts of the cluster, with or without the term. Ranking
    sees one row per cluster and vocabulary term. Weights unfolded from vectors that
    carry their ``cluster_id`` are not joined with the labels again.
    """
    if "cluster_id" not in weights.columns:
        weights = weights.join(labels.select("post_id", "cluster_id"), "post_id")
    sizes = labels.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    sums = (
        weights.filter(F.col("cluster_id").isNotNull())
        .groupBy("cluster_id", "term")
        .agg(F.sum("tfidf").alias("total"))
    )
    means = sums.join(sizes, "cluster_id").withColumn(
        "weight", F.round(F.col("total") / F.col("size"), 9)
    )
    order = Window.partitionBy("cluster_id").orderBy(F.desc("weight"), "term")
    return (
        means.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select("cluster_id", "rank", "term", "weight")
    )


def cluster_profile(labelled: DataFrame) -> DataFrame:
    """Size, mean compound and share of each sentiment label per cluster."""
    shares = [
        F.avg((F.col("sent_label") == name).cast("double")).alias(f"{name}_share")
        for name in fv.SENTIMENT_LABELS
    ]
    return labelled.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"), F.avg("compound").alias("avg_compound"), *shares
    )


def cluster_examples(labelled: DataFrame, n: int = fv.TOPIC_EXAMPLES) -> DataFrame:
    """The first n posts of each cluster in search order, as an array of structs.

    Each task cuts its own rows to n per cluster before the shuffle, so a cluster
    that holds most posts still sends n rows per task.
    """
    similarity = column_or(labelled, "similarity_score", 0.0)
    order = Window.partitionBy("cluster_id").orderBy(F.desc(similarity), "post_id")
    first = labelled.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return first.groupBy("cluster_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", "post_id", "title"))).alias("examples")
    )


def project_2d(vectors: DataFrame) -> DataFrame:
    """The vectors with ``x`` and ``y``, their first two principal components.

    One distributed pass builds the covariance, whose side is the vocabulary (2,000
    terms at most by default) and not the number of posts. Its two leading axes are
    found on the driver; placing a post multiplies its few non-zero entries with them.
    """
    rows = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors.select("features"), "features"))
    axes = _leading_axes(rows.computeCovariance().toArray())
    entries = F.unwrap_udt("features")

    def place(axis) -> Column:
        weight = F.split(F.lit(",".join(map(repr, axis.tolist()))), ",").cast("array<double>")
        products = F.zip_with(
            entries["indices"], entries["values"], lambda at, value: F.get(weight, at) * value
        )
        return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)

    return vectors.withColumns({"x": place(axes[0]), "y": place(axes[1])})


def _leading_axes(covariance: np.ndarray) -> np.ndarray:
    """The two axes of largest variance, each turned so that its largest entry is positive."""
    _, axes = np.linalg.eigh(covariance)
    leading = np.zeros((2, len(covariance)))
    leading[: min(2, len(covariance))] = axes[:, ::-1][:, :2].T
    turn = np.sign([axis[np.argmax(np.abs(axis))] for axis in leading])
    return leading * np.where(turn == 0, 1, turn)[:, None]


def topic_map(points: DataFrame, posts: DataFrame) -> DataFrame:
    """Every post with its place, its cluster and the fields shown on the map."""
    url = F.coalesce(column_or(posts, "url", fv.DEFAULT_URL), F.lit(fv.DEFAULT_URL))
    shown = posts.select("post_id", "title", "subreddit", "score", "sent_label", url.alias("url"))
    return (
        points.select("post_id", "cluster_id", "x", "y")
        .join(shown, "post_id")
        .withColumn("cluster_label", cluster_label(F.col("cluster_id")))
    )


def projection_centroids(points: DataFrame) -> DataFrame:
    """Mean place per cluster label."""
    return points.groupBy("cluster_label").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def cluster_records(
    posts: DataFrame,
    weights: DataFrame,
    labels: DataFrame,
    n_terms: int = fv.TOPIC_TERMS,
) -> DataFrame:
    """One row per cluster: size, top terms, examples, mean compound and shares.

    Expects posts with sentiment; each part is reduced to its clusters before they meet.
    """
    labelled = posts.join(labels, "post_id")
    terms = (
        cluster_top_terms(weights, labels, n_terms)
        .groupBy("cluster_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("ranked"))
        .select("cluster_id", F.col("ranked.term").alias("top_terms"))
    )
    return (
        cluster_profile(labelled)
        .join(terms, "cluster_id", "left")
        .join(cluster_examples(labelled), "cluster_id", "left")
    )
