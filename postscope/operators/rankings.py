"""Totals, rankings and engagement breakdowns."""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postscope import fixed_values as fv
from postscope.functions.classify import (
    category_of,
    media_type_of,
    normal_domain,
    normal_link,
)
from postscope.operators.ingest import column_or
from postscope.session import literal_rows

# Scores are counted in buckets of 2**10 neighbouring values to find a rank.
_RANK_BITS = 10
_RANGE_BITS = 20
# A fraction's rank is found by so many of its 64 bits at a time.
_DIGIT_BITS = 16


def dataset_overview(posts: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: posts, distinct communities, distinct authors, viral posts.

    ``approximate`` counts distinct values with sketches: a single small row per
    task is shuffled in place of the values.
    """
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    return posts.agg(
        F.count(F.lit(1)).alias("total_posts"),
        distinct("subreddit").alias("active_subreddits"),
        distinct("author").alias("active_authors"),
        F.count_if(F.col("score") > fv.VIRAL_SCORE).alias("viral_posts"),
    )


def subreddit_counts(posts: DataFrame, n: int | None = None) -> DataFrame:
    """Posts per community, most first; all of them or the first n."""
    counts = (
        posts.filter(F.col("subreddit").isNotNull())
        .groupBy("subreddit")
        .agg(F.count(F.lit(1)).alias("posts"))
        .orderBy(F.desc("posts"), "subreddit")
    )
    return counts if n is None else counts.limit(n)


def top_subreddits(posts: DataFrame, n: int = fv.TOP_SUBREDDITS) -> DataFrame:
    return subreddit_counts(posts, n)


def community_share(posts: DataFrame) -> DataFrame:
    """Posts per community with its share of all posts that name one."""
    total = posts.agg(F.count("subreddit")).scalar()
    counts = subreddit_counts(posts)
    return counts.withColumn("share", F.col("posts") / total).orderBy(
        F.desc("posts"), "subreddit"
    )


def exact_percentiles(posts: DataFrame, column: str, points: dict[str, float]) -> DataFrame:
    """One row with linearly interpolated percentiles of a numeric column.

    Equal integers are counted first and ranked as counts; fractions are selected digit by digit.
    Neither way gathers the distinct values in one task, as the built-in exact percentile does.
    """
    if not isinstance(posts.schema[column].dataType, T.IntegralType):
        return fractional_percentiles(posts, column, points)
    counts = (
        posts.filter(F.col(column).isNotNull())
        .groupBy(F.col(column).cast("bigint").alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return percentiles_of_counts(counts, points)


def _ordered_bits(values: Column) -> Column:
    """A double's 64 bits as a whole number that is ordered as doubles are; NaN above all, as in Spark."""

    @F.arrow_udf("bigint")
    def ordered(batch: pa.Array) -> pa.Array:
        bits = batch.fill_null(0.0).to_numpy(zero_copy_only=False).view(np.int64)
        bits = np.where(np.isnan(bits.view(np.float64)), np.int64(0x7FF8000000000000), bits)
        keys = np.where(bits < 0, ~bits ^ np.int64(-(1 << 63)), bits)
        return pa.array(keys, mask=batch.is_null().to_numpy(zero_copy_only=False))

    return ordered(values)


def _double_of(ordered: int) -> float:
    bits = ordered if ordered >= 0 else ~(ordered ^ -(1 << 63))
    return struct.unpack("<d", struct.pack("<q", bits))[0]


def fractional_percentiles(posts: DataFrame, column: str, points: dict[str, float]) -> DataFrame:
    """One row of percentiles of a column of fractions, by radix selection; it is worked out now.

    A value is four digits of 16 bits. A pass counts one digit of the values that share their
    leading digits with a wanted rank, all of them at first, and tells which digit each rank
    has next; so a pass brings back 65,536 counts per wanted rank at most, whatever the table holds,
    and after four the values are known. Null without a value; a decimal counts as a double.
    """
    keys = posts.select(_ordered_bits(F.col(column).cast("double")).alias("key")).filter(F.col("key").isNotNull())
    ranks: dict[tuple[str, bool], tuple[int, int]] = {}  # (point, upper): leading digits, rank among their values
    total = 0
    for shift in range(64 - _DIGIT_BITS, -1, -_DIGIT_BITS):
        rows = keys
        if ranks:
            rows = keys.filter(F.shiftright("key", shift + _DIGIT_BITS).isin(sorted({lead for lead, _ in ranks.values()})))
        cells = sorted(tuple(r) for r in rows.groupBy(F.shiftright("key", shift).alias("cell")).count().collect())
        if not ranks:
            total = sum(n for _, n in cells)
            if not total:
                return literal_rows(posts.sparkSession, [tuple([None] * len(points))], ", ".join(f"{p} double" for p in points))
            for name, share in points.items():
                spot = share * (total - 1)
                ranks |= {(name, False): (0, math.floor(spot)), (name, True): (0, math.ceil(spot))}
        whole = shift + _DIGIT_BITS == 64
        for point, (lead, rank) in ranks.items():
            for cell, n in cells:
                if not whole and cell >> _DIGIT_BITS != lead:
                    continue
                if rank < n:
                    ranks[point] = (cell, rank)
                    break
                rank -= n
    found = []
    for name, share in points.items():
        low, high = (_double_of(ranks[name, upper][0]) for upper in (False, True))
        spot = share * (total - 1)
        apart = low != high and not (math.isnan(low) or math.isnan(high))
        found.append((math.ceil(spot) - spot) * low + (spot - math.floor(spot)) * high if apart else high)
    cells_of = [F.lit(value).alias(name) for name, value in zip(points, found)]
    return posts.sparkSession.range(1).select(*cells_of)


def percentiles_of_counts(counts: DataFrame, points: dict[str, float]) -> DataFrame:
    """One row of percentiles from ``(value, n)``, one row per distinct integer.

    Buckets of 1,024 values and ranges of 2 ** 20 give each value its rank, and only the
    values at the wanted ranks go on. The widest single step is the running total over
    ranges.
    """
    counts = (
        counts.withColumn("bucket", F.shiftright("value", _RANK_BITS))
        # Said once for both uses below, so that they share one scan and shuffle.
        .filter(F.col("bucket").isNotNull())
    )
    buckets = counts.groupBy("bucket").agg(F.sum("n").alias("in_bucket"))
    buckets = buckets.withColumn("range", F.shiftright("bucket", _RANGE_BITS - _RANK_BITS))
    ranges = buckets.groupBy("range").agg(F.sum("in_bucket").alias("in_range"))
    ranges = ranges.select(
        "range",
        (F.sum("in_range").over(Window.orderBy("range")) - F.col("in_range")).alias("before_range"),
        F.sum("in_range").over(Window.partitionBy()).alias("total"),
    )
    before = F.sum("in_bucket").over(Window.partitionBy("range").orderBy("bucket")) - F.col("in_bucket")
    placed = buckets.withColumn("before", before).join(ranges, "range")
    placed = placed.select("bucket", (F.col("before_range") + F.col("before")).alias("before_bucket"), "total")
    within = Window.partitionBy("bucket").orderBy("value")
    ranked = counts.join(placed, "bucket").select(
        "value",
        "total",
        "n",
        (F.col("before_bucket") + F.sum("n").over(within) - F.col("n")).alias("first"),
    )

    def at(rank: Column) -> Column:
        holds = (F.col("first") <= rank) & (rank < F.col("first") + F.col("n"))
        return F.max(F.when(holds, F.col("value")))

    picked, results = [], []
    for name, share in points.items():
        position = F.lit(share) * (F.col("total") - 1)
        picked += [
            at(F.floor(position)).alias(f"{name}_low"),
            at(F.ceil(position)).alias(f"{name}_high"),
        ]
        spot = F.lit(share) * (F.col("total") - 1)
        low, high = F.col(f"{name}_low"), F.col(f"{name}_high")
        results.append((low + (high - low) * (spot - F.floor(spot))).alias(name))
    return ranked.agg(F.max("total").alias("total"), *picked).select(*results)


def score_stats(posts: DataFrame, approximate: bool = False) -> DataFrame:
    """One row: mean, extremes, median, 90th percentile and sample deviation of the score.

    Zeros without posts; the deviation of a single post is null.
    """
    score = F.col("score")
    plain = posts.agg(
        F.count(F.lit(1)).alias("total"),
        F.avg(score).alias("avg_score"),
        F.max(score).alias("max_score"),
        F.min(score).alias("min_score"),
        F.stddev_samp(score).alias("score_std"),
        *(
            [
                F.percentile_approx(score, 0.5, 10_000).cast("double").alias("median_score"),
                F.percentile_approx(score, 0.9, 10_000).cast("double").alias("p90_score"),
            ]
            if approximate
            else []
        ),
    )
    if not approximate:
        ranks = exact_percentiles(posts, "score", {"median_score": 0.5, "p90_score": 0.9})
        plain = plain.select("*", ranks.select(F.struct("*")).scalar().alias("ranks")).select(
            *plain.columns, "ranks.*"
        )
    empty = F.col("total") == 0

    def zero_when_empty(name: str) -> Column:
        return F.when(empty, 0).otherwise(F.col(name)).alias(name)

    names = ["avg_score", "max_score", "min_score", "median_score", "p90_score", "score_std"]
    return plain.select(*[zero_when_empty(name) for name in names])


def with_media_type(posts: DataFrame) -> DataFrame:
    # The lower-cased link is a column of its own, made once and not once per rule.
    lowered = posts.withColumn("_link", normal_link(F.col("url")))
    return lowered.withColumn("media_type", media_type_of(F.col("_link"))).drop("_link")


def media_impact(posts: DataFrame) -> DataFrame:
    """Mean score per media type."""
    return (
        with_media_type(posts)
        .groupBy("media_type")
        .agg(F.avg("score").alias("score"))
        .orderBy("media_type")
    )


def top_images(posts: DataFrame, n: int = fv.TOP_IMAGES) -> DataFrame:
    images = with_media_type(posts).filter(F.col("media_type") == fv.MEDIA_MARKS[0][0])
    return images.orderBy(F.desc("score"), "post_id").limit(n)


def with_category(posts: DataFrame) -> DataFrame:
    domain = normal_domain(column_or(posts, "domain", fv.DEFAULT_DOMAIN))
    lowered = posts.withColumn("_domain", domain)
    return lowered.withColumn("category", category_of(F.col("_domain"))).drop("_domain")


def content_composition(posts: DataFrame) -> DataFrame:
    """Posts, score size and comment size by community and category, and by community.

    Sizes are at least one per post. The posts are reduced to their (community,
    category) pairs first; the upper level, category null, sums those pairs.
    """
    pairs = (
        with_category(posts)
        .groupBy("subreddit", "category")
        .agg(
            F.count(F.lit(1)).alias("posts"),
            F.sum(F.greatest(F.col("score"), F.lit(0)) + 1).alias("score_size"),
            F.sum(F.greatest(F.col("comments"), F.lit(0)) + 1).alias("comments_size"),
        )
    )
    keys = [F.col("subreddit"), F.col("category")]
    return pairs.groupingSets([keys, keys[:1]], *keys).agg(
        F.grouping("category").cast("int").alias("level"),
        F.sum("posts").alias("posts"),
        F.sum("score_size").alias("score_size"),
        F.sum("comments_size").alias("comments_size"),
    )


def viral_post(posts: DataFrame) -> DataFrame:
    """The post with the highest score; equals go by search order, then id."""
    order = [F.desc("score")]
    if "similarity_score" in posts.columns:
        order.append(F.desc("similarity_score"))
    return posts.orderBy(*order, "post_id").limit(1)


def controversy_points(posts: DataFrame) -> DataFrame:
    """Comments against score on log axes, with the approval clamped to the colour range."""
    ratio = F.coalesce(
        column_or(posts, "upvote_ratio", fv.DEFAULT_UPVOTE_RATIO), F.lit(fv.DEFAULT_UPVOTE_RATIO)
    )
    low, high = fv.UPVOTE_RANGE

    def log_axis(name: str) -> Column:
        return F.when(F.col(name) > 0, F.log10(F.col(name)))

    return posts.select(
        "post_id",
        "title",
        "subreddit",
        "comments",
        "score",
        ratio.alias("upvote_ratio"),
        log_axis("comments").alias("log_comments"),
        log_axis("score").alias("log_score"),
        F.least(F.greatest(ratio, F.lit(low)), F.lit(high)).alias("colour"),
    )
