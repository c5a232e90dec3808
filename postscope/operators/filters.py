"""Row filters and column selections over posts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postscope import fixed_values as fv
from postscope.functions.text import matches_any_case, strip


def date_bounds(posts: DataFrame) -> DataFrame:
    """One row: the first and the last day with a post."""
    return posts.agg(
        F.to_date(F.min("timestamp")).alias("min_date"),
        F.to_date(F.max("timestamp")).alias("max_date"),
    )


def filter_date_range(posts: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """Posts from the first moment of ``start`` to the last of ``end``.

    Compares the raw timestamp, so that the scan can skip row groups.
    """
    if start > end:
        raise ValueError("start date must not be after end date")
    first = F.lit(start).cast("timestamp_ntz")
    past = F.lit(end + dt.timedelta(days=1)).cast("timestamp_ntz")
    return posts.filter((F.col("timestamp") >= first) & (F.col("timestamp") < past))


def filter_viral(posts: DataFrame, above: int = fv.VIRAL_SCORE) -> DataFrame:
    return posts.filter(F.col("score") > above)


def filter_title_keyword(posts: DataFrame, pattern: str) -> DataFrame:
    """Posts whose title holds the pattern, a regular expression, in any case."""
    return posts.filter(F.coalesce(matches_any_case(F.col("title"), pattern), F.lit(False)))


def filter_nonblank_title(posts: DataFrame) -> DataFrame:
    """Posts whose title has more than white space."""
    return posts.filter(strip(F.col("title")) != "")


def enough_titles(posts: DataFrame, least: int = fv.TOPIC_MIN_TITLES) -> bool:
    """Whether at least that many posts have a title; stops counting there."""
    return filter_nonblank_title(posts).limit(least).count() >= least


def project_result_table(posts: DataFrame) -> DataFrame:
    """The seven columns of a result list, sentiment as display text."""
    label = F.col("sent_label")
    shown = F.lit(None).cast("string")
    for name, text in fv.SENTIMENT_DISPLAY.items():
        shown = F.when(label == name, text).otherwise(shown)
    return posts.select(
        "timestamp", "subreddit", "title", "score", "comments", shown.alias("sent_label"), "url"
    )


def lookup_post(posts: DataFrame, post_id) -> DataFrame:
    return posts.filter(F.col("post_id") == post_id).select("post_id", "title", "url")
