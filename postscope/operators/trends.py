"""Posting over time. Results have one row per day, week or month, not per post."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postscope import fixed_values as fv
from postscope.functions import dates
from postscope.functions.text import matches_any_case
from postscope.operators.keyword_index import keyword_hits
from postscope.session import literal_rows


def _count_by(posts: DataFrame, *keys: Column) -> DataFrame:
    return posts.groupBy(*keys).agg(F.count(F.lit(1)).alias("posts"))


def posts_by_day(posts: DataFrame) -> DataFrame:
    day = F.to_date("timestamp")
    return (
        _count_by(posts, day.alias("date"))
        .select("date", F.col("date").alias("plot_date"), "posts")
        .orderBy("plot_date")
    )


def posts_by_week(posts: DataFrame) -> DataFrame:
    """Counts per Sunday-start week of a year, placed at the week's Sunday.

    The last week of a year and week 00 of the next share a Sunday but stay two rows.
    """
    day = F.to_date("timestamp")
    return _count_by(
        posts, dates.year_week(day).alias("year_week"), dates.week_start(day).alias("plot_date")
    ).orderBy("plot_date", "year_week")


def posts_by_month(posts: DataFrame) -> DataFrame:
    month = dates.month_start(F.col("timestamp"))
    return (
        _count_by(posts, month.alias("plot_date"))
        .select(dates.year_month(F.col("plot_date")).alias("year_month"), "plot_date", "posts")
        .orderBy("plot_date")
    )


def aggregate_time(posts: DataFrame, granularity: str = "Day") -> DataFrame:
    """Counts by ``Day``, ``Week`` or ``Month``, each with ``plot_date`` and ``posts``."""
    by = {"Day": posts_by_day, "Week": posts_by_week, "Month": posts_by_month}
    if granularity not in by:
        raise ValueError(f"granularity must be one of {', '.join(by)}")
    return by[granularity](posts)


def posts_by_day_subreddit(posts: DataFrame) -> DataFrame:
    named = posts.filter(F.col("subreddit").isNotNull())
    return _count_by(named, F.to_date("timestamp").alias("date"), F.col("subreddit")).orderBy(
        "date", "subreddit"
    )


def _daily(posts: DataFrame) -> DataFrame:
    return _count_by(posts, F.to_date("timestamp").alias("date"))


def peak_day(posts: DataFrame) -> DataFrame:
    """The day with most posts, the earliest of equals."""
    return _daily(posts).orderBy(F.desc("posts"), "date").limit(1)


def peak_and_trough(posts: DataFrame) -> DataFrame:
    """One row: busiest and quietest day with posts; null dates and zeros without posts."""
    return extreme_days(_daily(posts))


def extreme_days(daily: DataFrame) -> DataFrame:
    """The row of ``peak_and_trough`` from ``(date, posts)``."""
    most = F.max(F.struct("posts", (-F.unix_date("date")).alias("day"), "date"))
    least = F.min(F.struct("posts", "date"))
    return (
        daily.agg(most.alias("most"), least.alias("least"))
        .select(
            F.col("most.date").alias("peak_date"),
            F.coalesce("most.posts", F.lit(0)).alias("peak_posts"),
            F.col("least.date").alias("trough_date"),
            F.coalesce("least.posts", F.lit(0)).alias("trough_posts"),
        )
    )


def reindex_weekdays(counts: DataFrame) -> DataFrame:
    """Counts by ``day_of_week`` placed on the fixed week, Monday first.

    A weekday without posts keeps a null count.
    """
    names = [(i, name) for i, name in enumerate(fv.WEEKDAYS)]
    week = literal_rows(counts.sparkSession, names, "day_of_week int, day string")
    return (
        week.join(counts, "day_of_week", "left")
        .select("day_of_week", "day", "posts")
        .orderBy("day_of_week")
    )


def weekday_rhythm(posts: DataFrame) -> DataFrame:
    """Count per weekday name, Monday first."""
    counts = _count_by(posts, F.weekday("timestamp").alias("day_of_week"))
    return reindex_weekdays(counts).select("day", "posts")


def keyword_weekly_trend(posts: DataFrame, keywords: Sequence[str]) -> DataFrame:
    """``(week, keyword, posts)``: titles matching each keyword by week.

    A keyword is a regular expression in any case. Weeks end on Sunday and are
    filled with zeros between the first and the last match of the keyword. Every
    title is read once and tested against all keywords in place; matches are
    counted before the shuffle.
    """
    if not keywords:
        keywords = ["$."]  # matches no title, so that the result is empty with its columns
    title = F.col("title")
    matched = F.array_compact(
        F.array(*[F.when(matches_any_case(title, kw), F.lit(kw)) for kw in dict.fromkeys(keywords)])
    )
    # The outer form keeps Catalyst from testing every title twice, once as a filter.
    hits = posts.select(
        dates.week_end(F.col("timestamp")).alias("week"), F.explode_outer(matched).alias("keyword")
    )
    return _filled_weeks(hits.filter(F.col("keyword").isNotNull()))


def _filled_weeks(hits: DataFrame) -> DataFrame:
    """Counts of ``(week, keyword)`` rows, with zeros between the first and the last week of a keyword."""
    weekly = _count_by(hits, F.col("keyword"), F.col("week"))
    # The weeks of one keyword are few enough for a row: at most some thousands.
    spans = weekly.groupBy("keyword").agg(
        F.sequence(F.min("week"), F.max("week"), F.expr("interval 7 days")).alias("weeks"),
        F.map_from_entries(F.collect_list(F.struct("week", "posts"))).alias("counts"),
    )
    filled = spans.select("keyword", "counts", F.explode("weeks").alias("week"))
    return filled.select(
        "week", "keyword", F.coalesce(F.col("counts")[F.col("week")], F.lit(0)).alias("posts")
    ).orderBy("keyword", "week")


def topic_weekly_trend(posts: DataFrame) -> DataFrame:
    """``(week, cluster_id, posts)`` of posts with a topic, every week of a topic's span.

    Weeks end on Sunday as in ``keyword_weekly_trend``; a week without a post has 0.
    """
    counts = (
        posts.filter(F.col("cluster_id").isNotNull())
        .groupBy("cluster_id", dates.week_end("timestamp").alias("week"))
        .agg(F.count(F.lit(1)).alias("posts"))
    )
    spans = counts.groupBy("cluster_id").agg(F.min("week").alias("a"), F.max("week").alias("b"))
    weeks = spans.select("cluster_id", F.explode(F.sequence("a", "b", F.expr("interval 7 days"))).alias("week"))
    found = weeks.join(counts, ["cluster_id", "week"], "left")
    return found.select("week", "cluster_id", F.coalesce("posts", F.lit(0)).cast("bigint").alias("posts"))


def keyword_index_trend(posts: DataFrame, keywords: DataFrame) -> DataFrame:
    """As ``keyword_weekly_trend`` for a table of any number of keywords in a column ``keyword``."""
    weekly = posts.select("title", dates.week_end(F.col("timestamp")).alias("week"))
    return _filled_weeks(keyword_hits(weekly, keywords).select("week", "keyword"))
