"""Fact tables and prompt texts for a written briefing.

Only tables and texts are made here; sending them to a text generator is left to
the caller. One-row facts are combined as scalar subqueries, never by a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postscope import fixed_values as fv
from postscope.functions.links import encyclopedia_url, news_search_url, parsed_day
from postscope.operators.ingest import column_or
from postscope.operators.rankings import (
    exact_percentiles,
    percentiles_of_counts,
    subreddit_counts,
    viral_post,
)
from postscope.operators.trends import extreme_days


def _row(frame: DataFrame) -> Column:
    """A one-row frame as a struct column; null if it has no row."""
    return frame.select(F.struct("*")).scalar()


def _search_order(posts: DataFrame) -> list[Column]:
    return [F.desc(column_or(posts, "similarity_score", 0.0)), F.col("post_id").asc()]


def _in_order(ranked: DataFrame, *values: str) -> Column:
    """The few rows of a ranked frame as an array in rank order."""
    collected = F.array_sort(F.collect_list(F.struct("at", *values)))
    return ranked.agg(collected.alias("rows")).scalar()


def briefing_facts(posts: DataFrame) -> DataFrame:
    """One row: total, first and last day, score statistics, extremes, top communities.

    Two passes over the posts: one aggregate, and one set of counts by day, by community
    and by score, which the three parts below it share.
    """
    score = F.col("score")
    integral = isinstance(posts.schema["score"].dataType, T.IntegralType)
    span = posts.agg(
        F.count(F.lit(1)).alias("total"),
        F.to_date(F.min("timestamp")).alias("start_date"),
        F.to_date(F.max("timestamp")).alias("end_date"),
        F.avg(score).alias("avg_score"),
        F.max(score).alias("max_score"),
        F.min(score).alias("min_score"),
        F.stddev_samp(score).alias("score_std"),
    )
    keys = posts.select(F.to_date("timestamp").alias("date"), "subreddit", "score")
    counts = keys.groupingSets([["date"], ["subreddit"], ["score"]], "date", "subreddit", "score").agg(
        F.grouping_id().alias("level"), F.count(F.lit(1)).alias("posts")
    )
    by_day, by_community, by_score = (counts.filter(F.col("level") == level) for level in (3, 5, 6))
    top = (
        by_community.filter(F.col("subreddit").isNotNull())
        .orderBy(F.desc("posts"), "subreddit")
        .limit(fv.BRIEFING_SUBREDDITS)
        .select(F.struct((-F.col("posts")).alias("p"), "subreddit").alias("at"), "subreddit")
    )
    shares = {"median_score": 0.5, "p90_score": 0.9}
    if integral:
        by_value = by_score.filter(score.isNotNull()).select(
            score.cast("bigint").alias("value"), F.col("posts").alias("n")
        )
        ranks = percentiles_of_counts(by_value, shares)
    else:
        ranks = exact_percentiles(posts, "score", shares)
    names = ["avg_score", "max_score", "min_score", "median_score", "p90_score", "score_std"]
    return (
        span.select(
            "*",
            _row(ranks).alias("ranks"),
            _row(extreme_days(by_day.select("date", "posts"))).alias("days"),
            _in_order(top, "subreddit").alias("top"),
        )
        .select("*", "ranks.*")
        .select(
            "total",
            "start_date",
            "end_date",
            *[F.when(F.col("total") == 0, 0).otherwise(F.col(name)).alias(name) for name in names],
            "days.*",
            F.col("top.subreddit").alias("top_subreddits"),
        )
    )


def suggestion_context(posts: DataFrame) -> DataFrame:
    """One row: the first titles and the first distinct communities in search order.

    A community's place is that of its best post, found by one aggregate.
    """
    similarity = column_or(posts, "similarity_score", 0.0)
    place = F.struct((-similarity).alias("s"), F.col("post_id").alias("p"))
    titles = (
        posts.select(place.alias("at"), "title")
        .orderBy("at")
        .limit(fv.SUGGESTION_TITLES)
    )
    communities = (
        posts.groupBy("subreddit")
        .agg(F.min(place).alias("at"))
        .orderBy("at")
        .limit(fv.SUGGESTION_SUBREDDITS)
    )
    rows = titles.agg(F.array_sort(F.collect_list(F.struct("at", "title"))).alias("titles"))
    return rows.select(
        F.col("titles.title").alias("titles"),
        _in_order(communities, "subreddit").alias("c"),
    ).select("titles", F.col("c.subreddit").alias("subreddits"))


def chat_rows(posts: DataFrame, n: int = fv.CHAT_ROWS) -> DataFrame:
    """The first n posts in search order, four columns and their rank key."""
    return posts.orderBy(*_search_order(posts)).limit(n).select(
        "post_id",
        (-column_or(posts, "similarity_score", 0.0)).alias("distance"),
        "title",
        "subreddit",
        "score",
        "sent_label",
    )


def chat_context(posts: DataFrame) -> DataFrame:
    """One row: total, viral post, top community, and the first rows as an array."""
    viral = viral_post(posts).select("title", "score")
    top = subreddit_counts(posts, 1).select("subreddit")
    rows = chat_rows(posts).select(
        F.struct("distance", "post_id").alias("at"), "title", "subreddit", "score", "sent_label"
    )
    return posts.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        _row(viral).alias("viral"),
        top.scalar().alias("top_subreddit"),
        _in_order(rows, "title", "subreddit", "score", "sent_label").alias("first_rows"),
    ).select(
        "total",
        F.col("viral.title").alias("viral_title"),
        F.col("viral.score").alias("viral_score"),
        "top_subreddit",
        F.transform("first_rows", lambda r: r.dropFields("at")).alias("first_rows"),
    )


def _number(column: str) -> Column:
    return F.coalesce(F.format_string("%.2f", F.round(F.col(column).cast("double"), 2)), F.lit("n/a"))


def _plain(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit("n/a"))


def _listed(column: str) -> Column:
    return F.concat_ws(", ", F.col(column))


def render_briefing_prompt(facts: DataFrame, query: str) -> DataFrame:
    """The briefing request as one text column."""
    lines = [
        F.concat(F.lit("Write an analyst briefing about posts that match: "), F.lit(query)),
        F.concat(
            F.lit("Posts: "), _plain("total"),
            F.lit(", from "), _plain("start_date"), F.lit(" to "), _plain("end_date"),
        ),
        F.concat(
            F.lit("Score mean "), _number("avg_score"),
            F.lit(", median "), _number("median_score"),
            F.lit(", 90th percentile "), _number("p90_score"),
            F.lit(", deviation "), _number("score_std"),
            F.lit(", from "), _plain("min_score"), F.lit(" to "), _plain("max_score"),
        ),
        F.concat(
            F.lit("Busiest day "), _plain("peak_date"), F.lit(" with "), _plain("peak_posts"),
            F.lit(" posts, quietest day "), _plain("trough_date"),
            F.lit(" with "), _plain("trough_posts"),
        ),
        F.concat(F.lit("Leading communities: "), _listed("top_subreddits")),
        F.lit(
            "Cover strength of the signal, communities, engagement, timing and an outlook. "
            "Use only these figures."
        ),
    ]
    return facts.select(F.concat_ws("\n", *lines).alias("prompt"))


def render_suggestion_prompt(context: DataFrame, query: str) -> DataFrame:
    """The request for follow-up questions as one text column."""
    lines = [
        F.concat(F.lit("Posts were searched for: "), F.lit(query)),
        F.concat(F.lit("Communities: "), _listed("subreddits")),
        F.concat(F.lit("Titles: "), F.concat_ws(" / ", "titles")),
        F.lit(
            "Give three short analytical questions about these posts, "
            "separated by a vertical bar and nothing else."
        ),
    ]
    return context.select(F.concat_ws("\n", *lines).alias("prompt"))


def render_chat_prompt(context: DataFrame, question: str) -> DataFrame:
    """The analyst's question with its facts as one text column."""
    stats = F.when(F.col("total") == 0, F.lit(fv.NO_DATA)).otherwise(
        F.concat(
            F.lit("Top post: "), _plain("viral_title"),
            F.lit(" (score "), _plain("viral_score"), F.lit("). Leading community: "),
            _plain("top_subreddit"), F.lit(". Posts: "), _plain("total"), F.lit("."),
        )
    )
    snippet = F.concat_ws(
        "\n",
        F.transform(
            "first_rows",
            lambda r: F.concat_ws(
                " | ", r["title"], r["subreddit"], r["score"].cast("string"), r["sent_label"]
            ),
        ),
    )
    lines = [
        F.lit("Answer from these facts and rows only."),
        stats,
        snippet,
        F.concat(F.lit("Question: "), F.lit(question)),
    ]
    return context.select(F.concat_ws("\n", *lines).alias("prompt"))


def parse_suggestions(
    replies: DataFrame, reply: str = "reply", has_posts: str | None = None
) -> DataFrame:
    """Add ``questions``: the reply split at vertical bars, trimmed, the first three.

    A null reply gives the questions for a failed request; where ``has_posts``
    names a column that is false, the questions for an empty result.
    """

    def fixed(questions) -> Column:
        return F.array(*[F.lit(question) for question in questions])

    parts = F.slice(
        F.transform(
            F.split(F.col(reply), "[|]"), lambda part: F.btrim(part, F.lit(" \t\n\r\f\x0b"))
        ),
        1,
        fv.SUGGESTIONS,
    )
    questions = F.coalesce(parts, fixed(fv.QUESTIONS_WHEN_FAILED))
    if has_posts:
        questions = F.when(F.col(has_posts), questions).otherwise(fixed(fv.QUESTIONS_WHEN_EMPTY))
    return replies.withColumn("questions", questions)


def context_links(peaks: DataFrame) -> DataFrame:
    """Add the two context links to rows of ``query`` and ``peak_date``."""
    day = parsed_day(F.col("peak_date"))
    return peaks.withColumns(
        {
            "news_url": news_search_url(F.col("query"), day),
            "encyclopedia_url": encyclopedia_url(day),
        }
    )
