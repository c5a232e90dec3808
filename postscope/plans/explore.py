"""Explore a collection of posts: overview, topic search, and tables about the matches."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postscope import fixed_values as fv
from postscope.operators import (
    briefing,
    filters,
    keywords,
    network,
    rankings,
    search,
    sentiment,
    topics,
    trends,
)


def overview(posts: DataFrame, start: dt.date, end: dt.date) -> dict[str, DataFrame]:
    """Totals, daily counts, peak, weekday rhythm and leading communities of a date range."""
    ranged = filters.filter_date_range(posts, start, end)
    return {
        "totals": rankings.dataset_overview(ranged),
        "daily": trends.posts_by_day(ranged),
        "peak": trends.peak_day(ranged),
        "weekdays": trends.weekday_rhythm(ranged),
        "subreddits": rankings.top_subreddits(ranged),
    }


def match_topic(
    posts: DataFrame,
    vectors: DataFrame,
    query_vector: Column | Sequence[float],
    lexicon: DataFrame | None,
    start: dt.date,
    end: dt.date,
    k: int = fv.DEFAULT_TOP_K,
    modifiers: DataFrame | None = None,
) -> DataFrame:
    """The best k posts of a date range with their sentiment, kept for the tables below.

    The matches are searched once; unpersist them when the tables are done. Blocks
    that get lost are computed again.
    """
    best = search.search_filtered(posts, vectors, query_vector, start, end, k)
    return sentiment.attach_sentiment(best, lexicon, modifiers).persist(
        StorageLevel.MEMORY_AND_DISK
    )


def trend_tables(
    matched: DataFrame,
    selected: Sequence[str] | None = None,
    stop_words: Sequence[str] | None = None,
) -> dict[str, DataFrame]:
    """Counts by day and community, keywords, and the weekly trend of the selected keywords.

    Without a selection the three heaviest keywords are taken.
    """
    best = keywords.top_keywords(matched, 50, stop_words)
    if selected is None:
        selected = [row.term for row in best.limit(3).collect()]
    return {
        "daily": trends.posts_by_day_subreddit(matched),
        "keywords": best,
        "keyword_trend": trends.keyword_weekly_trend(matched, selected),
    }


def topic_tables(
    matched: DataFrame, stop_words: Sequence[str] | None = None
) -> dict[str, DataFrame]:
    """Clusters with profile, map, centroids and sentiment shares; empty below five titles."""
    used = filters.filter_nonblank_title(matched)
    found = topics.topic_vectors(used, stop_words)
    if found is None:
        return {}
    vectors, names = found
    # Clusters and places are added beside the vectors, so neither is joined to them.
    clustered = topics.topic_clusters(vectors)
    labels = clustered.select("post_id", "cluster_id")
    weights = keywords.unfold_weights(clustered, names)
    points = topics.topic_map(topics.project_2d(clustered), used)
    return {
        "clusters": topics.cluster_records(used, weights, labels),
        "map": points,
        "centroids": topics.projection_centroids(points),
        "sentiment": sentiment.sentiment_share_by_cluster(points),
    }


def source_tables(matched: DataFrame) -> dict[str, DataFrame]:
    """Engagement points, content composition, media impact and the image gallery."""
    return {
        "controversy": rankings.controversy_points(matched),
        "composition": rankings.content_composition(matched),
        "media_impact": rankings.media_impact(matched),
        "images": rankings.top_images(matched),
    }


def network_tables(matched: DataFrame) -> dict[str, DataFrame]:
    edges = network.network_edges(matched)
    return {
        "edges": edges,
        "nodes": network.network_nodes(edges),
        "counts": network.network_counts(edges),
    }


def briefing_tables(matched: DataFrame, query: str) -> dict[str, DataFrame]:
    """Facts, the request for a written briefing, and context links for the peak day."""
    facts = briefing.briefing_facts(matched)
    peaks = facts.select(
        F.lit(query).alias("query"), F.col("peak_date").cast("string").alias("peak_date")
    )
    return {
        "facts": facts,
        "briefing_prompt": briefing.render_briefing_prompt(facts, query),
        "suggestion_prompt": briefing.render_suggestion_prompt(
            briefing.suggestion_context(matched), query
        ),
        "context_links": briefing.context_links(peaks),
    }


def analyst_question(matched: DataFrame, question: str) -> DataFrame:
    """The question with its facts and first rows as one prompt; works without matches too."""
    return briefing.render_chat_prompt(briefing.chat_context(matched), question)
