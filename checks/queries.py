"""One query per operator over the given tables, named as the operator."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import fixture as fx
from postscope.functions import text
from postscope.operators import (
    ball_search,
    briefing,
    co_sharing,
    embedding_jobs,
    filters,
    ingest,
    keywords,
    network,
    rankings,
    reports,
    search,
    sentiment,
    topics,
    trends,
)
from postscope.scratch import scratch_path
from postscope.session import literal_rows
from postscope.sources import posts as post_files
from postscope.sources import vectors as vector_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def rounded(frame: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return frame.withColumns({c: F.round(F.col(c).cast("double"), digits) for c in columns})


def joined(column: str, separator: str = "|") -> Column:
    return F.array_join(F.col(column), separator).alias(column)


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return search.vector_of(fx.vectors(spark, sf_dir), fx.QUERY_POST)


def matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All posts that have a vector, with their similarity to the query vector."""
    scores = search.similarity_scores(
        fx.posts(spark, sf_dir), fx.vectors(spark, sf_dir), query_vector(spark, sf_dir)
    )
    return fx.posts(spark, sf_dir, scores)


def scored(posts: DataFrame) -> DataFrame:
    spark = posts.sparkSession
    return sentiment.attach_sentiment(posts, fx.lexicon(spark), fx.modifiers(spark))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched posts with sentiment and cluster."""
    posts = scored(matched(spark, sf_dir))
    return posts.join(fx.labels(spark, sf_dir), "post_id").withColumn(
        "cluster_label", topics.cluster_label(F.col("cluster_id"))
    )


# --- ingest --------------------------------------------------------------------


def _epoch(time: Column) -> Column:
    passed = time - F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return passed.cast("interval second").cast("decimal(18,6)")


def _raw_records(posts: DataFrame) -> DataFrame:
    """Posts as records: epoch seconds as text, some of them bad or missing."""
    number = _epoch(F.col("timestamp")).cast("string")
    seconds = (
        F.when(F.col("post_id") % 7 == 3, "not a time")
        .when(F.col("post_id") % 11 == 5, F.lit(None))
        .otherwise(number)
    )
    return posts.withColumn("created_utc", seconds).drop("timestamp")


@query
def read_posts(spark, sf_dir):
    path = scratch_path(spark, "posts-json")
    source = fx.posts(spark, sf_dir).withColumnRenamed("timestamp", "created_at")
    post_files.write_posts_json(source, path)
    records = post_files.read_posts(spark, path, source.schema)
    good, _ = post_files.split_corrupt(records)
    return good.withColumn("selftext", F.md5("selftext"))


@query
def ingest_records(spark, sf_dir):
    """Nested records with times as texts of all kinds, bad ones, missing ones and corrupt lines."""
    posts = fx.posts(spark, sf_dir)
    kind = F.col("post_id") % 10
    second = F.floor(_epoch(F.col("timestamp"))).cast("bigint")
    time = (
        F.when(kind < 2, second.cast("string"))
        .when(kind == 2, (second * 1000).cast("string"))
        .when(kind == 3, (second * 1_000_000).cast("string"))
        .when(kind == 4, (second * 1_000_000_000).cast("string"))
        .when(kind < 7, F.date_format(F.date_trunc("second", "timestamp"), "yyyy-MM-dd'T'HH:mm:ss"))
        .when(kind == 7, "not a time")
    )
    records = posts.select(
        F.struct("post_id", time.alias("created_at"), "selftext", "subreddit", "comments").alias("data"),
        F.when(kind == 9, F.lit('{"data": {"post')).alias(post_files.CORRUPT_COLUMN),
    )
    found = ingest.ingest(records, corrupt="drop")
    return found.select(
        "post_id", "timestamp", "year_month", "hour", F.md5("text_col").alias("text_md5"), "subreddit", "comments"
    )


QUERIES["ingest"] = QUERIES.pop("ingest_records")


@query
def flatten_struct(spark, sf_dir):
    posts = fx.posts(spark, sf_dir)
    nested = posts.select(
        F.lit("t3").alias("kind"),
        F.struct(
            "post_id", "title", F.struct("score", "comments").alias("counts")
        ).alias("data"),
    )
    flat = ingest.flatten_struct(nested)
    return flat.toDF(*[name.replace(".", "_") for name in flat.columns])


@query
def resolve_timestamp_column(spark, sf_dir):
    records = _raw_records(fx.posts(spark, sf_dir)).withColumn("created_at", F.lit("2020-01-01"))
    name = ingest.resolve_timestamp_column(records)
    return records.select(
        "post_id", F.lit(name).alias("column_name"), F.col(name).isNotNull().alias("present")
    )


@query
def parse_timestamp(spark, sf_dir):
    records = ingest.parse_timestamp(_raw_records(fx.posts(spark, sf_dir)), "created_utc")
    return records.select("post_id", "created_utc")


@query
def drop_undated(spark, sf_dir):
    records = ingest.parse_timestamp(_raw_records(fx.posts(spark, sf_dir)), "created_utc")
    return ingest.drop_undated(records, "created_utc").select("post_id", "timestamp")


@query
def choose_text_column(spark, sf_dir):
    body = F.when(F.col("post_id") % 5 != 2, F.col("selftext"))
    chosen = ingest.choose_text_column(fx.posts(spark, sf_dir).withColumn("selftext", body))
    return chosen.select(
        "post_id", F.length("text_col").alias("n_chars"), F.md5("text_col").alias("text_md5")
    )


@query
def derive_calendar(spark, sf_dir):
    return ingest.derive_calendar(fx.posts(spark, sf_dir)).select(
        "post_id", "date", "year_week", "year_month", "day_of_week", "hour"
    )


@query
def fill_schema_defaults(spark, sf_dir):
    records = (
        ingest.choose_text_column(fx.posts(spark, sf_dir))
        .drop("subreddit", "score", "title")
        .withColumnRenamed("comments", "num_comments")
    )
    return ingest.fill_schema_defaults(records).select(
        "post_id", "subreddit", "score", "comments", "title"
    )


@query
def load_embeddings(spark, sf_dir):
    path = scratch_path(spark, "vectors")
    pairs = search.align_embeddings(fx.posts(spark, sf_dir), fx.vectors(spark, sf_dir))
    pairs.select("post_id", "embedding").write.parquet(path)
    loaded = vector_files.load_embeddings(spark, path, pairs)
    return loaded.select("post_id", F.size("embedding").alias("dims"))


@query
def vector_mismatches(spark, sf_dir):
    return vector_files.vector_mismatches(fx.posts(spark, sf_dir), fx.vectors(spark, sf_dir))


def _prepared(spark, sf_dir, *limit):
    """Some texts get white space of all kinds around them, some have nothing else."""
    kind = F.col("post_id") % 50
    text = F.when(kind == 7, F.concat(F.lit("\r\n\u00a0\x0b"), "selftext", F.lit("\u2003\x1f\r"))).when(
        kind == 8, "\r\t \u3000\r"
    )
    posts = fx.posts(spark, sf_dir).withColumn("selftext", text.otherwise(F.col("selftext")))
    return embedding_jobs.prepare_embedding_text(ingest.choose_text_column(posts), *limit)


@query
def prepare_embedding_text_cut(spark, sf_dir):
    return _prepared(spark, sf_dir, 200).select("post_id", "n_tokens", F.md5("text").alias("text_md5"))


@query
def prepare_embedding_text(spark, sf_dir):
    return _prepared(spark, sf_dir).select("post_id", "n_tokens", F.md5("text").alias("text_md5"))


@query
def token_budget_batches(spark, sf_dir):
    return embedding_jobs.token_budget_batches(_prepared(spark, sf_dir))


@query
def write_embeddings(spark, sf_dir):
    path = scratch_path(spark, "vectors")
    pairs = search.align_embeddings(fx.posts(spark, sf_dir), fx.vectors(spark, sf_dir))
    vector_files.write_embeddings(pairs.select("post_id", "embedding"), path, pairs)
    return spark.read.parquet(path).select(
        "post_id",
        F.size("embedding").alias("dims"),
        F.round(
            F.aggregate("embedding", F.lit(0.0), lambda total, x: total + x.cast("double")), 6
        ).alias("total"),
    )


# --- filters -------------------------------------------------------------------


@query
def date_bounds(spark, sf_dir):
    return filters.date_bounds(fx.posts(spark, sf_dir))


@query
def filter_date_range(spark, sf_dir):
    posts = filters.filter_date_range(fx.posts(spark, sf_dir), fx.START, fx.END)
    return posts.select("post_id", "timestamp", "author", "subreddit")


@query
def filter_viral(spark, sf_dir):
    return filters.filter_viral(fx.posts(spark, sf_dir)).select("post_id", "score")


@query
def filter_title_keyword(spark, sf_dir):
    posts = filters.filter_title_keyword(fx.posts(spark, sf_dir), fx.TITLE_PATTERN)
    return posts.select("post_id", "title")


@query
def filter_nonblank_title(spark, sf_dir):
    blanked = fx.posts(spark, sf_dir).withColumn(
        "title",
        F.when(F.col("post_id") % 3 == 1, "   ")
        .when(F.col("post_id") % 9 == 2, "\t\r\n\u00a0\u2003\x1c")
        .otherwise(F.col("title")),
    )
    return filters.filter_nonblank_title(blanked).select("post_id", "title")


@query
def project_result_table(spark, sf_dir):
    return filters.project_result_table(scored(fx.posts(spark, sf_dir)))


@query
def lookup_post(spark, sf_dir):
    return filters.lookup_post(fx.posts(spark, sf_dir), fx.LOOKUP_POST)


# --- joins and search ----------------------------------------------------------


@query
def align_embeddings(spark, sf_dir):
    pairs = search.align_embeddings(fx.posts(spark, sf_dir), fx.vectors(spark, sf_dir))
    rows = pairs.select("post_id", "subreddit", F.posexplode("embedding").alias("dim", "value"))
    return rounded(rows, "value")


@query
def semi_join_top_authors(spark, sf_dir):
    posts = network.semi_join_top_authors(fx.posts(spark, sf_dir))
    return posts.select("post_id", "author", "subreddit")


@query
def reindex_weekdays(spark, sf_dir):
    weekday = F.weekday("timestamp")
    counts = (
        fx.posts(spark, sf_dir)
        .groupBy(weekday.alias("day_of_week"))
        .agg(F.count(F.lit(1)).alias("posts"))
    )
    return trends.reindex_weekdays(counts).withColumn(
        "posts", F.coalesce(F.col("posts").cast("string"), F.lit("missing"))
    )


@query
def sentiment_lexicon_join(spark, sf_dir):
    hits = sentiment.sentiment_lexicon_join(fx.posts(spark, sf_dir), fx.lexicon(spark))
    sums = hits.groupBy("post_id", "word").agg(
        F.count(F.lit(1)).alias("n"), F.sum("valence").alias("valence")
    )
    return rounded(sums, "valence")


@query
def similarity_scores(spark, sf_dir):
    scores = search.similarity_scores(
        fx.posts(spark, sf_dir), fx.vectors(spark, sf_dir), query_vector(spark, sf_dir)
    )
    return rounded(scores, "similarity_score")


@query
def search_top_k(spark, sf_dir):
    best = search.search_top_k(
        fx.posts(spark, sf_dir), fx.vectors(spark, sf_dir), query_vector(spark, sf_dir)
    )
    return rounded(best, "similarity_score").select(
        "post_id", "timestamp", "author", "subreddit", "title", "similarity_score"
    )


@query
def search_filtered(spark, sf_dir):
    best = search.search_filtered(
        fx.posts(spark, sf_dir),
        fx.vectors(spark, sf_dir),
        query_vector(spark, sf_dir),
        fx.START,
        fx.END,
    )
    return rounded(best, "similarity_score").select(
        "post_id", "timestamp", "subreddit", "title", "similarity_score"
    )


@query
def search_shared_link(spark, sf_dir):
    sharing = search.posts_sharing_link(fx.posts(spark, sf_dir), fx.SHARED_URL)
    best = search.search_top_k(sharing, fx.vectors(spark, sf_dir), query_vector(spark, sf_dir), k=20)
    return rounded(best, "similarity_score").select("post_id", "url", "similarity_score")


@query
def search_balls(spark, sf_dir):
    path = scratch_path(spark, "ball-index")
    ball_search.build_ball_index(fx.vectors(spark, sf_dir), path, cells=64)
    index = ball_search.load_ball_index(spark, path)
    best = ball_search.search_balls(fx.posts(spark, sf_dir), index, query_vector(spark, sf_dir))
    return rounded(best, "similarity_score").select(
        "post_id", "timestamp", "author", "subreddit", "title", "similarity_score"
    )


@query
def topic_weekly_trend(spark, sf_dir):
    posts = fx.posts(spark, sf_dir).join(fx.labels(spark, sf_dir), "post_id")
    return trends.topic_weekly_trend(posts)


@query
def search_many(spark, sf_dir):
    queries = fx.table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0")
    return search.search_many(
        fx.posts(spark, sf_dir),
        fx.vectors(spark, sf_dir),
        queries.select(F.col("vec_id").alias("query_id"), "embedding"),
        k=20,
    )


@query
def cosine_top_k(spark, sf_dir):
    best = search.cosine_top_k(
        fx.posts(spark, sf_dir), fx.vectors(spark, sf_dir), query_vector(spark, sf_dir)
    )
    return rounded(best, "similarity_score").select("post_id", "title", "similarity_score")


# --- sentiment -----------------------------------------------------------------


@query
def sentiment_compound(spark, sf_dir):
    compound = sentiment.sentiment_compound(
        fx.posts(spark, sf_dir), fx.lexicon(spark), fx.modifiers(spark)
    )
    return rounded(compound, "compound")


@query
def sentiment_label(spark, sf_dir):
    return scored(fx.posts(spark, sf_dir)).select("post_id", "sent_label")


@query
def sentiment_neutral_fallback(spark, sf_dir):
    posts = sentiment.attach_sentiment(fx.posts(spark, sf_dir), None)
    return posts.select("post_id", "compound", "sent_label")


@query
def sentiment_share_by_cluster(spark, sf_dir):
    shares = sentiment.sentiment_share_by_cluster(labelled(spark, sf_dir))
    return rounded(shares, "Positive", "Negative", "Neutral")


# --- trends --------------------------------------------------------------------


@query
def posts_by_day(spark, sf_dir):
    return trends.posts_by_day(fx.posts(spark, sf_dir))


@query
def posts_by_week(spark, sf_dir):
    return trends.posts_by_week(fx.posts(spark, sf_dir))


@query
def posts_by_month(spark, sf_dir):
    return trends.posts_by_month(fx.posts(spark, sf_dir))


@query
def posts_by_day_subreddit(spark, sf_dir):
    return trends.posts_by_day_subreddit(fx.posts(spark, sf_dir))


@query
def peak_day(spark, sf_dir):
    return trends.peak_day(fx.posts(spark, sf_dir))


@query
def peak_and_trough(spark, sf_dir):
    return trends.peak_and_trough(fx.posts(spark, sf_dir))


@query
def weekday_rhythm(spark, sf_dir):
    return trends.weekday_rhythm(fx.posts(spark, sf_dir))


@query
def keyword_weekly_trend(spark, sf_dir):
    return trends.keyword_weekly_trend(fx.posts(spark, sf_dir), fx.KEYWORDS)


@query
def keyword_index_trend(spark, sf_dir):
    keywords = literal_rows(spark, [(k,) for k in fx.KEYWORDS + fx.STOP_WORDS], "keyword string")
    return trends.keyword_index_trend(fx.posts(spark, sf_dir), keywords)


# --- rankings ------------------------------------------------------------------


@query
def dataset_overview(spark, sf_dir):
    return rankings.dataset_overview(fx.posts(spark, sf_dir))


@query
def top_subreddits(spark, sf_dir):
    return rankings.top_subreddits(fx.posts(spark, sf_dir))


@query
def subreddit_counts(spark, sf_dir):
    return rankings.subreddit_counts(fx.posts(spark, sf_dir))


@query
def score_stats(spark, sf_dir):
    stats = rankings.score_stats(fx.posts(spark, sf_dir))
    return rounded(stats, "avg_score", "median_score", "p90_score", "score_std")


@query
def score_stats_fractional(spark, sf_dir):
    posts = fx.posts(spark, sf_dir).withColumn("score", F.col("score") * F.col("upvote_ratio"))
    stats = rankings.score_stats(posts)
    return rounded(stats, *stats.columns)


@query
def media_impact(spark, sf_dir):
    return rounded(rankings.media_impact(fx.posts(spark, sf_dir)), "score")


@query
def top_images(spark, sf_dir):
    return rankings.top_images(fx.posts(spark, sf_dir)).select("post_id", "url", "score")


@query
def content_composition(spark, sf_dir):
    return rankings.content_composition(fx.posts(spark, sf_dir))


@query
def viral_post(spark, sf_dir):
    best = rankings.viral_post(matched(spark, sf_dir))
    return rounded(best.select("post_id", "title", "score", "similarity_score"), "similarity_score")


@query
def controversy_points(spark, sf_dir):
    points = rankings.controversy_points(fx.posts(spark, sf_dir))
    return rounded(points, "upvote_ratio", "log_comments", "log_score", "colour")


@query
def community_share(spark, sf_dir):
    return rounded(rankings.community_share(fx.posts(spark, sf_dir)), "share")


# --- keywords ------------------------------------------------------------------


@query
def clean_title(spark, sf_dir):
    return fx.posts(spark, sf_dir).select("post_id", text.clean_title(F.col("title")).alias("cleaned"))


def _terms(spark, sf_dir):
    return keywords.tokenize_ngrams(fx.posts(spark, sf_dir), fx.STOP_WORDS)


def _weights(spark, sf_dir):
    terms = _terms(spark, sf_dir)
    return keywords.tfidf_weights(terms, keywords.prune_vocabulary(terms))


@query
def tokenize_ngrams(spark, sf_dir):
    return _terms(spark, sf_dir).select("post_id", joined("terms"), F.size("terms").alias("n"))


@query
def prune_vocabulary(spark, sf_dir):
    return keywords.prune_vocabulary(_terms(spark, sf_dir))


@query
def tfidf_weights(spark, sf_dir):
    return rounded(_weights(spark, sf_dir), "tfidf")


@query
def top_keywords(spark, sf_dir):
    best = keywords.top_keywords(fx.posts(spark, sf_dir), n=50, stop_words=fx.STOP_WORDS)
    return rounded(best, "weight")


# --- topics --------------------------------------------------------------------


@query
def cluster_count_rule(spark, sf_dir):
    counted = filters.filter_nonblank_title(fx.posts(spark, sf_dir)).agg(
        F.count(F.lit(1)).alias("titles")
    )
    return counted.withColumn("clusters", topics.cluster_count_rule(F.col("titles")))


@query
def topic_clusters(spark, sf_dir):
    vectors, _ = topics.topic_vectors(fx.posts(spark, sf_dir), fx.STOP_WORDS)
    return topics.topic_clusters(vectors).select("post_id", "cluster_id")


@query
def topic_cluster_checks(spark, sf_dir):
    """What holds for any right clustering: all posts in it, k by the rule, each at its nearest centre."""
    vectors, _ = topics.topic_vectors(fx.posts(spark, sf_dir), fx.STOP_WORDS)
    model = topics.topic_model(vectors)
    centres = np.array(model.clusterCenters())

    @F.arrow_udf("boolean")
    def nearest(at: pa.Array, weight: pa.Array, cluster: pa.Array) -> pa.Array:
        n = len(cluster)
        row = np.repeat(np.arange(n), at.value_lengths().to_numpy(zero_copy_only=False))
        terms, weights = at.flatten().to_numpy(), weight.flatten().to_numpy()
        dots = np.array([np.bincount(row, centre[terms] * weights, n) for centre in centres])
        apart = (centres * centres).sum(axis=1)[:, None] - 2 * dots
        own = apart[cluster.to_numpy(), np.arange(n)]
        return pa.array(own <= apart.min(axis=0) + 1e-9)

    parts = F.unwrap_udt("features")
    found = model.transform(vectors).select(
        "cluster_id", nearest(parts["indices"], parts["values"], F.col("cluster_id")).alias("right")
    )
    return found.agg(
        F.lit(filters.filter_nonblank_title(fx.posts(spark, sf_dir)).count()).cast("bigint").alias("posts_in"),
        F.count(F.lit(1)).alias("posts_out"),
        F.count_distinct("cluster_id").cast("int").alias("clusters"),
        F.count_if(~F.col("right")).alias("misplaced"),
    )


@query
def cluster_top_terms(spark, sf_dir):
    posts = fx.posts(spark, sf_dir).select("post_id")
    labels = fx.labels(spark, sf_dir).join(posts, "post_id")
    return rounded(topics.cluster_top_terms(_weights(spark, sf_dir), labels), "weight")


@query
def cluster_profile(spark, sf_dir):
    profile = topics.cluster_profile(labelled(spark, sf_dir))
    return rounded(
        profile, "avg_compound", "positive_share", "negative_share", "neutral_share"
    )


@query
def cluster_examples(spark, sf_dir):
    posts = matched(spark, sf_dir).join(fx.labels(spark, sf_dir), "post_id")
    examples = topics.cluster_examples(posts).select("cluster_id", F.inline("examples"))
    return examples.select("cluster_id", "rank", "post_id", "title")


@query
def project_2d(spark, sf_dir):
    vectors, _ = topics.topic_vectors(fx.posts(spark, sf_dir), fx.STOP_WORDS)
    return topics.project_2d(vectors).select("post_id", "x", "y")


@query
def project_2d_checks(spark, sf_dir):
    """What holds for the two leading axes: no correlation, and more variance than any two terms hold."""
    vectors, _ = topics.topic_vectors(fx.posts(spark, sf_dir), fx.STOP_WORDS)
    spread = vectors.select(Summarizer.variance(F.col("features")).alias("v")).first().v
    most = float(np.sort(spread.toArray())[-2:].sum())
    found = topics.project_2d(vectors).agg(
        F.count(F.lit(1)).alias("posts"),
        F.corr("x", "y").alias("r"),
        (F.var_samp("x") + F.var_samp("y")).alias("held"),
    )
    return found.select(
        "posts", (F.abs("r") < 1e-6).alias("uncorrelated"), (F.col("held") >= most - 1e-9).alias("best")
    )


@query
def projection_centroids(spark, sf_dir):
    points = fx.table(spark, sf_dir, "embeddings").select(
        topics.cluster_label(F.col("label")).alias("cluster_label"),
        F.col("embedding")[0].cast("double").alias("x"),
        F.col("embedding")[1].cast("double").alias("y"),
    )
    return rounded(topics.projection_centroids(points), "x", "y")


# --- classes and links ---------------------------------------------------------


@query
def categorize_domain(spark, sf_dir):
    return rankings.with_category(fx.posts(spark, sf_dir)).select("post_id", "domain", "category")


@query
def detect_media_type(spark, sf_dir):
    return rankings.with_media_type(fx.posts(spark, sf_dir)).select("post_id", "url", "media_type")


@query
def context_links(spark, sf_dir):
    day = F.to_date("timestamp").cast("string")
    peaks = fx.posts(spark, sf_dir).select(
        "post_id",
        F.concat(F.lit("news from "), "subreddit").alias("query"),
        F.when(F.col("post_id") % 9 == 4, F.lit(None))
        .when(F.col("post_id") % 10 == 7, "None")
        .otherwise(day)
        .alias("peak_date"),
    )
    return briefing.context_links(peaks)


# --- network -------------------------------------------------------------------


def _edges(spark, sf_dir):
    return network.network_edges(fx.posts(spark, sf_dir))


@query
def top_authors(spark, sf_dir):
    return network.top_authors(fx.posts(spark, sf_dir))


@query
def network_edges(spark, sf_dir):
    return _edges(spark, sf_dir)


@query
def network_nodes(spark, sf_dir):
    return network.network_nodes(_edges(spark, sf_dir))


@query
def network_counts(spark, sf_dir):
    return network.network_counts(_edges(spark, sf_dir))


# --- briefing ------------------------------------------------------------------


@query
def briefing_facts(spark, sf_dir):
    facts = briefing.briefing_facts(fx.posts(spark, sf_dir))
    facts = rounded(facts, "avg_score", "median_score", "p90_score", "score_std")
    return facts.withColumn("top_subreddits", joined("top_subreddits"))


@query
def suggestion_context(spark, sf_dir):
    context = briefing.suggestion_context(matched(spark, sf_dir))
    return context.select(joined("titles"), joined("subreddits"))


@query
def chat_context(spark, sf_dir):
    context = briefing.chat_context(scored(matched(spark, sf_dir)))
    rows = F.transform(
        "first_rows",
        lambda r: F.concat_ws(";", r.title, r.subreddit, r.score.cast("string"), r.sent_label),
    )
    return context.withColumn("first_rows", F.array_join(rows, "|"))


@query
def render_prompts(spark, sf_dir):
    posts = matched(spark, sf_dir)
    prompts = {
        "briefing": briefing.render_briefing_prompt(briefing.briefing_facts(posts), "harbour"),
        "suggestions": briefing.render_suggestion_prompt(
            briefing.suggestion_context(posts), "harbour"
        ),
        "chat": briefing.render_chat_prompt(
            briefing.chat_context(scored(posts)), "Who posts most?"
        ),
    }
    rows = [frame.select(F.lit(kind).alias("kind"), "prompt") for kind, frame in prompts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


@query
def parse_suggestions(spark, sf_dir):
    documents = fx.table(spark, sf_dir, "documents")
    replies = documents.select(
        "doc_id",
        F.when(F.col("doc_id") % 13 != 4, F.col("text")).alias("reply"),
        (F.col("doc_id") % 17 != 6).alias("has_posts"),
    )
    parsed = briefing.parse_suggestions(replies, has_posts="has_posts")
    return parsed.select(
        "doc_id", F.size("questions").alias("n"), F.md5(joined("questions")).alias("questions_md5")
    )


# --- reports -------------------------------------------------------------------


@query
def metadata_summary(spark, sf_dir):
    return reports.metadata_table(fx.posts(spark, sf_dir))


@query
def corrupt_line_report(spark, sf_dir):
    path = scratch_path(spark, "lines")
    posts = fx.posts(spark, sf_dir).select("post_id", "author", "title", "url", "domain")
    line = F.to_json(F.struct("*"))
    broken = F.when(F.col("post_id") % 6 == 1, F.expr("substr(line, 1, length(line) - 7)"))
    posts.withColumn("line", line).select(
        F.coalesce(broken, F.col("line")).alias("value")
    ).write.text(path)
    records = post_files.read_posts(spark, path, posts.schema)
    return reports.corrupt_line_report(records, ["author", "title", "url", "domain", "score"])


def _tagged_posts(spark, sf_dir):
    kind = F.col("post_id") % 11
    added = (
        F.when(kind == 1, " see [here](https://a.example/c). #Tag")
        .when(kind == 2, " (https://a.example/c), https://w.example/x_(y)!")
        .when(kind == 3, " https://a.example/c#frag #ÄÖ_1, a#b")
        .otherwise("")
    )
    return fx.posts(spark, sf_dir).withColumn("selftext", F.concat("selftext", added))


@query
def sharing_network(spark, sf_dir):
    return reports.sharing_network(_tagged_posts(spark, sf_dir), fx.KEYWORDS)


@query
def co_sharing_accounts(spark, sf_dir):
    return co_sharing.co_sharing_accounts(_tagged_posts(spark, sf_dir), fx.KEYWORDS, fx.CO_SHARING_SECONDS)
