"""What the plans look like, whole jobs, and results that do not depend on the layout."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from checks import fixture as fx
from postscope.operators import embedding_jobs, filters, search, topics, trends
from postscope.plans import explore
from postscope.sources import posts as post_files
from postscope.sources import vectors as vector_files
from postscope.streaming.daily_counts import stream_posts, stream_posts_by_day_subreddit

SF_DIR = "/root/testdata/sf0.001"


def physical(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_query_pairs_everything_with_everything(spark):
    for name, query in entry.queries().items():
        plan = physical(query(spark, SF_DIR))
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_date_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "posts")
    fx.posts(spark, SF_DIR).write.parquet(path)
    ranged = filters.filter_date_range(spark.read.parquet(path), fx.START, fx.END)
    plan = physical(trends.posts_by_day(ranged))
    assert "GreaterThanOrEqual(timestamp" in plan and "LessThan(timestamp" in plan
    assert "ReadSchema: struct<timestamp:timestamp_ntz>" in plan


def test_vectors_are_scored_before_the_join(spark, no_broadcast):
    posts, vectors = fx.posts(spark, SF_DIR), fx.vectors(spark, SF_DIR)
    scores = search.similarity_scores(posts, vectors, search.vector_of(vectors, 0))
    shuffled = re.findall(r"Exchange hashpartitioning\(post_id.*\n.*", physical(scores))
    assert shuffled and all("embedding" not in part.split("\n")[0] for part in shuffled)
    joined = optimized(scores).split("Join Inner")[1]
    assert joined.index("similarity_score") < joined.index("Relation")


def test_bucketed_tables_join_without_a_shuffle(spark, no_broadcast):
    post_files.write_posts_table(fx.posts(spark, SF_DIR), "posts_b", 4)
    vector_files.write_vectors_table(
        fx.vectors(spark, SF_DIR).select("post_id", "embedding"), "vectors_b", 4
    )
    pairs = search.align_embeddings(spark.table("posts_b"), spark.table("vectors_b"))
    assert pairs.count() > 0
    assert "Exchange" not in physical(pairs)


def test_groups_are_cut_before_the_shuffle(spark, no_broadcast):
    posts = fx.posts(spark, SF_DIR).withColumn("cluster_id", F.lit(1) * F.col("score") % 3)
    plan = physical(topics.cluster_examples(posts))
    assert plan.count("WindowGroupLimit") == 2  # once before, once after the exchange


@pytest.mark.parametrize(
    "name", ["posts_by_week", "top_subreddits", "score_stats", "search_top_k", "search_many",
             "tfidf_weights", "sentiment_compound", "token_budget_batches", "network_nodes"]
)
def test_results_do_not_depend_on_the_number_of_partitions(spark, name):
    query = entry.queries()[name]
    wanted = sorted(map(repr, query(spark, SF_DIR).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        assert sorted(map(repr, query(spark, SF_DIR).collect())) == wanted
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


@pytest.mark.parametrize("name", ["topic_cluster_checks", "project_2d_checks"])
def test_topic_checks_do_not_depend_on_the_number_of_partitions(spark, name):
    test_results_do_not_depend_on_the_number_of_partitions(spark, name)


def test_cluster_labels_do_not_depend_on_the_layout(spark):
    vectors, _ = topics.topic_vectors(fx.posts(spark, SF_DIR), fx.STOP_WORDS)
    one, five = (
        {r.post_id: r.cluster_id for r in topics.topic_clusters(vectors.repartition(n)).collect()} for n in (1, 5)
    )
    assert one == five


def test_batches_move_no_text_and_search_without_filter_no_ids(spark):
    posts, vectors = fx.posts(spark, SF_DIR), fx.vectors(spark, SF_DIR)
    prepared = embedding_jobs.prepare_embedding_text(posts.withColumnRenamed("selftext", "text_col"))
    batches = embedding_jobs.token_budget_batches(prepared)
    plan = batches._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan[: plan.index("Exchange")].replace("MapInArrow", "")
    scores = search.similarity_scores(None, vectors, search.vector_of(vectors, 0))
    assert "Exchange" not in scores._jdf.queryExecution().executedPlan().toString()


def test_whole_exploration(spark):
    posts, vectors = fx.posts(spark, SF_DIR), fx.vectors(spark, SF_DIR)
    start, end = dt.date(2024, 1, 1), dt.date(2025, 12, 31)
    assert explore.overview(posts, start, end)["totals"].first().total_posts == 1000
    matched = explore.match_topic(
        posts, vectors, search.vector_of(vectors, 0), fx.lexicon(spark), start, end, 60
    )
    try:
        assert matched.count() == 60
        tables = {
            **explore.trend_tables(matched, stop_words=fx.STOP_WORDS),
            **explore.topic_tables(matched, fx.STOP_WORDS),
            **explore.source_tables(matched),
            **explore.network_tables(matched),
            **explore.briefing_tables(matched, "harbour"),
        }
        sizes = {name: frame.count() for name, frame in tables.items()}
        assert sizes["clusters"] == sizes["centroids"] == sizes["sentiment"] == 5
        assert sizes["map"] == 60 and sizes["facts"] == 1
        assert all(sizes.values()), sizes
        assert explore.analyst_question(matched, "why?").first().prompt.endswith("why?")
    finally:
        matched.unpersist()
    assert explore.topic_tables(matched.limit(4), fx.STOP_WORDS) == {}


def test_stream_equals_batch(spark, tmp_path):
    source = fx.posts(spark, SF_DIR).select(
        "post_id", "subreddit", F.col("timestamp").alias("created_at")
    )
    folder = str(tmp_path / "in")
    post_files.write_posts_json(source.repartition(3), folder)
    stream = stream_posts(spark, folder, "post_id bigint, subreddit string, created_at string")
    query = (
        stream_posts_by_day_subreddit(stream)
        .writeStream.outputMode("complete")
        .format("memory")
        .queryName("daily")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination(120)
    batch = trends.posts_by_day_subreddit(fx.posts(spark, SF_DIR))
    assert sorted(spark.table("daily").collect()) == sorted(batch.collect())


def test_stream_closes_days_and_drops_late_rows(spark, tmp_path):
    """Append mode: a day comes out once the watermark has passed it, a later row of it is dropped."""
    folder = tmp_path / "in"
    folder.mkdir()

    def arrive(name, rows):
        (folder / name).write_text("".join(f'{{"post_id": {i}, "subreddit": "s", "created_at": "{t}"}}\n' for i, t in rows))

    def run():
        stream = stream_posts(spark, str(folder), "post_id bigint, subreddit string, created_at string")
        query = (
            stream_posts_by_day_subreddit(stream, late="1 day")
            .writeStream.outputMode("append")
            .format("parquet")
            .option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "checkpoint"))
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination(120)
        return sorted((str(r.date), r.posts) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    arrive("1.json", [(1, "2024-01-01T10:00:00"), (2, "2024-01-02T09:00:00")])
    assert run() == []
    arrive("2.json", [(3, "2024-01-01T23:00:00"), (4, "2024-01-03T12:00:00")])  # within a day: still counted
    assert run() == [("2024-01-01", 2)]
    arrive("3.json", [(5, "2024-01-01T11:00:00"), (6, "2024-01-02T20:00:00"), (7, "2024-01-05T00:00:00")])
    assert run() == [("2024-01-01", 2), ("2024-01-02", 2), ("2024-01-03", 1)]  # row 5 came too late


def test_only_titles_move_for_queries_without_texts(spark, no_broadcast):
    plan = physical(fx.posts(spark, SF_DIR).select("post_id", "title"))
    moved = plan.split("Exchange hashpartitioning(doc_id")[1:]
    columns = [part.split("\n")[1] for part in moved]
    assert any("replace(substring(text" in c for c in columns)
    assert not any(re.search(r"[\[ ]text#\d+(,|\]$)", re.sub(r"substring\(text#\d+,", "", c)) for c in columns)


def test_posts_with_scores_move_no_text_by_post(spark, no_broadcast):
    from checks import queries

    plan = physical(queries.matched(spark, SF_DIR))
    above = plan[: plan.index("Exchange hashpartitioning")]
    assert "hashpartitioning(doc_id" in plan and "hashpartitioning(post_id" not in above


def test_sizes_are_made_once_for_batches(spark):
    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            made.add(batch.num_rows)
            yield batch

    items = spark.range(500).selectExpr("id AS post_id", "1 AS n_tokens").mapInArrow(count, "post_id long, n_tokens int")
    assert embedding_jobs.token_budget_batches(items, 10).count() == 500
    assert made.value == 500


def test_posts_are_written_packed(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(post_files, "FILE_RECORDS", 100)
    posts = fx.posts(spark, SF_DIR)
    post_files.write_posts_json(posts.repartition(2), str(tmp_path / "posts"))
    files = list((tmp_path / "posts").glob("part-*"))
    assert len(files) >= 10 and all(f.name.endswith(".json.gz") for f in files)
    assert post_files.read_posts(spark, str(tmp_path / "posts"), posts.schema).count() == 1000
