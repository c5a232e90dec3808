import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from postscope.operators import filters, search

RNG = np.random.default_rng(3)
MATRIX = np.round(RNG.normal(size=(400, 8)), 3)
MATRIX[200:330] = MATRIX[7]  # a third of all vectors are copies
IDS = list(range(400))


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, [float(x) for x in MATRIX[i]]) for i in IDS]
    frame = spark.createDataFrame(rows, "post_id bigint, embedding array<double>")
    return frame.repartition(5).persist()


@pytest.fixture(scope="module")
def posts(spark):
    # Posts 390 and up have no vector; vectors 0 to 4 have no post.
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(hours=i), f"t{i}") for i in range(5, 410)]
    return spark.createDataFrame(rows, "post_id bigint, timestamp timestamp_ntz, title string")


def brute_force(query, k, ids=range(5, 400)):
    scores = {i: round(float(MATRIX[i] @ query), 9) for i in ids}
    return sorted(scores, key=lambda i: (-scores[i], i))[:k]


def test_top_k_with_ties_by_id(posts, vectors):
    for k in (1, 50, 390, 1000):
        found = search.search_top_k(posts, vectors, MATRIX[7], k).collect()
        assert [r.post_id for r in found] == brute_force(MATRIX[7], k)
        assert found[0].similarity_score == pytest.approx(float(MATRIX[7] @ MATRIX[7]))


def test_query_vector_from_a_post(posts, vectors):
    asked = search.vector_of(vectors, 9)
    found = search.search_top_k(posts, vectors, asked, 20).collect()
    assert [r.post_id for r in found] == brute_force(MATRIX[9], 20)


def test_filtered_search_ranks_inside_the_range(posts, vectors):
    day = dt.date(2024, 1, 3)
    found = search.search_filtered(posts, vectors, MATRIX[7], day, day, 50).collect()
    assert [r.post_id for r in found] == brute_force(MATRIX[7], 50, range(48, 72))


@pytest.mark.parametrize("block, vector_block", [(2, 60), (256, 10**6), (2, 1000), (100, 7)])
def test_many_queries_in_any_number_of_blocks(spark, posts, vectors, block, vector_block):
    asked = [1, 7, 50, 120, 399]
    queries = vectors.filter(F.col("post_id").isin(asked)).select(
        F.concat(F.lit("q"), "post_id").alias("query_id"), "embedding"
    )
    rows = search.search_many(posts, vectors, queries, 30, block, vector_block).collect()
    for i in asked:
        ranked = sorted((r.rank, r.post_id) for r in rows if r.query_id == f"q{i}")
        assert [p for _, p in ranked] == brute_force(MATRIX[i], 30)
        assert [r for r, _ in ranked] == list(range(1, 31))


def test_many_queries_with_text_ids(spark):
    vectors = spark.createDataFrame(
        [("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("c", [0.0, 1.0])],
        "post_id string, embedding array<float>",
    )
    queries = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    rows = search.search_many(vectors, vectors, queries, k=2).orderBy("rank").collect()
    assert [r.post_id for r in rows] == ["a", "b"]


def test_cosine_ignores_length_and_skips_zero_vectors(spark):
    vectors = spark.createDataFrame(
        [(1, [10.0, 0.0]), (2, [1.0, 1.0]), (3, [0.0, 0.0])],
        "post_id bigint, embedding array<float>",
    )
    found = search.cosine_top_k(vectors.select("post_id"), vectors, [2.0, 2.0], 5).collect()
    assert [(r.post_id, round(r.similarity_score, 6)) for r in found] == [(2, 1.0), (1, 0.707107)]


def test_date_range_includes_both_ends(spark):
    times = ["2024-03-01 00:00:00", "2024-03-02 23:59:59.999999", "2024-03-03 00:00:00",
             "2024-02-29 23:59:59.999999"]
    posts = spark.createDataFrame(
        [(i, dt.datetime.fromisoformat(t)) for i, t in enumerate(times)],
        "post_id int, timestamp timestamp_ntz",
    )
    kept = filters.filter_date_range(posts, dt.date(2024, 3, 1), dt.date(2024, 3, 2))
    assert {r.post_id for r in kept.collect()} == {0, 1}
    with pytest.raises(ValueError):
        filters.filter_date_range(posts, dt.date(2024, 3, 2), dt.date(2024, 3, 1))


def test_keyword_filter_is_unicode_and_null_safe(spark):
    posts = spark.createDataFrame([(1, "CIÓN"), (2, None), (3, "x")], "post_id int, title string")
    assert [r.post_id for r in filters.filter_title_keyword(posts, "ción|CION").collect()] == [1]


def test_viral_is_strict_and_lookup(spark):
    posts = spark.createDataFrame(
        [(1, 100, "a", "u"), (2, 101, "b", "v")], "post_id int, score bigint, title string, url string"
    )
    assert [r.post_id for r in filters.filter_viral(posts).collect()] == [2]
    assert filters.lookup_post(posts, 2).first().title == "b"
    assert filters.lookup_post(posts, 9).count() == 0


def test_null_vectors_are_no_hits_and_wrong_lengths_are_named(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.5, None]), (4, [0.5, 0.5])]
    vectors = spark.createDataFrame(rows, "post_id bigint, embedding array<double>")
    posts = vectors.select("post_id")
    for search_one in (search.search_top_k, search.cosine_top_k):
        for matched in (False, True):
            assert [r.post_id for r in search_one(posts, vectors, [1.0, 0.0], 10, matched).collect()] == [1, 4]
    queries = vectors.withColumnRenamed("post_id", "query_id")
    found = search.search_many(posts, vectors, queries.where("query_id <> 3"), k=2).collect()
    assert sorted((r.query_id, r.rank, r.post_id) for r in found) == [(1, 1, 1), (1, 2, 4), (4, 1, 1), (4, 2, 4)]
    odd = vectors.union(spark.createDataFrame([(9, [1.0])], vectors.schema))
    with pytest.raises(Exception, match="vector of post 9 has 1 entries, not 2"):
        search.search_top_k(posts, odd, [1.0, 0.0], 10, matched=True).collect()


def test_many_queries_never_pass_the_driver(spark, posts, vectors, monkeypatch):
    """No collect while planning, one plan of one scan of each side for any number of blocks; ties by id."""
    monkeypatch.setattr(type(vectors), "collect", None)
    found = search.search_many(None, vectors, vectors.withColumnRenamed("post_id", "query_id"), 3, 10, 10)
    monkeypatch.undo()
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    best = {(r.query_id, r.rank): r.post_id for r in found.collect()}
    assert all([best[i, k + 1] for k in range(3)] == brute_force(MATRIX[i], 3, range(400)) for i in range(0, 400, 9))
    assert search.search_many(None, vectors, vectors.where("false").withColumnRenamed("post_id", "query_id")).collect() == []


def test_ten_thousand_queries_in_one_pass(spark):
    rng = np.random.default_rng(8)
    vectors = spark.createDataFrame([(i, rng.normal(size=4).tolist()) for i in range(50)], "post_id bigint, embedding array<double>")
    asked = [(i, rng.normal(size=4).tolist()) for i in range(10_000)]
    queries = spark.createDataFrame(asked, "query_id bigint, embedding array<double>")
    found = search.search_many(None, vectors, queries, k=1)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert found.count() == 10_000
