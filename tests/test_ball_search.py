import numpy as np
import pytest
from pyspark.sql import functions as F

from postscope.operators import ball_search, search

RNG = np.random.default_rng(11)
MIDDLES = RNG.normal(size=(20, 16))
POINTS = MIDDLES[np.arange(1200) % 20] + RNG.normal(size=(1200, 16)) * 0.05
POINTS[300:700] = POINTS[3]  # a third of all vectors are copies
POINTS[40] = 0.0
POINTS[1100:] *= RNG.uniform(0.1, 4, size=(100, 1))


@pytest.fixture(scope="module")
def vectors(spark):
    rows = [(i, [float(x) for x in p]) for i, p in enumerate(POINTS)]
    rows += [(5000, None), (5001, [float("nan")] * 16), (5002, [None] * 16)]
    return spark.createDataFrame(rows, "post_id bigint, embedding array<double>").repartition(6).persist()


@pytest.fixture(scope="module")
def posts(spark):
    return spark.range(5, 6000).select(F.col("id").alias("post_id"), F.lit("t").alias("title"))


@pytest.fixture(scope="module")
def index(spark, vectors, tmp_path_factory):
    ball_search.FILE_ROWS, before = 100, ball_search.FILE_ROWS
    path = f"file://{tmp_path_factory.mktemp('balls')}/index"
    ball_search.build_ball_index(vectors, path, cells=32)
    ball_search.FILE_ROWS = before
    return ball_search.load_ball_index(spark, path)


@pytest.mark.parametrize("cosine", [False, True])
@pytest.mark.parametrize("asked, k", [(7, 1), (7, 50), (3, 30), (3, 450), (1150, 20), (19, 2000)])
def test_same_rows_as_the_full_search(posts, vectors, index, asked, k, cosine):
    found = ball_search.search_balls(posts, index, POINTS[asked], k, cosine=cosine).collect()
    expected = search.search_top_k(posts, vectors, POINTS[asked], k, cosine=cosine).collect()
    assert [(r.post_id, r.similarity_score) for r in found] == [(r.post_id, r.similarity_score) for r in expected]


def test_bounds_hold_for_every_vector(index):
    own = {r.post_id: r.cell for r in index.vectors.select("post_id", "cell").collect()}
    row = {int(c): i for i, c in enumerate(index.cells)}
    for query in (POINTS[7], -POINTS[3], RNG.normal(size=16), np.zeros(16)):
        plain = index.bounds(query, False)
        for i in range(len(POINTS)):
            assert round(float(POINTS[i] @ query), search.SCORE_DIGITS) <= plain[row[own[i]]]
        if query.any():
            angles = index.bounds(query, True)
            for i in range(len(POINTS)):
                size = np.linalg.norm(POINTS[i]) * np.linalg.norm(query)
                if size:
                    assert round(float(POINTS[i] @ query) / size, search.SCORE_DIGITS) <= angles[row[own[i]]]


def test_most_vectors_are_not_read(posts, index):
    counts = dict(zip(index.cells.tolist(), index.counts))
    read = [sum(counts[c] for c in ball_search.winning_cells(posts, index, POINTS[i], 10, True)) for i in (1, 7, 12, 19)]
    assert max(read) < 0.25 * sum(counts.values())


def test_cells_are_chosen_by_their_folders(posts, index):
    chosen = ball_search._vectors_of(index, [1, 2])
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(cell" in plan or "PartitionFilters: [cell" in plan
    hot = max(zip(index.counts, index.cells))[1]
    files = index.vectors.filter(F.col("cell") == int(hot)).select(F.input_file_name()).distinct().count()
    assert files > 1  # copies of one vector are not one file


def test_few_posts_among_the_vectors(spark, vectors, index):
    few = spark.createDataFrame([(i,) for i in (11, 333, 1111)], "post_id bigint")
    found = ball_search.search_balls(few, index, POINTS[7], 2).collect()
    expected = search.search_top_k(few, vectors, POINTS[7], 2).collect()
    assert found == expected


def test_empty_table_and_infinite_entries(spark, vectors, tmp_path):
    path = f"file://{tmp_path}"
    ball_search.build_ball_index(vectors.where("false"), f"{path}/none")
    empty = ball_search.load_ball_index(spark, f"{path}/none")
    assert ball_search.search_balls(vectors.select("post_id"), empty, POINTS[7], 5).collect() == []
    rows = [(i, [float(i), 1.0]) for i in range(50)] + [(99, [float("inf"), 1.0])]
    hard = spark.createDataFrame(rows, "post_id bigint, embedding array<double>")
    ball_search.build_ball_index(hard, f"{path}/hard", cells=4)
    found = ball_search.search_balls(hard.select("post_id"), ball_search.load_ball_index(spark, f"{path}/hard"), [1.0, 0.0], 2)
    assert [r.post_id for r in found.collect()] == [99, 49]
