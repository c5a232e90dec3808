import math
from collections import Counter

import numpy as np
import pytest
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from postscope import fixed_values as fv
from postscope.functions.text import clean_title
from postscope.operators import filters, keywords, topics

STOP = ["the", "of"]


def titled(spark, titles):
    return spark.createDataFrame(list(enumerate(titles)), "post_id int, title string")


def test_clean_title(spark):
    cases = {
        "Top 10 of 2000 at A Glance": "top    glance",
        "see https://a.b/c?d=1 now": "see  now",
        "été à la mode": "été   mode",
        "x1y22z über": " über",
        None: "",
    }
    cleaned = titled(spark, list(cases)).select(clean_title(F.col("title")).alias("c"))
    found = [" ".join(r.c.split()) for r in cleaned.collect()]
    assert found == [" ".join(c.split()) for c in
                     ["top glance", "see now", "été mode", "xyz über", ""]]


def test_bigrams_run_across_stop_words(spark):
    posts = titled(spark, ["storm of the century", "alone", "", None])
    rows = {r.post_id: r.terms for r in keywords.tokenize_ngrams(posts, STOP).collect()}
    assert rows == {0: ["storm", "century", "storm century"], 1: ["alone"], 2: [], 3: []}


def test_default_stop_words(spark):
    posts = titled(spark, ["this is the storm"])
    assert keywords.tokenize_ngrams(posts).first().terms == ["storm"]


def brute_force(documents, min_df, max_df, limit):
    """The published formula: smoothed idf, unit length per document."""
    n = len(documents)
    df = Counter(t for d in documents for t in set(d))
    tf = Counter(t for d in documents for t in d)
    kept = [t for t in df if min_df <= df[t] <= max_df * n]
    kept = sorted(kept, key=lambda t: (-tf[t], t))[:limit]
    idf = {t: math.log((1 + n) / (1 + df[t])) + 1 for t in kept}
    weights = {}
    for i, document in enumerate(documents):
        counts = Counter(t for t in document if t in idf)
        length = math.sqrt(sum((c * idf[t]) ** 2 for t, c in counts.items()))
        for t, c in counts.items():
            weights[i, t] = c * idf[t] / length
    return kept, weights


@pytest.mark.parametrize("limit", [1000, 5])
def test_weights_equal_brute_force(spark, limit):
    rng = np.random.default_rng(1)
    names = [f"word{chr(97 + i)}" for i in range(12)]
    titles = [" ".join(rng.choice(names, rng.integers(0, 9))) for _ in range(120)]
    # A third of all posts are copies, and one word is in nearly all of them.
    titles[:40] = ["worda wordb wordb"] * 40
    titles = [f"everywhere {t}" for t in titles]
    posts = titled(spark, titles).repartition(4)
    terms = keywords.tokenize_ngrams(posts, STOP)
    documents = [r.terms for r in terms.orderBy("post_id").collect()]
    kept, weights = brute_force(documents, 3, 0.9, limit)
    assert "everywhere" not in kept
    vocabulary = keywords.prune_vocabulary(terms, max_features=limit)
    assert [r.term for r in vocabulary.collect()] == kept
    found = {(r.post_id, r.term): r.tfidf
             for r in keywords.tfidf_weights(terms, vocabulary).collect()}
    assert found == {key: pytest.approx(w) for key, w in weights.items()}
    sums = Counter()
    for (_, term), weight in weights.items():
        sums[term] += weight
    best = keywords.top_keywords(posts, 3, STOP, max_features=limit).collect()
    assert [r.term for r in best] == sorted(sums, key=lambda t: (-round(sums[t], 9), t))[:3]


def test_nothing_survives_pruning(spark):
    posts = titled(spark, ["one", "two"])
    best = keywords.top_keywords(posts, 5, STOP)
    assert best.columns == ["term", "weight"] and best.count() == 0


@pytest.mark.parametrize("titles, k", [(4, 2), (5, 2), (16, 2), (24, 3), (40, 5), (4000, 5)])
def test_cluster_count_rule(spark, titles, k):
    assert topics.cluster_count_rule(titles) == k
    assert spark.range(1).select(topics.cluster_count_rule(F.lit(titles))).first()[0] == k


def topic_posts(spark):
    groups = ["stock market crash", "football match goal", "rain storm flood"]
    return titled(spark, [f"{groups[i % 3]} item" for i in range(30)] + ["  ", None]).withColumns(
        {
            "subreddit": F.lit("s"),
            "score": F.lit(1),
            "compound": F.lit(0.5),
            "sent_label": F.lit("positive"),
            "url": F.lit(None).cast("string"),
        }
    )


def test_too_few_titles(spark):
    assert topics.topic_vectors(titled(spark, ["a b", " ", None, "storm", "flood", "rain"])) is None
    assert not filters.enough_titles(titled(spark, ["x"] * 4))
    assert filters.enough_titles(titled(spark, ["x"] * 5))


def test_clusters_separate_topics_and_repeat(spark):
    posts = topic_posts(spark)
    vectors, names = topics.topic_vectors(posts, STOP)
    assert "stock market" in names
    labels = {r.post_id: r.cluster_id for r in topics.topic_clusters(vectors).collect()}
    assert sorted(labels) == list(range(30))  # blank titles are not clustered
    assert len(set(labels.values())) == 3
    for i in range(30):
        assert labels[i] == labels[i % 3]
    again = {r.post_id: r.cluster_id for r in topics.topic_clusters(vectors).collect()}
    assert again == labels


def test_passes_read_written_vectors(spark):
    vectors, _ = topics.topic_vectors(topic_posts(spark), STOP)
    plan = vectors._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" in plan
    assert "UDF" not in plan and "regexp" not in plan


def test_starts_hold_decoded_vectors_and_equal_kmeans(spark, monkeypatch):
    vectors, _ = topics.topic_vectors(topic_posts(spark), STOP)
    fit, levels = KMeans.fit, []

    def seen(self, frame):
        levels.append(frame.storageLevel)
        return fit(self, frame)

    monkeypatch.setattr(KMeans, "fit", seen)
    model = topics.topic_model(vectors, starts=3)
    # KMeans decodes every vector in each pass over a frame that is persisted itself.
    assert levels == [StorageLevel.NONE] * 3
    dealt = vectors.repartition(1).sortWithinPartitions("post_id")
    plain = [fit(KMeans(k=3, seed=fv.TOPIC_SEED + i), dealt) for i in range(3)]
    best = min(plain, key=lambda found: found.summary.trainingCost)
    assert np.array_equal(model.clusterCenters(), best.clusterCenters())


def test_vocabulary_counts_repeated_terms(spark):
    rows = [(1, ["b", "a", "b", "b"]), (2, ["b"]), (3, []), (4, None), (5, [None, "a"])]
    terms = spark.createDataFrame(rows, "post_id long, terms array<string>")
    found = keywords.prune_vocabulary(terms, min_df=1, max_df=1.0)
    assert [tuple(r) for r in found.collect()] == [("b", 2, 4), ("a", 2, 2)]
    # One row per term of a post reaches the counts, without a function called per term.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate ") == 1 and "transform(" not in plan


def test_projection_equals_numpy(spark):
    posts = topic_posts(spark)
    vectors, _ = topics.topic_vectors(posts, STOP)
    rows = sorted((r.post_id, r.features.toArray()) for r in vectors.collect())
    matrix = np.array([v for _, v in rows])
    _, axes = np.linalg.eigh(np.cov(matrix.T))
    wanted = np.abs(matrix @ axes[:, ::-1][:, :2])
    points = {r.post_id: (r.x, r.y) for r in topics.project_2d(vectors).collect()}
    spread = np.array([points[i] for i, _ in rows])
    # Equal variance along both axes leaves their turn open, so distances are compared.
    left = np.linalg.norm(spread[:, None] - spread[None], axis=2)
    right = matrix @ axes[:, ::-1][:, :2]
    assert np.allclose(left, np.linalg.norm(right[:, None] - right[None], axis=2), atol=1e-6)
    assert wanted.shape == spread.shape


def test_cluster_tables(spark):
    posts = topic_posts(spark).withColumn("similarity_score", F.col("post_id") / 100)
    used = filters.filter_nonblank_title(posts)
    terms = keywords.tokenize_ngrams(used, STOP, clean=None)
    weights = keywords.tfidf_weights(terms, keywords.prune_vocabulary(terms, 1, 1.0))
    labels = used.select("post_id", (F.col("post_id") % 3).alias("cluster_id"))
    records = {r.cluster_id: r for r in
               topics.cluster_records(used, weights, labels).collect()}
    assert {r.size for r in records.values()} == {10}
    assert set(records[0].top_terms) >= {"stock", "market", "crash"}
    assert [e.post_id for e in records[2].examples] == [29, 26, 23]
    assert records[1].positive_share == 1.0 and records[1].avg_compound == 0.5
    points = used.select("post_id", F.lit(1.0).alias("x"), F.lit(2.0).alias("y"))
    shown = topics.topic_map(points.join(labels, "post_id"), used)
    assert {r.url for r in shown.collect()} == {"#"}
    centroids = topics.projection_centroids(shown).collect()
    assert {(r.cluster_label, r.x, r.y) for r in centroids} == {
        (f"Cluster {i}", 1.0, 2.0) for i in range(3)
    }
