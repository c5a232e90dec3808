import math

import pytest
from pyspark.sql import functions as F

from postscope.operators import sentiment

LEXICON = [("good", 1.9), ("bad", -2.5), ("no", -1.2), (":)", 2.0), ("shit", -2.6), ("kind", 2.4), ("hella", 0.4)]


def compound(total):
    return round(total / math.sqrt(total * total + 15), 4)


CASES = {
    "good": 1.9,
    "a good day": 1.9,
    "very good": 1.9 + 0.293,
    "VERY good": 1.9 + 0.293 + 0.733,
    "very bad": -2.5 - 0.293,
    "hardly good": 1.9 - 0.293,
    "not good": 1.9 * -0.74,
    "not very good": (1.9 + 0.293) * -0.74,
    "very big and good": 1.9 + 0.293 * 0.9,
    "isn't good": 1.9 * -0.74,
    "never was it good": 1.9 * -0.74,
    "not that it was good": 1.9,
    "GOOD day": 1.9 + 0.733,
    "BAD day": -2.5 - 0.733,
    "GOOD": 1.9,
    "good!": 1.9 + 0.292,
    "good!!!!!!": 1.9 + 4 * 0.292,
    "good??": 1.9 + 2 * 0.18,
    "good?????": 1.9 + 0.96,
    "bad!": -2.5 - 0.292,
    "good but bad": 1.9 * 0.5 - 2.5 * 1.5,
    "good, But, bad": 1.9 * 0.5 - 2.5 * 1.5,
    "butter good": 1.9,
    "no good": 1.9 * -0.74,
    "a no": -1.2,
    "NO good day": 0.0 - 0.733 + 1.9 * -0.74,
    "no very good": (1.9 * -0.74) - 0.293 - 1.2,
    "no day or good": 1.9 * -0.74 - 1.2,
    "never so good": (1.9 + 0.293) * 1.25,
    "it was never this good": (1.9 * 1.25) * 1.25,
    "without doubt good": 1.9,
    "it is without a doubt good": 1.9,
    "without good": 1.9 * -0.74,
    "it is kind of good": 1.9 - 0.293,
    "kind words": 2.4,
    "effing good": 1.9 + 0.293,
    "hella good": 1.9,
    "least good": 1.9 * -0.74,
    "at least good": 1.9,
    "the very least good": 1.9 + 0.293 * 0.95,
    "well it was the shit": 3.0,
    "don't be bad": -2.5 * -0.74,
    "\u00a0good\u2003day\r\n": 1.9,
    "(good),": 1.9,
    ":)": 2.0,
    "ok :)": 2.0,
    "nothing here": 0.0,
    "": 0.0,
}


@pytest.fixture(scope="module")
def lexicon(spark):
    return spark.createDataFrame(LEXICON, "word string, valence double")


def test_rules(spark, lexicon):
    texts = list(CASES)
    posts = spark.createDataFrame(
        [(i, t, None) for i, t in enumerate(texts)], "post_id int, title string, selftext string"
    )
    rows = {r.post_id: r.compound for r in sentiment.sentiment_compound(posts, lexicon).collect()}
    found = {texts[i]: value for i, value in rows.items()}
    assert found == {text: pytest.approx(compound(total), abs=1e-9)
                     for text, total in CASES.items()}


def test_title_and_body_count_and_null_posts_are_neutral(spark, lexicon):
    posts = spark.createDataFrame(
        [(1, "good", "good"), (2, None, None)], "post_id int, title string, selftext string"
    )
    rows = {r.post_id: r for r in sentiment.attach_sentiment(posts, lexicon).collect()}
    assert rows[1].compound == compound(3.8) and rows[1].sent_label == "positive"
    assert rows[2].compound == 0.0 and rows[2].sent_label == "neutral"


def test_label_thresholds_are_strict(spark):
    values = [(0.05,), (0.0501,), (-0.05,), (-0.0501,), (0.0,)]
    frame = spark.createDataFrame(values, "c double")
    labels = [r[0] for r in frame.select(sentiment.sentiment_label(F.col("c"))).collect()]
    assert labels == ["neutral", "positive", "neutral", "negative", "neutral"]


def test_without_lexicon_all_are_neutral(spark):
    posts = spark.createDataFrame([(1, "good")], "post_id int, title string")
    row = sentiment.attach_sentiment(posts, None).first()
    assert (row.compound, row.sent_label) == (0.0, "neutral")


def test_tables_of_any_size(spark):
    table = {f"w{i}": i / 7 for i in range(5000)} | {"é'\"\\": 1.5, "日本": -2.0}
    find = sentiment.looked_up(table)
    words = [(w,) for w in [*table, "x", "", None, "w5000"]]
    rows = spark.createDataFrame(words, "word string").select("word", find(F.col("word")).alias("n")).collect()
    assert {r.word: r.n for r in rows if r.n is not None} == table and len(rows) == len(words)
    assert spark.range(1).select(sentiment.looked_up({})(F.lit("a"))).first()[0] is None


def test_lexicon_join_counts_from_one(spark, lexicon):
    posts = spark.createDataFrame([(1, "good, GOOD", " bad :)"), (2, None, "x")], "post_id int, title string, selftext string")
    found = sentiment.sentiment_lexicon_join(posts, lexicon).collect()
    assert sorted(map(tuple, found)) == [(1, 1, "good", 1.9), (1, 2, "good", 1.9), (1, 3, "bad", -2.5), (1, 4, ":)", 2.0)]


def test_scores_need_no_shuffle(spark, lexicon):
    posts = spark.createDataFrame([(1, "good")], "post_id int, title string").repartition(3)
    plan = sentiment.attach_sentiment(posts, lexicon)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert plan.count("Exchange") == posts._jdf.queryExecution().toString().count("Exchange")


def test_shares_fill_missing_labels_with_zero(spark):
    rows = [("Cluster 0", "positive"), ("Cluster 0", "neutral"), ("Cluster 1", "negative")]
    labelled = spark.createDataFrame(rows, "cluster_label string, sent_label string")
    shares = {r.cluster: (r.Positive, r.Negative, r.Neutral)
              for r in sentiment.sentiment_share_by_cluster(labelled).collect()}
    assert shares == {"Cluster 0": (0.5, 0.0, 0.5), "Cluster 1": (0.0, 1.0, 0.0)}
    assert sentiment.sentiment_share_by_cluster(labelled.limit(0)).count() == 0


def test_words_found_by_a_pattern_are_those_of_all_tokens(spark, lexicon, monkeypatch):
    texts = ["", " ", "good", "\u3000GOOD!\x1fbad", "x  y\n\nz not  good, but (bad)", "a b c d never so good", "no no, nothing :) :-)",
             "İstanbul ΣΑΣ σας Kelvin \ufdd0good", "the least good of all BUT BAD", "very\t\t\t\tgood kind of bad " * 9, "GOOD BAD", "日本 GOOD é"]
    posts = spark.createDataFrame([(i, t, t[::-1]) for i, t in enumerate(texts)], "post_id int, title string, selftext string")
    more = spark.createDataFrame([("i̇stanbul", 1.5), ("σας", -1.0), ("kelvin", 0.5), ("日本", 0.25), ("a", 0.1), (":d", 2.0)], "word string, valence double")
    words = lexicon.select("word", "valence").unionByName(more)

    def found():
        hits = sentiment.sentiment_lexicon_join(posts, words).collect()
        return sorted(map(tuple, sentiment.sentiment_compound(posts, words).collect())), sorted(map(tuple, hits))

    by_pattern = found()
    monkeypatch.setattr(sentiment, "MAX_SUMS", 1)
    assert found() == by_pattern and len(by_pattern[1]) > 40
    monkeypatch.setattr(sentiment, "MAX_PATTERN_WORDS", 0)
    assert found() == by_pattern


def test_texts_are_not_split_into_all_words(spark, lexicon):
    posts = spark.createDataFrame([(1, "good", "bad")], "post_id int, title string, selftext string")
    plan = sentiment.attach_sentiment(posts, lexicon)._jdf.queryExecution().optimizedPlan().toString()
    assert "split(btrim(_text" not in plan.split("LogicalRDD")[0].replace("ELSE exists(split(btrim(_text", "")
