import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from postscope.operators import keyword_index, trends

RNG = random.Random(4)
WORDS = ["".join(RNG.choice("abcdeä") for _ in range(RNG.randint(1, 6))) for _ in range(300)]
TITLES = [" ".join(RNG.choices(WORDS, k=8)) for _ in range(200)]
TITLES += ["Ab\u212bC \u212aelvin \u03a3\u03c3\u03c2 stra\u00dfe \u0130stanbul", "a.b+c (x) Harbour", "", None, "ab", "HARBOUR harbour"] + ["hot title"] * 100


@pytest.fixture(scope="module")
def posts(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(days=i % 90), t, "kept") for i, t in enumerate(TITLES)]
    return spark.createDataFrame(rows, "post_id bigint, timestamp timestamp_ntz, title string, keyword string").repartition(4).persist()


def table(spark, keywords):
    return spark.createDataFrame([(k,) for k in keywords], "keyword string")


@pytest.mark.parametrize("keywords", [
    ["harbour", "HOT", "\u03c3\u03c3\u03c3", "kelvin", "istanbul", "STRA\u00dfE", "b\u00e5c"],
    ["a", "ab", "a.b", "a\\.b\\+c", "h.t", "(x)", "hot t", "^hot", "nowhere", "har|tit"],
])
def test_equal_to_one_test_per_keyword(spark, posts, keywords):
    found = trends.keyword_index_trend(posts, table(spark, keywords + keywords[:2] + [None])).collect()
    expected = trends.keyword_weekly_trend(posts, keywords).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, expected)) and found


def test_five_thousand_keywords(spark, posts):
    keywords = sorted({"".join(RNG.choice("abcde\u00e4 ") for _ in range(RNG.randint(3, 5))) for _ in range(9000)})[:5000]
    hits = keyword_index.keyword_hits(posts.select("post_id", "title"), table(spark, keywords))
    found = sorted((r.post_id, r.keyword) for r in hits.collect())
    patterns = [(k, re.compile(k, re.I)) for k in keywords]
    expected = sorted((i, k) for i, t in enumerate(TITLES) for k, p in patterns if t and p.search(t))
    assert found == expected and len(found) > 1000


def test_plan_does_not_grow_with_the_keywords(spark, posts, tmp_path):
    sizes = []
    for n in (5, 5000):
        path = f"{tmp_path}/words"
        spark.range(n).select(F.concat(F.lit("word"), "id").alias("keyword")).write.mode("overwrite").parquet(path)
        plan = trends.keyword_index_trend(posts, spark.read.parquet(path))._jdf.queryExecution().optimizedPlan().toString()
        sizes.append(plan.count("\n"))
    assert sizes[0] == sizes[1]


def test_no_keywords_and_no_posts(spark, posts):
    assert trends.keyword_index_trend(posts, table(spark, [])).collect() == []
    assert trends.keyword_index_trend(posts.where("false"), table(spark, ["hot", "a.b"])).collect() == []
