"""Edge cases of trends, rankings, classes, network, briefing and reports."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from postscope import fixed_values as fv
from postscope.functions.classify import categorize_domain, detect_media_type
from postscope.operators import briefing, network, rankings, reports, trends

SCHEMA = (
    "post_id bigint, timestamp timestamp_ntz, author string, subreddit string, title string, "
    "score bigint, comments bigint, url string, domain string, similarity_score double, "
    "sent_label string"
)


def post(i, time="2024-01-01 12:00:00", author="a", subreddit="s", title="t", score=1, comments=1,
         url=None, domain=None, similarity=0.0, label="neutral"):
    return (i, dt.datetime.fromisoformat(time), author, subreddit, title, score, comments, url,
            domain, similarity, label)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def test_weeks_at_year_end_stay_two_rows(spark):
    posts = frame(spark, [post(1, "2017-12-31 10:00:00"), post(2, "2018-01-01 10:00:00"),
                          post(3, "2019-01-01 10:00:00")])
    rows = [tuple(r) for r in trends.posts_by_week(posts).collect()]
    sunday = dt.date(2017, 12, 31)
    assert rows == [("2017-53", sunday, 1), ("2018-00", sunday, 1),
                    ("2019-00", dt.date(2018, 12, 30), 1)]


def test_granularity(spark):
    posts = frame(spark, [post(1)])
    assert trends.aggregate_time(posts, "Month").first().year_month == "2024-01"
    assert trends.aggregate_time(posts.limit(0), "Week").count() == 0
    with pytest.raises(ValueError):
        trends.aggregate_time(posts, "Year")


def test_peak_and_trough_take_the_earliest_and_bear_emptiness(spark):
    posts = frame(spark, [post(1, "2024-01-02 00:00:00"), post(2, "2024-01-01 00:00:00")])
    row = trends.peak_and_trough(posts).first()
    assert row.peak_date == row.trough_date == dt.date(2024, 1, 1)
    assert trends.peak_day(posts).first().date == dt.date(2024, 1, 1)
    assert tuple(trends.peak_and_trough(posts.limit(0)).first()) == (None, 0, None, 0)


def test_weekdays_without_posts_are_null(spark):
    rows = trends.weekday_rhythm(frame(spark, [post(1), post(2)])).collect()
    assert [r.day for r in rows] == list(fv.WEEKDAYS)
    assert [r.posts for r in rows] == [2] + [None] * 6


def test_keyword_trend_fills_gaps_and_skips_absent_words(spark):
    posts = frame(spark, [
        post(1, "2024-01-07 23:59:59.500000", title="Big ÉTÉ news"),
        post(2, "2024-01-22 00:00:00", title="été"),
        post(3, "2024-01-22 00:00:00", title=None),
    ])
    rows = [(str(r.week), r.keyword, r.posts)
            for r in trends.keyword_weekly_trend(posts, ["été", "absent", "été"]).collect()]
    assert rows == [("2024-01-07", "été", 1), ("2024-01-14", "été", 0),
                    ("2024-01-21", "été", 0), ("2024-01-28", "été", 1)]
    empty = trends.keyword_weekly_trend(posts, [])
    assert empty.columns == ["week", "keyword", "posts"] and empty.count() == 0


def test_null_keys_are_not_counted(spark):
    posts = frame(spark, [post(1, author=None, subreddit=None), post(2), post(3)])
    assert [tuple(r) for r in rankings.subreddit_counts(posts).collect()] == [("s", 2)]
    assert [tuple(r) for r in network.top_authors(posts).collect()] == [("a", 2)]
    assert trends.posts_by_day_subreddit(posts).agg(F.sum("posts")).first()[0] == 2
    assert rankings.community_share(posts).first().share == 1.0
    assert tuple(rankings.dataset_overview(posts).first()) == (3, 1, 1, 0)
    assert tuple(rankings.dataset_overview(posts, approximate=True).first()) == (3, 1, 1, 0)
    assert tuple(rankings.dataset_overview(posts.limit(0)).first()) == (0, 0, 0, 0)


def test_ties_rank_by_name(spark):
    posts = frame(spark, [post(1, author="b", subreddit="y"), post(2, author="a", subreddit="x")])
    assert [r.subreddit for r in rankings.top_subreddits(posts).collect()] == ["x", "y"]
    assert [r.author for r in network.top_authors(posts, 1).collect()] == ["a"]


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_percentiles_equal_linear_interpolation(spark, size):
    rng = np.random.default_rng(size)
    scores = [int(x) for x in rng.integers(-5_000, 50_000, size)]
    scores[: size // 3] = [777] * (size // 3)  # a third of all scores are equal
    posts = spark.createDataFrame([(s,) for s in scores], "score bigint")
    row = rankings.score_stats(posts).first()
    assert row.median_score == pytest.approx(np.median(scores))
    assert row.p90_score == pytest.approx(np.percentile(scores, 90))
    assert row.avg_score == pytest.approx(np.mean(scores))
    if size == 1:
        assert row.score_std is None
    else:
        assert row.score_std == pytest.approx(np.std(scores, ddof=1))


def test_fractional_percentiles_by_radix_selection(spark):
    """Equal to the built-in percentile over signs, sizes, ties, infinities, nulls and one value."""
    rng = np.random.default_rng(6)
    wide = [float(x) for x in rng.standard_normal(3000) * 10.0 ** rng.integers(-300, 300, 3000)]
    sets = [wide, [0.1] * 500 + [-0.0, 0.0, 0.30000000000000004, 0.3], [5e-324, -5e-324], [2.5], [1.5, None, -1.5, None], [float("inf"), 1.0, -7.25]]
    points = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.9, "e": 1.0}
    for values in sets:
        posts = spark.createDataFrame([(v,) for v in values], "score double").repartition(3)
        wanted = posts.agg(*[F.percentile("score", F.lit(p)).alias(n) for n, p in points.items()]).first()
        assert rankings.exact_percentiles(posts, "score", points).first() == wanted
    empty = spark.createDataFrame([(None,)], "score double")
    assert tuple(rankings.exact_percentiles(empty, "score", points).first()) == (None,) * 5
    nan = spark.createDataFrame([(1.0,), (float("nan"),), (2.0,)], "score float")
    assert rankings.exact_percentiles(nan, "score", {"m": 0.5}).first().m == 2.0


def test_sharing_network_survives_any_link(spark):
    """Links of 100,000 characters, brackets and marks, each in one post, which ended the session once."""
    texts = ["https://a.b/" + "x" * 100_000, "http://a.b/" + "(y)" * 50_000, "http://c.d/" + "." * 100_000 + " (http://e.f/g)(http://h.i/j_(k)),"]
    posts = frame(spark, [post(i, title=t, url=None) for i, t in enumerate([*texts, "http://(", "http://x(y)z(", "http://x)http://w"])])
    items = {r.item for r in reports.sharing_network(posts.withColumn("selftext", F.lit(""))).collect()}
    assert items == {*texts[:2], "http://c.d/", "http://e.f/g", "http://h.i/j_(k)", "http://x(y)z", "http://x", "http://w"}


def test_score_stats_without_posts_are_zero(spark):
    posts = spark.createDataFrame([], "score bigint")
    assert [float(x) for x in rankings.score_stats(posts).first()] == [0.0] * 6
    assert [float(x) for x in rankings.score_stats(posts, approximate=True).first()] == [0.0] * 6


def test_composition_clamps_negative_sizes_and_has_two_levels(spark):
    posts = frame(spark, [post(1, score=-9, comments=-9, domain="self.x"),
                          post(2, score=4, comments=2, domain=None)])
    rows = {(r.subreddit, r.category): (r.level, r.posts, r.score_size, r.comments_size)
            for r in rankings.content_composition(posts).collect()}
    assert rows == {("s", fv.CATEGORY_SELF): (0, 1, 1, 1), ("s", fv.CATEGORY_OTHER): (0, 1, 5, 3),
                    ("s", None): (1, 2, 6, 4)}
    plain = posts.drop("domain")
    assert {r.category for r in rankings.with_category(plain).collect()} == {fv.CATEGORY_SELF}


def test_controversy_defaults_and_clamps(spark):
    posts = frame(spark, [post(1, score=-3, comments=100)])
    row = rankings.controversy_points(posts).first()
    assert (row.upvote_ratio, row.log_score, row.log_comments, row.colour) == (1.0, None, 2.0, 1.0)
    low = rankings.controversy_points(posts.withColumn("upvote_ratio", F.lit(0.2))).first()
    assert (low.upvote_ratio, low.colour) == (0.2, 0.5)


def test_viral_post_ties_follow_search_order(spark):
    posts = frame(spark, [post(1, score=5, similarity=0.1), post(2, score=5, similarity=0.9)])
    assert rankings.viral_post(posts).first().post_id == 2
    assert rankings.viral_post(posts.drop("similarity_score")).first().post_id == 1


def test_every_class_of_domain_and_link(spark):
    domains = {"self.news": "Original Discussion", "old.reddit.com": "Original Discussion",
               "v.redd.it": "Image/Media", "I.IMGUR.com": "Image/Media", "youtu.be": "Video",
               " twitch.tv ": "Video", "netflix.com": "Social Media", "m.facebook.com":
               "Social Media", "example.org": "External Link / News", None: "External Link / News"}
    rows = spark.createDataFrame([(d,) for d in domains], "d string")
    found = {r.d: r.c for r in rows.select("d", categorize_domain(F.col("d")).alias("c")).collect()}
    assert found == domains
    links = {"https://a.b/C.PNG": "Image", "https://imgur.com/x": "Image", "v.redd.it/1": "Video",
             "https://youtube.com": "Video", "https://reddit.com/r/a/comments/1": "Text/Discussion",
             "https://reddit.com/r/a": "Link/Article", None: "Link/Article"}
    rows = spark.createDataFrame([(u,) for u in links], "u string")
    found = {r.u: r.c for r in rows.select("u", detect_media_type(F.col("u")).alias("c")).collect()}
    assert found == links


def test_network_sizes(spark):
    posts = frame(spark, [post(1, author="a", subreddit="x"), post(2, author="b", subreddit="x"),
                          post(3, author="a", subreddit="y"), post(4, author="a", subreddit="x"),
                          post(5, author="a", subreddit=None)])
    edges = network.network_edges(posts)
    assert {tuple(r) for r in edges.collect()} == {("a", "x", 2), ("b", "x", 1), ("a", "y", 1)}
    nodes = {r.node: (r.node_type, r.size) for r in network.network_nodes(edges).collect()}
    assert nodes == {"a": ("Author", 10.0), "b": ("Author", 10.0), "x": ("Subreddit", 23.0),
                     "y": ("Subreddit", 21.5)}
    assert tuple(network.network_counts(edges).first()) == (2, 2, 3)
    assert network.semi_join_top_authors(posts, 1).count() == 4


def test_briefing_of_nothing(spark):
    nothing = frame(spark, [])
    facts = briefing.briefing_facts(nothing).first()
    assert (facts.total, facts.start_date, facts.peak_posts, facts.top_subreddits) == (0, None, 0, [])
    context = briefing.suggestion_context(nothing).first()
    assert (context.titles, context.subreddits) == ([], [])
    prompt = briefing.render_chat_prompt(briefing.chat_context(nothing), "why?").first().prompt
    assert fv.NO_DATA in prompt and prompt.endswith("Question: why?")
    assert "n/a" in briefing.render_briefing_prompt(briefing.briefing_facts(nothing), "q").first()[0]


def test_suggestions(spark):
    rows = [(" a |b|\nc\n|d", True), ("one", True), (None, True), ("x", False)]
    replies = spark.createDataFrame(rows, "reply string, has boolean")
    found = [r.questions for r in briefing.parse_suggestions(replies, has_posts="has").collect()]
    assert found == [["a", "b", "c"], ["one"], list(fv.QUESTIONS_WHEN_FAILED),
                     list(fv.QUESTIONS_WHEN_EMPTY)]


def test_context_links(spark):
    rows = [("a b", "2024-03-01"), ("q", None), ("q", "None")]
    peaks = spark.createDataFrame(rows, "query string, peak_date string")
    first, *blank = briefing.context_links(peaks).collect()
    assert "q=a+b&" in first.news_url
    assert "cd_min:02/29/2024,cd_max:03/02/2024" in first.news_url
    assert first.encyclopedia_url.endswith("/March_2024")
    assert all((r.news_url, r.encyclopedia_url) == ("", "") for r in blank)


def test_sharing_network_counts_each_item_once_per_post(spark):
    posts = frame(spark, [post(1, title="#Tag #tag see https://a.b/c", url="https://a.b/c"),
                          post(2, title="storm", author="b")]).withColumn("selftext", F.lit(""))
    rows = {tuple(r) for r in reports.sharing_network(posts, ["Storm"]).collect()}
    assert rows == {("a", "hashtag", "#tag", 1), ("a", "url", "https://a.b/c", 1),
                    ("b", "keyword", "Storm", 1)}


def test_metadata_is_written(spark, tmp_path):
    posts = frame(spark, [post(i, score=i) for i in range(30)])
    reports.write_metadata(posts, str(tmp_path / "meta"))
    top = spark.read.json(str(tmp_path / "meta" / "top_posts"))
    assert top.count() == 10 and top.agg(F.min("score")).first()[0] == 20
    days = spark.read.option("header", True).csv(str(tmp_path / "meta" / "daily_counts_csv"))
    assert [tuple(r) for r in days.collect()] == [("2024-01-01", "30")]


def test_hashtags_are_sought_from_their_mark(spark):
    assert reports.HASHTAG.startswith("#")
    text = "#a b#c \u3000#d (#e ##f \U0001F600#g #h#i\x85#j"
    posts = spark.createDataFrame([(1, "u", None, text, None)], "post_id int, author string, title string, selftext string, url string")
    assert {r.item for r in reports.sharing_network(posts).collect()} == {"#a", "#d", "#h", "#j"}
