import datetime as dt
import random
from collections import defaultdict

import pytest

from postscope.operators import co_sharing

SCHEMA = "post_id bigint, author string, timestamp timestamp_ntz, title string, selftext string, url string, author_load int"
START = dt.datetime(1969, 12, 31, 12)
HOUR = 3600


def some_posts():
    rng = random.Random(11)
    rows = []
    for i in range(700):
        # one link that half of all posts hold, some common tags, and a tail
        tags = " ".join(f"#t{min(int(rng.expovariate(0.15)), 40)}" for _ in range(rng.randint(0, 2)))
        url = "https://hot.example/" if rng.random() < 0.5 else f"https://l.example/{rng.randint(0, 60)}"
        author = "bot" if rng.random() < 0.3 else f"a{rng.randint(0, 60)}"
        at = START + dt.timedelta(seconds=rng.randint(0, 48) * 1800)
        rows.append((i, author, at, tags, "see", url, 1))
    rows += rows[:20]
    rows += [(900, None, START, "#t1 #t2", None, None, 1), (901, "late", None, "#t1 #t2", "", "https://hot.example/", 1)]
    rows += [(902, "", START, "#t1 #t0", None, "https://hot.example/", None), (903, "blank", START, None, None, None, 1)]
    return rows


def brute(rows, seconds, min_items):
    shares = defaultdict(set)
    for _, author, at, title, _, url, _ in rows:
        if author is None or at is None:
            continue
        for item in {t.lower() for t in (title or "").split()} | ({url} if url else set()):
            shares[item].add((author, at))
    met = defaultdict(set)
    for item, held in shares.items():
        for a, s in held:
            for b, t in held:
                if a < b and abs((s - t).total_seconds()) <= seconds:
                    met[a, b].add(item)
    return sorted((a, b, len(items)) for (a, b), items in met.items() if len(items) >= min_items)


@pytest.mark.parametrize("seconds, min_items, block", [(HOUR, 1, 1000), (HOUR, 2, 7), (1800, 2, 1000), (5 * HOUR, 4, 3), (1, 2, 2)])
def test_equal_to_all_pairs(spark, monkeypatch, seconds, min_items, block):
    monkeypatch.setattr(co_sharing, "BLOCK_ROWS", block)
    rows = some_posts()
    posts = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = co_sharing.co_sharing_accounts(posts, None, seconds, min_items).collect()
    assert sorted(map(tuple, found)) == brute(rows, seconds, min_items) and found


def test_window_is_inclusive_and_repeats_count_once(spark):
    at = dt.datetime(2024, 5, 1, 0, 59, 59, 999_999)
    rows = [(i, author, at + shift, "#x #y", None, None, 1) for i, (author, shift) in enumerate([
        ("a", dt.timedelta()), ("b", dt.timedelta(hours=1)), ("b", dt.timedelta(hours=1)),
        ("c", dt.timedelta(hours=1, microseconds=1))])]
    found = co_sharing.co_sharing_accounts(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, found)) == [("a", "b", 2), ("b", "c", 2)]


def test_a_hot_item_makes_no_pairs_of_accounts_without_another(spark):
    """Five hundred accounts share one link at once; only two of them share anything else."""
    rows = [(i, f"a{i:03}", START, "#z" if i < 2 else "", None, "https://hot.example/", 1) for i in range(500)]
    shares = co_sharing.share_cells(spark.createDataFrame(rows, SCHEMA), None, HOUR * 1_000_000)
    pairs = co_sharing._candidates(co_sharing._leading(shares, 2), HOUR * 1_000_000)
    assert [tuple(r) for r in pairs.collect()] == [("a000", "a001")]


def test_empty_and_wrong_parameters(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert co_sharing.co_sharing_accounts(empty).collect() == []
    with pytest.raises(ValueError):
        co_sharing.co_sharing_accounts(empty, window_seconds=0)
    with pytest.raises(ValueError):
        co_sharing.co_sharing_accounts(empty, min_items=0)


def test_pairs_that_meet_rarely_but_share_much_are_counted_from_their_meetings(spark, monkeypatch):
    """Thirty accounts, each pair close in time at few of a hundred items: nothing is looked up pair by pair."""
    rows = [(100 * a + i, f"a{a:02}", START + dt.timedelta(hours=3 * ((a * i) % 29)), f"#i{i}", None, None, 1)
            for a in range(30) for i in range(100)]
    monkeypatch.setattr(co_sharing, "_verified", lambda *_: pytest.fail("pairs were looked up"))
    posts = spark.createDataFrame(rows, SCHEMA)
    found = co_sharing.co_sharing_accounts(posts, None, HOUR, 2).collect()
    assert sorted(map(tuple, found)) == brute(rows, HOUR, 2) and len(found) == 435


@pytest.mark.parametrize("looked_up", [True, False])
def test_both_ways_to_count_agree(spark, monkeypatch, looked_up):
    rows = some_posts()
    monkeypatch.setattr(co_sharing, "FEWER_MEETINGS", 0)
    monkeypatch.setattr(co_sharing, "_unfolded", lambda *_: 0.0 if looked_up else float("inf"))
    found = co_sharing.co_sharing_accounts(spark.createDataFrame(rows, SCHEMA), None, HOUR, 2).collect()
    assert sorted(map(tuple, found)) == brute(rows, HOUR, 2) and found
