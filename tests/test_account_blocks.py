import datetime as dt

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_co_sharing import HOUR, SCHEMA, START, brute, some_posts

from postscope.operators import account_blocks, co_sharing


def test_meetings_of_many_accounts_are_not_moved(spark, monkeypatch):
    """Twelve hundred accounts share two tags within an hour: each pair meets twice, and no meeting is shuffled."""
    monkeypatch.setattr(co_sharing, "_meetings", lambda *_: pytest.fail("meetings were moved"))
    rows = [(i, f"a{i:04}", START + dt.timedelta(seconds=i), "#x #y", None, None, 1) for i in range(1200)]
    found = co_sharing.co_sharing_accounts(spark.createDataFrame(rows, SCHEMA), None, HOUR, 2)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    pairs = found.agg(
        F.count(F.lit(1)), F.count_distinct("author", "other"), F.min("items"), F.max("items"),
        F.bool_and(F.col("author") < F.col("other")),
    ).first()
    assert tuple(pairs) == (1200 * 1199 // 2, 1200 * 1199 // 2, 2, 2, True)


@pytest.mark.parametrize("seconds, min_items, accounts", [(HOUR, 1, 2000), (HOUR, 2, 9), (1, 2, 20), (5 * HOUR, 4, 5)])
def test_blocks_have_all_pairs(spark, monkeypatch, seconds, min_items, accounts):
    monkeypatch.setattr(co_sharing, "MOVED_MEETINGS", -1)
    monkeypatch.setattr(co_sharing, "block_work", lambda *_: 0.0)
    monkeypatch.setattr(account_blocks, "BLOCK_ACCOUNTS", accounts)
    rows = some_posts()
    posts = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = co_sharing.co_sharing_accounts(posts, None, seconds, min_items)
    assert "CartesianProduct" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, found.collect())) == brute(rows, seconds, min_items)


def pairs_of_rows(rows, seconds, min_items, blocks):
    """The two kernels without Spark, authors dealt to blocks by the length of their names and last letter."""
    window = seconds * 1_000_000
    shares = {}
    for _, author, at, title, _, url, _ in rows:
        if author is not None and at is not None:
            micros = (at - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1)
            for item in {t.lower() for t in (title or "").split()} | ({url} if url else set()):
                shares.setdefault((author, item, micros // window), []).append(micros)
    number = {item: 3 * n for n, item in enumerate(sorted({item for _, item, _ in shares}))}
    dealt = {}
    for (author, item, cell), times in shares.items():
        block = (len(author) + sum(map(ord, author[-1:]))) % blocks
        dealt.setdefault(block, []).append((number[item], cell, min(times), max(times), author))
    packed = []
    for block, held in dealt.items():
        held.sort()
        columns = dict(zip(("key", "cell", "first", "last", "author"), map(list, zip(*held))))
        packed.append(account_blocks._row(pa.table(columns), block, window))
    met = [
        pa.RecordBatch.from_arrays(
            [*one.columns, *two.columns], names=[f"{side}_{c}" for side in ("left", "right") for c in one.schema.names]
        )
        for one in packed for two in packed if one.column("block")[0].as_py() <= two.column("block")[0].as_py()
    ]
    found = [tuple(r.values()) for batch in account_blocks._counted(window, min_items)(met) for r in batch.to_pylist()]
    assert len(found) == len(set(found))
    return sorted(found)


@pytest.mark.parametrize("seconds, min_items, blocks", [(HOUR, 1, 1), (HOUR, 2, 4), (1800, 2, 9), (1, 2, 3), (5 * HOUR, 4, 2), (10**9, 1, 3)])
@pytest.mark.parametrize("step, few, numbers", [(1 << 18, 4096, 1 << 62), (5, 0, 1 << 62), (5, 4096, 0), (1, 60, 0), (1 << 18, 0, 0)])
def test_steps_runs_and_times_by_order(monkeypatch, seconds, min_items, blocks, step, few, numbers):
    """Items alone or in runs, a few meetings at a time, and times by their order have one result."""
    for name, value in (("STEP", step), ("FEW", few), ("NUMBERS", numbers)):
        monkeypatch.setattr(account_blocks, name, value)
    rows = some_posts()
    assert pairs_of_rows(rows, seconds, min_items, blocks) == brute(rows, seconds, min_items)


def test_names_in_their_order_and_shares_at_the_edge_of_the_window():
    """Names are compared as bytes; shares exactly a window apart meet, a microsecond more do not, before 1970 too."""
    edge = dt.datetime(1969, 12, 31, 23, 59, 59, 999_999)
    rows = [
        (1, "é", edge, "#x #y", None, None, 1), (2, "z", edge + dt.timedelta(hours=1), "#x #y", None, None, 1),
        (3, "Z", edge + dt.timedelta(hours=1, microseconds=1), "#x", None, None, 1), (4, "", edge, "#x", None, None, 1),
        (5, "\U0001f600", edge, "#x", None, None, 1), (6, "～", edge, "#x", None, None, 1),
    ]
    for blocks in (1, 2, 5):
        found = pairs_of_rows(rows, HOUR, 1, blocks)
        assert found == brute(rows, HOUR, 1)
        assert ("z", "é", 2) in found and ("～", "\U0001f600", 1) in found and ("Z", "é", 1) not in found


def test_block_numbers():
    assert account_blocks.block_number(0, 0, 8) == 1
    assert account_blocks.block_number(3, 100, 8) == 3
    assert account_blocks.block_number(90_000, 10, 8) == 45
    assert account_blocks.block_number(5_000, 90_000_000, 8) == 90


def test_batches_of_blocks_are_bounded_unless_the_session_bounds_them(spark):
    setting = account_blocks.BATCH_SETTING
    before = spark.conf.get(setting, None)
    shares = spark.createDataFrame([("a", 1, 0, 5, 5), ("b", 1, 0, 6, 6)], "author string, key long, cell long, first long, last long")
    try:
        spark.conf.set(setting, "1234567")
        found = account_blocks.pairs_of_blocks(shares, HOUR, 1, 2).collect()
        assert [tuple(r) for r in found] == [("a", "b", 1)] and spark.conf.get(setting) == "1234567"
        spark.conf.unset(setting)
        account_blocks.pairs_of_blocks(shares, HOUR, 1, 2)
        assert spark.conf.get(setting) == str(account_blocks.BATCH_BYTES)
    finally:
        spark.conf.unset(setting)
        if before is not None:
            spark.conf.set(setting, before)
