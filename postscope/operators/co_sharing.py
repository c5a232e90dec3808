"""Accounts that share the same items at nearly the same time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from postscope.operators.account_blocks import block_number, block_work, pairs_of_blocks
from postscope.operators.reports import shared_items
from postscope.scratch import written

#: Accounts of one item and stretch of time that one task compares with as many others at a time.
BLOCK_ROWS = 1_000

#: Pairs are taken from leading items first if all items would make more than so many times their meetings.
FEWER_MEETINGS = 4

#: Up to so many meetings are moved by a shuffle; of more, blocks of accounts are compared where that is less work.
MOVED_MEETINGS = 1_000_000


def share_cells(posts: DataFrame, keywords: list[str] | None, window: int) -> DataFrame:
    """``(author, key, cell, first, last)``: who shared which item in which cell of time, in microseconds.

    Cells are as long as the window, so two shares of a cell are close, and of two in adjacent
    cells the last of the earlier and the first of the later one tell. Repeated shares are one
    row. Items of a single author, most links of a corpus, are left out, the others numbered.
    """
    shares = (
        shared_items(posts.filter(F.col("timestamp").isNotNull()), keywords, ("timestamp",))
        .select(
            "author",
            F.unhex(F.md5(F.concat_ws(" ", "kind", "item"))).alias("key"),
            F.unix_micros(F.col("timestamp").cast("timestamp")).alias("at"),
        )
        .withColumn("cell", F.expr(f"(at - pmod(at, {window})) div {window}"))
        .groupBy("author", "key", "cell")
        .agg(F.min("at").alias("first"), F.max("at").alias("last"))
    )
    shares = written(shares, "shares")
    common = shares.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), (F.min("author") != F.max("author")).alias("several")
    )
    numbered = common.filter("several").select("key", "n", F.monotonically_increasing_id().alias("number"))
    kept = shares.join(written(numbered, "items"), "key").drop("key").withColumnRenamed("number", "key")
    return written(kept, "common-shares")


def _leading(shares: DataFrame, min_items: int) -> DataFrame:
    """Shares but those of each author's ``min_items - 1`` most frequent items.

    Two authors with ``min_items`` common items have one of these among the leading items of
    both: items have one order for all authors, and at most ``min_items - 1`` come last.
    """
    if min_items == 1:
        return shares
    # Each task cuts its own rows of an author to this number first.
    order = Window.partitionBy("author").orderBy(F.desc("n"), "key")
    frequent = (
        shares.select("author", "key", "n").distinct()
        .withColumn("place", F.row_number().over(order))
        .filter(F.col("place") < min_items)
        .select("author", "key")
    )
    return shares.join(frequent, ["author", "key"], "left_anti")


def _sides(shares: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Shares as the earlier and as the later one of a meeting: the later one is of the slot or the cell after it."""
    earlier = shares.select("key", F.col("cell").alias("slot"), "author", F.col("last").alias("left_last"))
    later = shares.select(
        "key", F.explode(F.array("cell", F.col("cell") - 1)).alias("slot"), "cell", F.col("author").alias("other"), "first"
    )
    return earlier, later


def _sizes(earlier: DataFrame, later: DataFrame) -> DataFrame:
    return earlier.groupBy("key", "slot").agg(F.count(F.lit(1)).alias("lefts")).join(
        later.groupBy("key", "slot").agg(F.count(F.lit(1)).alias("rights")), ["key", "slot"]
    )


def _compared(shares: DataFrame) -> float:
    """How many pairs of shares a join by item and cell makes, from the sizes of the cells."""
    product = F.col("lefts").cast("double") * F.col("rights")
    return _sizes(*_sides(shares)).agg(F.sum(product).alias("n")).first().n or 0.0


def _meetings(shares: DataFrame, window: int) -> DataFrame:
    """``(author, other, key)``: who shared an item close in time, ``author`` the smaller name, with repetitions.

    A share meets those of its own cell and of the next one. The accounts of a hot item's cell
    are dealt to blocks, and each task compares one block with one other.
    """
    earlier, later = _sides(shares)
    parts = lambda n: F.ceil(F.col(n) / BLOCK_ROWS).cast("int")
    size = (
        _sizes(earlier, later)
        .filter((F.col("lefts") > BLOCK_ROWS) | (F.col("rights") > BLOCK_ROWS))
        .select("key", "slot", parts("lefts").alias("p"), parts("rights").alias("q"))
    )
    size = written(size, "hot-cells")

    def dealt(rows: DataFrame, account: str, own: str, opposite: str, names: tuple[str, str]) -> DataFrame:
        mine = F.pmod(F.xxhash64(account), F.coalesce(F.col(own), F.lit(1)))
        others = F.sequence(F.lit(0), F.coalesce(F.col(opposite), F.lit(1)) - 1)
        return (
            rows.join(size, ["key", "slot"], "left")
            .withColumns({names[0]: mine.cast("int"), names[1]: F.explode(others)})
            .drop("p", "q")
        )

    pairs = dealt(earlier, "author", "p", "q", ("i", "j")).join(
        dealt(later, "other", "q", "p", ("j", "i")), ["key", "slot", "i", "j"]
    )
    same = (F.col("cell") == F.col("slot")) & (F.col("author") < F.col("other"))
    next_ = (
        (F.col("cell") > F.col("slot"))
        & (F.col("author") != F.col("other"))
        & (F.col("first") - F.col("left_last") <= window)
    )
    return pairs.filter(same | next_).select(
        F.least("author", "other").alias("author"), F.greatest("author", "other").alias("other"), "key"
    )


def _candidates(leading: DataFrame, window: int) -> DataFrame:
    """Pairs of authors with a common leading item close in time, each once."""
    return _meetings(leading, window).select("author", "other").distinct()


def _load(shares: DataFrame) -> DataFrame:
    return shares.groupBy("author").agg(F.count(F.lit(1)).alias("shares"))


def _with_load(pairs: DataFrame, load: DataFrame) -> DataFrame:
    """Pairs with the number of shares of both accounts."""
    for name in ("author", "other"):
        pairs = pairs.join(load.select(F.col("author").alias(name), F.col("shares").alias(f"{name}_load")), name)
    return pairs


def _unfolded(pairs: DataFrame, shares: DataFrame) -> float:
    """How many shares ``_verified`` looks up: those of the account of each pair that has fewer."""
    least = F.least("author_load", "other_load").cast("double")
    return _with_load(pairs, _load(shares)).agg(F.sum(least).alias("n")).first().n or 0.0


def _verified(pairs: DataFrame, shares: DataFrame, window: int) -> DataFrame:
    """``(author, other, items)`` of pairs: all items that both shared close in time.

    The account with fewer shares is unfolded and looked up at the other one, so an account
    with very many shares is never unfolded once per partner.
    """
    pairs = _with_load(pairs, _load(shares))
    swapped = F.col("other_load") < F.col("author_load")

    def pick(yes: str, no: str) -> Column:
        return F.when(swapped, F.col(yes)).otherwise(F.col(no))

    pairs = pairs.select("author", "other", pick("other", "author").alias("light"), pick("author", "other").alias("heavy"))
    light = shares.select(
        F.col("author").alias("light"), "key", F.col("cell").alias("slot"), "first", "last"
    )
    heavy = shares.select(
        F.col("author").alias("heavy"),
        "key",
        F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("slot"),
        "cell",
        F.col("first").alias("heavy_first"),
        F.col("last").alias("heavy_last"),
    )
    gap = F.greatest(F.col("heavy_first") - F.col("last"), F.col("first") - F.col("heavy_last"))
    near = (F.col("cell") == F.col("slot")) | (gap <= window)
    met = pairs.join(light, "light").join(heavy, ["heavy", "key", "slot"]).filter(near)
    return met.groupBy("author", "other").agg(F.count_distinct("key").alias("items"))


def co_sharing_accounts(
    posts: DataFrame, keywords: list[str] | None = None, window_seconds: int = 3600, min_items: int = 2
) -> DataFrame:
    """``(author, other, items)``: accounts that shared at least ``min_items`` items close in time.

    An item (hashtag, link or keyword, as in ``sharing_network``) counts once per pair if both
    shared it no more than ``window_seconds`` apart; ``author`` is the smaller name. Posts
    without author or time are left out. An item that very many share makes pairs only among
    accounts that have ``min_items - 1`` items at least as frequent besides it; with
    ``min_items = 1`` every pair within the window is a result.

    Where that spares little, or pairs hold so many shares that looking these up would be more
    than all meetings, meetings are counted as they are; where these would be many to move, each
    block of accounts meets each other in one task. All ways have the same result.
    """
    if window_seconds < 1 or min_items < 1:
        raise ValueError("window_seconds and min_items must be positive")
    window = window_seconds * 1_000_000
    shares = share_cells(posts, keywords, window)
    meetings = _compared(shares)
    size = _load(shares).agg(F.count(F.lit(1)).alias("accounts"), F.sum("shares").alias("shares")).first()
    accounts, rows = size.accounts, size.shares or 0
    blocks = block_number(accounts, rows, shares.sparkSession.sparkContext.defaultParallelism)
    work = meetings if meetings <= MOVED_MEETINGS else min(meetings, block_work(accounts, rows, meetings, blocks))
    if min_items > 1:
        leading = _leading(shares, min_items)
        if work > FEWER_MEETINGS * _compared(leading):
            pairs = written(_candidates(leading, window), "account-pairs")
            if _unfolded(pairs, shares) <= work:
                return _verified(pairs, shares, window).filter(F.col("items") >= min_items)
    if work < meetings:
        return pairs_of_blocks(shares, window, min_items, blocks)
    counted = _meetings(shares, window).groupBy("author", "other").agg(F.count_distinct("key").alias("items"))
    return counted.filter(F.col("items") >= min_items)
