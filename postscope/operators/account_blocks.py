"""Pairs of accounts counted where blocks of accounts meet, so that no pair and no meeting is moved."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postscope.scratch import written

#: Accounts and shares of a block, on average at most. Two blocks have a table of counts with the square of the accounts.
BLOCK_ACCOUNTS = 2_000
BLOCK_SHARES = 1_000_000
#: Pairs of blocks for each core, at least where there are accounts enough.
CELLS_PER_CORE = 4

#: Packed blocks go to Python tasks in batches of about so many bytes, unless the session says otherwise.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"

#: Meetings and results worked on at once, and meetings of an item that are worth a turn of their own.
STEP = 1 << 18
FEW = 4_096

#: A group and a time within it are one number below this.
NUMBERS = 1 << 62

_ARRAYS = ("keys", "cells", "sizes", "accounts", "firsts", "lasts")


def block_number(accounts: int, shares: int, cores: int) -> int:
    """How many blocks accounts are dealt to."""
    least = math.ceil(math.sqrt(2 * CELLS_PER_CORE * cores))
    wanted = max(-(-accounts // BLOCK_ACCOUNTS), -(-shares // BLOCK_SHARES), least)
    return max(1, min(accounts, wanted))


def block_work(accounts: int, shares: int, meetings: float, blocks: int) -> float:
    """The work of ``pairs_of_blocks`` in rows moved by a shuffle, of which each costs two to three microseconds.

    Every block is read once for each other, every pair of accounts has a place in a table, and
    a meeting is a place looked up, in some twenty nanoseconds.
    """
    return shares * blocks / 16 + accounts**2 / 256 + meetings / 128


def pairs_of_blocks(shares: DataFrame, window: int, min_items: int, blocks: int) -> DataFrame:
    """``(author, other, items)``: pairs with at least ``min_items`` common items close in time.

    ``shares`` as of ``share_cells``. Accounts are dealt to blocks, each is written once as one
    row of packed numbers, and each meets each other in one task, which counts the items of
    their pairs in a table of its own. What is written grows with the shares; blocks are read
    as often as there are blocks, and only results leave the tasks.
    """
    spark = shares.sparkSession
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))  # a row is some MB; the JVM holds a batch several times outside its heap
    author = shares.schema["author"].dataType
    fields = [T.StructField("block", T.IntegerType()), T.StructField("names", T.ArrayType(author))]
    fields += [T.StructField(name, T.BinaryType()) for name in _ARRAYS]
    dealt = shares.select("author", "key", "cell", "first", "last").repartition(blocks, "author")
    packed = dealt.sortWithinPartitions("key", "cell", "first").mapInArrow(_packed(window), T.StructType(fields))
    packed = written(packed, "account-blocks")
    left, right = (packed.select([F.col(c).alias(f"{side}_{c}") for c in packed.columns]) for side in ("left", "right"))
    # Neither side is sent or shuffled: a task reads some blocks of both.
    met = left.hint("shuffle_replicate_nl").join(right, F.col("left_block") <= F.col("right_block"))
    result = [T.StructField("author", author), T.StructField("other", author), T.StructField("items", T.LongType(), False)]
    return met.mapInArrow(_counted(window, min_items), T.StructType(result))


def _packed(window: int):
    """The shares of a task as one row."""

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        held = [batch for batch in batches if batch.num_rows]
        if held:
            yield _row(pa.Table.from_batches(held), TaskContext.get().partitionId(), window)

    return pack


def _row(shares, block: int, window: int):
    """The shares of one block, sorted by item, cell and time, as a row of numbers; accounts are numbered by name."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    names = shares.column("author").unique()
    names = names.take(pc.sort_indices(names))
    account = pc.index_in(shares.column("author"), names).to_numpy()
    key, cell, first, last = (shares.column(c).to_numpy() for c in ("key", "cell", "first", "last"))
    start = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])])
    size = np.diff(start, append=len(key))
    arrays = key[start], cell[start], size, account, first - cell * window, last - cell * window
    row = [pa.array([block], pa.int32()), pa.ListArray.from_arrays([0, len(names)], names)]
    row += [pa.array([a.astype(np.int32 if c == "accounts" else np.int64).tobytes()]) for c, a in zip(_ARRAYS, arrays)]
    return pa.RecordBatch.from_arrays(row, names=["block", "names", *_ARRAYS])


class _Block:
    """The shares of some accounts: groups of one item and cell, by both, and in each the shares by their first time."""

    def __init__(self, row, side: str, i: int):
        import numpy as np

        def numbers(name, kind=np.int64):
            return np.frombuffer(row.column(f"{side}_{name}")[i].as_buffer(), kind)

        self.number = row.column(f"{side}_block")[i].as_py()
        self.names = row.column(f"{side}_names")[i].values
        self.keys, self.cells, self.sizes = numbers("keys"), numbers("cells"), numbers("sizes")
        self.accounts = numbers("accounts", np.int32).astype(np.int64)
        self.firsts, self.lasts = numbers("firsts"), numbers("lasts")
        self.start = np.r_[0, np.cumsum(self.sizes)]


class _Met:
    """For each share of ``one`` the shares of ``two`` that it meets as the earlier one: from ``low`` on, ``many`` of them.

    Those of its own cell are among them unless ``later`` asks for the next cell only; of that
    one, the shares whose first time lies no further into it than the last one into the own cell.
    """

    def __init__(self, one, two, items, groups, window: int, later: bool):
        import numpy as np

        def found(wanted):
            at = np.searchsorted(theirs, wanted)
            return at, theirs[np.minimum(at, len(theirs) - 1)] == wanted

        mine, theirs = groups
        same, has_same = found(mine)
        next_, has_next = found(mine + 1)
        if later:
            has_same = np.zeros_like(has_same)
        first, last, width = two.firsts, one.lasts, window
        if len(theirs) * width >= NUMBERS:  # times by their order instead
            times, order = np.unique(np.r_[first, last], return_inverse=True)
            first, last, width = order[: len(first)], order[len(first) :], len(times)
        placed = np.repeat(np.arange(len(theirs)), two.sizes) * width + first
        has_next_share = np.repeat(has_next, one.sizes)
        reach = (np.repeat(next_, one.sizes) * width + last)[has_next_share]
        # The next cell of an item lies right behind the own one.
        low = np.where(has_same, two.start[same], two.start[next_])
        high = np.where(has_same, two.start[np.minimum(same + 1, len(theirs))], low)
        self.low, high = np.repeat(low, one.sizes), np.repeat(high, one.sizes)
        high[has_next_share] = np.searchsorted(placed, reach, side="right")
        self.many = high - self.low
        self.before = np.r_[0, np.cumsum(self.many)]
        self.own, self.others = one.accounts, two.accounts
        self.items = np.repeat(items, one.sizes)

    def steps(self, begin: int, end: int):
        """Meetings of the shares from ``begin`` to ``end``, some at a time: ``(share, account, other account)``."""
        import numpy as np

        while begin < end:
            stop = int(np.searchsorted(self.before, self.before[begin] + STEP, side="right")) - 1
            stop = min(max(stop, begin + 1), end)
            many = self.many[begin:stop]
            total = int(self.before[stop] - self.before[begin])
            if total:
                shift = self.low[begin:stop] - (self.before[begin:stop] - self.before[begin])
                other = self.others[np.arange(total) + np.repeat(shift, many)]
                yield begin, many, self.own[begin:stop], other
            begin = stop


def _counts(left: _Block, right: _Block, window: int):
    """How many items each account of ``left`` shared close in time with each one of ``right``."""
    import numpy as np

    alone = left.number == right.number
    keys = np.unique(np.r_[left.keys, right.keys])
    low = min(left.cells.min(), right.cells.min())
    span = max(left.cells.max(), right.cells.max()) - low + 2
    items = [np.searchsorted(keys, block.keys) for block in (left, right)]
    groups = [item * span + (block.cells - low) for item, block in zip(items, (left, right))]
    columns = len(right.names)
    places = len(left.names) * columns
    counts = np.zeros(places, np.int32)

    sides = [(_Met(left, right, items[0], groups, window, False), columns, 1)]
    if not alone:
        sides.append((_Met(right, left, items[1], groups[::-1], window, True), 1, columns))
    # The first share of each item, and behind the last one.
    edges = [np.searchsorted(met.items, np.arange(len(keys) + 1)) for met, _, _ in sides]
    totals = sum(np.diff(met.before[edge]) for (met, _, _), edge in zip(sides, edges))

    def codes(begin: int, end: int, numbered: bool):
        """Places in the table of the meetings of some items, with the number of the item in front if asked for."""
        for (met, by_own, by_other), edge in zip(sides, edges):
            for first, many, own, other in met.steps(int(edge[begin]), int(edge[end])):
                if alone:
                    own = np.repeat(own, many)
                    code = np.minimum(own, other) * columns + np.maximum(own, other)
                else:
                    code = np.repeat(own * by_own, many) + (other * by_other if by_other > 1 else other)
                if numbered:
                    code += np.repeat((met.items[first : first + len(many)] - begin) * places, many)
                yield code[own != other] if alone else code

    # Items with many meetings mark the table, the others are sorted some at a time.
    marked = np.zeros(places, bool)
    much = totals > max(places // 16, FEW)
    for item in np.flatnonzero(much):
        marked[:] = False
        for code in codes(item, item + 1, False):
            marked[code] = True
        counts += marked
    # Runs of the others with about one step of meetings; an item is in one run.
    step = np.cumsum(np.where(much, 0, totals)) // STEP
    cut = np.flatnonzero(np.r_[True, (step[1:] != step[:-1]) | much[1:] | much[:-1], True])
    for begin, end in zip(cut[:-1], cut[1:]):
        if not much[begin] and totals[begin:end].any():
            code = np.sort(np.concatenate([*codes(begin, end, True)] or [np.zeros(0, np.int64)]))
            once = code[np.r_[True, code[1:] != code[:-1]]] if len(code) else code
            np.add.at(counts, once % places, 1)
    return counts.reshape(-1, columns)


def _counted(window: int, min_items: int):
    """Of pairs of packed blocks: the pairs of accounts with at least ``min_items`` items, the smaller name first."""

    def count(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        left = right = None
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = _Block(batch, "left", i), _Block(batch, "right", i)
                counts = _counts(left, right, window)
                names = pa.concat_arrays([left.names, right.names])
                place = np.empty(len(names), np.int64)
                place[pc.sort_indices(names).to_numpy()] = np.arange(len(names))
                rows = max(1, STEP // max(1, counts.shape[1]))
                for begin in range(0, counts.shape[0], rows):
                    own, other = np.nonzero(counts[begin : begin + rows] >= min_items)
                    if not len(own):
                        continue
                    items = counts[begin + own, other].astype(np.int64)
                    own, other = begin + own, len(left.names) + other
                    swapped = place[own] > place[other]
                    pair = np.where(swapped, other, own), np.where(swapped, own, other)
                    yield pa.RecordBatch.from_arrays(
                        [*(names.take(pa.array(side)) for side in pair), pa.array(items)], names=["author", "other", "items"]
                    )

    return count
