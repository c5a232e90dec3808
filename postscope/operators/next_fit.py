"""Next-fit packing in one global order, worked out in parallel.

Next-fit looks sequential: whether an item starts a batch depends on all items before it.
But all that a block of items needs to know of them is how much the batch holds that is open
when the block begins. A block is therefore a function from that amount to the batches it
closes and the amount left open at its end. Unless the whole block fits into the open batch
(the amount grows by the block's sum), only the first item that does not fit matters, so the
function is a step function with no more steps than items that fit into one budget.

Such functions compose, and their composition has the same form. Blocks are composed to
ranges of blocks and these to larger ones until a few are left, whose starts are worked out in
order; the starts then go back down the same levels, and every block is packed by itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postscope.scratch import written

#: Items of a block. monotonically_increasing_id counts a partition's rows in 33 bits.
BLOCK_BITS = 16
PARTITION_BITS = 33
#: Ranges composed at once above the blocks of a partition, and left for the driver at the top.
RANGE_BITS = 8

FUNCTION = "block long, total long, first array<long>, closed array<long>, open array<long>"
STARTS = "block long, batch long, used long"


@dataclass
class Transfer:
    """What a run of items does to the open batch.

    An open amount of at most ``budget - total`` grows by ``total`` and closes nothing. For
    larger ones ``first`` holds where each step begins, ``closed`` and ``open`` its values.
    """

    total: int
    first: np.ndarray
    closed: np.ndarray
    open: np.ndarray

    def at(self, used: int, budget: int) -> tuple[int, int]:
        if used + self.total <= budget:
            return 0, used + self.total
        step = int(np.searchsorted(self.first, used, "right")) - 1
        return int(self.closed[step]), int(self.open[step])


def batch_starts(sizes: np.ndarray, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums before each item (and of all), and the first item that does not fit a batch begun by each."""
    before = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    return before, np.searchsorted(before[1:], before[:-1] + budget, "right")


def transfer_of(sizes: np.ndarray, budget: int) -> Transfer:
    """The function of a block of items, each of which fits the budget."""
    n = len(sizes)
    before, nxt = batch_starts(sizes, budget)
    # From a batch begun by item i to the block's end: jumps of doubling length add up what is closed.
    jump, closed = np.append(nxt, n), np.append((nxt < n).astype(np.int64), 0)
    last = np.where(jump < n, jump, np.arange(n + 1))  # where the last batch of the way begins
    while (jump < n).any():
        closed = closed + closed[jump]
        last = last[last]
        jump = jump[jump]
    open_ = before[n] - before[last]
    # Item j is the first that does not fit for amounts above budget - sum(items to j).
    reach = int(np.searchsorted(before, budget, "right")) - 1  # items from the front that fit an empty batch
    j = np.arange(min(reach, n - 1), -1, -1)
    first = budget - before[j + 1] + 1
    first, j = np.maximum(first, 0), j
    keep = np.append(first[1:] != first[:-1], True) & (first <= budget)  # items of no size never are the first
    j = j[keep]
    return Transfer(int(before[n]), first[keep], closed[j] + 1, open_[j])


def compose(one: Transfer, two: Transfer, budget: int) -> Transfer:
    """First one, then two."""
    parts = []
    limit = min(budget - one.total, budget)
    if limit >= 0:  # amounts that pass the first run and end in a step of the second one
        begin = np.maximum(two.first - one.total, 0)
        end = np.append(two.first[1:] - one.total - 1, limit)
        inside = (end >= 0) & (begin <= limit) & (begin + one.total + two.total > budget)
        parts.append((begin[inside], two.closed[inside], two.open[inside]))
    if len(one.first):
        free = one.open + two.total <= budget
        step = np.maximum(np.searchsorted(two.first, one.open, "right") - 1, 0)
        closed, open_ = (x[step] if len(x) else np.zeros(len(step), np.int64) for x in (two.closed, two.open))
        parts.append((one.first, one.closed + np.where(free, 0, closed), np.where(free, one.open + two.total, open_)))
    first, closed, open_ = (np.concatenate(x) if parts else np.zeros(0, np.int64) for x in zip(*parts or [((), (), ())]))
    first, closed, open_ = (np.asarray(x, np.int64) for x in (first, closed, open_))
    new = np.ones(len(first), bool)
    new[1:] = (closed[1:] != closed[:-1]) | (open_[1:] != open_[:-1])
    return Transfer(one.total + two.total, first[new], closed[new], open_[new])


def batch_numbers(sizes: np.ndarray, budget: int, batch: int, used: int) -> np.ndarray:
    """The batch of each item of a block, if it begins with so much in batch number ``batch``."""
    before, nxt = batch_starts(sizes, budget)
    begins = np.zeros(len(sizes), np.int64)
    at = int(np.searchsorted(before[1:], budget - used, "right"))
    while at < len(sizes):  # once per batch, not per item
        begins[at] = 1
        at = int(nxt[at])
    return batch + np.cumsum(begins)


# --- as Spark jobs -------------------------------------------------------------


def _groups(batches: Iterable[pa.RecordBatch], key: int) -> Iterator[tuple[int, pa.Table]]:
    """Rows of sorted batches by equal values of a column."""
    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy()
        edges = [0, *(np.flatnonzero(np.diff(values)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            if held and values[a] != last:
                yield int(last), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = values[a]
    if held:
        yield int(last), pa.Table.from_batches(held)


def _functions(items: Iterable[tuple[int, Transfer]]) -> Iterator[pa.RecordBatch]:
    long_list = pa.list_(pa.int64())
    for block, f in items:
        columns = [pa.array([block]), pa.array([f.total])]
        columns += [pa.array([x], long_list) for x in (f.first, f.closed, f.open)]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "total", "first", "closed", "open"])


def _transfer(row: dict) -> Transfer:
    return Transfer(row["total"], *(np.array(row[name], np.int64) for name in ("first", "closed", "open")))


def _block_functions(budget: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _functions(
            (block, transfer_of(rows.column("size").to_numpy(), budget)) for block, rows in _groups(batches, 0)
        )

    return run


def _range_functions(budget: int):
    """Of functions sorted by (range, block): each range's own, composed as its blocks come."""

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Transfer]]:
        last, so_far = None, None
        for batch in batches:
            for row in batch.to_pylist():
                f = _transfer(row)
                if row["range"] == last:
                    so_far = compose(so_far, f, budget)
                    continue
                if last is not None:
                    yield last, so_far
                last, so_far = row["range"], f
        if last is not None:
            yield last, so_far

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _functions(composed(batches))

    return run


def _block_starts(budget: int):
    """Of functions sorted by (range, block) with the start of their range: the start of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, at = None, (0, 0)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["range"] != last:
                    last, at = row["range"], (row["batch"], row["used"])
                out.append((row["block"], *at))
                closed, used = _transfer(row).at(at[1], budget)
                at = (at[0] + closed, used)
            columns = [pa.array([row[i] for row in out], pa.int64()) for i in range(3)]
            yield pa.RecordBatch.from_arrays(columns, names=["block", "batch", "used"])

    return run


def _packed(budget: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches, 0):
            start = rows.column("batch")[0].as_py(), rows.column("used")[0].as_py()
            numbers = batch_numbers(rows.column("size").to_numpy(), budget, *start)
            columns = [pa.chunked_array([pa.array(numbers)])] + [rows.column(name) for name in names[1:]]
            yield from pa.table(columns, names=names).combine_chunks().to_batches()

    return run


def next_fit(items: DataFrame, order: list[str], size: str, budget: int, block_bits: int = BLOCK_BITS) -> DataFrame:
    """The items with the number of their ``batch`` in one pass in the given order, counted from 0.

    ``size`` must be between 0 and the budget. The items are written as they come, as ranges are
    taken from a sample and what makes the sizes would be done twice; then they are ranged by their order,
    written once more, and moved by block; only ids and sizes should be among their columns.
    """
    spark = items.sparkSession
    items = written(items, "items")
    names = items.columns
    placed = items.repartitionByRange(*order).sortWithinPartitions(*order)
    # A row's number: its partition's place in the order, then its own in the partition.
    placed = placed.withColumn("_row", F.monotonically_increasing_id())
    placed = written(placed, "ranged").withColumn("_block", F.shiftright("_row", block_bits))
    in_order = placed.select(F.col("_block").alias("block"), "_row", F.col(size).cast("long").alias("size"))
    in_order = in_order.repartition("block").sortWithinPartitions("_row")
    levels = [written(in_order.select("block", "size").mapInArrow(_block_functions(budget), FUNCTION), "block-functions")]
    shifts: list[int] = []
    highest = levels[0].agg(F.max("block")).first()[0] or 0
    while highest >> RANGE_BITS:
        # first the blocks of a partition, however many, then 256 ranges at a time
        shifts.append(PARTITION_BITS - block_bits if not shifts else RANGE_BITS)
        grouped = _ranged(levels[-1], shifts[-1])
        levels.append(written(grouped.mapInArrow(_range_functions(budget), FUNCTION), "range-functions"))
        highest >>= shifts[-1]
    # At most 256 functions are left: their starts follow one from another.
    starts, at = [], (0, 0)
    for row in levels[-1].orderBy("block").collect():
        starts.append((row["block"], *at))
        closed, used = _transfer(row.asDict()).at(at[1], budget)
        at = (at[0] + closed, used)
    found = spark.createDataFrame(starts, STARTS)
    for functions, shift in zip(levels[-2::-1], shifts[::-1]):
        above = found.select(F.col("block").alias("range"), "batch", "used")
        found = written(_ranged(functions, shift, above).mapInArrow(_block_starts(budget), STARTS), "block-starts")
    begun = placed.join(found.withColumnRenamed("block", "_block"), "_block")
    begun = begun.select("_block", "batch", "used", "_row", F.col(size).cast("long").alias("size"), *[F.col(n).alias(f"_{n}") for n in names])
    begun = begun.repartition("_block").sortWithinPartitions("_block", "_row")
    schema = T.StructType([T.StructField("batch", T.LongType())] + [T.StructField(f"_{n}", items.schema[n].dataType) for n in names])
    packed = begun.mapInArrow(_packed(budget, schema.names), schema)
    return packed.toDF("batch", *names)


def _ranged(functions: DataFrame, shift: int, above: DataFrame | None = None) -> DataFrame:
    rows = functions.withColumn("range", F.shiftright("block", shift))
    if above is not None:
        rows = rows.join(above, "range")
    return rows.repartition("range").sortWithinPartitions("range", "block")
