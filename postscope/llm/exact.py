"""Exact duplicates by counting quotient filters and byte verification.

Texts are equal when they are identical after lower-casing A-Z. A text's fingerprint is a
64-bit hash of its normalised bytes. Each task puts the fingerprints of its rows into one
counting quotient filter per shard (the leading bits of a fingerprint): a bit per quotient
that occurs, a bit per slot that ends a run, and sorted remainders with their counts. A
fingerprint is its shard, quotient and remainder put together, so filters of one shard
merge without loss whatever their number of quotients, by merging sorted runs and adding
counts. Only fingerprints counted more than once go on: their rows are grouped by the whole
normalised text, byte by byte, with copies combined before the shuffle, so a group that
holds a third of all rows sends one text per task. All other rows are done.

Cases: a null text is an empty one, and all empty texts are equal. Of equal texts the row
with the largest doc_id stays; rows without an id come last, and of several rows that share
the largest id (or of a group without any id) one stays, all are returned. Texts that only share a
fingerprint are told apart. Very long texts are compared whole. Extra columns are not read.
An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postscope.llm.jaccard import complete_groups
from postscope.llm.shared import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A shard's merged filter holds about so many fingerprints at most.
SHARD_PRINTS = 1 << 20
LEAST_SHARD_BITS = 8
#: A task hands its filters on whenever it has seen so many rows.
TASK_PRINTS = 1 << 22
#: Classes are sent to all tasks up to this number (some 100 bytes each), and joined beyond.
SENT_CLASSES = 200_000

FILTERS = "shard int, quotient_bits int, occupied binary, run_ends binary, remainders binary, counts binary"
REPEATED = "print long, n long"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def shard_bits(rows: int) -> int:
    """Leading bits of a fingerprint that name its shard, for so many rows."""
    bits = LEAST_SHARD_BITS
    while rows >> bits > SHARD_PRINTS:
        bits += 1
    return bits


def build_filter(prints: np.ndarray, counts: np.ndarray, shard: int) -> dict:
    """The quotient filter of sorted distinct fingerprints of one shard (its leading ``shard`` bits).

    There are about as many quotients as fingerprints; remainders keep whole bytes.
    """
    quotient_bits = max(3, int(len(prints) - 1).bit_length())
    rest = 64 - shard - quotient_bits
    inside = prints & np.uint64((1 << (64 - shard)) - 1)
    quotients = (inside >> np.uint64(rest)).astype(np.int64)
    occupied = np.zeros(1 << quotient_bits, bool)
    occupied[quotients] = True
    ends = np.ones(len(prints), bool)
    ends[:-1] = quotients[1:] != quotients[:-1]
    remainders = (inside & np.uint64((1 << rest) - 1)).astype("<u8")
    width = -(-rest // 8)
    return {
        "shard": int(prints[0] >> np.uint64(64 - shard)),
        "quotient_bits": quotient_bits,
        "occupied": np.packbits(occupied).tobytes(),
        "run_ends": np.packbits(ends).tobytes(),
        "remainders": remainders.view(np.uint8).reshape(-1, 8)[:, :width].tobytes(),
        "counts": counts.astype("<u4").tobytes(),
    }


def read_filter(found: dict, shard: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted fingerprints of a filter and their counts: the inverse of ``build_filter``."""
    rest = 64 - shard - found["quotient_bits"]
    counts = np.frombuffer(found["counts"], "<u4").astype(np.int64)
    width = -(-rest // 8)
    remainders = np.zeros((len(counts), 8), np.uint8)
    remainders[:, :width] = np.frombuffer(found["remainders"], np.uint8).reshape(len(counts), width)
    ends = np.unpackbits(np.frombuffer(found["run_ends"], np.uint8), count=len(counts)).astype(np.int64)
    quotients = np.flatnonzero(np.unpackbits(np.frombuffer(found["occupied"], np.uint8)))
    run = np.cumsum(ends) - ends  # runs that ended before each slot
    high = (quotients[run].astype(np.uint64) << np.uint64(rest)) | np.uint64(found["shard"] << (64 - shard))
    return high | remainders.view("<u8")[:, 0], counts


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints of several sorted runs, counts added."""
    prints = np.concatenate([p for p, _ in runs])
    counts = np.concatenate([c for _, c in runs])
    order = np.argsort(prints, kind="stable")  # merges runs that are sorted already
    prints, counts = prints[order], counts[order]
    first = np.ones(len(prints), bool)
    first[1:] = prints[1:] != prints[:-1]
    places = np.flatnonzero(first)
    return prints[places], np.add.reduceat(counts, places) if len(places) else counts


def _filters(shard: int, most: int):
    def cut(parts: list[np.ndarray]) -> pa.RecordBatch:
        prints, counts = np.unique(np.concatenate(parts), return_counts=True)
        owner = prints >> np.uint64(64 - shard)
        edges = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]]))
        rows = [build_filter(prints[a:b], counts[a:b], shard) for a, b in zip(edges[:-1], edges[1:])]
        types = [pa.int32(), pa.int32()] + [pa.binary()] * 4
        return pa.RecordBatch.from_arrays(
            [pa.array([row[name] for row in rows], kind) for name, kind in zip(rows[0], types)], names=list(rows[0])
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) >= most:
                yield cut(held)
                held = []
        if held:
            yield cut(held)

    return run


def _merged(shard: int):
    """Of filters sorted by shard: fingerprints counted more than once.

    Filters of a shard are merged as they come; what is held is the shard's own filter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def repeated(have) -> pa.RecordBatch:
            prints, counts = have
            again = counts > 1
            return pa.RecordBatch.from_arrays([pa.array(prints[again].view(np.int64)), pa.array(counts[again])], names=["print", "n"])

        at, have = None, None
        for batch in batches:
            for rows in complete_groups(iter([batch]), 1):
                found = rows.to_pylist()
                if found[0]["shard"] != at:
                    if have is not None:
                        yield repeated(have)
                    at, have = found[0]["shard"], None
                runs = [read_filter(f, shard) for f in found]
                have = merge_runs(runs if have is None else [have, *runs])
        if have is not None:
            yield repeated(have)

    return run


def repeated_prints(prints: DataFrame, rows: int) -> DataFrame:
    """``(print, n)`` of every fingerprint in more than one row of (print)."""
    bits = shard_bits(rows)
    filters = prints.select("print").mapInArrow(_filters(bits, TASK_PRINTS), FILTERS)
    placed = filters.repartition("shard").sortWithinPartitions("shard")
    return placed.mapInArrow(_merged(bits), REPEATED)


def _sent(rows: DataFrame, most: int) -> DataFrame:
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


def exact_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of (doc_id, text): which row of its group stays, and the group's size."""
    texts = docs.select("doc_id", normalised(F.col("text")).alias("normal"))
    prints = texts.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64("normal").alias("print"),
        F.unhex(F.sha2("normal", 256)).alias("sha"),
    )
    prints = written(prints, "prints")
    repeated = written(repeated_prints(prints, prints.count()), "repeated-prints").select("print")
    repeated = _sent(repeated, SENT_CLASSES)
    # Whole texts are compared here; partial aggregation leaves one copy of each per task.
    open_ = texts.select(F.xxhash64("normal").alias("print"), "normal").join(repeated, "print", "left_semi")
    classes = open_.groupBy("print", "normal").agg(F.count("*").alias("size")).where("size > 1")
    classes = classes.select("print", F.unhex(F.sha2("normal", 256)).alias("sha"), "size")
    # doc_id and row number: of rows with the largest id one stays; nulls are smaller than any id.
    last = prints.join(repeated, "print", "left_semi").groupBy("print", "sha").agg(
        F.max(F.struct("doc_id", "row_id")).alias("last")
    )
    classes = written(classes.join(last, ["print", "sha"]), "equal-texts")
    classes = classes.select(F.col("print").alias("_print"), F.col("sha").alias("_sha"), "size", "last")
    classes = _sent(classes, SENT_CLASSES)
    same = (prints["print"] == F.col("_print")) & (prints["sha"] == F.col("_sha"))
    return prints.join(classes, same, "left").select(
        "doc_id",
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("last.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row_id") == F.col("last.row_id"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
