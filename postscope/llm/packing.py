"""Token ids packed into rows of equal length.

Texts become ids of a public byte-level vocabulary, each with an end id. A document longer
than a row is cut into pieces that together are the whole document. Pieces are dealt by
hash to shards of bounded size, and each shard is packed best-fit decreasing: the longest
piece first, into the row with the smallest gap that takes it, which a segment tree over
gap sizes finds. A row holds its ids as little-endian numbers, padded at the end; the
cumulative lengths of its pieces say where attention ends and positions start again.

Cases: a null or empty text is its end id alone; rows with equal ids are packed each; null
ids stay null. An empty table gives no rows.
"""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postscope.llm.jaccard import complete_groups
from postscope.llm.shared import written

ROW_IDS = 2048
#: A shard is about so many bytes of text, whatever the size of the corpus.
SHARD_BYTES = 16 << 20
TABLE_ENTRIES = 400_000
#: White space as the vocabulary's pattern sees it.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

PIECES = "doc_id long, part int, n int, ids binary"
PACKED = (
    "shard long, row int, n_ids int, doc_ids array<long>, parts array<int>, cumulative array<int>, "
    "resets array<int>, ids binary"
)


class IdTable:
    """Ids of distinct chunks, of which no id crosses a border, as little-endian bytes."""

    def __init__(self, ranks: bytes, pattern: str):
        pairs = (line.split() for line in ranks.splitlines() if line)
        merges = {base64.b64decode(a): int(b) for a, b in pairs}
        self.codec = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        self.end = len(merges)
        self.kind = np.dtype("<u2" if self.end < 1 << 16 else "<u4")
        self.table: dict[str, bytes] = {}

    def ids(self, text: str) -> bytes:
        parts = CHUNK.findall(text)
        table = self.table
        if len(table) > TABLE_ENTRIES:
            table.clear()
        for part in set(parts).difference(table):
            table[part] = np.array(self.codec.encode_ordinary(part), self.kind).tobytes()
        return b"".join([table[p] for p in parts]) + np.array([self.end], self.kind).tobytes()


class GapTree:
    """Segment tree over gap sizes 0 .. most that finds the smallest gap of at least a size."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.open = np.zeros(2 * self.leaves, np.int64).tolist()
        self.rows: list[list[int]] = [[] for _ in range(self.leaves)]

    def add(self, gap: int, row: int) -> None:
        heapq.heappush(self.rows[gap], row)
        at = gap + self.leaves
        while at:
            self.open[at] += 1
            at >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The row (and its gap) with the smallest gap of at least ``size``; the oldest of equals."""
        at = size + self.leaves
        if not self.open[at]:
            while at > 1 and (at & 1 or not self.open[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.open[2 * at] else 2 * at + 1
        gap = at - self.leaves
        row = heapq.heappop(self.rows[gap])
        while at:
            self.open[at] -= 1
            at >>= 1
        return row, gap


def best_fit_rows(sizes: list[int], most: int) -> list[list[int]]:
    """Indices of sizes (in the given order, longest first) by row, best fit."""
    tree, rows = GapTree(most), []
    for i, size in enumerate(sizes):
        found = tree.take(size)
        row, gap = found if found else (len(rows), most)
        if found is None:
            rows.append([])
        rows[row].append(i)
        if gap > size:
            tree.add(gap - size, row)
    return rows


def _pieces(shared, pattern: str, row_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = IdTable(shared.value, pattern)
        size = row_ids * table.kind.itemsize
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out = []
                for doc, text in zip(*(batch.column(i)[at : at + 256].to_pylist() for i in (0, 1))):
                    ids = table.ids(text or "")
                    for part, k in enumerate(range(0, len(ids), size)):
                        piece = ids[k : k + size]
                        out.append((doc, part, len(piece) // table.kind.itemsize, piece))
                types = [pa.int64(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)], names=["doc_id", "part", "n", "ids"]
                )

    return run


def _packed(row_ids: int, end: int, kind: np.dtype):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in complete_groups(batches, 1):
            docs, parts, sizes, ids = (shard.column(i).to_pylist() for i in range(1, 5))
            order = sorted(range(len(docs)), key=lambda i: (-sizes[i], docs[i] is None, docs[i] or 0, parts[i], ids[i]))
            out = []
            for number, row in enumerate(best_fit_rows([sizes[i] for i in order], row_ids)):
                held = [order[i] for i in row]
                ends = np.cumsum([sizes[i] for i in held]).tolist()
                fill = np.full(row_ids - ends[-1], end, kind).tobytes()
                out.append(
                    (
                        shard.column(0)[0].as_py(),
                        number,
                        ends[-1],
                        [docs[i] for i in held],
                        [parts[i] for i in held],
                        [0, *ends],
                        [0, *ends[:-1]],
                        b"".join([ids[i] for i in held]) + fill,
                    )
                )
            types = [pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), *[pa.list_(pa.int32())] * 3, pa.binary()]
            for at in range(0, len(out), 1000):
                columns = [pa.array(c, t) for c, t in zip(zip(*out[at : at + 1000]), types)]
                yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in PACKED.split(", ")])

    return run


def pack_tokens(docs: DataFrame, ranks: bytes, pattern: str, row_ids: int = ROW_IDS) -> DataFrame:
    """Rows of ``row_ids`` ids over every row of (doc_id, text), written by whatever writes the result.

    ``ids`` is a row of the id matrix; ``cumulative`` the borders of its pieces; ``resets``
    where positions start again at 0; ``doc_ids`` and ``parts`` name the pieces.
    """
    sc = docs.sparkSession.sparkContext
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = total // SHARD_BYTES + 1
    table = IdTable(ranks, pattern)
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    pieces = rows.mapInArrow(_pieces(sc.broadcast(ranks), pattern, row_ids), PIECES)
    # numbers are written before the shuffle, so that a task that runs again deals alike
    pieces = written(pieces.withColumn("number", F.monotonically_increasing_id()), "pieces")
    dealt = F.pmod(F.xxhash64("doc_id", "part", "ids", "number"), F.lit(shards))
    pieces = pieces.select(dealt.alias("shard"), "doc_id", "part", "n", "ids")
    placed = pieces.repartition("shard").sortWithinPartitions("shard")
    return placed.mapInArrow(_packed(row_ids, table.end, table.kind), PACKED)


def row_positions(cumulative: list[int], row_ids: int = ROW_IDS) -> np.ndarray:
    """Position of every id of a row: from 0 in each piece, and 0 in the padding."""
    out = np.zeros(row_ids, np.int64)
    for a, b in zip(cumulative[:-1], cumulative[1:]):
        out[a:b] = np.arange(b - a)
    return out
