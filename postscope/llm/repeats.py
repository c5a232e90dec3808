"""Windows that also start in a document with a smaller id: sampled suffixes.

All windows of a corpus are too many to move. Each window therefore names one suffix, its
anchor, by its own content: the position of its smallest short hash, modulo the number of
places an anchor may take (a mod-minimizer). Equal windows name anchors at equal distance
with equal prefixes, so comparing anchors loses no match; about one position in twenty is
an anchor. The stages are

1. anchors: (prefix hash, hash of the surroundings, document, place), combined per task:
   an anchor whose surroundings a smaller document of the same task has is settled there;
2. groups of equal prefixes, read as a sorted stream: an anchor whose surroundings a smaller
   document has lies in repeats only and is settled; prefixes of one class are dropped (the
   last prefix of a batch, which may go on, is written as provisional and dropped by a join);
3. what is left, the edges of repeats, is compared window by window by the caller's solver,
   from the surroundings themselves;
4. all covered stretches of a document are joined to its text.

Streams keep one row of state, so a prefix that a third of all documents holds needs no
memory; the combining in stage 1 bounds its rows by the number of tasks' chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postscope.llm import words as W
from postscope.llm.jaccard import complete_groups
from postscope.llm.shared import written

WINDOW = 50
PREFIX = 29
PLACES = WINDOW - PREFIX + 1  # 22, where in a window its anchor may be
SHORT = 7  # equals PREFIX modulo PLACES, as the sampling needs
AROUND = WINDOW - PREFIX
#: Rows are combined in stretches of this many bytes of text.
COMBINE_BYTES = 8 << 20
#: Prefixes with more open surroundings than this are grouped by whole windows instead.
GROUP_ROWS = 20_000
#: Low bits of a place; the others tell rows with equal ids apart by their text.
PLACE_BITS = 31
NO_ID = -(1 << 63)

ANCHORS = "prefix long, around long, doc_id long, place long"
STATES = "settled boolean, prefix long, doc_id long, place long"
WINDOWS = "hi long, lo long, doc_id long, place long"
STRETCHES = "doc_id long, place long, size int"


@dataclass
class Units:
    """Hashes of a chunk's units (bytes or words), where each text's units begin, and the units."""

    values: np.ndarray
    bounds: np.ndarray
    content: np.ndarray


def anchor_places(units: Units) -> tuple[np.ndarray, np.ndarray]:
    """Anchors of all windows, as places in the chunk, and the text of each."""
    starts, _ = W.windows_inside(units.bounds, WINDOW)
    if not len(starts):
        return starts, starts
    short = W.window_hashes(units.values, SHORT)
    low = np.uint64(0xFFFFFFFF)
    least = (short & ~low) | np.arange(len(short), dtype=np.uint64)
    span, width = WINDOW - SHORT + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    smallest = (least[starts] & low).astype(np.int64)
    chosen = np.zeros(len(units.values), bool)
    chosen[starts + (smallest - starts) % PLACES] = True
    places = np.flatnonzero(chosen)
    return places, np.searchsorted(units.bounds, places, "right") - 1


def surroundings(units: Units, places: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last (excluded) unit of the windows that an anchor may belong to."""
    return np.maximum(places - AROUND, units.bounds[text]), np.minimum(places + WINDOW, units.bounds[text + 1])


def _stretch_hashes(values: np.ndarray, start: np.ndarray, stop: np.ndarray, place: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * W.powers(W.STEP, len(values))[:-1], out=total[1:])
    moved = (total[stop] - total[start]) * W.powers(W.STEP_INVERSE, len(values))[start]
    shape = ((place - start) * 1000 + (stop - place)).astype(np.uint64)
    return W.mix(W.mix(moved) + shape)


def _anchors(units_of: Callable[[W.Chunk], Units]):
    def combined(parts: list[tuple]) -> tuple[list, list]:
        prefix, around, doc, place = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((place, doc, around, prefix))
        prefix, around, doc, place = prefix[order], around[order], doc[order], place[order]
        again = np.zeros(len(prefix), bool)  # rows of one id and text say the same
        again[1:] = np.logical_and.reduce([x[1:] == x[:-1] for x in (prefix, around, doc, place)])
        prefix, around, doc, place = (x[~again] for x in (prefix, around, doc, place))
        first = np.ones(len(prefix), bool)
        first[1:] = (prefix[1:] != prefix[:-1]) | (around[1:] != around[:-1])
        settled = doc > doc[first][np.cumsum(first) - 1]
        return [x[~settled] for x in (prefix, around, doc, place)], [doc[settled], place[settled]]

    def emit(parts: list[tuple]) -> pa.RecordBatch:
        (prefix, around, doc, place), (done_doc, done_place) = combined(parts)
        # settled anchors take the same way: a class of their own behind a row that settles it
        n = len(done_doc)
        free = W.mix(done_place.view(np.uint64) + W.mix(done_doc.view(np.uint64)))
        columns = [
            np.concatenate([W.signed(prefix), W.signed(free)]),
            np.concatenate([W.signed(around), np.zeros(n, np.int64)]),
            np.concatenate([doc, done_doc]),
            np.concatenate([place, -1 - done_place]),
        ]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["prefix", "around", "doc_id", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            ids, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for chunk in W.chunks(batch.column(2)):
                units = units_of(chunk)
                places, text = anchor_places(units)
                if len(places):
                    start, stop = surroundings(units, places, text)
                    prefix = W.window_hashes(units.values, PREFIX)[places]
                    around = _stretch_hashes(units.values, start, stop, places)
                    rows = chunk.first + text
                    parts.append((prefix, around, ids[rows], (places - units.bounds[text]) | tags[rows]))
                held += len(chunk.data)
                if held >= COMBINE_BYTES:
                    if parts:
                        yield emit(parts)
                    parts, held = [], 0
        if parts:
            yield emit(parts)

    return run


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (prefix, around, doc_id): settled anchors, and open ones of mixed prefixes.

    Open rows of a batch's last prefix that has one class so far are provisional (``settled`` is
    null). If the prefix is mixed, the first row of its next class is open for certain, so the
    prefixes of open rows tell which provisional ones are open too.
    """

    def rows(settled: bool | None, prefix, doc, place) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([settled] * len(doc), pa.bool_()), pa.array(prefix), pa.array(doc), pa.array(place)],
            names=["settled", "prefix", "doc_id", "place"],
        )

    last = None  # prefix, around and smallest document of the last class
    mixed = False  # whether the last prefix has several classes
    for batch in batches:
        prefix, around, doc, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        done = place < 0
        if done.any():
            yield rows(True, prefix[done], doc[done], -1 - place[done])
            prefix, around, doc, place = (x[~done] for x in (prefix, around, doc, place))
        if not len(prefix):
            continue
        new_prefix = np.ones(len(prefix), bool)
        new_prefix[1:] = prefix[1:] != prefix[:-1]
        new_class = new_prefix.copy()
        new_class[1:] |= around[1:] != around[:-1]
        if last is not None and prefix[0] == last[0]:
            new_prefix[0] = False
            new_class[0] = around[0] != last[1]
        least = np.concatenate([[last[2] if last is not None else 0], doc[new_class]])[np.cumsum(new_class)]
        settled = doc > least
        if settled.any():
            yield rows(True, prefix[settled], doc[settled], place[settled])
        group = np.cumsum(new_prefix)  # 0: goes on from the last batch
        classes = np.bincount(group, weights=new_class, minlength=group[-1] + 1)
        several = classes > 1
        several[0] = mixed or (classes[0] > 0 and last is not None)
        open_ = ~settled & several[group]
        if open_.any():
            yield rows(False, prefix[open_], doc[open_], place[open_])
        mixed = bool(several[group[-1]])
        if not mixed:
            tail = ~settled & (group == group[-1])
            if tail.any():
                yield rows(None, prefix[tail], doc[tail], place[tail])
        last = (prefix[-1], around[-1], least[-1])


def _context(units_of: Callable[[W.Chunk], Units]):
    """Of (doc_id, tag, text, open anchors): the surroundings of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            opened = batch.column(3)
            for chunk in W.chunks(batch.column(2)):
                units = units_of(chunk)
                out: list[tuple] = []
                for k in range(chunk.texts):
                    row = chunk.first + k
                    a, b = units.bounds[k], units.bounds[k + 1]
                    for spot in opened[row].as_py():
                        place = a + (spot["place"] & ((1 << PLACE_BITS) - 1))
                        start, stop = max(place - AROUND, a), min(place + WINDOW, b)
                        at = int(start - a) | int(tags[row])
                        out.append((spot["prefix"], ids[row], at, place - start, units.content[start:stop].tobytes()))
                    if len(out) > 20_000:
                        yield _context_batch(out)
                        out = []
                if out:
                    yield _context_batch(out)

    return run


CONTEXTS = "prefix long, doc_id long, place long, ahead int, units binary"


def _context_batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["prefix", "doc_id", "place", "ahead", "units"]
    )


@dataclass
class Contexts:
    """Surroundings of anchors as rows of units, the anchor in column AROUND, where they are valid."""

    group: np.ndarray
    doc: np.ndarray
    units: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def windows(self, at: int) -> np.ndarray:
        """Rows in which the window that starts in column ``at`` is inside the document."""
        return np.flatnonzero((self.first <= at) & (at + WINDOW <= self.last))


def contexts(batch: pa.RecordBatch, dtype) -> Contexts:
    prefix, doc, ahead = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 3))
    parts = [np.frombuffer(x, dtype) for x in batch.column(4).to_pylist()]
    units = np.zeros((len(parts), AROUND + WINDOW), dtype)
    first = AROUND - ahead.astype(np.int64)
    last = first + np.array([len(p) for p in parts])
    for row, at, part in zip(units, first, parts):
        row[at : at + len(part)] = part
    group = np.zeros(len(prefix), np.int64)
    group[1:] = np.cumsum(prefix[1:] != prefix[:-1])
    return Contexts(group, doc, units, first, last)


def _unrepeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of contexts sorted by (prefix, doc_id, place): one of each; rows of one id and text bring the same."""
    last = None
    for batch in batches:
        key = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1)
        if not len(key):
            continue
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]).any(axis=1)
        new[0] = last is None or bool((key[0] != last).any())
        last = key[-1]
        yield batch.filter(pa.array(new))


def _solve(solver: Callable[[Contexts], tuple[np.ndarray, np.ndarray]], dtype, rows_at_once: int = 8192):
    """Of contexts sorted by prefix: the stretch of each that a smaller document has."""

    def finish(groups: list[pa.RecordBatch]) -> pa.RecordBatch:
        batch = pa.Table.from_batches(groups).combine_chunks().to_batches()[0]
        rows = contexts(batch, dtype)
        lo, hi = solver(rows)
        keep = hi > lo
        start = batch.column(2).to_numpy(zero_copy_only=False) + lo - rows.first
        return pa.RecordBatch.from_arrays(
            [pa.array(rows.doc[keep]), pa.array(start[keep]), pa.array((hi - lo)[keep].astype(np.int32))],
            names=["doc_id", "place", "size"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for group in complete_groups(_unrepeated(batches), 1):
            if group.num_rows > 1:
                held.append(group)
                n += group.num_rows
            if n >= rows_at_once:
                yield finish(held)
                held, n = [], 0
        if held:
            yield finish(held)

    return run


def _single_windows(dtype):
    """Of contexts of hot prefixes: 128-bit hashes of every window by itself."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out = []
            size = WINDOW * np.dtype(dtype).itemsize
            step = np.dtype(dtype).itemsize
            for _, doc, place, _, units in zip(*(c.to_pylist() for c in batch.columns)):
                for at in range(0, len(units) - size + 1, step):
                    digest = np.frombuffer(xxhash.xxh3_128_digest(units[at : at + size]), np.int64)
                    out.append((digest[0], digest[1], doc, place + at // step))
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*out)], names=["hi", "lo", "doc_id", "place"]
                )

    return run


def _first_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of windows sorted by (hi, lo, doc_id): those that a smaller document has."""
    last = None
    for batch in batches:
        hi, lo, doc, place = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
        if not len(hi):
            continue
        new = np.ones(len(hi), bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        if last is not None and (hi[0], lo[0]) == last[:2]:
            new[0] = False
        least = np.concatenate([[last[2] if last is not None else 0], doc[new]])[np.cumsum(new)]
        last = (hi[-1], lo[-1], least[-1])
        keep = doc > least
        yield pa.RecordBatch.from_arrays(
            [pa.array(doc[keep]), pa.array(place[keep]), pa.array(np.full(keep.sum(), WINDOW, np.int32))],
            names=["doc_id", "place", "size"],
        )


def tagged(docs: DataFrame) -> DataFrame:
    """(doc_id, tag, text); the tag, upper bits of a hash of the text, goes into places."""
    tag = F.shiftleft(F.shiftrightunsigned(F.xxhash64("text"), PLACE_BITS + 1), PLACE_BITS)
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), tag.alias("tag"), "text")


def covered(
    docs: DataFrame,
    units_of: Callable[[W.Chunk], Units],
    dtype,
    solver: Callable[[Contexts], tuple[np.ndarray, np.ndarray]],
) -> DataFrame:
    """Every row of ``docs`` as (doc_id, text, anchors, stretches).

    ``anchors`` are places whose surroundings are covered as a whole, ``stretches`` are
    (place, size) that are; both null if there are none.
    """
    rows = tagged(docs)
    anchors = rows.mapInArrow(_anchors(units_of), ANCHORS)
    sorted_ = anchors.repartition("prefix").sortWithinPartitions("prefix", "around", "doc_id")
    states = written(sorted_.mapInArrow(_settle, STATES), "anchors")
    tag = F.shiftleft(F.shiftright("place", PLACE_BITS), PLACE_BITS)
    certain = states.where(~F.col("settled")).select("prefix", "doc_id", "place")
    provisional = states.where(F.col("settled").isNull()).select("prefix", "doc_id", "place")
    open_ = certain.union(written(provisional.join(certain, "prefix", "left_semi"), "mixed-prefixes"))
    hot = open_.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") > GROUP_ROWS)
    hot = written(hot.select("prefix", F.lit(True).alias("hot")), "hot-prefixes")
    spots = open_.groupBy("doc_id", tag.alias("tag")).agg(F.collect_set(F.struct("prefix", "place")).alias("open"))
    found = rows.join(spots, ["doc_id", "tag"]).select("doc_id", "tag", "text", "open")
    around = written(found.mapInArrow(_context(units_of), CONTEXTS), "surroundings")
    cool = around.join(hot, "prefix", "left_anti").repartition("prefix").sortWithinPartitions("prefix", "doc_id", "place")
    solved = cool.select("prefix", "doc_id", "place", "ahead", "units").mapInArrow(_solve(solver, dtype), STRETCHES)
    single = around.join(hot, "prefix", "left_semi").select("prefix", "doc_id", "place", "ahead", "units")
    single = single.mapInArrow(_single_windows(dtype), WINDOWS)
    single = single.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "doc_id").mapInArrow(_first_in, STRETCHES)
    whole = states.where("settled").select("doc_id", "place", F.lit(0).alias("size"))
    marks = whole.union(solved).union(single).groupBy("doc_id", tag.alias("tag")).agg(
        F.collect_set(F.struct("place", "size")).alias("marks")
    )
    return rows.join(marks, ["doc_id", "tag"], "left").select("doc_id", "text", "marks")


def mark_covered(n: int, marks: list | None) -> np.ndarray:
    """Which of a text's ``n`` units the marks of ``covered`` cover."""
    if not marks:
        return np.zeros(n, bool)
    low = (1 << PLACE_BITS) - 1
    place = np.array([m["place"] for m in marks], np.int64) & low
    size = np.array([m["size"] for m in marks], np.int64)
    start = np.where(size == 0, np.maximum(place - AROUND, 0), place)
    stop = np.where(size == 0, np.minimum(place + WINDOW, n), place + size)
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, stop, -1)
    return np.cumsum(change)[:-1] > 0
