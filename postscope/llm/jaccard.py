"""N-gram Jaccard join by parity sketches.

A document is the set of its distinct word shingles, as 64-bit hashes. Its parity sketch
XORs one bit per shingle, so the Hamming distance of two sketches never exceeds the size
of the symmetric difference. Sizes fall into bands; in a band two sets that reach the
threshold differ in at most d shingles. Shingles are dealt to d + 1 + e pieces by hash, and
the piece's XOR is its key: by the pigeonhole principle at least e + 1 pieces of two similar
sets are untouched by their difference, so a set with at most e empty pieces shares a key
with every set that it links to. A set with more is dealt once more with another hash.

Candidates of a key are first compared with the key's smallest document only. Keys whose
documents are then still in several components are compared in blocks by sketch: first each
document with the closest one of another component, then all pairs that are still apart. So all links that could join two components are tried,
while groups of copies never turn into all their pairs.

Cases: null and empty texts have no shingles and link with nothing; fewer words than a
shingle are one shingle. Sets are compared under names of their own (``set_id``, from their
content), so every text of an id is linked like any other; rows with equal ids, and all rows
without one, are one document in the result, whose component holds the links of all its
texts. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postscope.llm import words as W
from postscope.llm.shared import SENT_IDS, components, row_hash, sent_if_few, written

SHINGLE = 4
PERCENT = 85
BAND_RATIO = 1.5
LEVELS = 3
#: Share of a band's pieces that may be empty.
EMPTY_SHARE = 0.08
#: Bits of a sketch for each shingle, before rounding up to a power of two.
SKETCH_BITS = 1.5
#: Documents of a key are compared in blocks of so many.
BLOCK = 1000
#: Rows of whole blocks, pairs of them and words of their sketches that a task works on at once.
ROWS_AT_ONCE = 8000
PAIRS = 1 << 18
PAIR_WORDS = 1 << 18

SETS = "doc_id long, text_hash long, set_id long, n_shingles long, digest binary, sketch binary"
KEYS = "key long, set_id long"
STARS = "key long, hub long, set_id long"


def shingle_sets(chunk: W.Chunk, shingle: int = SHINGLE) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a chunk."""
    data = W.ASCII_LOWER[chunk.data]
    starts, stops, bounds = W.word_bounds(chunk)
    hashes = W.word_hashes(data, starts, stops)
    windows = W.window_hashes(hashes, shingle)
    out = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= shingle:
            out.append(np.unique(windows[a : b - shingle + 1]))
        elif b > a:
            out.append(W.window_hashes(hashes[a:b], int(b - a)) ^ np.uint64(b - a))
        else:
            out.append(hashes[:0])
    return out


def set_digest(elements: np.ndarray) -> bytes:
    return hashlib.blake2b(elements.tobytes(), digest_size=16).digest()


def set_name(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def band_edges(most: int) -> list[int]:
    """First sizes of the bands up to the one that holds ``most``, and of the next two."""
    edges = [1]
    while len(edges) < 3 or edges[-3] <= most:
        edges.append(max(edges[-1] + 1, int(np.ceil(edges[-1] * BAND_RATIO))))
    return edges


def most_different(total: int, percent: int) -> int:
    """The largest symmetric difference of two sets of ``total`` elements together that still link."""
    return (100 - percent) * total // (100 + percent)


def piece_keys(elements: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """The keys of a set: one per piece, in its own size band and, if it can link there, the next."""
    n = len(elements)
    if not n:
        return np.zeros(0, np.uint64)
    edges = band_edges(n)
    own = int(np.searchsorted(edges, n, "right")) - 1
    keys = []
    for band in (own, own + 1):
        if band > own and 100 * n < percent * edges[band]:
            continue
        least = most_different(2 * (edges[band + 1] - 1), percent) + 1
        spare = int(np.ceil(EMPTY_SHARE * least))
        pieces = least + spare
        for level in range(LEVELS):
            salt = np.uint64((band * LEVELS + level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1))
            dealt = ((W.mix(elements + salt) >> np.uint64(32)) * np.uint64(pieces)) >> np.uint64(32)
            dealt = dealt.astype(np.int64)
            content = np.zeros(pieces, np.uint64)
            np.bitwise_xor.at(content, dealt, elements)
            filled = np.bincount(dealt, minlength=pieces) > 0
            if level == LEVELS - 1:
                filled[:] = True  # the last time an empty piece is a key as well
            names = W.mix(salt + np.arange(pieces, dtype=np.uint64))
            keys.append(W.mix(content[filled] ^ names[filled]))
            if pieces - filled.sum() <= spare:
                break
    return np.unique(np.concatenate(keys))


def parity_sketch(elements: np.ndarray) -> bytes:
    bits = 64
    while bits < SKETCH_BITS * len(elements):
        bits *= 2
    flips = np.bincount((elements & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def folded(sketch: np.ndarray, size: int) -> np.ndarray:
    """A sketch (or rows of them) of ``size`` bytes, as if it had been made with fewer bits."""
    while sketch.shape[-1] > size:
        half = sketch.shape[-1] // 2
        sketch = sketch[..., :half] ^ sketch[..., half:]
    return sketch


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch.column(2)):
                sets = shingle_sets(chunk, shingle)
                digests = [set_digest(s) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[chunk.first : chunk.last],
                        batch.column(1)[chunk.first : chunk.last],
                        pa.array([set_name(d) for d in digests], pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array(digests, pa.binary()),
                        pa.array([parity_sketch(s) for s in sets], pa.binary()),
                    ],
                    names=["doc_id", "text_hash", "set_id", "n_shingles", "digest", "sketch"],
                )

    return run


def _keys(shingle: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # sets of this task: copies are joined by digest, one of them gives keys
        for batch in batches:
            for chunk in W.chunks(batch.column(0)):
                names, keys = [], []
                for elements in shingle_sets(chunk, shingle):
                    digest = set_digest(elements)
                    if len(elements) and digest not in seen:
                        seen.add(digest)
                        keys.append(piece_keys(elements, percent))
                        names.append(np.full(len(keys[-1]), set_name(digest), np.int64))
                if keys:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(W.signed(np.concatenate(keys))), pa.array(np.concatenate(names))], names=["key", "set_id"]
                    )

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (key, set_id): keys of several sets, each set once with the first one."""
    last_key, last_hub, last_one, last_open = None, None, None, False
    for batch in batches:
        key, one = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        if not len(key):
            continue
        first, again = np.empty(len(key), bool), np.empty(len(key), bool)
        first[0] = last_key is None or key[0] != last_key
        first[1:] = key[1:] != key[:-1]
        again[0] = not first[0] and one[0] == last_one
        again[1:] = ~first[1:] & (one[1:] == one[:-1])
        run = np.cumsum(first)
        hubs = np.concatenate([[last_hub if last_hub is not None else 0], one[first]])[run]
        last_key, last_hub, last_one = key[-1], hubs[-1], one[-1]
        keep = (one != hubs) & ~again
        opened, place = np.unique(run[keep], return_index=True)
        place = place[(opened > 0) | (not last_open)]  # the first set itself, once per key
        last_open = run[-1] in opened or (run[-1] == 0 and last_open)
        if keep.any():
            key, hubs, one = key[keep], hubs[keep], one[keep]
            columns = [np.concatenate([key, key[place]]), np.concatenate([hubs, hubs[place]]), np.concatenate([one, hubs[place]])]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "hub", "set_id"])


def bits_apart(sketches: list[bytes], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hamming distance of pairs of sketches, the longer of a pair folded to the length of the other."""
    lengths = np.fromiter(map(len, sketches), np.int64, len(sketches))
    place, rows = np.zeros(len(sketches), np.int64), {}
    for length in np.unique(lengths).tolist():
        mine = np.flatnonzero(lengths == length)
        place[mine] = np.arange(len(mine))
        rows[length] = np.frombuffer(b"".join(sketches[i] for i in mine), np.uint64).reshape(len(mine), -1)
    apart = np.zeros(len(left), np.int64)
    kind = lengths[left] * (1 << 32) + lengths[right]
    for pair in np.unique(kind).tolist():
        one, two = pair >> 32, pair & ((1 << 32) - 1)
        words = min(one, two) // 8
        for part in np.array_split(np.flatnonzero(kind == pair), -(-int((kind == pair).sum()) * words // PAIR_WORDS)):
            a, b = (folded(rows[n][place[side[part]]], words) for n, side in ((one, left), (two, right)))
            apart[part] = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
    return apart


def _near(percent: int):
    """Of (a, b, sizes, sketches): pairs whose sketches do not rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            na, nb = (batch.column(i).to_numpy() for i in (2, 4))
            sketches = batch.column(3).to_pylist() + batch.column(5).to_pylist()
            apart = bits_apart(sketches, np.arange(n), np.arange(n, 2 * n))
            keep = (apart <= (100 - percent) * (na + nb) // (100 + percent)) & (
                100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
            )
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return run


def _linked(shingle: int, percent: int):
    """Of (a, b, text_a, text_b): pairs whose sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                hubs, place = np.unique(part.column(0).to_numpy(zero_copy_only=False), return_index=True)
                texts = part.column(2).take(pa.array(place))
                left = dict(zip(hubs.tolist(), (s for c in W.chunks(texts) for s in shingle_sets(c, shingle))))
                right = [s for c in W.chunks(part.column(3)) for s in shingle_sets(c, shingle)]
                keep = []
                for hub, other in zip(part.column(0).to_pylist(), right):
                    both = len(np.intersect1d(left[hub], other, assume_unique=True))
                    keep.append(100 * both >= percent * (len(left[hub]) + len(other) - both))
                yield part.filter(pa.array(keep, pa.bool_())).select([0, 1])

    return run


def close_pairs(group, comps, sizes, sketches, side, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs of rows of one group and different components whose sketches do not rule a link out, and how far apart they are.

    Rows are ordered by group and size, so that the partners of a row that fit by size are a
    range behind it. Pairs are made and tried some at a time, whatever the groups' sizes.
    """
    order = np.lexsort((sizes, group))
    group, comps, sizes, side = (x[order] for x in (group, comps, sizes, side))
    new = np.concatenate([[True], group[1:] != group[:-1]])
    rank = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    # a block of two parts of a key compares one with the other only
    two_sided = (np.maximum.reduceat(side, starts) > np.minimum.reduceat(side, starts))[rank]
    # group and size as one number that grows with the order
    wide = int(sizes.max()) * 100 // percent + 2
    last = np.searchsorted(rank * wide + sizes, rank * wide + sizes * 100 // percent, "right")
    counts = last - np.arange(len(order)) - 1
    upto = np.cumsum(counts)
    at = 0
    while at < len(order):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS, "right")))
        some = counts[at:end]
        left = np.repeat(np.arange(at, end), some)
        right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(some) - some, some)
        at = end
        fit = (comps[left] != comps[right]) & (~two_sided[left] | (side[left] != side[right]))
        left, right = left[fit], right[fit]
        if not len(left):
            continue
        used = np.unique(np.concatenate([left, right]))
        apart = bits_apart([sketches[i] for i in order[used]], np.searchsorted(used, left), np.searchsorted(used, right))
        both = sizes[left] + sizes[right]
        close = apart <= (100 - percent) * both // (100 + percent)
        yield order[left[close]], order[right[close]], apart[close] / both[close]


def closest(a: np.ndarray, b: np.ndarray, apart: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs: for each a the one that is least apart, equals by the id of b."""
    best = np.lexsort((ids[b], apart, a))
    best = best[np.concatenate([[True], a[best][1:] != a[best][:-1]])] if len(best) else best
    return a[best], b[best], apart[best]


def _blocks(percent: int, nearest: bool):
    """Of rows sorted by (key, low, high): pairs of other components that sketches do not rule out.

    ``nearest`` keeps the closest one of each document only. Whole groups are compared some
    thousand rows at a time, as most of them are small; of the pairs made, those of one turn
    are held.
    """

    def named(ids, a, b) -> pa.RecordBatch:
        a, b = ids[a], ids[b]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    def compare(groups: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(groups).combine_chunks().to_batches()[0]
        group = np.repeat(np.arange(len(groups)), [g.num_rows for g in groups])
        ids, comps, sizes, side = (rows.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5, 7))
        best = None
        for a, b, apart in close_pairs(group, comps, sizes, rows.column(6).to_pylist(), side, percent):
            if not nearest:
                yield named(ids, a, b)
                continue
            both = [np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([apart, apart])]
            best = closest(*(both if best is None else map(np.concatenate, zip(best, both))), ids)
        if best is not None:
            yield named(ids, *best[:2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for rows in complete_groups(batches, 3):
            if rows.num_rows < 2:
                continue
            held.append(rows)
            size += rows.num_rows + rows.nbytes // 4096  # long texts have long sketches
            if size >= ROWS_AT_ONCE:
                yield from compare(held)
                held, size = [], 0
        if held:
            yield from compare(held)

    return run


def complete_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Groups of equal leading columns of sorted batches, each as one batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for a, b in zip(edges[:-1], edges[1:]):
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield held[0] if len(held) == 1 else pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def set_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """One text (set_id, text) of every wanted set (set_id, first_id, first_hash).

    A list of few sets is sent to all tasks, so that only the wanted texts are shuffled
    later on; a longer one is joined. Of repeated rows one text is taken.
    """
    few = wanted.limit(SENT_IDS // 3 + 1).count() <= SENT_IDS // 3
    same = (docs["doc_id"] == wanted["first_id"]) & (docs["text_hash"] == wanted["first_hash"])
    return docs.join(F.broadcast(wanted) if few else wanted, same).select("set_id", "text").dropDuplicates(["set_id"])


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, shingle: int, percent: int, label: str) -> DataFrame:
    """Links (u, v) among candidate pairs (a, b) of sets, by their sketches, then by their texts."""
    one = classes.select(F.col("set_id").alias("a"), F.col("n_shingles").alias("na"), F.col("sketch").alias("sa"))
    two = classes.select(F.col("set_id").alias("b"), F.col("n_shingles").alias("nb"), F.col("sketch").alias("sb"))
    both = pairs.join(one, "a").join(two, "b").select("a", "b", "na", "sa", "nb", "sb")
    near = written(both.mapInArrow(_near(percent), "a long, b long"), label)
    ids = near.select(F.col("a").alias("set_id")).union(near.select(F.col("b").alias("set_id"))).distinct()
    wanted = classes.select("set_id", "first_id", "first_hash").join(ids, "set_id", "left_semi")
    texts = set_texts(docs, written(wanted, label + "-sets"))
    left = texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b"))
    rows = near.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return written(rows.mapInArrow(_linked(shingle, percent), "a long, b long").toDF("u", "v"), label + "-links")


def _apart(stars: DataFrame, joined: DataFrame, classes: DataFrame, percent: int, nearest: bool) -> DataFrame:
    """Candidate pairs (a, b) of keys whose sets are in several components."""
    members = stars.select("key", "set_id").join(joined, stars["set_id"] == joined["id"], "left")
    members = members.select("key", "set_id", F.coalesce("component_id", "set_id").alias("component_id"))
    mixed = members.groupBy("key").agg(
        F.min("component_id").alias("lo"),
        F.max("component_id").alias("hi"),
        F.count("*").alias("n"),
        F.bit_xor(F.xxhash64("set_id")).alias("one"),
        F.bit_xor(F.xxhash64("set_id", F.lit(1))).alias("two"),
    )
    # untouched pieces of a family of copies have the same sets: one key of them will do
    mixed = mixed.where("lo <> hi").groupBy("n", "one", "two").agg(F.min("key").alias("key"))
    mixed = mixed.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    open_ = members.join(mixed, "key").withColumn("own", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int"))
    open_ = open_.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    open_ = open_.select(
        "key",
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        "set_id",
        "component_id",
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    )
    open_ = open_.join(classes, "set_id").select(
        "key", "low", "high", "set_id", "component_id", "n_shingles", "sketch", "side"
    )
    placed = open_.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return placed.mapInArrow(_blocks(percent, nearest), "a long, b long").distinct()


def jaccard_components(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document of (doc_id, text): its set's size and the smallest id linked to it."""
    no_id = F.lit(-(1 << 63))
    docs = docs.select(F.coalesce(F.col("doc_id").cast("long"), no_id).alias("doc_id"), row_hash("text").alias("text_hash"), "text")
    sets = written(docs.mapInArrow(_sets(shingle), SETS), "sets")
    # copies of a set are one class, joined by its smallest document
    classes = sets.where("n_shingles > 0").groupBy("set_id", "digest", "n_shingles")
    classes = classes.agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"), F.min("sketch").alias("sketch"), F.count("*").alias("n")
    )
    classes = classes.select(
        "set_id", "digest", "n_shingles", "sketch", "n", F.col("first.doc_id").alias("first_id"), F.col("first.text_hash").alias("first_hash")
    )
    classes = written(classes, "classes")
    copies = sets.join(classes.where("n > 1").select("digest", "first_id"), "digest")
    copies = copies.select(F.col("doc_id").alias("u"), F.col("first_id").alias("v")).where("u <> v")
    keys = docs.select("text").mapInArrow(_keys(shingle, percent), KEYS)
    stars = keys.repartition("key").sortWithinPartitions("key", "set_id").mapInArrow(_stars, STARS)
    stars = written(stars, "stars")
    first = stars.where("hub <> set_id").select(F.col("hub").alias("a"), F.col("set_id").alias("b")).distinct()
    links = _verified(docs, classes, first, shingle, percent, "near")
    joined = written(components(links), "components")
    # The closest set elsewhere joins most of what is still apart; then all pairs left are tried.
    for nearest in (True, False):
        pairs = _apart(stars, joined, classes, percent, nearest)
        more = _verified(docs, classes, pairs, shingle, percent, "rest")
        edges = joined.select(F.col("id").alias("u"), F.col("component_id").alias("v")).union(more)
        joined = written(components(edges), "components")
    # from sets to documents: each set hangs on its smallest document
    one = classes.select(F.col("set_id").alias("id"), F.col("first_id").alias("u"))
    two = classes.select(F.col("set_id").alias("component_id"), F.col("first_id").alias("v"))
    edges = joined.join(one, "id").join(two, "component_id").select("u", "v")
    joined = written(components(edges.union(copies)), "components")
    members = sets.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    return members.join(joined, members["doc_id"] == joined["id"], "left").select(
        F.nullif(F.col("doc_id"), F.lit(-(1 << 63))).alias("doc_id"),
        "n_shingles",
        F.nullif(F.coalesce("component_id", "doc_id"), F.lit(-(1 << 63))).alias("component_id"),
    )


def one_of_each(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that are the smallest of their component, with their own columns.

    What is dropped is looked up, so that the texts that stay need no shuffle as long as
    the dropped ids are few enough to be sent to all tasks. Of repeated rows (equal id and
    text) one stays; rows without an id count as one document, the smallest.
    """
    gone = found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("_gone_id"))
    gone = sent_if_few(gone.distinct(), "dropped-ids")
    left = docs.join(gone, docs["doc_id"].eqNullSafe(F.col("_gone_id")), "left_anti")
    again = docs.groupBy(F.col("doc_id").alias("_again_id")).agg(F.count("*").alias("n")).where("n > 1")
    again = sent_if_few(again.select("_again_id"), "repeated-ids")
    same = left["doc_id"].eqNullSafe(F.col("_again_id"))
    once, repeated = left.join(again, same, "left_anti"), left.join(again, same, "left_semi")
    return once.unionByName(repeated.dropDuplicates(["doc_id", "text"]))
