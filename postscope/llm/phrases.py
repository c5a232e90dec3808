"""Phrases that collocate, by multikey three-way quicksort of suffix pointers.

A suffix starts at a word and ends with its piece (text between marks); as phrases have
three words at most, it is three word hashes. Suffixes are routed globally by their leading
words: by the first one, by two where the first word is frequent enough to fill a task, by
three where the first two are. Equal suffixes of a stretch of text travel as one with a
weight, so no word, pair or passage fills a task. In a task the pointers are
sorted by three-way partitioning, word by word: the weight of an equal-partition is the count
of its leading words, and a partition that weighs less than the least count is abandoned,
whether it is sorted or not, since nothing in it can be frequent enough.

Counts of words come with their spelling from a first pass, which also names the words and
pairs that need a finer route. What is in a candidate (parts, cuts) is as frequent as
the candidate itself, so only frequent words and pairs are joined with each other. Scores
use whole numbers of 38 digits, enough for counts below 10 ** 16; larger ones would be an error.

Cases: a null text is an empty one; a null language is ``und``, as that value itself is. Words
never cross marks or texts. Repeated rows count again. Very long texts are read whole. Extra columns are not read. An
empty table gives no rows. Hashes of 64 bits stand for words until their spelling is joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from postscope.llm import words as W
from postscope.llm.jaccard import complete_groups
from postscope.llm.shared import written

LEAST = 10
TOP = 2000
SHARE_PERCENT = 50
SCALE = 1_000_000
#: Text that is turned into suffixes at once, and suffixes of which equal ones are put together before they travel.
CHUNK_BYTES = 1 << 20
BLOCK_SUFFIXES = 1 << 20
#: A word or pair with this share of all words gets a route by one more word.
HOT_SHARE = 1 / 512
#: Suffixes that one group of the sort holds, about.
GROUP_SUFFIXES = 1 << 21
LEAST_GROUPS = 256
#: Spellings a task counts before it hands them on.
TASK_WORDS = 400_000
#: Cells that share the first cut of a language's best phrases.
CELLS = 256

BREAKS = np.zeros(256, bool)
BREAKS[list(b".,;:!?\n\x0b\x0c\r")] = True
#: What each byte becomes before words are cut: lower case, marks and blanks as blanks.
PLAIN = np.where(BREAKS, np.uint8(32), W.ASCII_LOWER)
#: A value per byte for the hash of a word; blanks have none.
VALUES = np.where(W.SPACES, np.uint64(0), W.BYTE_VALUES)

WORDS = "lang string, first long, second long, word binary, n long"
SUFFIXES = "bucket int, lang string, deep int, first binary, runs binary, second binary, third binary, weights binary"
COUNTS = "lang string, first long, second long, third long, n long"


def hashed(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash above 0 of the bytes of every word; between words there are only blanks."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    data = data[starts[0] :]
    at = starts - starts[0]
    steps = np.diff(np.append(at, len(data)))
    place = np.arange(len(data), dtype=np.int64) - np.repeat(at, steps)
    power = W.powers(W.STEP, int(steps.max()))
    found = W.mix(np.add.reduceat(VALUES[data] * power[place], at) + (stops - starts).astype(np.uint64))
    found[found == 0] = 1
    return found


def suffixes(chunk: W.Chunk) -> tuple[np.ndarray, ...]:
    """Per word of a chunk: text, start and end, its hash and the next two of its piece (0 for none)."""
    breaks = BREAKS[chunk.data]
    plain = W.Chunk(chunk.first, chunk.last, PLAIN[chunk.data], chunk.bounds)
    starts, stops, bounds = W.word_bounds(plain)
    hashes = hashed(plain.data, starts, stops)
    text = np.repeat(np.arange(chunk.texts), np.diff(bounds))
    piece = np.cumsum(breaks, dtype=np.int64)[starts] if len(starts) else starts
    n = len(starts)
    follows = np.zeros(n + 2, bool)  # whether word i is in the piece of word i - 1
    follows[1:n] = (piece[1:] == piece[:-1]) & (text[1:] == text[:-1])
    after = np.concatenate([hashes, np.zeros(2, np.uint64)])
    second = np.where(follows[1 : n + 1], after[1 : n + 1], np.uint64(0))
    third = np.where(follows[1 : n + 1] & follows[2 : n + 2], after[2 : n + 2], np.uint64(0))
    return plain.data, text, starts, stops, hashes, second, third


def _by_language(batch: pa.RecordBatch, most: int) -> Iterator[tuple[str, tuple]]:
    """Per chunk and language: its data and suffixes. Column 0 is the language, column 1 the text."""
    batch = batch.take(pc.sort_indices(batch.column(0)))  # so that a chunk holds few languages
    for chunk in W.chunks(batch.column(1), most):
        data, text, *rest = suffixes(chunk)
        langs = batch.column(0)[chunk.first : chunk.last].dictionary_encode()
        if len(langs.dictionary) == 1:
            yield langs.dictionary[0].as_py(), (data, *rest)
            continue
        codes = langs.indices.to_numpy(zero_copy_only=False)[text]
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            inside = codes == code
            yield lang, (data, *[x[inside] for x in rest])


def _distinct(order: np.ndarray, keys: list[np.ndarray], weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Neighbours in this order that are equal in all keys put together, with their weights."""
    keys = [key[order] for key in keys]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    places = np.flatnonzero(new)
    if weights is None:
        counts = np.diff(np.append(places, len(order)))
    else:
        counts = np.add.reduceat(weights[order], places) if len(places) else weights[:0]
    return [key[places] for key in keys], counts


def _spellings(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> pa.Array:
    """The bytes of some words of a chunk."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(stops - starts, out=offsets[1:])
    at = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], stops - starts)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[at])])


def _merged_words(parts: list[tuple[np.ndarray, np.ndarray, pa.Array]]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Hashes, counts and spellings with counts of equal hashes added."""
    hashes, place, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_index=True, return_inverse=True)
    counts = np.bincount(inverse, weights=np.concatenate([p[1] for p in parts])).astype(np.int64)
    return hashes, counts, pa.concat_arrays([p[2] for p in parts]).take(pa.array(place))


def _words(hot_share: float, most: int, task_words: int):
    """Spellings and counts of words (second 0), and pairs that are hot in their stretch of text."""

    def cut(lang: str, first: np.ndarray, second: np.ndarray, words: pa.Array, n: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array([lang] * len(first), pa.string()), pa.array(W.signed(first)), pa.array(W.signed(second))]
        names = ["lang", "first", "second", "word", "n"]
        return pa.RecordBatch.from_arrays([*columns, words.cast(pa.binary()), pa.array(n, pa.int64())], names=names)

    def counted(held: dict[str, list]) -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            hashes, counts, words = _merged_words(parts)
            yield cut(lang, hashes, np.zeros_like(hashes), words, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray, pa.Array]]] = {}
        for batch in batches:
            for lang, (data, starts, stops, first, second, _) in _by_language(batch, most):
                if not len(first):
                    continue
                hashes, place, counts = np.unique(first, return_index=True, return_counts=True)
                held.setdefault(lang, []).append((hashes, counts, _spellings(data, starts[place], stops[place])))
                # a pair that has the hot share of all words has it in some stretch as well
                likely = np.isin(first, hashes[counts >= hot_share * len(first)]) & (second > 0)
                order = np.lexsort((second[likely], first[likely]))
                (one, two), n = _distinct(order, [first[likely], second[likely]])
                hot = n >= hot_share * len(first)
                if hot.any():
                    yield cut(lang, one[hot], two[hot], pa.nulls(int(hot.sum()), pa.large_binary()), n[hot])
                if sum(len(p[0]) for parts in held.values() for p in parts) > task_words:
                    held = {name: [_merged_words(parts)] for name, parts in held.items()}
                    if 2 * sum(len(p[0][0]) for p in held.values()) > task_words:
                        yield from counted(held)
                        held = {}
        yield from counted(held)

    return run


def routes(
    first: np.ndarray, second: np.ndarray, third: np.ndarray, hot_words: np.ndarray, hot_pairs: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """What each suffix is routed by, and whether that is all its three words."""
    at = W.mix(first)
    if not len(hot_words):
        return at, np.zeros(len(at), bool)
    finer = np.isin(first, hot_words)
    pair = W.mix(at ^ (second * W.STEP))
    at = np.where(finer, pair, at)
    deep = finer & np.isin(pair, hot_pairs) & (third > 0)
    if deep.any():
        at = np.where(deep, W.mix(pair ^ (third * W.STEP)), at)
    return at, deep


def _packed(lang: str, deep: int, at: np.ndarray, words: list[np.ndarray], weights: np.ndarray | None, groups: int) -> pa.RecordBatch:
    """Rows of one language, one per group: its distinct suffixes, the first word once per run.

    One sort by route and hash brings equal suffixes together (should hashes meet, an equal
    suffix is packed twice, and counted right all the same).
    """
    first, second, third = words
    low = W.mix(second ^ (third * W.STEP)) >> np.uint64(32)
    order = np.argsort((at & np.uint64(0xFFFFFFFF00000000)) | low)
    (at, first, second, third), weights = _distinct(order, [at, first, second, third], weights)
    bucket = (((at >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)).astype(np.int64)
    runs = np.flatnonzero(np.concatenate([[True], (first[1:] != first[:-1]) | (bucket[1:] != bucket[:-1])]))
    lengths = np.diff(np.append(runs, len(first))).astype("<u4")
    edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
    run_edges = np.searchsorted(runs, edges)
    firsts, weights = first[runs], weights.astype("<u4")
    columns: list[list] = [[], [], [], [], []]
    for a, b, c, d in zip(edges[:-1], edges[1:], run_edges[:-1], run_edges[1:]):
        for column, part in zip(columns, (firsts[c:d], lengths[c:d], second[a:b], third[a:b], weights[a:b])):
            column.append(part.tobytes())
    n = len(edges) - 1
    arrays = [pa.array(bucket[edges[:-1]], pa.int32()), pa.array([lang] * n, pa.string()), pa.array([deep] * n, pa.int32())]
    names = [field.split()[0] for field in SUFFIXES.split(", ")]
    return pa.RecordBatch.from_arrays(arrays + [pa.array(c, pa.binary()) for c in columns], names=names)


def _suffixes(hot: dict[str, tuple[np.ndarray, np.ndarray]], groups: int, most: int, block: int):
    """Distinct suffixes of stretches of text with weights, packed by group."""
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64))

    def packed(lang: str, parts: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        words = [np.concatenate(x) for x in zip(*parts)]
        at, deep = routes(*words, *hot.get(lang, none))
        if not deep.any():
            yield _packed(lang, 0, at, words, None, groups)
            return
        rest = [x[~deep] for x in words]
        inside = [x[deep] for x in words]
        yield _packed(lang, 1, at[deep], inside, None, groups)
        # the pair itself is counted once, where all of its suffixes would have gone
        (one, two), total = _distinct(np.lexsort((inside[1], inside[0])), inside[:2])
        place, _ = routes(one, two, np.zeros_like(one), *hot[lang])
        words = [np.concatenate([a, b]) for a, b in zip(rest, (one, two, np.zeros_like(one)))]
        weights = np.concatenate([np.ones(len(rest[0]), np.int64), total])
        yield _packed(lang, 0, np.concatenate([at[~deep], place]), words, weights, groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[list[np.ndarray]]] = {}
        size = 0
        for batch in batches:
            for lang, (_, _, _, first, second, third) in _by_language(batch, most):
                inside = second > 0  # a single word is no phrase
                if inside.any():
                    held.setdefault(lang, []).append([x[inside] for x in (first, second, third)])
                    size += int(inside.sum())
                if size >= block:
                    for name, parts in held.items():
                        yield from packed(name, parts)
                    held, size = {}, 0
        for name, parts in held.items():
            yield from packed(name, parts)

    return run


def frequent_prefixes(keys: list[np.ndarray], weights: np.ndarray, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort: per depth, a pointer into every frequent equal-partition and its weight.

    All partitions of a depth are split at once, each by a pivot of its own into smaller, equal and
    greater. Equal ones are sorted by the next key; any that weighs less than ``least`` is abandoned.
    """
    found = []
    pointers, lengths = np.arange(len(weights)), np.array([len(weights)], np.int64)
    random = np.random.Generator(np.random.PCG64(1))
    for key in keys:
        full = key[pointers] > 0
        owner = np.repeat(np.arange(len(lengths)), lengths)
        lengths = np.bincount(owner[full], minlength=len(lengths))
        pointers, lengths = pointers[full], lengths[lengths > 0]
        deeper, sizes, heads, counts = [], [], [], []
        while len(pointers):
            starts = np.cumsum(lengths) - lengths
            values = key[pointers]
            pivots = values[starts + random.integers(0, lengths)]
            owner = np.repeat(np.arange(len(lengths)), lengths)
            at = pivots[owner]
            side = 3 * owner + 1 + (values > at) - (values < at).astype(np.int64)
            order = np.argsort(side, kind="stable")
            pointers, side = pointers[order], side[order]
            edges = np.flatnonzero(np.concatenate([[True], side[1:] != side[:-1]]))
            weight = np.add.reduceat(weights[pointers], edges)
            lengths = np.diff(np.append(edges, len(pointers)))
            frequent = weight >= least
            equal = side[edges] % 3 == 1
            done = np.repeat(frequent & equal, lengths)
            deeper.append(pointers[done])
            sizes.append(lengths[frequent & equal])
            heads.append(pointers[edges[frequent & equal]])
            counts.append(weight[frequent & equal])
            pointers = pointers[np.repeat(frequent & ~equal, lengths)]
            lengths = lengths[frequent & ~equal]
        none = np.zeros(0, np.int64)
        found.append((np.concatenate([none, *heads]), np.concatenate([none, *counts])))
        pointers, lengths = np.concatenate([none, *deeper]), np.concatenate([none, *sizes])
    return found


def _unpacked(rows: pa.RecordBatch) -> list[np.ndarray]:
    """First, second and third words and weights of packed rows of one group."""

    def column(i: int, kind: str) -> np.ndarray:
        return np.frombuffer(b"".join(rows.column(i).to_pylist()), kind)

    first = np.repeat(column(3, "<u8"), column(4, "<u4"))
    return [first, column(5, "<u8"), column(6, "<u8"), column(7, "<u4").astype(np.int64)]


def _counted(least: int):
    """Of packed suffixes sorted by (bucket, lang, deep): frequent pairs (third 0) and triples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in complete_groups(batches, 3):
            first, second, third, weights = _unpacked(rows)
            depths = frequent_prefixes([first, second, third], weights, least)
            lang, deep = rows.column(1)[0].as_py(), rows.column(2)[0].as_py()
            for depth in (2, 3) if not deep else (3,):
                at, n = depths[depth - 1]
                if len(at):
                    last = third[at] if depth == 3 else np.zeros(len(at), np.uint64)
                    columns = [pa.array(W.signed(x)) for x in (first[at], second[at], last)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * len(at), pa.string()), *columns, pa.array(n)], names=["lang", "first", "second", "third", "n"]
                    )

    return run


def _hot_routes(words: DataFrame, total: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Per language the words and pairs that need a finer route.

    Counts never depend on these lists. They are short by definition: the counts in them add
    up to all words at most, so 5 / HOT_SHARE rows come to the driver at most.
    """
    limit = HOT_SHARE * total
    singles = words.where((F.col("second") == 0) & (F.col("n") >= limit)).select("lang", "first", "second")
    pairs = words.where((F.col("second") != 0) & (F.col("n") >= limit / 4)).select("lang", "first", "second")
    rows = singles.union(pairs).collect()
    hot = {}
    for lang in {row["lang"] for row in rows}:
        mine = np.array([(row["first"], row["second"]) for row in rows if row["lang"] == lang], np.int64).view(np.uint64)
        one, two = mine[mine[:, 1] == 0][:, 0], mine[mine[:, 1] != 0]
        hot[lang] = (one, W.mix(W.mix(two[:, 0]) ^ (two[:, 1] * W.STEP)))
    return hot


def phrase_counts(texts: DataFrame, words: DataFrame, total: int, least: int) -> DataFrame:
    """``(lang, first, second, third, n)`` of frequent pairs (third 0) and triples of (lang, text)."""
    groups = max(LEAST_GROUPS, -(-total // GROUP_SUFFIXES))
    packed = texts.mapInArrow(_suffixes(_hot_routes(words, total), groups, CHUNK_BYTES, BLOCK_SUFFIXES), SUFFIXES)
    placed = packed.repartition("bucket", "lang", "deep").sortWithinPartitions("bucket", "lang", "deep")
    return placed.mapInArrow(_counted(least), COUNTS)


def scored(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 * a * a / (left * right)) in whole numbers of 38 digits; counts are below 10 ** 16."""
    wide = [x.cast("decimal(16,0)") for x in (a, left, right)]
    top = wide[0] * wide[0] * F.lit(SCALE).cast("decimal(7,0)")
    return F.call_function("div", top, wide[1] * wide[2])


def mine_phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, share_percent: int = SHARE_PERCENT) -> DataFrame:
    """The first ``top`` phrases of each language of (lang, text), with their counts and scores."""
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    words = texts.mapInArrow(_words(HOT_SHARE, CHUNK_BYTES, TASK_WORDS), WORDS).groupBy("lang", "first", "second", "word").agg(F.sum("n").alias("n"))
    words = written(words, "words")
    single = words.where("second = 0")
    sizes = single.groupBy("lang").agg(F.sum("n").alias("total"))
    total = sizes.agg(F.sum("total")).first()[0] or 0
    counts = written(phrase_counts(texts, words, total, least), "phrase-counts")
    spelled = single.where(F.col("n") >= least).select("lang", "first", F.col("word").cast("string").alias("word"), "n")

    def word(k: int) -> DataFrame:
        return spelled.toDF("lang", f"h{k}", f"w{k}", f"n{k}")

    pairs = counts.where("third = 0").select("lang", F.col("first").alias("h1"), F.col("second").alias("h2"), F.col("n").alias("a"))
    triples = counts.where("third <> 0").toDF("lang", "h1", "h2", "h3", "a")
    front = pairs.toDF("lang", "h1", "h2", "n12")
    back = pairs.toDF("lang", "h2", "h3", "n23")
    triples = written(triples.join(front, ["lang", "h1", "h2"]).join(back, ["lang", "h2", "h3"]), "triples")
    covers = 100 * F.col("a") >= share_percent * F.col("n12")
    covered = triples.where(covers).select("lang", "h1", "h2")
    covers = 100 * F.col("a") >= share_percent * F.col("n23")
    covered = covered.union(triples.where(covers).select("lang", "h2", "h3")).distinct()
    pairs = pairs.join(covered, ["lang", "h1", "h2"], "left_anti")
    pairs = pairs.join(word(1), ["lang", "h1"]).join(word(2), ["lang", "h2"])
    triples = triples.join(word(1), ["lang", "h1"]).join(word(2), ["lang", "h2"]).join(word(3), ["lang", "h3"])

    def cut(left: str, right: str) -> Column:
        n, one, two = F.col("a"), F.col(left), F.col(right)
        return F.struct(scored(n, one, two).alias("score"), one.alias("l"), two.alias("r"))

    # Of equal scores the first cut counts.
    lower = F.when(F.col("late.score") < F.col("early.score"), F.col("late")).otherwise(F.col("early"))
    triples = triples.withColumns({"early": cut("n1", "n23"), "late": cut("n12", "n3")})
    triples = triples.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "a", lower.alias("cut"))
    pairs = pairs.select("lang", F.concat_ws(" ", "w1", "w2").alias("phrase"), "a", cut("n1", "n2").alias("cut"))
    found = pairs.union(triples).select("lang", "phrase", "a", "cut.*")
    # The best of some cells of each language first, so that no language is ranked in one task whole.
    order = [F.desc("score"), F.desc("a"), "phrase"]
    found = found.withColumn("cell", F.pmod(F.xxhash64("phrase"), F.lit(CELLS)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "cell").orderBy(*order))).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return found.join(sizes, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score"
    )
