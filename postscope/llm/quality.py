"""Quality rules: lines that many documents of a host share.

Lines are normalised (A-Z lowered, blanks collapsed) and hashed with their host; each
document counts once per line. A line in more documents than its host's limit is
removed from all of them but the one with the smallest id, and a document of which
too little is left is rejected. Basic counts of a document (short, repetitive) are
rules beside it.

Cases: a null or empty text has no words and fails the base rules; a null host is a
host of its own; every row counts as a document, also if rows are repeated; rows with
equal ids that hold a line first keep it alike. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postscope.llm import words as W
from postscope.llm.shared import SENT_IDS, row_hash, sent_if_few, written

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A line is over the limit in more documents of its host than this many and this share.
MIN_LINE_DOCS = 10
LINE_SHARE = 0.01
#: The share asks for no more documents than this, however large the host is.
MAX_LINE_DOCS = 1000
#: A document is depleted if fewer words, or a smaller share of its words, are left.
LEFT_WORDS = 20
LEFT_SHARE = 0.2

PROFILE = (
    "row_id long, doc_id long, host string, n_words long, word_chars long, n_symbols long, "
    "n_dup_lines long, n_repeat_words long, line_keys array<long>, line_words array<int>, row_hash long"
)


def line_key(host: str | None, line: bytes) -> int | None:
    """Hash of a host and a normalised line as a signed integer; None for a line without words."""
    norm = b" ".join(line.lower().split())
    if not norm:
        return None
    lead = b"\x00" if host is None else b"\x01" + host.encode()
    key = xxhash.xxh64_intdigest(lead + b"\n" + norm)
    return key - (1 << 64) if key >> 63 else key


def _repeated(word_hash: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a window found twice or more in it."""
    at, text = W.windows_inside(bounds, WINDOW)
    if not len(at):
        return np.zeros(len(bounds) - 1, np.int64)
    key = W.window_hashes(word_hash, WINDOW)[at] ^ W.mix(text.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(len(word_hash) + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + WINDOW, -1)
    return W.sums(np.cumsum(change)[:-1] > 0, bounds)


def _lines(host: str | None, text: bytes) -> tuple[int, list[int], list[int]]:
    seen: set[bytes] = set()
    found: dict[int, int] = {}
    repeated = 0
    for line in text.split(b"\n"):
        n = len(line.split())
        if not n:
            continue
        if line in seen:
            repeated += 1
        seen.add(line)
        key = line_key(host, line)
        found[key] = found.get(key, 0) + n
    return repeated, list(found), list(found.values())


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for chunk in W.chunks(batch.column(3)):
            starts, stops, bounds = W.word_bounds(chunk)
            data = chunk.data
            point = ~W.SPACES[data] & ((data & 0xC0) != 0x80)
            hosts = batch.column(2)[chunk.first : chunk.last].to_pylist()
            raw = data.tobytes()
            lines = [
                _lines(host, raw[a:b]) for host, a, b in zip(hosts, chunk.bounds[:-1], chunk.bounds[1:])
            ]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0)[chunk.first : chunk.last],
                    batch.column(1)[chunk.first : chunk.last],
                    batch.column(2)[chunk.first : chunk.last],
                    pa.array(np.diff(bounds)),
                    pa.array(W.sums(point, chunk.bounds)),
                    pa.array(W.sums(SYMBOLS[data], chunk.bounds)),
                    pa.array([x[0] for x in lines], pa.int64()),
                    pa.array(_repeated(W.word_hashes(data, starts, stops), bounds)),
                    pa.array([x[1] for x in lines], pa.list_(pa.int64())),
                    pa.array([x[2] for x in lines], pa.list_(pa.int32())),
                    batch.column(4)[chunk.first : chunk.last],
                ],
                names=[f.split()[0] for f in PROFILE.split(", ")],
            )


def quality_rules(
    docs: DataFrame,
    min_line_docs: int = MIN_LINE_DOCS,
    line_share: float = LINE_SHARE,
    left_words: int = LEFT_WORDS,
    left_share: float = LEFT_SHARE,
    max_line_docs: int = MAX_LINE_DOCS,
) -> DataFrame:
    """Counts, verdict and the keys of removed lines for every row of (doc_id, source, text).

    ``row_hash`` names the row's source and text, as rows may share an id.
    Texts are read once. The line keys, a few numbers per text, are written to the
    shared folder; counting and judging work on them alone.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"),
        F.col("doc_id").cast("long"),
        F.col("source").alias("host"),
        "text",
        row_hash("source", "text").alias("row_hash"),
    )
    profile = written(rows.mapInArrow(_profile, PROFILE), "lines")
    # Rows with equal id, source and text are one document: one of them is counted.
    again = profile.groupBy("doc_id", "row_hash").agg(F.count("*").alias("n"), F.min("row_id").alias("one")).where("n > 1")
    again = sent_if_few(again.select(F.col("doc_id").alias("_id"), F.col("row_hash").alias("_hash"), "one"), "repeated-rows")
    same = profile["doc_id"].eqNullSafe(F.col("_id")) & (profile["row_hash"] == F.col("_hash"))
    profile = profile.join(again, same, "left").withColumn("counts", F.coalesce(F.col("one") == F.col("row_id"), F.lit(True)))
    each = profile.select("row_id", "doc_id", "row_hash", "host", "counts", F.explode(F.arrays_zip("line_keys", "line_words")).alias("line"))
    each = each.select("row_id", "doc_id", "row_hash", "host", "counts", F.col("line.line_keys").alias("key"), F.col("line.line_words").alias("n"))
    # the line stays in its first document, by id (none comes first), then by content
    counted = (
        each.where("counts")
        .groupBy("key")
        .agg(F.count("*").alias("docs"), F.min(F.struct("doc_id", "row_hash")).alias("first"), F.min("host").alias("host"))
        .where(F.col("docs") > min_line_docs)
    )
    hosts = profile.where("counts").groupBy("host").agg(F.count("*").alias("host_docs"))
    over = (
        counted.join(hosts, counted["host"].eqNullSafe(hosts["host"]))
        .where(F.col("docs") > F.least(line_share * F.col("host_docs"), F.lit(float(max_line_docs))))
        .select("key", F.col("first.doc_id").alias("first_id"), F.col("first.row_hash").alias("first_hash"))
    )
    removed = (
        each.join(over, "key")
        .where(~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("row_hash") == F.col("first_hash"))))
        .groupBy("row_id")
        .agg(F.sum("n").alias("removed_words"), F.collect_list("key").alias("removed_lines"))
    )
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    depleted = F.col("removed_words").isNotNull() & ((left < left_words) | (left < left_share * F.col("n_words")))
    return (
        profile.drop("line_keys", "line_words", "host", "_id", "_hash", "one", "counts")
        .join(removed, "row_id", "left")
        .select(
            "doc_id",
            "n_words",
            "word_chars",
            "n_symbols",
            "n_dup_lines",
            "n_repeat_words",
            failed.alias("base_failed"),
            (~failed & ~depleted).alias("kept"),
            F.coalesce("removed_words", F.lit(0)).alias("removed_words"),
            "removed_lines",
            "row_hash",
        )
    )


def _without_lines(host: str | None, text: str | None, keys: list[int] | None) -> str | None:
    if not keys or text is None:
        return text
    gone = set(keys)
    return b"\n".join(x for x in text.encode().split(b"\n") if line_key(host, x) not in gone).decode()


def _cut_lines(text: int, host: int, keys: int):
    """Of rows with text, host and keys at these places: the texts without the lines, some of the rows at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in W.chunks(batch.column(text)):
                part = batch.slice(chunk.first, chunk.texts)
                new = [
                    _without_lines(h.as_py(), t.as_py(), k.as_py()) if k.is_valid else t.as_py()
                    for h, t, k in zip(part.column(host), part.column(text), part.column(keys))
                ]
                yield part.set_column(text, part.schema.field(text), pa.array(new, part.schema.field(text).type))

    return run


def clean_documents(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """The kept documents with their own columns, without the removed lines.

    A row is judged by its id, source and text; only repeated rows share a verdict.
    Rejected rows and removed lines are looked up; as long as there are few enough to be
    sent to all tasks, texts need no shuffle.
    """
    ruled = verdict.groupBy(F.col("doc_id").alias("_ruled_id"), F.col("row_hash").alias("_ruled_hash")).agg(
        F.max("kept").alias("_ruled_kept"), F.max("removed_lines").alias("_ruled_lines")
    )
    ruled = written(ruled, "verdicts")
    gone = sent_if_few(ruled.where(~F.col("_ruled_kept")).select("_ruled_id", "_ruled_hash"), "rejected-rows")
    cut = ruled.where(F.col("_ruled_kept") & (F.size("_ruled_lines") > 0)).select("_ruled_id", "_ruled_hash", "_ruled_lines")
    lines = cut.agg(F.sum(F.size("_ruled_lines") + 2)).first()[0] or 0
    names = docs.columns
    same = docs["doc_id"].cast("long").eqNullSafe(F.col("_ruled_id")) & (row_hash("source", "text") == F.col("_ruled_hash"))
    joined = docs.join(gone, same, "left_anti").join(F.broadcast(cut) if lines <= SENT_IDS else cut, same, "left")
    joined = joined.select(*names, "_ruled_lines")
    schema = joined.schema
    text, host, keys = (joined.columns.index(x) for x in ("text", "source", "_ruled_lines"))

    out = joined.mapInArrow(_cut_lines(text, host, keys), schema).select(*names)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else out
