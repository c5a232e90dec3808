"""Repeated word windows by prefix-partitioned suffix trees, and their removal.

Suffixes are split by prefixes into groups that fit in memory, and each group is a subtree
of the corpus' suffix tree. A prefix is the anchor prefix of a suffix's window (see
``repeats``); where more suffixes share it than a task should hold, it grows to the whole
window. A subtree is held as its sorted suffixes and the lengths that neighbours have in
common: runs with at least WINDOW words in common are its deep internal nodes, the maximal
repeats. Below such a node every suffix but those of its smallest document is a repeat.

Cases: null and empty texts have no words; texts shorter than a window keep all; rows with
equal ids never remove from each other; null ids count as the smallest id. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postscope.llm import words as W
from postscope.llm.repeats import NO_ID, PLACES, WINDOW, Contexts, Units, covered, mark_covered
from postscope.llm.shared import row_hash

RESULT = "doc_id long, n_words long, n_removed long, kept string, text_hash long"


def word_units(chunk: W.Chunk) -> Units:
    starts, stops, bounds = W.word_bounds(chunk)
    hashes = W.word_hashes(chunk.data, starts, stops)
    return Units(hashes, bounds, hashes)


def deep_nodes(group: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in the order of their subtrees, and the deep internal node (or 0) above each.

    ``suffixes`` has a row of at least WINDOW words each; ``group`` tells subtrees apart.
    """
    lead = np.empty((len(group), 1 + WINDOW), ">u8")
    lead[:, 0] = group
    lead[:, 1:] = suffixes[:, :WINDOW]
    order = np.argsort(np.ascontiguousarray(lead).view(f"S{8 * (1 + WINDOW)}")[:, 0], kind="stable")
    lead = lead[order]
    common = np.logical_and.accumulate(lead[1:] == lead[:-1], axis=1).sum(axis=1) - 1
    deep = common >= WINDOW
    start = np.zeros(len(order), bool)
    start[:-1] = deep
    start[1:] &= ~deep
    node = np.cumsum(start)
    under = np.zeros(len(order), bool)
    under[:-1] |= deep
    under[1:] |= deep
    return order, np.where(under, node, 0)


def repeated_suffixes(rows: Contexts) -> tuple[np.ndarray, np.ndarray]:
    """For each row the columns that windows of smaller documents cover (low >= high: none)."""
    low = np.full(len(rows.doc), WINDOW * 2)
    high = np.zeros(len(rows.doc), np.int64)
    for at in range(PLACES):
        row = rows.windows(at)
        if len(row) < 2:
            continue
        order, node = deep_nodes(rows.group[row], rows.units[row, at : at + WINDOW])
        row = row[order]
        least = np.full(node.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, node, rows.doc[row])
        later = row[(node > 0) & (rows.doc[row] > least[node])]
        np.minimum.at(low, later, at)
        np.maximum.at(high, later, at + WINDOW)
    return low, high


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, marks, text_hash in zip(*batch.columns):
            words = (text.as_py() or "").encode().split()
            gone = mark_covered(len(words), marks.as_py())
            kept = b" ".join(words if not marks.is_valid else [w for w, g in zip(words, gone.tolist()) if not g])
            doc = doc.as_py()
            out.append((None if doc == NO_ID else doc, len(words), int(gone.sum()), kept.decode(), text_hash.as_py()))
        types = [*[pa.int64()] * 3, pa.string(), pa.int64()]
        for at in range(0, len(out), 256):
            columns = [pa.array(c, t) for c, t in zip(zip(*out[at : at + 256]), types)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in RESULT.split(", ")])


def remove_repeated_words(docs: DataFrame) -> DataFrame:
    """Every row of (doc_id, text) with its words that no window of a smaller document covers.

    ``text_hash`` names the text that was cut, as rows may share an id.
    """
    rows = covered(docs, word_units, np.uint64, repeated_suffixes)
    return rows.select("doc_id", "text", "marks", row_hash("text").alias("text_hash")).mapInArrow(_cut, RESULT)


def documents_without_repeats(docs: DataFrame, removed: DataFrame) -> DataFrame:
    """The documents with their own columns; where words were removed, the kept ones are the text.

    A row takes what was kept of its own id and text: rows of one id keep their own texts.
    """
    short = removed.where("n_removed > 0").groupBy(F.col("doc_id").alias("_cut_id"), F.col("text_hash").alias("_cut_hash"))
    short = short.agg(F.min("kept").alias("_cut_text"))
    names = docs.columns
    same = docs["doc_id"].eqNullSafe(F.col("_cut_id")) & (row_hash("text") == F.col("_cut_hash"))
    out = docs.join(short, same, "left").withColumn("text", F.coalesce("_cut_text", "text"))
    if "n_chars" in names:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("_cut_hash").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    return out.select(*names)
