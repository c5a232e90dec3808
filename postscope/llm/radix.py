"""Repeated byte windows by a depth-limited radix sort, and their removal.

Suffixes are ordered only through WINDOW bytes, most significant digits first. The first
digit is a suffix's anchor prefix (see ``repeats``): its pass is the shuffle, after which
groups of one document drop out. Within a task the other passes refine all groups at once
by eight bytes each; suffixes that are alone drop out, and groups that are left after the
last pass are exactly the repeated windows.

Cases: null and empty texts have no bytes; texts shorter than a window keep all; rows with
equal ids never remove from each other; null ids count as the smallest id. An empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from postscope.llm import words as W
from postscope.llm.repeats import NO_ID, PLACES, WINDOW, Contexts, Units, covered, mark_covered

DIGIT = 8
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def byte_units(chunk: W.Chunk) -> Units:
    return Units(W.BYTE_VALUES[chunk.data], chunk.bounds, chunk.data)


def digits(units: np.ndarray) -> np.ndarray:
    """The eight bytes from each column on as one number, missing ones 0."""
    padded = np.zeros((len(units), units.shape[1] + DIGIT), np.uint64)
    padded[:, : units.shape[1]] = units
    out = np.zeros(units.shape, np.uint64)
    for k in range(DIGIT):
        out |= padded[:, k : k + units.shape[1]] << np.uint64(56 - 8 * k)
    return out


def repeated_windows(rows: Contexts) -> tuple[np.ndarray, np.ndarray]:
    """For each row the columns that windows of smaller documents cover (low >= high: none)."""
    number = digits(rows.units)
    row = np.concatenate([rows.windows(at) for at in range(PLACES)])
    at = np.concatenate([np.full(len(rows.windows(at)), at) for at in range(PLACES)])
    label = rows.group[row] * PLACES + at
    for done in range(0, WINDOW, DIGIT):
        digit = number[row, at + done]
        if WINDOW - done < DIGIT:
            digit = digit >> np.uint64(8 * (DIGIT - (WINDOW - done)))
        order = np.lexsort((digit, label))
        row, at, label, digit = row[order], at[order], label[order], digit[order]
        new = np.ones(len(row), bool)
        new[1:] = (label[1:] != label[:-1]) | (digit[1:] != digit[:-1])
        label = np.cumsum(new) - 1
        several = np.bincount(label, minlength=1)[label] > 1 if len(label) else new
        row, at, label = row[several], at[several], label[several]
    low = np.full(len(rows.doc), WINDOW * 2)
    high = np.zeros(len(rows.doc), np.int64)
    if len(row):
        least = np.full(label.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, label, rows.doc[row])
        later = rows.doc[row] > least[label]
        np.minimum.at(low, row[later], at[later])
        np.maximum.at(high, row[later], at[later] + WINDOW)
    return low, high


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc, text, marks in zip(batch.column(0), batch.column(1), batch.column(2)):
            data = np.frombuffer((text.as_py() or "").encode(), np.uint8)
            gone = mark_covered(len(data), marks.as_py())
            spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
            kept = data[~gone].tobytes() if spans else data.tobytes()
            doc = doc.as_py()
            out.append((None if doc == NO_ID else doc, len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        types = [*[pa.int64()] * 4, pa.string(), pa.binary()]
        for at in range(0, len(out), 256):
            columns = [pa.array(c, t) for c, t in zip(zip(*out[at : at + 256]), types)]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in RESULT.split(", ")])


def remove_repeated_bytes(docs: DataFrame) -> DataFrame:
    """Every row of (doc_id, text) with its bytes that no window of a smaller document covers."""
    return covered(docs, byte_units, np.uint8, repeated_windows).mapInArrow(_cut, RESULT)
