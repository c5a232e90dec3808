"""Language identification with a string kernel.

The kernel of two texts is the number of character n-grams (lengths 1 to 4, hashed)
that occur in both, divided by the geometric mean of the numbers in each: a blended
spectrum of presences. A bounded sample of labelled rows is mapped through landmark
texts (Nyström) and a ridge regression per language, one against the rest, is solved on
the driver. With P the 0/1 matrix of n-grams in a batch of texts and L that of the
landmarks, scores are P L^T B; as L^T B is fixed, a batch is one matrix product.

Cases: a null text or one without a letter is ``und`` with score 0, and is not learned
from; a null language is not learned from; with nothing to learn from every row is
``und``. Rows with equal ids are held out alike. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ORDERS = (1, 2, 3, 4)
BITS = 16
CELLS = 1 << BITS
#: Bounds of what is learned from: labelled rows over all languages, and landmarks.
TRAIN_ROWS = 3000
LANDMARKS = 256
RIDGE = 1e-3
BATCH_TEXTS = 64
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"

_STEP = np.uint64(0x9E3779B97F4A7C15)
_LETTER = re.compile(r"[^\W\d_]")
PREDICTION = "doc_id long, held_out boolean, lang_pred string, score double"


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows of the fold that nothing is learned from; a null id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))) % FOLDS == HELD_OUT


def presence(texts: list[str | None], out: np.ndarray) -> np.ndarray:
    """Fill a row of 0/1 n-gram cells for every text; returns how many each text has."""
    out[: len(texts)] = 0
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in low])])
    gram = np.zeros(len(points), np.uint64)
    for n in ORDERS:
        if len(points) < n:
            break
        size = len(points) - n + 1
        gram = gram[:size] * _STEP + points[n - 1 :] + np.uint64(n)
        cells = ((gram * _STEP) >> np.uint64(64 - BITS)).astype(np.int64)
        for i in range(len(texts)):
            out[i, cells[bounds[i] : max(bounds[i], bounds[i + 1] - n + 1)]] = 1
    return out[: len(texts)].sum(axis=1)


@dataclass
class KernelModel:
    languages: list[str]
    weights: np.ndarray  # cells x languages
    bias: np.ndarray

    def scores(self, cells: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return cells @ self.weights / np.sqrt(np.maximum(counts, 1))[:, None] + self.bias


def unpacked(bits: np.ndarray) -> np.ndarray:
    """0/1 rows of packed bits, each divided by its length."""
    cells = np.unpackbits(bits, axis=1).astype(np.float32)
    cells /= np.sqrt(np.maximum(cells.sum(axis=1), 1))[:, None]
    return cells


def fit(bits: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> KernelModel:
    """Ridge regressions on Nyström features of packed 0/1 rows, unpacked a block at a time.

    Landmarks are taken in turn from each language.
    """
    languages = sorted(set(labels))
    truth = np.array([languages.index(x) for x in labels])
    rank = np.zeros(len(labels), np.int64)
    for k in range(len(languages)):
        rank[truth == k] = np.arange((truth == k).sum())
    base = unpacked(bits[np.lexsort((truth, rank))[:landmarks]])
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    keep = values > values.max() * 1e-7
    root = vectors[:, keep] / np.sqrt(values[keep])
    kernel = [unpacked(bits[at : at + BATCH_TEXTS]) @ base.T for at in range(0, len(bits), BATCH_TEXTS)]
    features = np.concatenate(kernel).astype(np.float64) @ root
    target = np.eye(len(languages))[truth]
    middle, share = features.mean(axis=0), target.mean(axis=0)
    shifted = features - middle
    inner = shifted.T @ shifted + ridge * len(labels) * np.eye(shifted.shape[1])
    solved = np.linalg.solve(inner, shifted.T @ (target - share))
    weights = base.T @ (root @ solved).astype(np.float32)
    return KernelModel(languages, weights, share - middle @ solved)


def training_rows(docs: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, list[str]]:
    """N-gram cells, packed to bits, and languages of at most ``train_rows`` labelled rows, as many of each language.

    Rows whose text has a letter are chosen by a hash of their id; only ids are ranked, and only the cells (8 KB a
    row) come to the driver. Of rows with one id and language the smallest cells are
    learned from, picked in each task and then over all, so that no more rows than are
    chosen arrive.
    """
    usable = F.col("lang").isNotNull() & ~held_out() & F.col("text").rlike(r"\p{L}")
    labelled = docs.where(usable).select("doc_id", "lang")
    languages = labelled.select("lang").distinct().limit(train_rows + 1).count()
    if not languages:
        return np.zeros((0, CELLS // 8), np.uint8), []
    if languages > train_rows:
        raise ValueError("more languages than training rows")
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = labelled.distinct().withColumn("n", F.row_number().over(order)).where(f"n <= {train_rows // languages}")
    chosen = chosen.select(F.col("doc_id").alias("train_id"), F.col("lang").alias("train_lang"))
    rows = docs.join(
        F.broadcast(chosen), (docs["doc_id"] == F.col("train_id")) & (docs["lang"] == F.col("train_lang"))
    ).select(F.col("doc_id").cast("long"), "train_lang", "text")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((1, CELLS), np.float32)
        least: dict[tuple[int, str], bytes] = {}  # chosen ids only: at most train_rows
        for batch in batches:
            for page, lang, text in zip(*(c.to_pylist() for c in batch.columns)):
                if text and _LETTER.search(text):
                    presence([text], cells)
                    bits = np.packbits(cells[0] > 0).tobytes()
                    least[page, lang] = min(least.get((page, lang), bits), bits)
        for (page, lang), bits in least.items():
            yield pa.RecordBatch.from_pydict({"id": [page], "lang": [lang], "bits": pa.array([bits], pa.binary())})

    packed = rows.mapInArrow(pack, "id long, lang string, bits binary")
    found = packed.groupBy("id", "lang").agg(F.min("bits").alias("bits")).collect()
    found = sorted(found, key=lambda r: (r["lang"], r["id"]))
    if not found:
        return np.zeros((0, CELLS // 8), np.uint8), []
    bits = np.frombuffer(b"".join(bytes(r["bits"]) for r in found), np.uint8).reshape(len(found), -1)
    return bits, [r["lang"] for r in found]


def identify_language(docs: DataFrame, train_rows: int = TRAIN_ROWS, landmarks: int = LANDMARKS) -> DataFrame:
    """Learn from the labelled rows outside the held-out fold, then predict every row."""
    bits, labels = training_rows(docs, train_rows)
    model = fit(bits, labels, landmarks) if labels else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        cells = np.zeros((BATCH_TEXTS, CELLS), np.float32)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_TEXTS):
                part = batch.slice(at, BATCH_TEXTS)
                texts = part.column(2).to_pylist()
                known = [bool(model and t and _LETTER.search(t)) for t in texts]
                names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
                if any(known):
                    counts = presence(texts, cells)
                    found = model.scores(cells[: len(texts)], counts)
                    best = found.argmax(axis=1)
                    names = [model.languages[b] if k else UNKNOWN for b, k in zip(best, known)]
                    scores = np.where(known, np.clip(found.max(axis=1), 0.0, 1.0), 0.0)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text")
    return rows.mapInArrow(predict, PREDICTION)
