"""Exact similarity search that leaves out vectors which cannot win.

Vectors are saved in cells, each around a centre, with a small table of balls: how far a
cell's vectors lie from its centre, in distance and in angle, and how long they are. A
ball bounds the score of all its vectors with a query. A search reads the most promising
cells first; the k-th score found there rules out every cell whose bound is below it.
Cells are folders of the saved table, so that a cell ruled out is never opened. The
result is that of ``search_top_k``, row for row; only what is read depends on the cells.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postscope import fixed_values as fv
from postscope.operators import search
from postscope.scratch import written

#: Centres are fitted on so many vectors for each cell, chosen by a hash of their ids.
SAMPLE_PER_CELL = 32
#: A cell is saved in files of about so many vectors; a hot cell has many files.
FILE_ROWS = 1_000_000
# Vectors with an infinite entry are in a cell of their own that is always read.
_UNBOUNDED = -1
# Bounds and scores are sums in different orders; a bound is taken to be higher by this share of its terms.
_SLACK = 1e-9
_BALLS = "balls"
_VECTORS = "vectors"


def _centres(vectors: DataFrame, cells: int, rounds: int = 5) -> np.ndarray:
    """Centres of at most ``cells`` groups of a sample of ``SAMPLE_PER_CELL`` vectors for each.

    The sample is chosen by a hash of the ids, so it does not depend on the layout, and its
    size by ``cells`` alone: it is all of the vectors that passes through the driver.
    """
    usable = vectors.filter(F.col("embedding").isNotNull() & F.forall("embedding", _finite))
    sample = usable.orderBy(F.xxhash64("post_id"), "post_id").limit(cells * SAMPLE_PER_CELL)
    rows = [r.embedding for r in sample.select("embedding").collect()]
    if not rows:
        return np.zeros((0, 0))
    if len({len(r) for r in rows}) > 1:
        raise ValueError("vectors have different numbers of entries")
    points = np.array(rows, dtype="float64")
    # Each further centre is the vector farthest from those chosen, which keeps the balls small.
    chosen = [int(np.linalg.norm(points - points.mean(axis=0), axis=1).argmin())]
    away = np.linalg.norm(points - points[chosen[0]], axis=1)
    while len(chosen) < cells and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, np.linalg.norm(points - points[chosen[-1]], axis=1))
    centres = points[chosen]
    for _ in range(rounds):
        own = _nearest(points, centres)
        counts = np.bincount(own, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        centres = sums[counts > 0] / counts[counts > 0][:, None]
    return centres


def _finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    sizes = (centres**2).sum(axis=1)
    slabs = [points[a : a + 1024] for a in range(0, len(points), 1024)]
    return np.concatenate([(sizes - 2 * (slab @ centres.T)).argmin(axis=1) for slab in slabs])


def build_ball_index(vectors: DataFrame, path: str, cells: int = 256) -> None:
    """Save ``(post_id, embedding)`` below ``path`` in cells, and the table of their balls.

    Null vectors and those with null or NaN entries have no score and are not saved. The
    number of cells bounds what a search holds on the driver, a centre for each; a cell of
    many vectors, as of a vector with many copies, is dealt to as many files as it fills.
    """
    spark = vectors.sparkSession
    id_field = vectors.schema["post_id"]
    aligned = vectors.select("post_id", F.col("embedding").cast("array<double>").alias("embedding"))
    scored = aligned.filter(
        F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x))
    )
    centres = _centres(scored, cells)
    sent = spark.sparkContext.broadcast(centres)

    def place(batches):
        import pyarrow as pa

        middle = sent.value
        lengths_of_middle = np.linalg.norm(middle, axis=1) if len(middle) else np.zeros(0)
        for batch in batches:
            if not batch.num_rows:
                continue
            size = middle.shape[1] if len(middle) else len(batch.column("embedding")[0])
            _, rows = search._matrix(batch, size)
            fine = np.isfinite(rows).all(axis=1) if len(middle) else np.zeros(len(rows), bool)
            cell = np.full(len(rows), _UNBOUNDED, np.int32)
            away, cosine = np.full(len(rows), np.inf), np.full(len(rows), -1.0)
            length = np.full(len(rows), np.inf)
            if fine.any():
                kept = rows[fine]
                own = _nearest(kept, middle)
                cell[fine] = own
                away[fine] = np.linalg.norm(kept - middle[own], axis=1)
                length[fine] = np.linalg.norm(kept, axis=1)
                product = (kept * middle[own]).sum(axis=1)
                both = length[fine] * lengths_of_middle[own]
                # A vector of no length takes no part in angles; a centre of none bounds none.
                cosine[fine] = np.where(
                    length[fine] == 0, 1.0, np.divide(product, both, out=np.full(len(both), -1.0), where=both > 0)
                )
            yield pa.RecordBatch.from_arrays(
                [batch.column("post_id"), batch.column("embedding"), pa.array(cell), *map(pa.array, (away, cosine, length))],
                names=["post_id", "embedding", "cell", "away", "cosine", "length"],
            )

    id_type = id_field.dataType.simpleString()
    schema = f"post_id {id_type}, embedding array<double>, cell int, away double, cosine double, length double"
    placed = written(scored.mapInArrow(place, schema), "cells")
    balls = placed.groupBy("cell").agg(
        F.max("away").alias("radius"),
        F.min("cosine").alias("least_cosine"),
        F.min("length").alias("least_length"),
        F.max("length").alias("most_length"),
        F.count(F.lit(1)).alias("vectors"),
    )
    balls = written(balls, "balls")
    known = [(i, [float(x) for x in c]) for i, c in enumerate(centres)]
    middles = spark.createDataFrame(known, "cell int, centre array<double>")
    # The type of the ids goes along, as a table without vectors has no files that tell it.
    balls = balls.withColumn("post_id", F.lit(None).cast(id_field.dataType))
    balls.join(middles, "cell", "left").coalesce(1).write.parquet(f"{path}/{_BALLS}")
    # One row per cell, so at most ``cells`` + 1 rows are sent.
    parts = balls.select("cell", F.ceil(F.col("vectors") / FILE_ROWS).alias("parts"))
    files = int(parts.agg(F.sum("parts")).first()[0] or 1)
    dealt = placed.join(F.broadcast(parts), "cell").withColumn(
        "part", F.pmod(F.xxhash64("post_id", "embedding"), F.col("parts"))
    )
    (
        dealt.repartition(files, "cell", "part")
        .select("post_id", "embedding", "cell")
        .write.partitionBy("cell")
        .parquet(f"{path}/{_VECTORS}")
    )


@dataclass
class BallIndex:
    """The balls of an index, one row for each cell, and the saved vectors."""

    vectors: DataFrame
    cells: np.ndarray
    centres: np.ndarray
    radius: np.ndarray
    least_cosine: np.ndarray
    least_length: np.ndarray
    most_length: np.ndarray
    counts: np.ndarray

    def bounds(self, query: np.ndarray, cosine: bool) -> np.ndarray:
        """No vector of a cell has a higher score with the query than this."""
        size = np.linalg.norm(query)
        lengths = np.linalg.norm(self.centres, axis=1)
        product = self.centres @ query
        both = lengths * size
        angle = np.arccos(np.clip(np.divide(product, both, out=np.ones(len(both)), where=both > 0), -1, 1))
        nearest = np.cos(np.maximum(0.0, angle - np.arccos(np.clip(self.least_cosine, -1, 1)) - 1e-7))
        if cosine:
            bound = nearest
        else:
            with np.errstate(invalid="ignore"):
                by_distance = product + size * self.radius
                by_angle = size * np.where(nearest > 0, self.most_length, self.least_length) * nearest
                slack = _SLACK * size * (lengths + self.radius)
            bound = np.fmin(by_distance, by_angle) + slack
        # Rounded scores may lie above by half a unit of the last digit.
        bound = bound + 10.0**-search.SCORE_DIGITS
        return np.where((self.cells == _UNBOUNDED) | np.isnan(bound), np.inf, bound)


def load_ball_index(spark: SparkSession, path: str) -> BallIndex:
    """An index as saved; its balls, one for each cell, are read now."""
    balls = spark.read.parquet(f"{path}/{_BALLS}")
    id_type = balls.schema["post_id"].dataType.simpleString()
    schema = f"post_id {id_type}, embedding array<double>, cell int"
    vectors = spark.read.schema(schema).parquet(f"{path}/{_VECTORS}")
    rows = balls.orderBy("cell").collect()
    size = max((len(r.centre) for r in rows if r.centre is not None), default=0)
    centres = np.array([r.centre or [0.0] * size for r in rows], dtype="float64").reshape(len(rows), size)
    names = ("cell", "radius", "least_cosine", "least_length", "most_length", "vectors")
    cells, *numbers = (np.array([r[name] for r in rows], dtype="float64") for name in names)
    return BallIndex(vectors, cells.astype(int), centres, *numbers)


def winning_cells(
    posts: DataFrame | None, index: BallIndex, query_vector: Sequence[float], k: int, cosine: bool = False
) -> list[int]:
    """Cells that may hold one of the k best posts.

    The cells with the highest bounds that hold k vectors are searched, and the k-th score
    of their posts decides about the others. While they hold fewer than k posts, as many
    cells more are searched as were before.
    """
    if not len(index.cells):
        return []
    query = np.array([float(x) for x in query_vector])
    if index.centres.shape[1] and len(query) != index.centres.shape[1]:
        raise ValueError(f"the query has {len(query)} entries, not {index.centres.shape[1]}")
    if not index.centres.shape[1]:
        return index.cells.tolist()
    if cosine and not np.linalg.norm(query) > 0:
        return index.cells.tolist()
    bounds = index.bounds(query, cosine)
    order = np.lexsort((index.cells, -bounds))
    taken = int(np.searchsorted(np.cumsum(index.counts[order]), k)) + 1
    while taken < len(order):
        tried = [int(c) for c in index.cells[order[:taken]]]
        scores = search.similarity_scores(posts, _vectors_of(index, tried), query_vector, cosine)
        best = scores.select(F.round("similarity_score", search.SCORE_DIGITS).alias("s")).orderBy(F.desc("s")).limit(k)
        found = best.agg(F.count("s").alias("n"), F.min("s").alias("least")).first()
        if found.n >= k:
            # Equal scores go by id: a cell that can reach the k-th score is read as well.
            return sorted(int(c) for c in index.cells[order[: max(taken, int((bounds >= found.least).sum()))]])
        taken *= 2
    return [int(c) for c in index.cells]


def _vectors_of(index: BallIndex, cells: list[int]) -> DataFrame:
    """The vectors of some cells; the test of the folder's name leaves the other cells unread."""
    return index.vectors.filter(F.col("cell").isin(cells)).select("post_id", "embedding")


def search_balls(
    posts: DataFrame,
    index: BallIndex,
    query_vector: Sequence[float],
    k: int = fv.DEFAULT_TOP_K,
    matched: bool = False,
    cosine: bool = False,
) -> DataFrame:
    """As ``search_top_k``, reading only cells that may hold one of the k best posts."""
    cells = winning_cells(None if matched else posts, index, query_vector, k, cosine)
    return search.search_top_k(posts, _vectors_of(index, cells), query_vector, k, matched, cosine)
