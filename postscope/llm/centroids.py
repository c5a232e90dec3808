"""Lloyd's rounds over integer vectors with scalar look-up tables.

Every component x becomes the integer floor(256 * x). For each dimension a batch tabulates
the squared difference of every integer value that occurs there to every centroid; the
distances of its vectors are gathers from these tables and sums. A round sends one partial
sum per task, centroid and dimension, and brings back one number for each centroid and
dimension, so the driver's work depends on neither vectors nor tasks. All arithmetic is in
whole numbers and exact, so results depend on no order of rows or tasks.

Cases: only vectors with exactly ``dims`` components, none null or non-finite, take part and
are returned. Integers beyond 2 ** 27 in size are worked on without a bound (as Python's whole
numbers); a distance or an inertia that does not fit 64 bits is null. Rows with equal ids are
vectors of their own; where they, or vectors without an id (named ``null``), tie for a first
centroid, their components decide. With fewer vectors than centroids each vector is one. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postscope.llm.shared import written
from postscope.session import literal_rows

CENTROIDS = 40
ROUNDS = 5
DIMS = 64
SCALE = 256
SEED_NAME = "2"
#: Vectors whose tables and distances are worked on together.
BLOCK = 2048
#: Integers up to this size have squared distances that fit 64 bits.
SMALL = 1 << 27
LIMB = 60

VECTORS = "vec_id long, rank string, small binary, large array<string>"
SUMS = "cluster int, dim int, limb int, part long"
ASSIGNED = "vec_id long, cluster int, distance decimal(38,0)"


def _integers(dims: int, seed: str):
    """Names and integers of the vectors that take part; integers as 32-bit numbers or, beyond, as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = pc.list_value_length(batch.column(1))
            batch = batch.filter(pc.fill_null(pc.equal(lengths, dims), False))
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
            rows = flat.reshape(batch.num_rows, dims)
            finite = np.isfinite(rows).all(axis=1)
            rows, ids = rows[finite], batch.column(0).filter(pa.array(finite))
            names = [f"{seed}:{'null' if i is None else i}" for i in ids.to_pylist()]
            fits = (np.abs(rows) < SMALL // SCALE).all(axis=1)
            small = np.floor(SCALE * np.where(fits[:, None], rows, 0.0)).astype("<i4")
            large = [None if f else [str(SCALE * Fraction(x) // 1) for x in row.tolist()] for f, row in zip(fits, rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    pa.array([hashlib.sha256(name.encode()).hexdigest() for name in names], pa.string()),
                    pa.array([row.tobytes() if f else None for f, row in zip(fits, small)], pa.binary()),
                    pa.array(large, pa.list_(pa.string())),
                ],
                names=["vec_id", "rank", "small", "large"],
            )

    return run


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integer matrices; small integers as 64-bit numbers, others as Python's."""
    for batch in batches:
        large = batch.column(2).is_valid()
        for part, exact in ((batch.filter(batch.column(1).is_valid()), False), (batch.filter(large), True)):
            for at in range(0, part.num_rows, size):
                some = part.slice(at, size)
                if exact:
                    rows = np.array([[int(x) for x in row] for row in some.column(2).to_pylist()], object)
                else:
                    rows = np.stack([np.frombuffer(x, "<i4") for x in some.column(1).to_pylist()]).astype(np.int64)
                yield some.column(0), rows


def distances(rows: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances (vectors by centroids) from one table per dimension."""
    total = np.zeros((len(rows), len(centroids)), rows.dtype)
    for dim in range(rows.shape[1]):
        values, place = np.unique(rows[:, dim], return_inverse=True)
        table = (values[:, None] - centroids[:, dim][None, :]) ** 2
        total += table[place]
    return total


def _fitting(centroids: list[list[int]], rows: np.ndarray) -> np.ndarray:
    """The centroids in the arithmetic that the rows, and they themselves, call for."""
    wide = rows.dtype == object or any(abs(x) > SMALL for c in centroids for x in c)
    return np.array(centroids, object if wide else np.int64)


def _assign(centroids: list[list[int]], rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    means = _fitting(centroids, rows)
    found = distances(rows.astype(means.dtype), means)
    cluster = np.argmin(found, axis=1)  # the first of equals
    return cluster, found[np.arange(len(rows)), cluster]


def _partial_sums(centroids: list[list[int]], size: int):
    """Per task: for each centroid its vectors (dim -1) and the sum of each dimension, in limbs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dims = len(centroids), len(centroids[0])
        total = np.zeros((k, dims + 1), object)
        for _, rows in _blocks(batches, size):
            cluster, _ = _assign(centroids, rows)
            order = np.argsort(cluster, kind="stable")
            edges = np.flatnonzero(np.concatenate([[True], np.diff(cluster[order]) != 0]))
            sums = np.add.reduceat(rows[order], edges, axis=0)
            for i, c in enumerate(cluster[order][edges]):
                total[c, 1:] += sums[i].astype(object)
            total[:, 0] += np.bincount(cluster, minlength=k).astype(object)
        out = []
        for c, d in np.argwhere(total != 0):
            value, limb = int(total[c, d]), 0
            while value not in (0, -1):
                out.append((c, d - 1, limb, value & ((1 << LIMB) - 1)))
                value, limb = value >> LIMB, limb + 1
            if value:  # -1 stands for all higher limbs of a negative sum
                out.append((c, d - 1, limb, -1))
        if out:
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([int(x) for x in column], t) for column, t in zip(zip(*out), types)], names=["cluster", "dim", "limb", "part"]
            )

    return run


def _moved(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: floored means, empty ones as they were."""
    parts = vectors.mapInArrow(_partial_sums(centroids, BLOCK), SUMS).groupBy("cluster", "dim", "limb")
    parts = parts.agg(F.sum(F.col("part").cast("decimal(38,0)")).alias("part"))
    sums: dict[tuple[int, int], int] = {}
    for row in parts.collect():  # one number per centroid, dimension and limb
        key = (row["cluster"], row["dim"])
        sums[key] = sums.get(key, 0) + (int(row["part"]) << (LIMB * row["limb"]))
    moved = []
    for c, mean in enumerate(centroids):
        n = sums.get((c, -1), 0)
        moved.append([sums.get((c, d), 0) // n for d in range(len(mean))] if n else mean)
    return moved


def _assigned(centroids: list[list[int]], size: int):
    top = 10**38 - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _blocks(batches, size):
            cluster, far = _assign(centroids, rows)
            exact = [int(x) if x <= top else None for x in far]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cluster.astype(np.int32)), pa.array(exact, pa.decimal128(38, 0))],
                names=["vec_id", "cluster", "distance"],
            )

    return run


def _as_row(row) -> list[int]:
    return np.frombuffer(row["small"], "<i4").tolist() if row["small"] is not None else [int(x) for x in row["large"]]


def first_centroids(vectors: DataFrame, k: int) -> list[list[int]]:
    """The k vectors with the smallest names' hashes; equal names by components."""
    # A whole number sorts like its text with a sign and a fixed width; only ties of names need it.
    order = F.concat_ws(",", F.coalesce(F.transform("large", lambda x: F.lpad(x, 48, " ")), F.array(F.hex("small"))))
    return [_as_row(row) for row in vectors.orderBy("rank", order).limit(k).collect()]


def cluster_vectors(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, dims: int = DIMS, seed: str = SEED_NAME
) -> DataFrame:
    """One row per vector that takes part: cluster, distance, inertias and its centroid's digest."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = written(rows.mapInArrow(_integers(dims, seed), VECTORS), "integer-vectors")
    centroids = first_centroids(rows, k)
    rows = rows.select("vec_id", "small", "large")
    for _ in range(rounds if centroids else 0):
        centroids = _moved(rows, centroids)
    found = written(rows.mapInArrow(_assigned(centroids or [[0] * dims], BLOCK), ASSIGNED), "assigned-vectors")
    sums = {row["cluster"]: row["inertia"] for row in found.groupBy("cluster").agg(F.try_sum("distance").alias("inertia")).collect()}
    total = None if None in sums.values() else sum(int(x) for x in sums.values())

    def fitting(value) -> int | None:
        return int(value) if value is not None and value < 1 << 63 else None

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    table = [(c, fitting(sums.get(c)), fitting(total), d) for c, d in enumerate(digests)] or [(0, None, None, "")]
    plan = literal_rows(spark, table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(plan), "cluster").select(
        "vec_id", "cluster", F.expr("try_cast(distance AS bigint)").alias("distance"), "cluster_inertia", "inertia", "centroid_sha256"
    )
