"""Near-duplicate vectors by random-hyperplane hashing with exact verification.

Equal vectors are one class, and one of each class takes part. A table's hash is the signs
of a vector's products with some random planes; bits per table follow the number of
vectors, and the number of tables follows from the wanted recall at the threshold. Vectors
of a bucket are compared by exact cosines in blocks; a pair is counted in the first table
in which it meets. A block returns one row per vector, its links and the root of its
block's component, so copies of a hot bucket never turn into rows of pairs.

Cases: vectors that are null, empty or zero or hold null or non-finite components link with
nothing and are components of their own; vectors of different length are never compared.
Classes are compared and joined under names of their own (``class_id``, from their content), so
rows with equal ids, and rows without one, are vectors of their own in links and components. A
component is named by its smallest id; without any id it has no name, and its rows are all
kept. A row without an id is not kept if its component has a name. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postscope.llm.jaccard import complete_groups
from postscope.llm.shared import components, written

THRESHOLD = 0.95
RECALL = 0.9999
BUCKET_VECTORS = 16
BLOCK = 1000
SEED = 7

KEYED = "vec_id long, digest binary"
SIGNED = "class_id long, digest binary, dim int, signs array<long>, vector binary"
LINKS = "class_id long, links long, root long"


def tables_for(count: int, threshold: float = THRESHOLD, recall: float = RECALL) -> tuple[int, int]:
    """Bits per table and number of tables for so many vectors."""
    bits = min(60, max(6, math.ceil(math.log2(max(count, 1) / BUCKET_VECTORS + 1))))
    same = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - same))


def usable(row: list | None) -> np.ndarray | None:
    """A vector in double precision, or None if it links with nothing."""
    if not row or any(x is None for x in row):
        return None
    vector = np.array(row, np.float64)
    return vector if np.isfinite(vector).all() and vector.any() else None


def vector_digest(vector: np.ndarray) -> bytes:
    return hashlib.blake2b((vector + 0.0).tobytes(), digest_size=16).digest()


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vectors = [usable(x) for x in batch.column(1).to_pylist()]
        digests = [None if v is None else vector_digest(v) for v in vectors]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary())], names=["vec_id", "digest"])


def class_name(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def _signed(bits: int, tables: int):
    """Signs and double components of one vector of each class of this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        seen: set[bytes] = set()
        place = (1 << np.arange(bits, dtype=np.int64))[:, None]
        for batch in batches:
            out = []
            for row in batch.column(0).to_pylist():
                vector = usable(row)
                digest = None if vector is None else vector_digest(vector)
                if digest is None or digest in seen:
                    continue
                seen.add(digest)
                dim = len(vector)
                if dim not in planes:
                    planes[dim] = np.random.Generator(np.random.PCG64(SEED + dim)).standard_normal((dim, tables * bits))
                side = (vector / np.abs(vector).max() @ planes[dim] > 0).reshape(tables, bits)
                out.append((class_name(digest), digest, dim, (side @ place)[:, 0].tolist(), vector.tobytes()))
            types = [pa.int64(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.binary()]
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), types)], names=["class_id", "digest", "dim", "signs", "vector"]
                )

    return run


def cosine_links(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which rows reach the threshold; cosines next to it are summed exactly."""

    def unit(x):
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.sqrt((x * x).sum(axis=1, keepdims=True))

    a, b = unit(left), unit(right)
    found = a @ b.T
    linked = found >= threshold
    for i, j in np.argwhere(np.abs(found - threshold) < 1e-10):
        x, y = left[i] / np.abs(left[i]).max(), right[j] / np.abs(right[j]).max()
        product, size = math.fsum(x * y), math.sqrt(math.fsum(x * x)) * math.sqrt(math.fsum(y * y))
        linked[i, j] = product / size >= threshold
    return linked


def roots(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Smallest id of each row's component of a symmetric link matrix."""
    label = ids.copy()
    top = np.iinfo(np.int64).max
    while True:
        least = np.minimum(label, np.where(linked, label[None, :], top).min(axis=1))
        if (least == label).all():
            return label
        label = least


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in complete_groups(batches, 5):
            if rows.num_rows < 2:
                continue
            table = rows.column(1)[0].as_py()
            ids, copies, side = (rows.column(i).to_numpy(zero_copy_only=False) for i in (5, 6, 7))
            signs = np.array(rows.column(8).to_pylist(), np.int64)
            vectors = np.stack([np.frombuffer(x, np.float64) for x in rows.column(9).to_pylist()])
            linked = cosine_links(vectors, vectors, threshold)
            linked |= linked.T
            np.fill_diagonal(linked, False)
            if rows.column(3)[0].as_py() != rows.column(4)[0].as_py():
                linked &= side[:, None] != side[None, :]
            root = roots(linked, ids)
            i, j = np.nonzero(linked)
            if table and len(i):
                first = ~(signs[i, :table] == signs[j, :table]).any(axis=1)
                i, j = i[first], j[first]
            links = np.bincount(i, weights=copies[j], minlength=len(ids)).astype(np.int64)
            keep = (links > 0) | (root != ids)
            if keep.any():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[keep]), pa.array(links[keep]), pa.array(root[keep])], names=["class_id", "links", "root"]
                )

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of (vec_id, embedding): links, component and whether it stays."""
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding")
    keyed = written(rows.mapInArrow(_keyed, KEYED), "vector-keys")
    classes = keyed.where("digest IS NOT NULL").groupBy("digest").agg(
        F.min("vec_id").alias("first_id"), F.count("*").alias("copies")
    )
    classes = written(classes, "vector-classes")
    bits, tables = tables_for(classes.count(), threshold, recall)
    chosen = rows.select("embedding").mapInArrow(_signed(bits, tables), SIGNED).dropDuplicates(["digest"])
    signed = written(chosen.join(classes.select("digest", "copies"), "digest"), "signs")
    each = signed.select("class_id", "dim", F.posexplode("signs").alias("table", "bucket"))
    shared = each.groupBy("dim", "table", "bucket").agg(F.count("*").alias("n")).where("n > 1")
    shared = shared.withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n")
    placed = each.join(shared, ["dim", "table", "bucket"])
    placed = placed.withColumn("own", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select(
        "dim",
        "table",
        "bucket",
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
        "class_id",
        (F.col("own") > F.col("other")).cast("int").alias("side"),
    )
    placed = placed.join(signed.select("class_id", "copies", "signs", "vector"), "class_id")
    group = ["dim", "table", "bucket", "low", "high"]
    placed = placed.select(*group, "class_id", "copies", "side", "signs", "vector")
    found = placed.repartition(*group).sortWithinPartitions(*group).mapInArrow(_compare(threshold), LINKS)
    found = written(found, "vector-links")
    links = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    joined = components(found.where("class_id <> root").select(F.col("class_id").alias("u"), F.col("root").alias("v")))
    named = signed.select("class_id", "digest").join(classes, "digest")
    joined = written(joined.join(named.select(F.col("class_id").alias("id"), "first_id"), "id"), "vector-components")
    least = joined.groupBy("component_id").agg(F.min("first_id").alias("least_id"))
    joined = joined.join(least, "component_id").select(F.col("id").alias("class_id"), F.lit(True).alias("joined"), "least_id")
    named = named.join(links, "class_id", "left").join(joined, "class_id", "left").select(
        "digest",
        (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
        F.when(F.col("joined"), F.col("least_id")).otherwise(F.col("first_id")).alias("component_id"),
        F.lit(True).alias("usable"),
    )
    out = keyed.join(named, "digest", "left").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).alias("n_links"),
        F.when(F.col("usable"), F.col("component_id")).otherwise(F.col("vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
