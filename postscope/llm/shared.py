"""Shared folder, written intermediate tables and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A list of ids is sent to all tasks up to this length (16 MB).
SENT_IDS = 2_000_000
#: Rows go to Python tasks in batches of about so many bytes (4 MB), unless the session says otherwise.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder that driver and executors share.

    ``spark.checkpoint.dir`` is read from the session. Only a local session without it
    gets a temporary folder; on a cluster the missing setting is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="postscope-llm-")
    return f"{folder.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches in this session, if it has no bound of its own.

    Batches are bounded by 10,000 rows otherwise, which are tens of MB of texts. The
    executor's JVM holds them twice (vectors, then the stream to the worker), each rounded
    up to a power of two, and the worker once more, for every running task.
    """
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends here."""
    small_batches(df.sparkSession)
    path = shared_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent_if_few(rows: DataFrame, label: str) -> DataFrame:
    """A written table, hinted to be sent to all tasks if it has at most ``SENT_IDS`` rows."""
    rows = written(rows, label)
    return F.broadcast(rows) if rows.limit(SENT_IDS + 1).count() <= SENT_IDS else rows


def row_hash(*columns: str) -> Column:
    """Hash of columns that tells nulls from values; with doc_id it tells rows of one id apart."""
    return F.xxhash64(*[c for name in columns for c in (F.col(name), F.col(name).isNull())])


def _digest(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """Connected components of an edge table (u, v): rows (id, component_id).

    Alternates large stars and small stars: every vertex hangs its larger (then its
    smaller) neighbours on the smallest one, until nothing changes. Minima are
    combined before each shuffle and joined back, so a vertex with many neighbours is
    split by adaptive execution. Every round is written to the shared folder. Vertices
    without an edge are not returned; loops and repeated edges have no effect.
    """
    now = written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    seen = _digest(now)
    while seen[0]:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        small = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        before, seen = seen, _digest(now)
        if before == seen:
            break
    leaves = now.groupBy("u").agg(F.min("v").alias("component_id")).select(F.col("u").alias("id"), "component_id")
    roots = now.select(F.col("v").alias("id")).distinct()
    roots = roots.join(leaves.select("id"), "id", "left_anti").select("id", F.col("id").alias("component_id"))
    return leaves.union(roots)
