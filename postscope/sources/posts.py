"""Posts from JSON Lines, and the table layout that later joins profit from."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT_COLUMN = "_corrupt_record"

# Fixed value: JSON time format; the default of the writer stops at milliseconds.
TIME_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"

#: Lines of a file of posts at most.
FILE_RECORDS = 50_000


def read_posts(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None
) -> DataFrame:
    """Read JSON Lines; a missing path raises when the plan is built.

    With a schema nothing is inferred and the lines are read once. A line that
    does not parse keeps its text in ``_corrupt_record``; the schema gets that
    column if it lacks it. Without a schema Spark makes one pass to infer it.
    """
    reader = spark.read.option("mode", "PERMISSIVE").option(
        "columnNameOfCorruptRecord", CORRUPT_COLUMN
    )
    if schema is not None:
        if isinstance(schema, str):
            schema = T.StructType.fromDDL(schema)
        if CORRUPT_COLUMN not in schema.fieldNames():
            schema = T.StructType(schema.fields + [T.StructField(CORRUPT_COLUMN, T.StringType())])
        reader = reader.schema(schema)
    return reader.json(path)


def write_posts_json(posts: DataFrame, path: str) -> None:
    """Write one JSON record per line, nulls left out, in packed files of a bounded number of lines.

    A packed file is read by one task, so none may grow with the posts.
    """
    packed = {"compression": "gzip", "maxRecordsPerFile": FILE_RECORDS, "timestampNTZFormat": TIME_FORMAT}
    posts.write.mode("errorifexists").options(**packed).json(path)


def write_posts_table(posts: DataFrame, table: str, buckets: int) -> None:
    """Save posts as a table bucketed and sorted by ``post_id``.

    Vectors saved with the same bucket count join it without a shuffle, and so
    do the per-post aggregates of the sentiment and keyword operators.
    """
    (
        posts.write.mode("errorifexists")
        .format("parquet")
        .bucketBy(buckets, "post_id")
        .sortBy("post_id")
        .saveAsTable(table)
    )


def split_corrupt(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records without the corrupt column, and the bad ones with it.

    The bad ones keep all columns: Spark refuses to read the corrupt column alone.
    """
    if CORRUPT_COLUMN not in records.columns:
        bad = records.limit(0).withColumn(CORRUPT_COLUMN, F.lit(None).cast("string"))
        return records, bad
    good = records.filter(F.col(CORRUPT_COLUMN).isNull()).drop(CORRUPT_COLUMN)
    return good, records.filter(F.col(CORRUPT_COLUMN).isNotNull())
