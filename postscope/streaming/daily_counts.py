"""The daily counts of the batch operators, kept up to date from a folder of JSON Lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postscope.operators.ingest import (
    drop_undated,
    flatten_struct,
    parse_timestamp,
    resolve_timestamp_column,
    without_corrupt,
)
from postscope.sources.posts import CORRUPT_COLUMN


def stream_posts(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Posts from JSON files as they arrive in a folder; corrupt lines are left out."""
    if isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if CORRUPT_COLUMN not in schema.fieldNames():
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT_COLUMN, T.StringType())])
    reader = spark.readStream.schema(schema).option("columnNameOfCorruptRecord", CORRUPT_COLUMN)
    records = flatten_struct(without_corrupt(reader.json(path), "drop"))
    column = resolve_timestamp_column(records)
    return drop_undated(parse_timestamp(records, column), column)


def stream_posts_by_day_subreddit(posts: DataFrame, late: str = "1 day") -> DataFrame:
    """``(date, subreddit, posts)``; a day is final once the watermark has passed it.

    State is one count per open day and community. Watermarks need an instant, so the
    zone-less times are read as UTC, where days of a window begin too.
    """
    instant = F.to_timestamp(F.concat(F.col("timestamp").cast("string"), F.lit("Z")))
    counts = (
        posts.filter(F.col("subreddit").isNotNull())
        .select("subreddit", instant.alias("instant"))
        .withWatermark("instant", late)
        .groupBy(F.window("instant", "1 day"), "subreddit")
        .agg(F.count(F.lit(1)).alias("posts"))
    )
    start = F.to_utc_timestamp("window.start", F.current_timezone())
    return counts.select(F.to_date(start).alias("date"), "subreddit", "posts")
