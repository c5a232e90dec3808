"""From raw records to posts: flatten, find the time and text, add what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postscope import fixed_values as fv
from postscope.functions import dates
from postscope.sources.posts import CORRUPT_COLUMN, split_corrupt

# Epoch seconds outside of this span do not fit 64-bit nanoseconds and count as bad.
_EPOCH_LIMIT = 9_223_372_036
_TIME_RANGE = ("1677-09-21 00:12:44", "2262-04-11 23:47:16")


def _leaf_columns(schema: T.StructType, path: str, name: str) -> list[Column]:
    leaves = []
    for field in schema.fields:
        source = f"{path}.`{field.name}`"
        target = f"{name}.{field.name}" if name else field.name
        if isinstance(field.dataType, T.StructType):
            leaves += _leaf_columns(field.dataType, source, target)
        else:
            leaves.append(F.col(source).alias(target))
    return leaves


def flatten_struct(records: DataFrame, column: str = "data") -> DataFrame:
    """Keep only the fields of a struct column; deeper fields become ``a.b``.

    Records without such a struct column pass unchanged.
    """
    if column not in records.columns:
        return records
    kind = records.schema[column].dataType
    if not isinstance(kind, T.StructType):
        return records
    return records.select(*_leaf_columns(kind, f"`{column}`", ""))


def resolve_timestamp_column(records: DataFrame) -> str:
    """The first of the known timestamp columns that is there."""
    for name in fv.TIMESTAMP_COLUMNS:
        if name in records.columns:
            return name
    raise ValueError(f"no timestamp column, expected one of {', '.join(fv.TIMESTAMP_COLUMNS)}")


def epoch_to_timestamp(epoch: Column) -> Column:
    """A number since 1970 as a zone-less UTC timestamp; null where bad or out of range.

    Its size tells the unit: seconds up to 1e11, then milli-, micro- and nanoseconds.
    """
    number = epoch.cast("string").try_cast("double")
    size = F.abs(number)
    seconds = (
        F.when(size < 1e11, number)
        .when(size < 1e14, number / 1e3)
        .when(size < 1e17, number / 1e6)
        .otherwise(number / 1e9)
    )
    inside = seconds.between(-_EPOCH_LIMIT, _EPOCH_LIMIT)
    span = F.make_dt_interval(secs=F.when(inside, seconds).cast("decimal(18,6)"))
    return F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + span


def parsed_timestamp(records: DataFrame, column: str) -> Column:
    """The column as a zone-less timestamp; null where it does not parse or is out of range.

    Numbers, and texts that are a number of nine digits or more, are epochs in every
    column; the epoch column takes any number. Texts have the same range as epochs.
    """
    kind = records.schema[column].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return F.col(column).cast("timestamp_ntz")
    epoch = epoch_to_timestamp(F.col(column))
    if column == fv.EPOCH_COLUMN or isinstance(kind, T.NumericType):
        return epoch
    text = F.col(column).cast("string")
    time = text.try_cast("timestamp_ntz")
    first, last = (F.lit(x).cast("timestamp_ntz") for x in _TIME_RANGE)
    inside = F.when(time.between(first, last), time)
    return F.when(text.rlike(r"^\s*[+-]?\d{9,}(\.\d*)?\s*$"), epoch).otherwise(inside)


def parse_timestamp(records: DataFrame, column: str) -> DataFrame:
    """Turn the column into a zone-less timestamp; what does not parse becomes null."""
    return records.withColumn(column, parsed_timestamp(records, column))


def drop_undated(records: DataFrame, column: str) -> DataFrame:
    """Drop rows without a time and call the time column ``timestamp``."""
    return records.na.drop(subset=[column]).withColumnRenamed(column, "timestamp")


def choose_text_column(records: DataFrame) -> DataFrame:
    """Add ``text_col``: the body if any record has one, else the title; null becomes blank.

    The choice is global. The look-up stops at the first record that has a body.
    """
    body, title = fv.TEXT_COLUMNS
    if body in records.columns:
        if not records.filter(F.col(body).isNotNull()).select(F.lit(1)).isEmpty():
            return records.withColumn("text_col", F.coalesce(F.col(body).cast("string"), F.lit("")))
    if title in records.columns:
        return records.withColumn("text_col", F.coalesce(F.col(title).cast("string"), F.lit("")))
    raise ValueError("no text column, expected " + " or ".join(fv.TEXT_COLUMNS))


def derive_calendar(posts: DataFrame) -> DataFrame:
    """Add date, week key, month key, weekday (Monday 0) and hour."""
    time = F.col("timestamp")
    day = F.to_date(time)
    return posts.withColumns(
        {
            "date": day,
            "year_week": dates.year_week(day),
            "year_month": dates.year_month(day),
            "day_of_week": F.weekday(day),
            "hour": F.hour(time),
        }
    )


def fill_schema_defaults(posts: DataFrame) -> DataFrame:
    """Add the columns that the records do not have; present columns stay as they are."""
    have = set(posts.columns)
    added: dict[str, Column] = {}
    if "subreddit" not in have:
        added["subreddit"] = F.lit(fv.DEFAULT_SUBREDDIT)
    if "score" not in have:
        added["score"] = F.lit(fv.DEFAULT_SCORE).cast("bigint")
    if "comments" not in have:
        added["comments"] = (
            F.col("num_comments")
            if "num_comments" in have
            else F.lit(fv.DEFAULT_COMMENTS).cast("bigint")
        )
    if "title" not in have:
        added["title"] = F.substring("text_col", 1, fv.TITLE_LENGTH)
    return posts.withColumns(added) if added else posts


def column_or(posts: DataFrame, name: str, default) -> Column:
    """The column where the posts have it, else the default as a literal."""
    return F.col(name) if name in posts.columns else F.lit(default)


def without_corrupt(records: DataFrame, corrupt: str = "raise") -> DataFrame:
    """Records without corrupt lines and without the column that holds them.

    ``raise`` fails with the line when a corrupt one is met while rows are read, without a
    pass of its own; ``drop`` leaves them out (``split_corrupt`` and the line report keep them).
    """
    if corrupt not in ("raise", "drop"):
        raise ValueError("corrupt must be raise or drop")
    if CORRUPT_COLUMN not in records.columns:
        return records
    line = F.col(CORRUPT_COLUMN)
    if corrupt == "drop":
        return split_corrupt(records)[0]
    failed = F.raise_error(F.concat(F.lit("corrupt line: "), F.substring(line, 1, 200))).cast("boolean")
    return records.filter(F.when(line.isNull(), True).otherwise(failed)).drop(CORRUPT_COLUMN)


def ingest(records: DataFrame, corrupt: str = "raise") -> DataFrame:
    """All ingest steps in order: raw records in, posts out."""
    flat = flatten_struct(without_corrupt(records, corrupt))
    column = resolve_timestamp_column(flat)
    dated = drop_undated(parse_timestamp(flat, column), column)
    return fill_schema_defaults(derive_calendar(choose_text_column(dated)))
