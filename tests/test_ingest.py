import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F

from postscope import fixed_values as fv
from postscope.operators import ingest, reports
from postscope.sources import posts as files


def write_lines(folder, lines):
    path = os.path.join(str(folder), "posts.jsonl")
    with open(path, "w") as out:
        out.write("\n".join(lines) + "\n")
    return path


def test_missing_file_raises(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_posts(spark, str(tmp_path / "absent.jsonl"))


def test_flat_and_nested_records_and_a_corrupt_line(spark, tmp_path):
    lines = [
        json.dumps({"data": {"post_id": 1, "created_utc": 0, "media": {"kind": {"a": 5}}}}),
        '{"data": {"post_id": 2, "crea',
        json.dumps({"kind": "x", "data": {"post_id": 3, "created_utc": 1.5}}),
    ]
    schema = (
        "kind string, data struct<post_id:bigint, created_utc:double, "
        "media:struct<kind:struct<a:int>>>"
    )
    records = files.read_posts(spark, write_lines(tmp_path, lines), schema)
    good, bad = files.split_corrupt(records)
    assert [row._corrupt_record for row in bad.collect()] == [lines[1]]
    flat = ingest.flatten_struct(good)
    assert flat.columns == ["post_id", "created_utc", "media.kind.a"]
    report = dict(reports.corrupt_line_report(records, ["kind", "absent"]).collect())
    assert report == {"corrupt": 1, "missing kind": 1, "missing absent": 2}


def test_without_schema_columns_are_inferred(spark, tmp_path):
    path = write_lines(tmp_path, [json.dumps({"post_id": 7, "title": "a"})])
    assert files.read_posts(spark, path).columns == ["post_id", "title"]


def test_json_round_trip_keeps_microseconds(spark, tmp_path):
    source = spark.sql("SELECT 1L AS post_id, timestamp_ntz'2024-01-02 03:04:05.678901' AS t")
    path = str(tmp_path / "out")
    files.write_posts_json(source, path)
    back = files.read_posts(spark, path, source.schema).first()
    assert back.t == dt.datetime(2024, 1, 2, 3, 4, 5, 678901)


def test_timestamp_column_order_and_absence(spark):
    both = spark.sql("SELECT 1 AS created_at, 2 AS created_utc")
    assert ingest.resolve_timestamp_column(both) == "created_utc"
    assert ingest.resolve_timestamp_column(both.withColumn("timestamp", F.lit(1))) == "timestamp"
    with pytest.raises(ValueError):
        ingest.resolve_timestamp_column(spark.sql("SELECT 1 AS time"))


def test_epochs(spark):
    rows = [(1, "0"), (2, "junk"), (3, None), (4, "1e300"), (5, "-1.5"), (6, "NaN")]
    records = spark.createDataFrame(rows, "post_id int, created_utc string")
    parsed = {r.post_id: r.created_utc for r in
              ingest.parse_timestamp(records, "created_utc").collect()}
    assert parsed == {
        1: dt.datetime(1970, 1, 1),
        2: None,
        3: None,
        4: None,
        5: dt.datetime(1969, 12, 31, 23, 59, 58, 500000),
        6: None,
    }
    kept = ingest.drop_undated(ingest.parse_timestamp(records, "created_utc"), "created_utc")
    assert {r.post_id for r in kept.collect()} == {1, 5}
    assert "timestamp" in kept.columns


def test_text_timestamps_keep_their_wall_time(spark):
    rows = [("2024-05-06T07:08:09Z",), ("2024-05-06 07:08:09",), ("garbage",), (None,)]
    records = spark.createDataFrame(rows, "created_at string")
    found = [r[0] for r in ingest.parse_timestamp(records, "created_at").collect()]
    assert found == [dt.datetime(2024, 5, 6, 7, 8, 9)] * 2 + [None, None]


def test_text_column_falls_back_to_title(spark):
    some = spark.createDataFrame([(None, "a"), ("b", "c")], "selftext string, title string")
    assert [r.text_col for r in ingest.choose_text_column(some).collect()] == ["", "b"]
    none = spark.createDataFrame([(None, "a"), (None, None)], "selftext string, title string")
    assert [r.text_col for r in ingest.choose_text_column(none).collect()] == ["a", ""]
    with pytest.raises(ValueError):
        ingest.choose_text_column(some.drop("selftext", "title"))


@pytest.mark.parametrize(
    "day, key",
    [
        ("2022-12-31", "2022-52"),
        ("2023-01-01", "2023-01"),
        ("2018-12-31", "2018-52"),
        ("2019-01-01", "2019-00"),
        ("2019-01-06", "2019-01"),
        ("2017-12-31", "2017-53"),
        ("2018-01-01", "2018-00"),
    ],
)
def test_week_keys_at_year_ends(spark, day, key):
    posts = spark.sql(f"SELECT timestamp_ntz'{day} 23:59:59.5' AS timestamp")
    row = ingest.derive_calendar(posts).first()
    assert row.year_week == key == dt.date.fromisoformat(day).strftime("%Y-%U")
    assert row.day_of_week == dt.date.fromisoformat(day).weekday()
    assert row.hour == 23


def test_defaults_only_for_absent_columns(spark):
    posts = spark.createDataFrame([("x" * 100, None)], "text_col string, score bigint")
    row = ingest.fill_schema_defaults(posts).first()
    assert (row.subreddit, row.score, row.comments) == (fv.DEFAULT_SUBREDDIT, None, 0)
    assert row.title == "x" * 80
    renamed = spark.createDataFrame([("a", 4)], "text_col string, num_comments bigint")
    assert ingest.fill_schema_defaults(renamed).first().comments == 4


def test_ingest_whole(spark):
    records = spark.createDataFrame(
        [(1, "1700000000", "hello"), (2, "bad", "x")],
        "post_id bigint, created_utc string, title string",
    )
    rows = ingest.ingest(records).collect()
    assert [(r.post_id, str(r.date), r.text_col) for r in rows] == [(1, "2023-11-14", "hello")]


@pytest.mark.parametrize("column", ["timestamp", "created_utc", "created_at"])
def test_epoch_numbers_of_all_units_in_every_column(spark, column):
    wanted = dt.datetime(2024, 3, 5, 6, 7, 8)
    second = 1709618828
    for kind in ("bigint", "string"):
        rows = [(i, second * unit if kind == "bigint" else str(second * unit)) for i, unit in enumerate([1, 10**3, 10**6, 10**9])]
        records = spark.createDataFrame(rows, f"post_id int, {column} {kind}")
        assert [r[column] for r in ingest.parse_timestamp(records, column).collect()] == [wanted] * 4
    posts = ingest.ingest(spark.createDataFrame([(1, second, "t")], f"post_id int, {column} bigint, title string"))
    assert posts.first().timestamp == wanted


def test_times_out_of_range_are_bad_in_texts_and_epochs(spark):
    rows = [(1, "1500-01-01"), (2, "2300-01-01T00:00:00"), (3, "2024-01-01 05:00:00"), (4, "20240101x"), (5, None)]
    records = spark.createDataFrame(rows, "post_id int, created_at string")
    parsed = {r.post_id: r.created_at for r in ingest.parse_timestamp(records, "created_at").collect()}
    assert parsed == {1: None, 2: None, 3: dt.datetime(2024, 1, 1, 5), 4: None, 5: None}
    report = dict(reports.corrupt_line_report(records, ["created_at"]).collect())
    assert report == {"corrupt": 0, "missing created_at": 1, "bad created_at": 3}


def test_corrupt_lines_raise_or_are_dropped(spark, tmp_path):
    lines = ['{"post_id": 1, "created_utc": 5, "title": "a"}', '{"post_id": 2, "created', '{"post_id": "x", "created_utc": 7, "title": "b"}']
    records = files.read_posts(spark, write_lines(tmp_path, lines), "post_id int, created_utc long, title string")
    dropped = ingest.ingest(records, corrupt="drop")
    assert [r.post_id for r in dropped.collect()] == [1] and files.CORRUPT_COLUMN not in dropped.columns
    with pytest.raises(Exception, match="corrupt line"):
        ingest.ingest(records).select("post_id").collect()
