"""Run a query on Spark and its SQL on DuckDB and compare every value."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return (0, "")
    if value is None:
        return (0, "")
    return (1, type(value).__name__, value)


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_cell(row[i]) for i in order) for row in rows), key=repr)


def differences(frame, connection, statement: str) -> str | None:
    """None if both give the same columns and rows, else a short report."""
    found = frame.collect()
    result = connection.execute(statement)
    names = [column[0] for column in result.description]
    wanted = result.fetchall()
    if sorted(frame.columns) != sorted(names):
        return f"columns {sorted(frame.columns)} against {sorted(names)}"
    left, right = _rows(frame.columns, found), _rows(names, wanted)
    if left == right:
        return None
    only_left = [row for row in left if row not in set(right)][:3] if len(left) < 50_000 else []
    only_right = [row for row in right if row not in set(left)][:3] if len(left) < 50_000 else []
    return f"{len(left)} rows against {len(right)}\n spark only {only_left}\n sql only {only_right}"
