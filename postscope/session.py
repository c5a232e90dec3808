"""Session settings and small constant tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(
    app_name: str = "postscope",
    master: str | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """A session with adaptive execution on and UTC dates.

    On a cluster the master, memory and shuffle width come from spark-submit;
    ``conf`` only adds to or overrides what is given there.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def literal_rows(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few fixed rows as a constant of the plan, of known size and without Python tasks."""

    def cell(value) -> str:
        if value is None:
            return "NULL"
        if isinstance(value, str):
            return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return repr(value) + "D" if isinstance(value, float) else str(value)

    names = [part.split()[0] for part in schema.split(",")]
    values = ", ".join("(" + ", ".join(cell(v) for v in row) + ")" for row in rows)
    table = spark.sql(f"SELECT * FROM VALUES {values} AS t({', '.join(names)})")
    types = [part.split()[1] for part in schema.split(",")]
    return table.select(*[F.col(n).cast(t).alias(n) for n, t in zip(names, types)])
