"""Calendar expressions over a date or zone-less timestamp column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_week(day: Column) -> Column:
    """Year and Sunday-start week number, ``2024-07``. Days before the first Sunday are week 00."""
    week = F.floor((F.dayofyear(day) + 7 - F.dayofweek(day)) / 7).cast("int")
    return F.concat(
        F.lpad(F.year(day).cast("string"), 4, "0"), F.lit("-"), F.lpad(week.cast("string"), 2, "0")
    )


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def week_start(day: Column) -> Column:
    """The Sunday on or before the day."""
    return F.date_sub(F.to_date(day), F.dayofweek(day) - 1)


def week_end(day: Column) -> Column:
    """The Sunday on or after the day."""
    return F.next_day(F.date_sub(F.to_date(day), 1), "SUN")


def month_start(day: Column) -> Column:
    return F.trunc(F.to_date(day), "month")
