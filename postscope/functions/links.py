"""Links that put a peak day into the context of its news."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from postscope import fixed_values as fv


def parsed_day(text: Column) -> Column:
    """The text as a date; null where it is not one."""
    return text.cast("string").try_cast("date")


def news_search_url(query: Column, day: Column) -> Column:
    """News search from the day before to the day after; only blanks of the query are encoded."""
    url = F.format_string(
        fv.NEWS_SEARCH_URL,
        F.replace(query, F.lit(" "), F.lit("+")),
        F.date_format(F.date_sub(day, 1), fv.WINDOW_DATE_FORMAT),
        F.date_format(F.date_add(day, 1), fv.WINDOW_DATE_FORMAT),
    )
    return F.when(day.isNull(), "").otherwise(url)


def encyclopedia_url(day: Column) -> Column:
    url = F.format_string(fv.ENCYCLOPEDIA_URL, F.date_format(day, fv.MONTH_FORMAT))
    return F.when(day.isNull(), "").otherwise(url)
