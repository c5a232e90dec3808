"""Titles that hold any of very many keywords, by an index of the keywords.

A keyword of plain characters that occurs in a title brings each of its runs of three
characters along. Every such keyword is entered in the index under the one of its runs that
the fewest keywords have; titles are unfolded to their distinct runs, joined with the index
and tested with the few keywords they meet. The plan is the same for five keywords
and for five thousand, and a title is never tested with all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The length of a run, and characters without a meaning in regular expressions.
RUN = 3
PLAIN = r"^[\p{L}\p{N}_ ,;:!@#%&=~'\"<>/-]+$"
# An index of up to this many keywords is sent to every task.
_BROADCAST_KEYWORDS = 1_000_000


def folded(text: Column) -> Column:
    """The text so that characters are equal that patterns in any case take for equal.

    Their engine compares characters by upper and then lower case. Here lower case is undone,
    which also joins variants without an upper form of their own. The dotted capital I is
    two characters in lower case and an I to the engine. The inner ``translate`` also keeps
    Catalyst from taking the two case changes for one.
    """
    lowered = F.lower(F.translate(text, "\u0130", "I"))
    return F.upper(F.translate(lowered, "\u03c2", "\u03c3"))


def runs(text: Column) -> Column:
    """The distinct runs of three characters of a text; none of a shorter one."""
    last = F.char_length(text) - (RUN - 1)
    starts = F.when(last >= 1, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda at: F.substr(text, at, F.lit(RUN))))


def keyword_index(keywords: DataFrame) -> DataFrame:
    """``(keyword, run)``: each distinct plain keyword under its rarest run, of equal ones the smallest."""
    plain = _distinct(keywords).filter(_indexable())
    each = plain.select("keyword", F.explode(runs(folded(F.col("keyword")))).alias("run"))
    spread = each.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    return (
        each.join(spread, "run")
        .groupBy("keyword")
        .agg(F.min(F.struct("n", "run")).alias("least"))
        .select("keyword", F.col("least.run").alias("run"))
    )


def _distinct(keywords: DataFrame) -> DataFrame:
    return keywords.select("keyword").filter(F.col("keyword").isNotNull()).distinct()


def _indexable() -> Column:
    return F.col("keyword").rlike(PLAIN) & (F.char_length(folded(F.col("keyword"))) >= RUN)


def keyword_hits(posts: DataFrame, keywords: DataFrame) -> DataFrame:
    """The posts' columns and ``keyword``, a row for each post and each keyword its title holds.

    A keyword is a regular expression in any case. Patterns with special characters and those
    below three characters are not in the index: every title is tested with each of these.
    Null titles hold nothing, null keywords are left out and equal ones count once. A column
    ``keyword`` of the posts is replaced.
    """
    posts = posts.drop("keyword")
    index = keyword_index(keywords).select(F.col("keyword").alias("_keyword"), F.col("run").alias("_run"))
    if index.limit(_BROADCAST_KEYWORDS + 1).count() <= _BROADCAST_KEYWORDS:
        index = F.broadcast(index)
    titled = posts.withColumn("_title", folded(F.col("title")))
    met = titled.select("*", F.explode_outer(runs(F.col("_title"))).alias("_run")).join(index, "_run")
    by_index = met.filter(_holds(folded(F.col("_keyword")), F.col("_keyword")))
    by_index = by_index.select(*posts.columns, F.col("_keyword").alias("keyword"))
    # The patterns outside of the index are one array, a constant of the plan's run.
    plain = F.when(F.col("keyword").rlike(PLAIN), folded(F.col("keyword"))).otherwise("")
    others = _distinct(keywords).filter(~_indexable())
    others = others.agg(F.collect_list(F.struct("keyword", plain.alias("plain"))))
    held = F.filter("_patterns", lambda p: _holds(p["plain"], p["keyword"]))
    tested = titled.withColumn("_patterns", others.scalar()).select(*posts.columns, F.inline_outer(held))
    tested = tested.filter(F.col("keyword").isNotNull()).drop("plain")
    return by_index.unionByName(tested)


def _holds(plain: Column, pattern: Column) -> Column:
    """Whether the title holds a pattern; most are ruled out by their plain characters, unless these are empty."""
    return F.col("_title").contains(plain) & F.rlike(F.col("title"), F.concat(F.lit("(?iU)"), pattern))
