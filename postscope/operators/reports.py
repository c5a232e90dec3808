"""Whole-set reports: metadata summary, bad input lines, and who shared what."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postscope import fixed_values as fv
from postscope.functions.text import SPACE_CLASS, WORD_CHAR
from postscope.operators.ingest import parsed_timestamp
from postscope.operators.rankings import subreddit_counts
from postscope.operators.trends import posts_by_day
from postscope.sources.posts import CORRUPT_COLUMN

# Patterns of shared items.
# A hashtag stands at the start or behind white space; a link ends before a bracket that it
# does not open itself, and without the punctuation behind it. Repetitions are possessive: the
# engine takes those in a loop, where others recurse once per character of a long link.
HASHTAG = rf"#(?<![^{SPACE_CLASS}]#){WORD_CHAR}+"  # the mark first: few characters are one
LINK_CHAR = r"[^\s\p{Z}()<>\[\]\"]"
SHARED_LINK = rf"https?://(?:{LINK_CHAR}++|\({LINK_CHAR}*+\))++"
LINK_END = ".,;:!?'*_~`"


def top_posts(posts: DataFrame, n: int = 10) -> DataFrame:
    return (
        posts.orderBy(F.desc("score"), "post_id")
        .limit(n)
        .select("post_id", "title", "score", "comments", "url")
    )


def metadata_summary(posts: DataFrame) -> dict[str, DataFrame]:
    """The parts of the summary: span, communities, daily counts, top ten posts."""
    span = posts.agg(
        F.count(F.lit(1)).alias("total_posts"),
        F.to_date(F.min("timestamp")).alias("start_date"),
        F.to_date(F.max("timestamp")).alias("end_date"),
    )
    return {
        "span": span,
        "subreddits": subreddit_counts(posts),
        "daily_counts": posts_by_day(posts).select("date", "posts"),
        "top_posts": top_posts(posts),
    }


def metadata_table(posts: DataFrame) -> DataFrame:
    """The summary as one table of section, name and number.

    One pass counts by community, by day and in all; a second one finds the top posts.
    """
    keys = posts.select("subreddit", F.to_date("timestamp").alias("day"), "timestamp")
    counts = keys.groupingSets([["subreddit"], ["day"], []], "subreddit", "day").agg(
        F.grouping_id().alias("level"),
        F.count(F.lit(1)).alias("posts"),
        F.to_date(F.min("timestamp")).alias("first"),
        F.to_date(F.max("timestamp")).alias("last"),
    )

    def row(section: str, name: Column, number: Column) -> Column:
        return F.struct(
            F.lit(section).alias("section"),
            name.cast("string").alias("name"),
            number.cast("bigint").alias("number"),
        )

    level, posts_in, none = F.col("level"), F.col("posts"), F.lit(None)
    rows = (
        F.when(
            level == 3,
            F.array(
                row("total_posts", none, posts_in),
                row("start_date", F.col("first"), none),
                row("end_date", F.col("last"), none),
            ),
        )
        .when(level == 1, F.array(row("subreddit", F.col("subreddit"), posts_in)))
        .otherwise(F.array(row("day", F.col("day"), posts_in)))
    )
    named = (level == 3) | ((level == 1) & F.col("subreddit").isNotNull()) | ((level == 2) & F.col("day").isNotNull())
    top = top_posts(posts).select(F.inline(F.array(row("top_post", F.col("post_id"), F.col("score")))))
    return counts.filter(named).select(F.inline(rows)).unionByName(top)


def write_metadata(posts: DataFrame, folder: str) -> None:
    """Write each part as JSON below the folder, and the daily counts as CSV too."""
    parts = metadata_summary(posts)
    for name, frame in parts.items():
        frame.write.mode("errorifexists").json(f"{folder}/{name}")
    parts["daily_counts"].write.mode("errorifexists").option("header", True).csv(
        f"{folder}/daily_counts_csv"
    )


def corrupt_line_report(records: DataFrame, required: list[str]) -> DataFrame:
    """``(problem, lines)``: corrupt lines, good lines that lack each required field, bad times.

    One pass; every line is tested for all problems at once.
    """
    corrupt = (
        F.col(CORRUPT_COLUMN).isNotNull() if CORRUPT_COLUMN in records.columns else F.lit(False)
    )
    checks = {"corrupt": corrupt}
    for name in required:
        missing = F.col(name).isNull() if name in records.columns else F.lit(True)
        checks[f"missing {name}"] = ~corrupt & missing
    times = [name for name in fv.TIMESTAMP_COLUMNS if name in records.columns][:1]
    for name in times:  # there, but not a time within range: ingest drops such records
        checks[f"bad {name}"] = ~corrupt & F.col(name).isNotNull() & parsed_timestamp(records, name).isNull()
    names = list(checks)
    totals = records.agg(*[F.count_if(checks[n]).alias(f"c{i}") for i, n in enumerate(names)])
    pairs = F.array(
        *[F.struct(F.lit(n).alias("problem"), F.col(f"c{i}").alias("lines"))
          for i, n in enumerate(names)]
    )
    return totals.select(F.inline(pairs))


def shared_items(posts: DataFrame, keywords: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(author, *keep, kind, item)``: each hashtag, link or keyword of each post, once per post."""
    # Made once per post; a plain search for the mark spares most texts the pattern.
    texts = posts.filter(F.col("author").isNotNull()).select(
        "author",
        *keep,
        F.lower(F.concat_ws(" ", "title", "selftext")).alias("lowered"),
        F.concat_ws(" ", "title", "selftext", "url").alias("linked"),
    )
    lowered, linked = F.col("lowered"), F.col("linked")

    def tagged(kind: str, items: Column) -> Column:
        return F.transform(items, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("item")))

    def every(pattern: str, mark: str, source: Column) -> Column:
        found = F.regexp_extract_all(source, F.lit(f"({pattern})"), F.lit(1))
        return F.when(source.contains(mark), found).otherwise(F.array().cast("array<string>"))

    found = [
        tagged("hashtag", every(HASHTAG, "#", lowered)),
        tagged(
            "url",
            F.transform(every(SHARED_LINK, "://", linked), lambda x: F.rtrim(x, F.lit(LINK_END))),
        ),
    ]
    for keyword in keywords or []:
        hit = lowered.contains(keyword.lower())
        found.append(
            tagged("keyword", F.array_compact(F.array(F.when(hit, F.lit(keyword)))))
        )
    items = texts.select("author", *keep, F.inline_outer(F.array_distinct(F.concat(*found))))
    return items.filter(F.col("item").isNotNull())


def sharing_network(posts: DataFrame, keywords: list[str] | None = None) -> DataFrame:
    """``(author, kind, item, posts)``: who shared which hashtag, link or keyword.

    Edges run between an author and an item, never between all authors of an
    item. An item counts once per post.
    """
    return shared_items(posts, keywords).groupBy("author", "kind", "item").agg(F.count(F.lit(1)).alias("posts"))
