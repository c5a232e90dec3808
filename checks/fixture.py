"""Posts and vectors derived from the given test tables, and the parameters of the checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postscope.session import literal_rows

# Links of the posts, chosen by event id.
MEDIA = [
    (0, "https://i.redd.it/a.jpg", "i.redd.it"),
    (1, "https://v.redd.it/b", "v.redd.it"),
    (2, "https://www.reddit.com/r/x/comments/1/", "self.x"),
    (3, "https://www.youtube.com/watch?v=1", "youtube.com"),
    (4, "https://youtu.be/2", "youtu.be"),
    (5, "https://imgur.com/c.png", "imgur.com"),
    (6, "https://x.com/u/1", "x.com"),
    (7, "https://www.netflix.com/t", "netflix.com"),
    (8, "https://news.example.org/1", "news.example.org"),
    (9, "https://www.tiktok.com/3", "TikTok.com "),
    (10, "https://old.reddit.com/r/y", "old.reddit.com"),
    (11, None, None),
]

START = dt.date(2024, 3, 1)
END = dt.date(2024, 8, 31)
QUERY_POST = 0
LOOKUP_POST = 42
SHARED_URL = "HTTPS://youtu.be/2"
CO_SHARING_SECONDS = 3 * 3600
KEYWORDS = ["worthless", "thing", "rewh", "und"]
TITLE_PATTERN = "th(ing|ere)|ción"

STOP_WORDS = (
    "the and of to in is it that with for was on be as by this are at from an "
    "de la le der die und que en des les un es el et ou den von du zu das une los"
).split()

LEXICON = [
    ("worthless", -1.9),
    ("pathetic", -2.7),
    ("idiot", -2.3),
    ("stupid", -2.4),
    ("trash", -1.5),
    ("no", -1.2),
    ("thing", 0.6),
    ("rewh", 1.6),
    ("hehely", 1.2),
    ("erin", 0.8),
    ("thon", 1.1),
    ("thea", -0.7),
    ("thatin", 0.9),
    ("orre", 1.4),
    ("une", 0.4),
    ("los", -0.5),
    ("nicht", -0.3),
    ("pas", -0.6),
    ("sur", 0.7),
    ("mit", 0.2),
]

# Degree words and negations that occur in the invented prose.
MODIFIERS = [
    ("the", 0.293, False),
    ("of", -0.293, False),
    ("to", 0.293, False),
    ("and", 0.0, True),
    ("der", 0.0, True),
    ("no", 0.0, True),
    ("thand", 0.293, False),
]

_SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
    "value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(_SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def posts(spark: SparkSession, sf_dir: str, beside: DataFrame | None = None) -> DataFrame:
    """Every event as a post, with the text of a document and one of the twelve links.

    Documents are dealt to events in turn, so that no event is left out. Rows ``beside``
    are joined by ``post_id`` while posts have no text yet, so that no text moves for them;
    titles are cut before documents are dealt, so that without texts only titles move. A text
    is as long for each of its posts, so the work behind is dealt to more tasks than cores.
    """
    events = table(spark, sf_dir, "events")
    documents = table(spark, sf_dir, "documents")
    media = literal_rows(spark, MEDIA, "m bigint, url string, domain string")
    k = F.get_json_object("props", "$.k").cast("bigint")
    shift = F.make_dt_interval(days=(F.col("event_id") * 37 % 400).cast("int"))
    title = F.replace(F.substring("text", 1, 80), F.lit("\n"), F.lit(" "))
    number = documents.count()
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    added = []
    if beside is not None:
        added = [name for name in beside.columns if name != "post_id"]
        events = events.join(beside.withColumnRenamed("post_id", "event_id"), "event_id")
    events = events.withColumn("doc_id", F.col("event_id") % number)
    return (
        events.repartition(tasks, "doc_id")
        .join(documents.withColumn("title", title).repartition(tasks, "doc_id"), "doc_id")
        .join(F.broadcast(media), F.col("m") == F.col("event_id") % 12)
        .select(
            F.col("event_id").alias("post_id"),
            (F.col("ts") + shift).alias("timestamp"),
            F.col("user_id").cast("string").alias("author"),
            F.col("source").alias("subreddit"),
            "title",
            F.col("text").alias("selftext"),
            "lang",
            (F.floor("value").cast("bigint") - 20).alias("score"),
            k.alias("comments"),
            (F.lit(0.5) + (k % 51).cast("double") / 100).alias("upvote_ratio"),
            "url",
            "domain",
            *added,
        )
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "post_id")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).select("post_id", F.col("label").alias("cluster_id"))


def lexicon(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, LEXICON, "word string, valence double")


def modifiers(spark: SparkSession) -> DataFrame:
    return literal_rows(spark, MODIFIERS, "word string, boost double, negates boolean")
