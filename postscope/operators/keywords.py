"""TF-IDF keywords of titles.

The vocabulary is one aggregate with map-side combine. Once it is known, weighing a
post needs nothing but the post: counts, weights and unit length are a projection
to a sparse vector, and the long table of weights is that vector unfolded. Neither
moves a row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postscope import fixed_values as fv
from postscope.functions.text import clean_title, with_bigrams, words


@lru_cache(maxsize=1)
def _english() -> tuple[str, ...]:
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


def tokenize_ngrams(
    posts: DataFrame,
    stop_words: Sequence[str] | None = None,
    clean: Callable[[Column], Column] | None = clean_title,
    column: str = "title",
) -> DataFrame:
    """``(post_id, terms)``: words without stop words, then their bigrams.

    ``stop_words`` defaults to Spark's English list.
    """
    stop_words = _english() if stop_words is None else tuple(stop_words)
    text = clean(F.col(column)) if clean else F.col(column)
    tokens = posts.select("post_id", words(text, stop_words).alias("tokens"))
    return tokens.select("post_id", with_bigrams(F.col("tokens")).alias("terms"))


def prune_vocabulary(
    terms: DataFrame,
    min_df: int = fv.KEYWORD_MIN_DF,
    max_df: float = fv.KEYWORD_MAX_DF,
    max_features: int = fv.KEYWORD_MAX_FEATURES,
) -> DataFrame:
    """``(term, df, tf)`` of the terms in use.

    Terms in fewer than ``min_df`` posts or more than the share ``max_df`` go
    first, then the most frequent ``max_features`` stay, equals by term. Document
    and term counts come from one pass and one row per term of a post: the terms of a
    post are sorted and each is marked where it first occurs, so nothing is grouped by post.
    """
    total = terms.agg(F.count(F.lit(1))).scalar()
    in_order = terms.select(F.sort_array("terms").alias("terms"))
    # The outer form keeps Catalyst from tokenizing every title twice, once for a
    # filter on the array's size.
    placed = in_order.select("terms", F.posexplode_outer("terms").alias("at", "term"))
    first = ~F.col("term").eqNullSafe(F.get("terms", F.col("at") - 1))
    counts = (
        placed.filter(F.col("term").isNotNull())
        .groupBy("term")
        .agg(F.count_if(first).alias("df"), F.count(F.lit(1)).alias("tf"))
    )
    kept = counts.filter((F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * total))
    return kept.orderBy(F.desc("tf"), "term").limit(max_features)


def _vocabulary_rows(terms: DataFrame, vocabulary: DataFrame) -> list:
    """The vocabulary with its smoothed inverse document frequency, in term order.

    Collected: the limit of the vocabulary bounds it.
    """
    total = terms.agg(F.count(F.lit(1))).scalar()
    idf = F.log((1 + total) / (1 + F.col("df"))) + 1
    return sorted(vocabulary.select("term", idf.alias("idf")).collect())


def tfidf_vectors(terms: DataFrame, vocabulary: DataFrame) -> tuple[DataFrame, list[str]]:
    """``(post_id, counts, features)`` as sparse vectors, and the term of each position.

    ``counts`` holds term counts and ``features`` the weights at unit length.
    """
    rows = _vocabulary_rows(terms, vocabulary)
    names = [row.term for row in rows]
    # A model needs one term at least; this one occurs in no text.
    counter = CountVectorizerModel.from_vocabulary(
        names or [" "], inputCol="terms", outputCol="counts"
    )
    weigh = ElementwiseProduct(
        scalingVec=Vectors.dense([row.idf for row in rows] or [0.0]),
        inputCol="counts",
        outputCol="raw",
    )
    scale = Normalizer(p=2.0, inputCol="raw", outputCol="features")
    vectors = scale.transform(weigh.transform(counter.transform(terms)))
    return vectors.select("post_id", "counts", "features"), names


def tfidf_weights(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(post_id, term, tf, tfidf)`` with unit length per post."""
    return unfold_weights(*tfidf_vectors(terms, vocabulary))


def unfold_weights(vectors: DataFrame, names: Sequence[str]) -> DataFrame:
    """The vectors as one row per post and term; other columns of the vectors stay."""
    counts, features = F.unwrap_udt("counts"), F.unwrap_udt("features")
    kept = [name for name in vectors.columns if name not in ("counts", "features")]
    parts = vectors.select(
        *kept,
        F.arrays_zip(
            counts["indices"].alias("at"),
            counts["values"].alias("tf"),
            features["values"].alias("tfidf"),
        ).alias("entries"),
    )
    entries = parts.select(*kept, F.inline_outer("entries").alias("at", "tf", "tfidf"))
    # One literal, split once at planning; terms hold word characters and blanks only.
    spelled = F.get(F.split(F.lit("|".join(names)), "[|]"), F.col("at"))
    return entries.filter(F.col("at").isNotNull()).select(
        *kept, spelled.alias("term"), F.col("tf").cast("bigint").alias("tf"), "tfidf"
    )


def top_keywords(
    posts: DataFrame,
    n: int = 20,
    stop_words: Sequence[str] | None = None,
    min_df: int = fv.KEYWORD_MIN_DF,
    max_df: float = fv.KEYWORD_MAX_DF,
    max_features: int = fv.KEYWORD_MAX_FEATURES,
) -> DataFrame:
    """``(term, weight)``: the n terms with the largest sum of weights; none if all are pruned."""
    terms = tokenize_ngrams(posts, stop_words)
    weights = tfidf_weights(terms, prune_vocabulary(terms, min_df, max_df, max_features))
    sums = weights.groupBy("term").agg(F.sum("tfidf").alias("weight"))
    return sums.orderBy(F.desc("weight"), "term").limit(n)
