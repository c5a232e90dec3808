"""Lexicon sentiment by the published valence rules, as column expressions.

Inputs are ``lexicon(word, valence)`` and, where the built-in word lists do not fit,
``modifiers(word, boost, negates)``. Both are word lists of bounded size: they are read on
the driver while the plan is built and become look-up tables in the plan. One pattern finds the
words of a post that may be in the lexicon; only these are looked up, get the words around them
and their valence, and the rules are steps over these few hits. Texts are not split into all
their words, they stay in the JVM, and nothing is shuffled.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable
from functools import partial, reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postscope import fixed_values as fv
from postscope.functions.text import SPACE_CLASS, strip
from postscope.functions.word_search import BLANK, MAX_PATTERN_WORDS, TOKEN, token_pattern, unused_characters
from postscope.session import literal_rows

# A longer word list is an error: it would no longer be small for driver and tasks.
MAX_WORDS = 1_000_000

#: Hits of a text whose numbers of tokens are summed up.
MAX_SUMS = 4_096


def default_modifiers(spark: SparkSession) -> DataFrame:
    """Degree words and negations of the published rules."""
    rows = (
        [(word, fv.BOOST, False) for word in fv.INTENSIFIERS]
        + [(word, -fv.BOOST, False) for word in fv.DAMPENERS]
        + [(word, 0.0, True) for word in fv.NEGATIONS]
    )
    return literal_rows(spark, rows, "word string, boost double, negates boolean")


def _full_text(posts: DataFrame) -> Column:
    parts = [
        F.coalesce(F.col(name), F.lit("")) if name in posts.columns else F.lit("")
        for name in ("title", "selftext")
    ]
    return F.concat(parts[0], F.lit(" "), parts[1])


def bare(token: Column) -> Column:
    """The token without punctuation at its ends, unless it would shrink to two characters."""
    stripped = F.btrim(token, F.lit(fv.PUNCTUATION))
    return F.when(F.length(stripped) > 2, stripped).otherwise(token)


def plain(token: Column) -> Column:
    """The bare word of a token in lower case."""
    return F.lower(bare(token))


def text_tokens(text: Column) -> Column:
    """Runs of characters between white space, in order; a blank text has one empty token."""
    return F.split(strip(text), f"[{SPACE_CLASS}]+")


def _listed(frame: DataFrame, *columns: str) -> list[tuple]:
    rows = frame.select(*columns).limit(MAX_WORDS + 1).collect()
    if len(rows) > MAX_WORDS:
        raise ValueError(f"a word list of more than {MAX_WORDS} words")
    return [tuple(row) for row in rows]


def looked_up(table: dict[str, float]) -> Callable[[Column], Column]:
    """A function from a word to its number, null for a word that is not in the table.

    The table is one constant of the plan, an array of small maps; a word's checksum says which.
    """
    maps: list[dict[str, float]] = [{} for _ in range(max(1, len(table)))]
    for word, number in table.items():
        maps[zlib.crc32(word.encode()) % len(maps)][word] = number
    held = F.from_json(F.lit(json.dumps(maps)), "array<map<string, double>>")

    def find(word: Column) -> Column:
        place = F.pmod(F.crc32(word.cast("binary")), F.lit(len(maps))).cast("int")
        return F.try_element_at(F.get(held, place), word)

    return find


def _is_loud(word: Column) -> Column:
    return F.coalesce((F.upper(word) == word) & (F.lower(word) != word), F.lit(False))


def _word(token: Column) -> Column:
    return F.coalesce(plain(token), F.lit(""))  # no word is empty


def _tokens(part: Column) -> Column:
    return F.regexp_extract_all(part, F.lit(TOKEN), F.lit(0))


def _ends(pieces: Column) -> Column:
    """The first three and the last three or more tokens of each piece of text, fewer if it has fewer."""
    first = f"^{BLANK}*+(?:{TOKEN}{BLANK}*+){{0,3}}"

    def cut(piece: Column) -> Column:
        # Whole tokens from the end, but perhaps fewer than three where blanks follow one another.
        near = F.substring_index(piece, " ", -6)
        return F.struct(_tokens(F.regexp_extract(piece, first, 0)).alias("first"), _tokens(near).alias("last"), piece.alias("piece"))

    def whole(cut: Column) -> Column:
        last = F.when(F.size(cut["last"]) >= 3, cut["last"]).otherwise(_tokens(cut["piece"]))
        return F.struct(cut["first"].alias("first"), last.alias("last"))

    return F.transform(F.transform(pieces, cut), whole)


def _pieces(text: Column, words: list[str]) -> Column:
    """The text cut before each token that may be one of the words; the first piece is before all of them."""
    mark, other = unused_characters(words, 2)
    pattern = token_pattern(words)
    padded = F.concat(F.lit(" "), F.replace(text, F.lit(mark), F.lit(other)))
    return F.split(F.regexp_replace(padded, pattern, f"{mark}$0"), mark) if pattern else F.array(padded)


def _around(pieces: Column) -> Column:
    """Of pieces with their ends: each found token with the tokens before it and from it on."""

    def joined(i: Column, name: str, steps: tuple[int, ...]) -> Column:
        none = F.array().cast("array<string>")
        return F.concat(*[F.coalesce(F.get(pieces, i + k)[name], none) for k in steps])

    each = F.transform(pieces, lambda p, i: F.struct(
        i.alias("at"), joined(i, "last", (-3, -2, -1)).alias("before"), joined(i, "first", (0, 1, 2)).alias("after")
    ))
    return F.filter(each, lambda h: h["at"] > 0)


def _all_around(text: Column) -> Column:
    """Each token with those before it and from it on, as ``_around`` has them, for lists too long for a pattern."""
    tokens = text_tokens(text)
    return F.transform(tokens, lambda t, i: F.struct(
        i.alias("at"), F.slice(tokens, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))).alias("before"),
        F.slice(tokens, i + 1, 3).alias("after"),
    ))


class _Tables:
    """Look-ups in the word lists."""

    def __init__(self, lexicon: DataFrame, modifiers: DataFrame | None):
        spark = lexicon.sparkSession
        words = {word: float(value) for word, value in _listed(lexicon, "word", "valence") if word is not None}
        changes = _listed(default_modifiers(spark) if modifiers is None else modifiers, "word", "boost", "negates")
        self.words = [*words, fv.CONTRAST_WORD]
        self.valence = looked_up(words)
        self.boost = looked_up({word: float(boost) for word, boost, _ in changes if boost})
        self.negation = looked_up({word: 1.0 for word, _, negates in changes if negates})
        self.idiom = looked_up(fv.IDIOMS)
        self.knows_least = "least" in words
        phrases = [*fv.IDIOMS, *(word for word, boost, _ in changes if boost)]
        # what else than a single word can be looked up starts with one of these
        self.in_phrases = sorted({p.split(" ")[0] for p in phrases if p and " " in p})


def _heard(hit: Column) -> list[Column]:
    """The token of a hit and the three before it."""
    before = hit["before"]
    return [F.get(hit["after"], F.lit(0)), *[F.get(before, F.size(before) - k) for k in (1, 2, 3)]]


def _with_context(hits: Column, mixed: Column, tables: _Tables) -> Column:
    """Each hit with the three words before it (back1 to back3), what they are, and the two after it."""

    def spelled(hit: Column) -> Column:
        tokens, after = _heard(hit), hit["after"]
        back = [_word(token).alias(f"back{k}") for k, token in enumerate(tokens)]
        loud = [F.when(mixed, _is_loud(token)).otherwise(False).alias(f"loud{k}") for k, token in enumerate(tokens)]
        return F.struct(hit["at"].alias("at"), *back, *loud, *[_word(F.get(after, F.lit(k))).alias(f"next{k}") for k in (1, 2)])

    def known(hit: Column) -> Column:
        out = hit.withField("base", tables.valence(hit["back0"]))
        for k in (1, 2, 3):
            out = out.withField(f"boost{k}", F.coalesce(tables.boost(hit[f"back{k}"]), F.lit(0.0)))
            # a word before counts unless there is none or it has a valence itself
            out = out.withField(f"counts{k}", (hit[f"back{k}"] != "") & tables.valence(hit[f"back{k}"]).isNull())
        return out

    found = F.transform(F.transform(hits, spelled), known)
    # degree words have no valence of their own, and "kind" has none in "kind of"
    return F.filter(
        found, lambda h: tables.boost(h["back0"]).isNull() & ~((h["back0"] == "kind") & (h["next1"] == "of"))
    )


def _first_value(tables: _Tables, hit: Column) -> Column:
    """The valence with what "no" does to it."""
    refused = hit["back1"].isin("no") | hit["back2"].isin("no") | (hit["back3"].isin("no") & hit["back1"].isin("or", "nor"))
    value = (
        F.when(refused, hit["base"] * fv.NEGATION_FACTOR)
        .when((hit["back0"] == "no") & tables.valence(hit["next1"]).isNotNull(), 0.0)
        .otherwise(hit["base"])
    )
    return hit.withField("value", value)


def _toward(value: Column, size: float) -> Column:
    return F.when(value > 0, size).otherwise(-size)


def _louder(hit: Column) -> Column:
    value = hit["value"]
    return hit.withField("value", value + F.when(hit["loud0"], _toward(value, fv.CAPITALS_BOOST)).otherwise(0.0))


def _boosted(k: int, hit: Column) -> Column:
    """The value moved by a degree word k words before."""
    value, boost = hit["value"], hit[f"boost{k}"]
    signed = F.when(value < 0, -boost).otherwise(boost)
    signed = signed + F.when(hit[f"loud{k}"], _toward(value, fv.CAPITALS_BOOST)).otherwise(0.0)
    moved = value + F.when(boost != 0, signed * fv.DISTANCE_DAMPING[k - 1]).otherwise(0.0)
    return hit.withField("value", F.when(hit[f"counts{k}"], moved).otherwise(value))


def _turned(k: int, tables: _Tables, hit: Column) -> Column:
    """The value after the k-th word before, which may negate it."""
    back = hit[f"back{k}"]
    negates = tables.negation(back).isNotNull() | back.contains(fv.NEGATION_CONTRACTION)
    factor = F.when(negates, fv.NEGATION_FACTOR).otherwise(1.0)
    if k > 1:
        raised = (back == "never") & hit[f"back{k - 1}"].isin(*fv.RAISED_AFTER_NEVER)
        if k == 3:  # as published, three words back a plain "so" or "this" before the word is enough
            raised = raised | hit["back1"].isin(*fv.RAISED_AFTER_NEVER)
        doubt = hit["back1"].isin("doubt") if k == 2 else hit["back1"].isin("doubt") | hit["back2"].isin("doubt")
        without = (back == "without") & doubt
        factor = F.when(raised, fv.NEVER_SO_FACTOR).when(without, 1.0).otherwise(factor)
    return hit.withField("value", F.when(hit[f"counts{k}"], hit["value"] * factor).otherwise(hit["value"]))


def _in_idioms(tables: _Tables, hit: Column) -> Column:
    """Fixed phrases around a word that has three words before it."""

    def phrase(first: int, last: int) -> Column:
        names = [f"back{-k}" if k <= 0 else f"next{k}" for k in range(first, last + 1)]
        return F.concat_ws(" ", *[hit[name] for name in names])

    around = ((-1, 0), (-2, 0), (-2, -1), (-3, -1), (-3, -2))
    value = F.coalesce(*[tables.idiom(phrase(*span)) for span in around], hit["value"])
    for last in (1, 2):
        value = F.coalesce(F.when(hit[f"next{last}"] != "", tables.idiom(phrase(0, last))), value)
    for span in ((-3, -1), (-3, -2), (-2, -1)):
        value = value + F.coalesce(tables.boost(phrase(*span)), F.lit(0.0))
    begins = [hit[f"back{k}"].isin(tables.in_phrases) for k in range(4)]
    phrased = begins[0] | begins[1] | begins[2] | begins[3]
    return hit.withField("value", F.when(hit["counts3"] & phrased, value).otherwise(hit["value"]))


def _after_least(hit: Column, tables: _Tables) -> Column:
    if tables.knows_least:
        return hit["value"]
    least = (hit["back1"] == "least") & ~hit["back2"].isin("at", "very")
    return F.when(least, hit["value"] * fv.NEGATION_FACTOR).otherwise(hit["value"])


def _hit_total(hits: Column, mixed: Column, turn: Column, tables: _Tables) -> Column:
    """Sum of the valences of all hits of a post; ``turn`` is the place of the contrast word, -1 without.

    One step over the hits per rule, so that no value is worked out twice.
    """
    found = _with_context(hits, mixed, tables)
    steps = [partial(_first_value, tables), _louder]
    for k in (1, 2, 3):
        steps += [partial(_boosted, k), partial(_turned, k, tables)]
    for step in [*steps, partial(_in_idioms, tables)]:
        found = F.transform(found, step)

    def weighed(h: Column) -> Column:
        weight = F.when((turn < 0) | (h["at"] == turn), 1.0).when(h["at"] < turn, fv.BEFORE_BUT).otherwise(fv.AFTER_BUT)
        return _after_least(h, tables) * weight

    return F.aggregate(found, F.lit(0.0), lambda total, h: total + weighed(h))


def _has_quiet(text: Column) -> Column:
    """Whether a token is not in capitals, as is one with a small letter a to z."""
    return F.when(text.rlike("[a-z]"), True).otherwise(F.exists(text_tokens(text), lambda t: ~_is_loud(t)))


def _emphasis(text: Column) -> Column:
    def count(mark: str) -> Column:
        return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))

    questions = count("?")
    asked = F.when(questions > fv.QUESTION_MANY, fv.QUESTION_MAX).when(questions > 1, questions * fv.QUESTION_BOOST).otherwise(0.0)
    return F.least(count("!"), F.lit(fv.EXCLAMATION_MAX)) * fv.EXCLAMATION_BOOST + asked


def _numbered(texts: DataFrame, words: list[str]) -> DataFrame:
    """``(post_id, hits)``: tokens that may be one of the words, at the number of tokens before them."""
    counted = F.transform(_pieces(F.col("text"), words), lambda p: F.struct(
        F.regexp_extract(p, TOKEN, 0).alias("token"), F.regexp_count(p, F.lit(TOKEN)).alias("n")
    ))
    before = F.aggregate("pieces", F.array().cast("array<int>"), lambda ns, p: F.concat(
        ns, F.array(F.coalesce(F.get(ns, F.size(ns) - 1), F.lit(0)) + p["n"])
    ))
    # The sums are copied once per hit, so a text with very many hits is rather split into all its words.
    texts = texts.select("post_id", "text", counted.alias("pieces"))
    texts = texts.select("post_id", "text", "pieces", F.when(F.size("pieces") <= MAX_SUMS, before).alias("before"))
    hit = lambda at, token: F.struct(at.alias("at"), plain(token).alias("word"))
    found = F.transform("pieces", lambda p, i: hit(F.get("before", i - 1), p["token"]))
    every = F.transform(text_tokens(F.col("text")), lambda t, i: hit(i, t))
    return texts.select("post_id", F.when(F.col("before").isNull(), every).otherwise(found).alias("hits"))


def sentiment_lexicon_join(posts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """``(post_id, at, word, valence)`` of every token found in the lexicon, counted from 1.

    Words are joined with the lexicon, which is sent to all tasks if it is as short as
    lexicons are, so that only hits move on. Of a list short enough for a pattern only words
    that may be in it are taken from the texts, at the number of tokens before them.
    """
    known = lexicon.filter(F.col("word").isNotNull()).dropDuplicates(["word"])
    known = known.select("word", F.col("valence").cast("double").alias("valence"))
    listed = [row.word for row in known.select("word").limit(MAX_WORDS + 1).collect()]
    if len(listed) <= MAX_WORDS:
        known = F.broadcast(known)
    # The outer form: for the inner one a filter on the array would split the text twice.
    if len(listed) <= MAX_PATTERN_WORDS and "" not in listed:
        places = _numbered(posts.select("post_id", _full_text(posts).alias("text")), listed)
        each = places.select("post_id", F.inline_outer("hits")).filter(F.col("at").isNotNull())
    else:
        words = F.transform(text_tokens(_full_text(posts)), plain)
        each = posts.select("post_id", F.posexplode_outer(words).alias("at", "word")).filter(F.col("word").isNotNull())
    return each.join(known, "word").select("post_id", (F.col("at") + 1).alias("at"), "word", "valence")


def sentiment_label(compound: Column) -> Column:
    positive, negative, neutral = fv.SENTIMENT_LABELS
    return (
        F.when(compound > fv.POSITIVE_ABOVE, positive)
        .when(compound < fv.NEGATIVE_BELOW, negative)
        .otherwise(neutral)
    )


def attach_sentiment(
    posts: DataFrame, lexicon: DataFrame | None, modifiers: DataFrame | None = None
) -> DataFrame:
    """Posts with ``compound`` and ``sent_label``; without a lexicon all are neutral."""
    if lexicon is None:
        return sentiment_neutral_fallback(posts)
    tables = _Tables(lexicon, modifiers)
    text, hits, near = (F.col(f"_{name}") for name in ("text", "hits", "near"))
    found = posts.withColumn("_text", _full_text(posts))
    if len(tables.words) <= MAX_PATTERN_WORDS and "" not in tables.words:
        found = found.withColumn("_ends", _pieces(text, tables.words))
        found = found.withColumn("_ends", F.when(F.size("_ends") > 1, _ends(F.col("_ends"))))
        found = found.withColumn("_near", F.coalesce(_around(F.col("_ends")), F.array()))
    else:
        found = found.withColumn("_ends", F.lit(None)).withColumn("_near", _all_around(text))

    def own(h: Column) -> Column:
        return plain(F.get(h["after"], F.lit(0)))

    found = found.withColumn("_hits", F.filter(near, lambda h: tables.valence(own(h)).isNotNull()))
    # Some words, but not all, are in capitals; without one at a hit it makes no difference.
    loud = F.exists(hits, lambda h: reduce(or_, map(_is_loud, _heard(h))))
    found = found.withColumn("_mixed", F.when(loud, _has_quiet(text)).otherwise(False))
    turn = F.get(F.filter(near, lambda h: own(h) == fv.CONTRAST_WORD), F.lit(0))["at"]
    found = found.withColumn("_turn", F.when(F.size(hits) > 0, F.coalesce(turn, F.lit(-1))).otherwise(-1))
    summed = _hit_total(hits, F.col("_mixed"), F.col("_turn"), tables)
    found = found.withColumn("_total", F.when(F.size(hits) > 0, summed))
    total = F.col("_total")
    found = found.withColumn("_total", F.when(total.isNotNull(), total + F.signum(total) * _emphasis(text)))
    compound = F.round(total / F.sqrt(total * total + fv.NORMALISATION_ALPHA), 4) + 0.0
    scored = found.withColumn("compound", F.coalesce(compound, F.lit(0.0)))
    scored = scored.drop("_text", "_ends", "_near", "_hits", "_mixed", "_turn", "_total")
    return scored.withColumn("sent_label", sentiment_label(F.col("compound")))


def sentiment_compound(
    posts: DataFrame, lexicon: DataFrame, modifiers: DataFrame | None = None
) -> DataFrame:
    """``(post_id, compound)``, compound between -1 and 1, 0 for texts without a hit."""
    return attach_sentiment(posts, lexicon, modifiers).select("post_id", "compound")


def sentiment_neutral_fallback(posts: DataFrame) -> DataFrame:
    """The result where no lexicon is at hand: compound 0, neutral."""
    return posts.withColumns({"compound": F.lit(0.0), "sent_label": sentiment_label(F.lit(0.0))})


def sentiment_share_by_cluster(labelled: DataFrame) -> DataFrame:
    """Share of each sentiment label per cluster.

    Expects ``cluster_label`` and ``sent_label``; three conditional means take
    the place of a pivot and need one partial aggregate.
    """
    shares = [
        F.avg((F.col("sent_label") == name).cast("double")).alias(name.capitalize())
        for name in fv.SENTIMENT_LABELS
    ]
    return (
        labelled.filter(F.col("cluster_label").isNotNull() & F.col("sent_label").isNotNull())
        .groupBy(F.col("cluster_label").alias("cluster"))
        .agg(*shares)
    )
