"""Texts made ready for an embedding model, packed into batches within a token budget."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postscope import fixed_values as fv
from postscope.functions.text import SPACES, strip
from postscope.operators.next_fit import BLOCK_BITS, next_fit

_ASCII_SPACE = np.zeros(256, bool)
_ASCII_SPACE[[ord(c) for c in SPACES if ord(c) < 128]] = True
_WIDE_SPACES = [c.encode() for c in SPACES if ord(c) >= 128]
_LEADS = np.zeros(256, bool)
_LEADS[[c[0] for c in _WIDE_SPACES]] = True


def clean_embedding_text(text: Column) -> Column:
    """Newlines and tabs become blanks, white space at the ends goes, blank text becomes a marker."""
    flat = F.coalesce(text, F.lit(""))
    for mark in "\n\t":  # as bytes, which translate would take one character at a time
        flat = F.replace(flat, F.lit(mark), F.lit(" "))
    flat = strip(flat)
    return F.when(flat == "", fv.NO_CONTENT).otherwise(flat)


def _space_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text are white space, of one byte or more."""
    space = _ASCII_SPACE[data]
    leads = np.flatnonzero(_LEADS[data])
    for wide in _WIDE_SPACES if len(leads) else ():
        at = leads[leads <= len(data) - len(wide)]
        for i, byte in enumerate(wide):
            at = at[data[at + i] == byte]
        for i in range(len(wide)):
            space[at + i] = True
    return space


def token_sizes(texts: pa.Array, limit: int) -> pa.Array:
    """Per text its tokens and, if they are more than the limit, the characters that the first ones take."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    bounds = offsets - offsets[0] if len(texts) else np.zeros(1, np.int64)
    full = ~_space_bytes(data)
    begins = np.empty_like(full)
    begins[1:] = ~full[:-1]
    begins[bounds[:-1][bounds[:-1] < len(full)]] = True
    starts = np.flatnonzero(full & begins)
    first = np.searchsorted(starts, bounds)
    counts = np.diff(first)
    cut = np.full(len(counts), -1, np.int64)
    for i in np.flatnonzero(counts > limit):
        text = data[bounds[i] : bounds[i + 1]]
        last = starts[first[i] + limit - 1] - bounds[i] if limit else 0
        end = last + int(np.argmin(full[bounds[i] + last : bounds[i + 1]])) if limit else 0
        cut[i] = int(((text[:end] & 0xC0) != 0x80).sum())
    arrays = [pa.array(counts, pa.int32()), pa.array(cut, pa.int32(), mask=cut < 0)]
    return pa.StructArray.from_arrays(arrays, names=["count", "cut"])


def prepare_embedding_text(posts: DataFrame, max_tokens: int = fv.MAX_TOKENS) -> DataFrame:
    """``(post_id, text, n_tokens)`` with every text cut to the token limit of the model.

    A token is a run of characters between white space. A text beyond the limit keeps
    an exact prefix, as a text within it is kept exactly. Tokens are counted on the bytes of
    a batch of texts at a time; only the counts come back to the rows.
    """

    @F.arrow_udf("struct<count: int, cut: int>")
    def sizes(texts: pa.Array) -> pa.Array:
        return token_sizes(texts, max_tokens)

    cleaned = posts.select("post_id", clean_embedding_text(F.col("text_col")).alias("full"))
    counted = cleaned.withColumn("found", sizes("full"))
    return counted.select(
        "post_id",
        F.when(F.col("found.cut").isNull(), F.col("full")).otherwise(F.substring("full", F.lit(1), F.col("found.cut"))).alias("text"),
        F.least("found.count", F.lit(max_tokens)).alias("n_tokens"),
    )


def token_budget_batches(prepared: DataFrame, budget: int = fv.MAX_TOKENS, block_bits: int = BLOCK_BITS) -> DataFrame:
    """``(batch, post_id, n_tokens)``; no batch holds more tokens than the budget.

    Texts are taken in id order, rows of one id by size; a text that would overflow the open
    batch starts the next one, and a text larger than the budget is an error. The batches are
    those of one pass over all texts, whatever the layout: see ``next_fit``. Packing
    needs ids and counts only, so texts are not moved: join them by ``post_id``.
    """
    fits = F.when(F.col("n_tokens") <= budget, F.col("n_tokens")).otherwise(
        F.raise_error(F.concat(F.lit("larger than the budget: post "), F.col("post_id").cast("string"))).cast("int")
    )
    sizes = prepared.select("post_id", fits.alias("n_tokens"))
    return next_fit(sizes, ["post_id", "n_tokens"], "n_tokens", budget, block_bits)
