"""Text expressions: title cleaning, word tokens and n-grams.

A word character is a Unicode letter, number or underscore. The class is spelled
out because Java's ``\\w`` is ASCII by default and its Unicode mode also admits
combining marks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the title cleaner and the tokenizer.
WORD_CHAR = r"[\p{L}\p{N}_]"
DIGITS = r"\p{Nd}+"
SHORT_WORD = rf"(?<!{WORD_CHAR}){WORD_CHAR}{{1,2}}(?!{WORD_CHAR})"
LINK = r"http[^\s\x0B\x1C-\x1F\x85\p{Z}]+"
WORD = rf"{WORD_CHAR}{{2,}}"
# White space as Python's str.split and str.strip see it.
SPACE_CLASS = r"\t-\r\x1C-\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPACES = "".join(
    chr(c)
    for first, last in [
        (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A),
        (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
    ]
    for c in range(first, last + 1)
)


def clean_title(title: Column) -> Column:
    """Lower case, then drop digits, words of one or two letters, and links, in that order."""
    text = F.lower(F.coalesce(title, F.lit("")))
    for pattern in (DIGITS, SHORT_WORD, LINK):
        text = F.regexp_replace(text, pattern, "")
    return text


def words(text: Column, stop_words: Sequence[str]) -> Column:
    """Words of at least two characters without the stop words, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({WORD})"), F.lit(1))
    if not stop_words:
        return found
    return F.filter(found, lambda word: ~word.isin(list(stop_words)))


def with_bigrams(tokens: Column) -> Column:
    """The tokens followed by each pair of neighbours joined by a blank."""
    pairs = F.transform(
        tokens, lambda word, i: F.concat(word, F.lit(" "), F.get(tokens, i + 1))
    )
    return F.concat(tokens, F.array_compact(pairs))


def matches_any_case(text: Column, pattern: str) -> Column:
    """Whether the regular expression occurs; case and word classes follow Unicode, not ASCII."""
    return text.rlike(f"(?iU){pattern}")


def strip(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.btrim(text, F.lit(SPACES))
