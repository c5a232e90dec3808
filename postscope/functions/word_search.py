"""A pattern that finds the tokens of a text whose bare word may be in a list of words.

A token is a run of characters between white space, its bare word has no punctuation at its
ends. The pattern is a tree of the words' characters in either case. It may find a few tokens
more, never fewer, so what it finds is looked up as before.
"""

from __future__ import annotations

import re
import sys
from collections import defaultdict
from collections.abc import Iterable
from functools import lru_cache

from postscope import fixed_values as fv
from postscope.functions.text import SPACES

#: Of more words the pattern would be slower than a look-up of every token.
MAX_PATTERN_WORDS = 20_000
# White space and its contrary, spelled so that most characters are told by one comparison or two.
_WIDE = r"\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
BLANK = rf"[\t\n\x0B\f\r\x1C\x1D\x1E\x1F\x20\x85\xA0[\u1680-\u3000&&[{_WIDE}]]]"
TOKEN = (
    r"[!-\x84[\x00-\x08\x0E-\x1B\x86-\x9F\xA1-\u167F\u3001-\x{10FFFF}"
    rf"[\u1681-\u2FFF&&[^{_WIDE}]]]]++"
)
_PUNCTUATION = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in fv.PUNCTUATION) + "]*+"


@lru_cache(maxsize=1)
def _cases() -> dict[str, set[str]]:
    """The characters whose lower case is a character, by that character."""
    cases = defaultdict(set)
    for code in range(sys.maxunicode + 1):
        low = chr(code).lower()
        if low != chr(code):
            cases[low].add(chr(code))
    for sigma in "σς":  # which of both the capital becomes depends on what is around it
        cases[sigma] |= {"σ", "ς", "Σ"}
    return cases


def _spelled(unit: str) -> str:
    cases = sorted({unit} | (_cases()[unit] if len(unit) > 1 or unit in _cases() else set()))
    spelled = ["".join(f"\\x{{{ord(c):x}}}" for c in case) for case in cases]
    if len(spelled) == 1:
        return spelled[0]
    return f"(?:{'|'.join(spelled)})" if any(len(c) > 1 for c in cases) else f"[{''.join(spelled)}]"


def _tree(words: Iterable[str]) -> str:
    """A pattern of all words; what words begin with alike is written once."""
    by_first = defaultdict(list)
    ends = False
    for word in words:
        first = re.match("i̇|.", word, re.DOTALL)
        if first is None:
            ends = True
        else:
            by_first[first.group()].append(word[first.end() :])
    branches = [_spelled(first) + _tree(rest) for first, rest in sorted(by_first.items())]
    if not branches:
        return ""
    if len(branches) == 1 and not ends:
        return branches[0]
    return f"(?:{'|'.join(branches)}){'?' if ends else ''}"


def token_pattern(words: Iterable[str]) -> str | None:
    """Matches a blank and a token behind it that may be one of the words; None without such words."""
    words = {w.lower() for w in words if w and not any(c in SPACES for c in w)}
    whole = {w for w in words if w[0] in fv.PUNCTUATION or w[-1] in fv.PUNCTUATION}
    parts = []
    if words - whole:
        parts.append(_PUNCTUATION + _tree(words - whole) + _PUNCTUATION)
    if whole:
        parts.append(_tree(whole))
    return f"{BLANK}(?:{'|'.join(parts)})(?={BLANK}|\\z)" if parts else None


def unused_characters(words: Iterable[str], n: int) -> list[str]:
    """Code points that stand for no character and are in none of the words."""
    used = set("".join(words))
    return [c for c in map(chr, range(0xFDD0, 0xFDF0)) if c not in used][:n]
