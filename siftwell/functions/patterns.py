"""Patterns are kept in RE2 form (as DuckDB reads them); this is the one place that turns them into Java's and Python's forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


WORD = "[A-Za-z0-9_]"
BOUNDARY = f"(?:(?<={WORD})(?!{WORD})|(?<!{WORD})(?={WORD}))"
BLANK = r"\t\n\f\r "


def _boundary(pattern: str, i: int) -> str:
    """A word boundary at pattern[i]: half of the test where what stands beside it at an end of the pattern is a word character anyway."""
    if i == 0 and pattern[2:3].isalnum():
        return f"(?<!{WORD})"
    if i == len(pattern) - 2 and pattern[i - 1 : i].isalnum():
        return f"(?!{WORD})"
    return BOUNDARY


def java(pattern: str) -> str:
    """The same matches in java.util.regex: ``.`` stops at line feeds only, ``$`` is the end of text, ``\\b`` and ``\\s`` are ASCII without the vertical tab."""
    return "(?d)" + _adapted(pattern, _boundary, r"\z")


def python(pattern: str) -> str:
    """The same matches in Python's re with its ASCII flag: ``$`` is the end of text, ``\\s`` has no vertical tab."""
    return _adapted(pattern, lambda p, i: r"\b", r"\Z")


def _adapted(pattern: str, boundary: Callable[[str, int], str], end: str) -> str:
    out, i, in_class = [], 0, False
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            pair = pattern[i : i + 2]
            if pair == "\\b" and not in_class:
                pair = boundary(pattern, i)
            elif pair == "\\z" and not in_class:
                pair = end
            elif pair == "\\s":
                pair = BLANK if in_class else f"[{BLANK}]"
            elif pair == "\\S" and not in_class:
                pair = f"[^{BLANK}]"
            out.append(pair)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class and pattern[i - 1] != "[" and pattern[i - 2 : i] != "[^":
            in_class = False
        elif c == "[" and in_class:
            c = "\\["
        elif c == "$" and not in_class:
            c = end
        out.append(c)
        i += 1
    return "".join(out)


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(java(pattern)), F.lit(group))


def find_first(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match, or null."""
    return F.nullif(F.regexp_extract(text, java(pattern), group), F.lit(""))


def has(text: Column, pattern: str) -> Column:
    return text.rlike(java(pattern))
