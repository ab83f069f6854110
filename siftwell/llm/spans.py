"""Spans of regular expressions as arrays of (start, end, match), in built-in functions only.

Offsets are code points, end exclusive. Patterns must match at least one character. Repetitions of a group
are written possessively where nothing behind them can need a character back, since Java would otherwise
recurse once per repetition and overflow its stack on long runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .shared import let

SPAN = "array<struct<start:int,stop:int,found:string>>"
BLOCK = 64


def running(values: Column) -> Column:
    """For each element of an array of ints the sum of those before it: block sums first, so long arrays stay cheap."""

    def grow(part: Column, first: Column) -> Column:
        return F.slice(F.aggregate(part, F.array(first), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x))), 1, F.size(part))

    def whole(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + x))
        return F.flatten(F.zip_with(blocks, grow(sums, F.lit(0)), grow))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))
    return F.when(F.size(values) == 0, F.array().cast("array<int>")).otherwise(let(blocks, whole))


def spans(text: Column, pattern: str, where: Column | None = None, context: int = 0) -> Column:
    """All leftmost non-overlapping matches of pattern. where: a cheap test without which there is no match.

    context: so many characters of what lies between a match and its neighbours come along as ``before`` and ``after``.
    """

    def place(parts: Column) -> Column:
        gaps, found = parts["gaps"], parts["found"]
        steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))

        def one(before: Column, m: Column, i: Column) -> Column:
            start = F.get(before, i) + F.length(F.get(gaps, i))
            fields = [start.alias("start"), (start + F.length(m)).alias("stop"), m.alias("found")]
            if context:
                fields += [F.right(F.get(gaps, i), F.lit(context)).alias("before"), F.left(F.get(gaps, i + 1), F.lit(context)).alias("after")]
            return F.struct(*fields)

        return let(running(steps), lambda before: F.transform(found, lambda m, i: one(before, m, i)))

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.when(F.size(found) > 0, let(F.struct(F.split(text, pattern, -1).alias("gaps"), found.alias("found")), place))
    got = both if where is None else F.when(where, both)
    return F.coalesce(got, F.array()).cast(SPAN.replace("found:string", "found:string,before:string,after:string") if context else SPAN)


def merged(kinds: dict[str, Column]) -> Column:
    """Spans of several kinds as one array of (start, rank, stop, kind, found), by start and then by kind as listed."""

    def tagged(n: int, kind: str, column: Column) -> Column:
        return F.transform(column, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind"), s["found"].alias("found")))

    return F.array_sort(F.concat(*[tagged(n, kind, column) for n, (kind, column) in enumerate(kinds.items())]))


def written(spans_column: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans_column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def replaced(text: Column, spans_column: Column, mark: Column) -> Column:
    """The text with every span, overlapping ones as one, replaced by mark. Spans are in order of their start."""
    none = F.array().cast("array<struct<start:int,stop:int>>")

    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        one = F.struct(s["start"].alias("start"), s["stop"].alias("stop"))
        wider = F.struct(last["start"].alias("start"), F.greatest(last["stop"], s["stop"]).alias("stop"))
        return F.when(F.size(acc) == 0, F.array(one)).when(last["stop"] > s["start"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(wider))).otherwise(F.concat(acc, F.array(one)))

    def cut(whole: Column) -> Column:
        pieces = F.transform(whole, lambda s, i: F.concat(F.substring(text, F.coalesce(F.get(whole, i - 1)["stop"], F.lit(0)) + 1, s["start"] - F.coalesce(F.get(whole, i - 1)["stop"], F.lit(0))), mark))
        return F.concat(F.array_join(pieces, ""), F.substring(text, F.element_at(whole, -1)["stop"] + 1, F.length(text)))

    joined = F.aggregate(spans_column, none, add)
    return F.when(F.size(spans_column) == 0, text).otherwise(let(joined, cut))
