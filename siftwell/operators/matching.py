"""Pattern rules over texts: a literal index first, then the patterns that it leaves, compiled once in a worker.

Every rule names literals of which each of its matches holds one. An Aho-Corasick automaton over all literals reads a text
once and gives the rules that can match at all, mostly a few of some two hundred; only these patterns run, in order. Rules
without literals run on every text, those with a long run on texts that have one. So the price of a page is one pass and a few patterns,
however many rules there are. What comes back is small; all that follows from a match is built-in functions.
"""

from __future__ import annotations

import re
import zlib
from functools import cache
from typing import NamedTuple

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.patterns import python
from siftwell.functions.workers import ready

FOUND = "array<struct<key:int,value:string>>"
LONG_RUN = re.compile("[0-9A-Za-z]{25}")


class Spec(NamedTuple):
    """What to look for. mode: ``all`` matches, the ``first``, or a ``flag`` that gives fixed. low: in the lower-case text. fold: values in lower case."""

    name: str
    pattern: str
    literals: tuple[str, ...] = ()
    group: int = 0
    mode: str = "all"
    fixed: str = ""
    run: bool = False
    low: bool = False
    fold: bool = False

    @property
    def key(self) -> int:
        return zlib.crc32("\t".join(map(str, self)).encode()) & 0x7FFFFFFF


class Matcher:
    """Specs made ready in one worker."""

    def __init__(self, specs: tuple[Spec, ...]):
        self.specs = [(s, s.key, re.compile(python(s.pattern), re.ASCII)) for s in specs]
        by: dict[str, list[int]] = {}
        for n, s in enumerate(specs):
            for x in s.literals:
                by.setdefault(x, []).append(n)
        self.always = [n for n, s in enumerate(specs) if not s.literals]
        self.automaton = None
        if by:
            self.automaton = ahocorasick.Automaton()
            for x, places in by.items():
                self.automaton.add_word(x, (x, places))
            self.automaton.make_automaton()

    def candidates(self, low: str, text: str) -> list[int]:
        """Places of the specs that can match."""
        tried = set(self.always)
        if self.automaton is not None:
            for places in {x: places for _, (x, places) in self.automaton.iter(low)}.values():
                tried.update(places)
        if any(self.specs[n][0].run for n in tried) and not LONG_RUN.search(text):
            tried = {n for n in tried if not self.specs[n][0].run}
        return sorted(tried)

    def found(self, text: str) -> list[tuple[int, str]]:
        """(key, value), by spec, then by place; a value of a spec once."""
        low, out = text.lower(), []
        for n in self.candidates(low, text):
            spec, key, pattern = self.specs[n]
            where = low if spec.low else text
            if spec.mode == "all":
                values = (m[spec.group] or "" for m in pattern.finditer(where))
                out += [(key, v) for v in dict.fromkeys(map(str.lower, values) if spec.fold else values)]
            elif m := pattern.search(where):
                out.append((key, spec.fixed if spec.mode == "flag" else m[0]))
        return out


@cache
def matcher(specs: tuple[Spec, ...]) -> Matcher:
    return Matcher(specs)


def distinct(specs: list[Spec]) -> tuple[Spec, ...]:
    """Each spec once; no two of them share a key."""
    out = tuple(dict.fromkeys(specs))
    if len({s.key for s in out}) < len(out):
        raise ValueError("two rules share a key: rename one")
    return out


def found(spark: SparkSession, text: Column, specs: tuple[Spec, ...]) -> Column:
    """What specs find in text: an array of (key, value); null text holds nothing."""
    if not specs:
        return F.array().cast(FOUND)
    ready(spark)

    def search(texts: pa.Array) -> pa.Array:
        own = matcher(specs)
        offsets, keys, values = [0], [], []
        for x in texts:
            if (t := x.as_py()) is not None:
                for k, v in own.found(t):
                    keys.append(k)
                    values.append(v)
            offsets.append(len(keys))
        pairs = pa.StructArray.from_arrays([pa.array(keys, pa.int32()), pa.array(values, pa.string())], ["key", "value"])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)

    search.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(search, FOUND)(text)
