"""Periodic runs of words, found by recompression.

The words of a batch of texts, with a separator of its own before and after each text, are compressed into one run-length grammar.
Levels alternate: block compression names each maximal block of one symbol by symbol and length; pair compression deals the
symbols to a left and a right side by hash and names each adjacent left-right pair. So equal stretches are parsed alike but for their ends, and an extension
query (how far do two places agree, forwards or backwards) climbs from level to level while both places begin a symbol there, takes at most
one step a level, and comes down again to the first difference: O(levels) lookups, for all queries of a batch at once. No
suffix array is built.

Candidates lie on a harmonic grid. A run of period q has at least 4q words, so it holds a multiple of 3q that agrees with
the word q further on; for each q only those n / 3q places are asked, n log n in all. Places whose neighbourhood
shows fewer than five agreeing words in a row are left out, since a run has more. The grammar's two extensions of a
candidate are the run. Of equal stretches the smallest period counts; it divides the others and is met first.

A run is a stretch of consecutive words with smallest period q and length >= max(LEAST_WORDS, LEAST_EXPONENT * q) that no
neighbouring word extends. The collapsed text keeps of each run the first q words: a word is dropped if any run contains it
after that run's first q words; kept words are joined by one space.

Null or empty text has no words, no runs and an empty collapsed text. Very long texts are taken whole, as a batch of
their own. Repeated rows get equal results, a row for each. Of runs of equal length the one with the smallest start, then
period, is the longest. An empty table gives an empty result. Further columns of docs, whatever their names, aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ready, text_of

LEAST_WORDS, LEAST_EXPONENT = 6, 4
#: Words whose grammar is built at once; a longer text is a batch of its own.
BATCH_WORDS = 200_000
Run = tuple[int, int, int]
RUNS = "array<struct<start:long,length:long,period:long>>"


class Level(NamedTuple):
    """Symbols of one level and how they make up the next: each one's parent, whether it is its first or last child, and
    how many equal symbols follow and precede it in its block, itself included (None where the next level pairs)."""

    symbols: np.ndarray
    parent: np.ndarray
    first: np.ndarray
    last: np.ndarray
    after: np.ndarray | None
    before: np.ndarray | None
    #: Indexes of the first and last children, by parent.
    firsts: np.ndarray
    lasts: np.ndarray


def _sides(symbols: np.ndarray, salt: int) -> np.ndarray:
    """A hashed bit for each symbol: whether it is on the left side."""
    x = (symbols.astype(np.uint64) + np.uint64(salt * 0x9E3779B9 + 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (x >> np.uint64(63)).astype(bool)


def _level(symbols: np.ndarray, first: np.ndarray, names: np.ndarray, after=None, before=None) -> tuple[Level, np.ndarray]:
    firsts = np.flatnonzero(first)
    last = np.concatenate((first[1:], [True]))
    return Level(symbols, np.cumsum(first) - 1, first, last, after, before, firsts, np.flatnonzero(last)), names


class Grammar:
    """The levels of a sequence of numbers that begins and ends with numbers that occur once."""

    def __init__(self, words: np.ndarray):
        self.levels: list[Level] = []
        self.free = int(words.max(initial=-1)) + 1
        symbols, salt = words.astype(np.int64), 0
        while len(symbols) > 1:
            symbols = self._pairs(self._blocks(symbols), salt)
            salt += 1
        self.top = symbols

    def _named(self, keys: np.ndarray) -> np.ndarray:
        """A new symbol for each distinct key."""
        different, place = np.unique(keys, return_inverse=True)
        out = place.reshape(-1) + self.free
        self.free += len(different)
        return out

    def _blocks(self, symbols: np.ndarray) -> np.ndarray:
        first = np.concatenate(([True], symbols[1:] != symbols[:-1]))
        if first.all():
            return symbols
        starts = np.flatnonzero(first)
        lengths = np.diff(np.append(starts, len(symbols)))
        place = np.arange(len(symbols)) - np.repeat(starts, lengths)
        names = symbols[starts].copy()
        many = lengths > 1
        names[many] = self._named((names[many] << 32) | lengths[many])
        level, out = _level(symbols, first, names, np.repeat(lengths, lengths) - place, place + 1)
        self.levels.append(level)
        return out

    def _pairs(self, symbols: np.ndarray, salt: int) -> np.ndarray:
        left = _sides(symbols, salt)
        paired = np.flatnonzero(left[:-1] & ~left[1:])
        if not len(paired):
            return symbols
        first = np.ones(len(symbols), bool)
        first[paired + 1] = False
        names = symbols.copy()
        names[paired] = self._named((symbols[paired] << 32) | symbols[paired + 1])
        level, out = _level(symbols, first, names[first])
        self.levels.append(level)
        return out

    def agreeing(self, a: np.ndarray, b: np.ndarray, forwards: bool = True) -> np.ndarray:
        """How many words agree from a and b on (a != b), or backwards from a and b."""
        i, j = a.astype(np.int64), b.astype(np.int64)
        stopped = np.zeros(len(a), np.int64)
        going = np.arange(len(a))
        for n, level in enumerate(self.levels):
            x, y = i[going], j[going]
            same = level.symbols[x] == level.symbols[y]
            stopped[going[~same]] = n
            going, x, y = going[same], x[same], y[same]
            if not len(going):
                break
            edge = level.first if forwards else level.last
            inside = ~(edge[x] & edge[y])
            far = self._step(level, x[inside], y[inside], forwards)
            x[inside] += far
            y[inside] += far
            i[going], j[going] = x, y
            aligned = edge[x] & edge[y]  # else two blocks of other lengths: they differ here
            stopped[going[~aligned]] = n
            going = going[aligned]
            i[going], j[going] = level.parent[i[going]], level.parent[j[going]]
        else:
            stopped[going] = len(self.levels)
        for n in range(int(stopped.max(initial=0)) - 1, -1, -1):
            down, level = np.flatnonzero(stopped > n), self.levels[n]
            child = level.firsts if forwards else level.lasts
            x, y = child[i[down]], child[j[down]]
            same = level.symbols[x] == level.symbols[y]
            far = self._step(level, x[same], y[same], forwards)
            x[same] += far
            y[same] += far
            i[down], j[down] = x, y
        return np.abs(i - a)

    @staticmethod
    def _step(level: Level, x: np.ndarray, y: np.ndarray, forwards: bool) -> np.ndarray | int:
        """Past one equal symbol, or past as much of a block as both have."""
        if level.after is None:
            return 1 if forwards else -1
        return np.minimum(level.after[x], level.after[y]) if forwards else -np.minimum(level.before[x], level.before[y])


def _grid(sizes: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, period, place) of the grid for periods low <= q < high: places 0, 3q, 6q, ... with another word q further on."""
    periods = np.minimum(sizes // LEAST_EXPONENT, high - 1) - low + 1
    periods[(sizes < LEAST_WORDS) | (periods < 0)] = 0
    text = np.repeat(np.arange(len(sizes)), periods)
    q = low + np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods)
    step = (LEAST_EXPONENT - 1) * q
    many = -(-(sizes[text] - q) // step)
    place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    return np.repeat(text, many), np.repeat(q, many), place * np.repeat(step, many)


def _promising(words: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether at least LEAST_WORDS - 1 words in a row, this one among them, agree: a run of period one has as many, others more."""
    out = words[a] == words[b]
    some = np.flatnonzero(out)
    total = np.zeros(len(some), np.int64)
    last = len(words) - 1
    for way in (1, -1):
        going = np.ones(len(some), bool)
        for d in range(1, LEAST_WORDS - 1):
            going &= words[np.clip(a[some] + way * d, 0, last)] == words[np.clip(b[some] + way * d, 0, last)]
            total += going
    out[some] = total >= LEAST_WORDS - 2
    return out


def runs_of(texts: list[list]) -> list[list[Run]]:
    """(start, length, period) of each text's runs, by start, then period. Texts are lists of words."""
    sizes = np.array([len(t) for t in texts], np.int64)
    known: dict = {}
    separators = iter(range(int(sizes.sum()), int(sizes.sum()) + len(texts) + 1))  # beyond any word's number
    numbers = [next(separators)]
    for t in texts:
        numbers.extend(known.setdefault(w, len(known)) for w in t)
        numbers.append(next(separators))
    words = np.array(numbers, np.int64)
    begins = 1 + np.cumsum(sizes + 1) - (sizes + 1)
    grammar: Grammar | None = None
    found: dict[tuple[int, int], int] = {}
    cover = np.full(len(words), -1, np.int64)
    ends, periods = np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = 1
    while low <= sizes.max(initial=0) // LEAST_EXPONENT:
        text, q, place = _grid(sizes, low, 2 * low)
        low *= 2
        a = begins[text] + place
        keep = _promising(words, a, a + q)
        a, q = a[keep], q[keep]
        if len(ends):  # inside a run whose period divides q the extension is that run again
            c = cover[a]
            keep = ~((c >= 0) & (a + q < ends[c]) & (q % periods[c] == 0))
            a, q = a[keep], q[keep]
        if not len(a):
            continue
        grammar = grammar or Grammar(words)
        start = a - grammar.agreeing(a - 1, a + q - 1, forwards=False)
        end = a + q + grammar.agreeing(a, a + q)
        long = end - start >= np.maximum(LEAST_WORDS, LEAST_EXPONENT * q)
        new = {(s, e): p for s, e, p in zip(start[long].tolist(), end[long].tolist(), q[long].tolist()) if (s, e) not in found}
        found |= new
        for n, ((s, e), p) in enumerate(sorted(new.items(), key=lambda r: r[0][1] - r[0][0]), len(ends)):
            cover[s:e] = n
        if new:
            shown = sorted(new.items(), key=lambda r: r[0][1] - r[0][0])
            ends, periods = np.append(ends, [r[0][1] for r in shown]), np.append(periods, [r[1] for r in shown])
    out: list[list[Run]] = [[] for _ in texts]
    for (s, e), p in found.items():
        n = int(np.searchsorted(begins, s, "right")) - 1
        out[n].append((s - int(begins[n]), e - s, p))
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(words: list, runs: list[Run]) -> list:
    """The words without the repetitions of any run."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[n] for n in np.flatnonzero(keep)]


def detected(docs: DataFrame, columns: list[Column], text_col: str = "text", edit: Callable[[object, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """columns of docs with n_words, runs (start, length, period; words numbered from 0) and the collapsed text.

    edit: changes a text's words before they are searched; it gets the first of columns and the words.
    """
    ready(docs.sparkSession)
    picked = docs.select(*columns, text_of(text_col).alias("__text"))
    names = picked.columns[:-1]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            keys, texts = part.column(0).to_pylist(), part.column(len(names)).cast(pa.binary())
            at = 0
            while at < len(texts):
                begin, held, size = at, [], 0
                while at < len(texts) and size < BATCH_WORDS:
                    words = texts[at].as_py().split()
                    if held and size + len(words) > BATCH_WORDS:
                        break
                    held.append(edit(keys[at], words) if edit else words)
                    size += len(words)
                    at += 1
                runs = runs_of(held)
                more = [
                    pa.array([len(w) for w in held], pa.int64()),
                    pa.array([[{"start": s, "length": n, "period": p} for s, n, p in r] for r in runs], pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                    pa.array([b" ".join(collapsed(w, r)).decode() for w, r in zip(held, runs)], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays([*(part.column(i).slice(begin, at - begin) for i in range(len(names))), *more], [*names, "n_words", "runs", "collapsed"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(batches, f"{schema}, n_words long, runs {RUNS}, collapsed string")


def repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The query's planted repetition: of a tenth of the texts (by the id's crc32) the words from a on repeat the first p of them. A null id counts as empty text."""
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def digest(docs: DataFrame) -> DataFrame:
    """(doc_id, n_runs, start, length, period, exponent_milli of the longest run, runs_sha256, collapsed_sha256, n_words)."""
    found = detected(docs, [F.col("doc_id")], edit=repeated)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("minus_start"), (-r["period"]).alias("minus_period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), (F.concat(r["period"].cast("string"), F.lit("\n"))))), "")
    told = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("top"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"), "n_words")
    start, period = -F.col("top.minus_start"), -F.col("top.minus_period")
    return told.select("doc_id", "n_runs", start.alias("start"), F.col("top.length").alias("length"), period.alias("period"), F.expr("1000 * top.length div -top.minus_period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256", "n_words")
