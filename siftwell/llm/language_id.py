"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is read as letters in lower case, everything else being a break (runs of breaks are one). Its n-grams are all stretches
of one to ORDERS code points, breaks included. Each n-gram is hashed to one of ``buckets``. The model is one matrix of log
probabilities, a row per bucket and a column per language, with smoothed counts and log priors. It is broadcast; texts
are scored batch by batch as sparse rows: the matrix rows of a batch's n-grams are gathered and added up text by text.

The model learns from the rows with a non-null language that are outside the held-out fold. Of each language it
reads at most about TRAIN_ROWS rows, those whose id hashes lowest (a bounded sample of labelled rows, allowed for a
classifier); languages with fewer are read whole, so rare ones keep all they have. Priors and everything else cover all rows.

The matrix has at most CELLS cells whatever the data: with many languages the number of buckets is halved until it fits.
A column with over CELLS / LEAST_BUCKETS distinct values holds no languages, and fitting raises an error.

``score`` is the posterior of the predicted language. n-grams of one text depend on each other, so a long text's log
likelihoods are scaled to the evidence of EVIDENCE n-grams; the order of the languages stays. Equal likelihoods go to the
language that sorts first.

Null text, empty text and text without a letter is ``und`` with score 0; so is every row where no language was learned.
Very long texts are scored whole, in pieces of bounded size. Repeated rows get equal results, a row for each. A null id
counts as empty text for the fold. An empty table gives an empty result. Further columns of docs, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ready, text_of

ORDERS = 4
BUCKETS, LEAST_BUCKETS, CELLS = 1 << 15, 1 << 10, 1 << 24
TRAIN_ROWS = 20_000
SMOOTH, EVIDENCE = 0.5, 50
UNKNOWN = "und"
#: n-grams that are gathered at once; with few languages a gathered block has some ten megabytes.
GATHER = 1 << 18
#: Code points of texts whose n-grams are held at once.
TOGETHER = 1 << 20


class Model(NamedTuple):
    languages: list[str]
    #: (buckets, languages), float32
    log_probability: np.ndarray
    log_prior: np.ndarray


@cache
def _folded() -> np.ndarray:
    """For each code point of the basic plane its lower-case letter, or a space."""
    out = np.full(1 << 16, 32, np.uint32)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = chr(c).lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def letters(text: str) -> np.ndarray:
    """The text's lower-case letters as code points, with one space for each run of anything else and one at either end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    points = np.where(points < 1 << 16, _folded()[np.minimum(points, (1 << 16) - 1)], points)
    points = np.concatenate(([np.uint32(32)], points, [np.uint32(32)]))
    keep = np.ones(len(points), bool)
    keep[1:] = (points[1:] != 32) | (points[:-1] != 32)
    return points[keep]


def ngrams(points: np.ndarray, buckets: int, orders: int = ORDERS) -> np.ndarray:
    """The bucket of each n-gram; buckets is a power of two."""
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    out, held = [], np.zeros(len(points), np.uint32)
    for n in range(orders):
        if len(points) <= n:
            break
        held = (held[: len(points) - n] * np.uint32(0x01000193)) ^ (points[n:] + np.uint32(n))
        mixed = (held ^ (held >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        out.append((mixed ^ (mixed >> np.uint32(13))) * np.uint32(0xC2B2AE35) >> shift)
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


def in_fold(id_col: str | Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text leaves this remainder; a null id counts as empty text."""
    key = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.encode(text_of(key.cast("string")), "utf-8")), F.lit(folds)) == fold


def _sample(known: DataFrame, most: int) -> tuple[dict[str, int], DataFrame]:
    """The languages with their numbers of rows, and rows (lang, text): of each language about so many at most. known: (id, lang, text)."""
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).limit(CELLS // LEAST_BUCKETS + 1).collect()}
    if len(counts) > CELLS // LEAST_BUCKETS:
        raise ValueError(f"over {CELLS // LEAST_BUCKETS} distinct languages: this column holds something else")
    shares = {k: int(most / n * (1 << 30)) for k, n in counts.items() if n > most}
    rows = known
    if shares:  # a language is listed here if it has over TRAIN_ROWS rows
        share = known.sparkSession.createDataFrame(sorted(shares.items()), "lang string, share long")
        place = F.pmod(F.xxhash64("id", "text"), F.lit(1 << 30))
        rows = known.join(F.broadcast(share), "lang", "left").filter(F.col("share").isNull() | (place < F.col("share")))
    return dict(sorted(counts.items())), rows.select("lang", "text")


def fitted(docs: DataFrame, train: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", most: int = TRAIN_ROWS) -> Model | None:
    """The model from the rows for which train holds; None where there is no such row with a language."""
    spark = ready(docs.sparkSession)
    known = docs.filter(train & F.col(lang_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), F.col(lang_col).cast("string").alias("lang"), text_of(text_col).alias("text"))
    known_rows, rows = _sample(known, most)
    languages = list(known_rows)
    if not languages:
        return None
    buckets = BUCKETS
    while buckets * len(languages) > CELLS:
        buckets //= 2
    places = spark.sparkContext.broadcast({k: n for n, k in enumerate(languages)})

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, total = places.value, np.zeros((len(places.value), buckets), np.int64)
        for part in parts:
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                total[place[lang]] += np.bincount(ngrams(letters(text), buckets), minlength=buckets)
        for n, row in enumerate(total):
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), n)), pa.array(at), pa.array(row[at])], ["place", "bucket", "n"])

    counts = np.full((buckets, len(languages)), SMOOTH, np.float64)
    priors = np.array(list(known_rows.values())) + 1.0
    sums = rows.mapInArrow(batches, "place long, bucket long, n long").groupBy("place", "bucket").agg(F.sum("n").alias("n"))
    for r in sums.toLocalIterator():  # CELLS rows at most
        counts[r["bucket"], r["place"]] += r["n"]
    return Model(languages, np.log(counts / counts.sum(axis=0)).astype(np.float32), np.log(priors / priors.sum()))


def likelihoods(texts: list[np.ndarray], model: Model) -> np.ndarray:
    """Summed log probabilities, a row per text (its buckets) and a column per language."""
    out = np.zeros((len(texts), len(model.languages)))
    step = max(1, GATHER * 8 // max(8, len(model.languages)))
    held: list[tuple[int, np.ndarray]] = []
    size = 0

    def settle() -> None:
        if held:
            starts = np.cumsum([0, *(len(g) for _, g in held[:-1])])
            sums = np.add.reduceat(model.log_probability[np.concatenate([g for _, g in held])], starts, axis=0, dtype=np.float64)
            np.add.at(out, [n for n, _ in held], sums)

    for n, grams in enumerate(texts):
        for at in range(0, len(grams), step):  # pieces begin at the same places of a text whatever batch it is in
            piece = grams[at : at + step]
            if size + len(piece) > step:
                settle()
                held, size = [], 0
            held.append((n, piece))
            size += len(piece)
    settle()
    return out


def predicted(docs: DataFrame, model: Model | None, columns: list[Column], text_col: str = "text") -> DataFrame:
    """columns of docs with lang_pred, score, n_ngrams and second_lang (the next likely language, null without one)."""
    spark = ready(docs.sparkSession)
    picked = docs.select(*columns, text_of(text_col).alias("__text"))
    names = picked.columns[:-1]
    held = spark.sparkContext.broadcast(model)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        for part in parts:
            langs, scores, sizes, seconds = [], [], [], []
            texts = part.column(len(names))
            at = 0
            while at < len(texts):
                some, size = [], 0
                while at < len(texts) and size < TOGETHER:
                    some.append(texts[at].as_py())
                    size += len(some[-1])
                    at += 1
                worth = [own is not None and any(map(str.isalpha, t)) for t in some]
                grams = [ngrams(letters(t), len(own.log_probability)) if w else np.zeros(0, np.uint32) for t, w in zip(some, worth)]
                sums = likelihoods(grams, own) if own is not None else None
                for n, (w, g) in enumerate(zip(worth, grams)):
                    sizes.append(len(g))
                    if not w:
                        langs.append(UNKNOWN)
                        scores.append(0.0)
                        seconds.append(None)
                        continue
                    all_in = sums[n] + own.log_prior
                    order = np.argsort(-all_in, kind="stable")
                    scaled = all_in / max(1.0, len(g) / EVIDENCE)
                    langs.append(own.languages[order[0]])
                    scores.append(float(1 / np.exp(scaled - scaled[order[0]]).sum()))
                    seconds.append(own.languages[order[1]] if len(order) > 1 else None)
            more = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sizes, pa.int64()), pa.array(seconds, pa.string())]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), *more], [*names, "lang_pred", "score", "n_ngrams", "second_lang"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(batches, f"{schema}, lang_pred string, score double, n_ngrams long, second_lang string")


def digest(docs: DataFrame, folds: int = 5, fold: int = 0) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_ngrams, second_lang), a row per row of docs, by a model that didn't see the fold."""
    out = in_fold("doc_id", folds, fold)
    model = fitted(docs, ~out)
    return predicted(docs, model, [F.col("doc_id"), out.alias("held_out")])
