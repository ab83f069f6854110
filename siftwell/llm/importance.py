"""Quality classification by importance resampling.

Two generative models over hashed unigrams and bigrams: one of the target (documents labelled as good), one of the raw
corpus (every document). A document's summed log ratio is the log of the ratio of the two models' likelihoods of its
n-grams. It grows with the document, from one to many thousands of words, so it is divided by a temperature:
(n-grams + PRIOR_NGRAMS) / LENGTH, which leaves the evidence of LENGTH n-grams whatever the document's own size
and damps texts of few n-grams. ``log_weight`` is that quotient; ``temperature=`` sets a constant one instead (1: the plain ratio).

Selection is Gumbel top-k: each document's log weight gets independent Gumbel noise (a hash of its id and text, so
that a lost executor's rows come back alike), and the k largest keys are the sample without replacement in proportion to
the weights. k is the target size: ``k=``, or the number of rows times the share of good ones among the
labelled documents of the table (all, where none is labelled).

The target model is fitted on at most TARGET_ROWS good documents, taken by the smallest hash of their id; the
raw model counts all rows. Both are tables of BUCKETS numbers. Without any good label the two are the same model and
every document weighs one.

Null or empty text has no n-grams and weight one. Very long texts are counted whole. Repeated rows have equal keys
and are selected or left out together, so ties at the k-th key are all selected. An empty table gives an empty result. Further
columns of docs, whatever their names, aren't read; ``keep_selected`` packs them into one struct.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, ready, text_of

BUCKETS = 1 << 14
TARGET_ROWS = 20_000
#: n-grams whose evidence a weight holds, n-grams of ratio one that every document counts besides its own, and pseudo-counts per bucket.
LENGTH, PRIOR_NGRAMS, SMOOTH = 40, 30, 1.0
REMEMBERED = 1 << 17


class Hasher:
    """Buckets of a text's unigrams and bigrams; words' hashes are remembered up to a bound."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.known = buckets, {}

    def words(self, text: str) -> np.ndarray:
        known, tokens = self.known, text.encode().split()
        if len(known) > REMEMBERED:
            known.clear()
        for t in tokens:
            if t not in known:
                known[t] = xxhash.xxh64_intdigest(t)
        return np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))

    def ngrams(self, text: str) -> np.ndarray:
        """A bucket per unigram and bigram."""
        one = self.words(text)
        two = (one[:-1] * np.uint64(0x9E3779B97F4A7C15)) ^ (one[1:] + np.uint64(0x7F4A7C15))
        two ^= two >> np.uint64(29)
        return np.concatenate((one, two)) % np.uint64(self.buckets)


def counted(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """n-grams of all rows by bucket: each task adds up its own rows, so a table of fixed size is all that moves."""
    ready(docs.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, total = Hasher(buckets), np.zeros(buckets, np.int64)
        for part in parts:
            for text in part.column(0).to_pylist():
                total += np.bincount(hasher.ngrams(text).astype(np.int64), minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total)], ["bucket", "n"])

    sums = docs.select(text_of(text_col).alias("text")).mapInArrow(batches, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets)
    for r in sums.collect():  # one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def target_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", most: int = TARGET_ROWS) -> DataFrame:
    """At most about so many documents labelled good: those whose id hashes into the lowest part of the range."""
    good = labels.filter("quality = 1").select(F.col("doc_id").alias("good")).distinct()
    n = good.count()
    share = 1.0 if n <= most else most / n
    few = good.filter(F.pmod(F.xxhash64("good"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) or 1))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("id"))
    return packed.join(F.broadcast(few), F.col("id") == F.col("good"), "left_semi").select("row.*")  # about TARGET_ROWS ids at most


def log_ratios(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    raw = counted(docs, text_col, buckets)
    target = counted(target_rows(docs, labels, id_col), text_col, buckets)
    if not target.any():
        return np.zeros(buckets)
    # Both models get the same pseudo-counts, spread like the raw corpus, so unseen buckets say nothing.
    prior = SMOOTH * buckets * (raw + 0.5) / (raw + 0.5).sum()
    return np.log((target + prior) / (target + prior).sum()) - np.log((raw + prior) / (raw + prior).sum())


def weighed(docs: DataFrame, ratios: np.ndarray, columns: list[Column], text_col: str = "text", temperature: float | None = None) -> DataFrame:
    """columns of docs (the id first) with n_ngrams, log_ratio (the sum), mean_log_ratio, log_weight and the Gumbel key."""
    spark = ready(docs.sparkSession)
    held = spark.sparkContext.broadcast(ratios)
    picked = docs.select(*columns, text_of(text_col).alias("__text"))
    names = picked.columns[:-1]

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        hasher = Hasher(len(table))
        for part in parts:
            n, ratio, weight, key = [], [], [], []
            for row, text in zip(part.column(0).to_pylist(), part.column(len(names)).to_pylist()):
                grams = hasher.ngrams(text)
                n.append(len(grams))
                ratio.append(float(table[grams.astype(np.int64)].sum()))
                weight.append(ratio[-1] / (temperature or (len(grams) + PRIOR_NGRAMS) / LENGTH))
                key.append(weight[-1] + gumbel(row, text))
            mean = [r / (m + PRIOR_NGRAMS) for r, m in zip(ratio, n)]
            extra = [pa.array(n, pa.int64()), *(pa.array(x, pa.float64()) for x in (ratio, mean, weight, key))]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(names))), *extra], [*names, "n_ngrams", "log_ratio", "mean_log_ratio", "log_weight", "gumbel_key"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema.fields[:-1])
    return picked.mapInArrow(batches, f"{schema}, n_ngrams long, log_ratio double, mean_log_ratio double, log_weight double, gumbel_key double")


def gumbel(row_id: object, text: str) -> float:
    """A standard Gumbel number from a hash of the id and the text."""
    u = (xxhash.xxh64_intdigest(f"{row_id}\t{text}", 7) + 0.5) / 2.0**64
    return -math.log(-math.log(u)) if 0 < u < 1 else 0.0


def kth_largest(keys: DataFrame, column: str, k: int, steps: int = 4096) -> float:
    """The k-th largest value of column, exactly: histograms of ever smaller ranges, each of a fixed number of counts."""
    low, high = keys.agg(F.min(column), F.max(column)).first()
    above = 0  # rows beyond high
    while low < high:
        width = (high - low) / steps
        if width <= 0 or low + width <= low:
            break
        inside = keys.filter(F.col(column).between(low, high))
        place = F.least(F.lit(steps - 1), F.floor((F.col(column) - low) / width))
        rows = {r["place"]: r for r in inside.groupBy(place.alias("place")).agg(F.count("*").alias("n"), F.min(column).alias("low"), F.max(column).alias("high")).collect()}
        for at in sorted(rows, reverse=True):
            if above + rows[at]["n"] >= k:
                low, high = rows[at]["low"], rows[at]["high"]
                break
            above += rows[at]["n"]
    return low


def target_size(docs: DataFrame, labels: DataFrame) -> int:
    """The rows of docs (doc_id, small) times the share of good ones among those labelled; all rows where none is."""
    n = docs.count()
    marked = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("marked")).agg(F.max("quality").alias("quality"))
    good, known = docs.join(marked, F.col("doc_id") == F.col("marked")).agg(F.sum((F.col("quality") == 1).cast("long")), F.count("*")).first()
    return round(n * good / known) if known else n


def _threshold(keys: DataFrame, labels: DataFrame, k: int | None) -> float:
    """The k-th largest key; infinite where nothing is to be selected."""
    count = target_size(keys.select("doc_id"), labels) if k is None else k
    return kth_largest(keys, "gumbel_key", count) if count > 0 and not keys.isEmpty() else math.inf


def resampled(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None, temperature: float | None = None) -> DataFrame:
    """(doc_id, n_ngrams, log_ratio, mean_log_ratio, log_weight, gumbel_key, selected), a row per row of docs."""
    ratios = log_ratios(docs, labels, id_col, text_col)
    keys = checkpointed(weighed(docs, ratios, [F.col(id_col).alias("doc_id")], text_col, temperature))
    return keys.withColumn("selected", F.col("gumbel_key") >= _threshold(keys, labels, k))


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, n_ngrams, log_ratio, mean_log_ratio, log_weight, gumbel_key, kept)."""
    return resampled(docs, labels).withColumnRenamed("selected", "kept")


def keep_selected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int | None = None) -> DataFrame:
    """The documents that the sample takes, with their own columns.

    A key depends on the id and the text alone, so once the k-th largest is known the documents are weighed again where they
    lie and compared with it; no text is shuffled.
    """
    ratios = log_ratios(docs, labels, id_col, text_col)
    keys = checkpointed(weighed(docs, ratios, [F.col(id_col).alias("doc_id")], text_col))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    again = weighed(docs, ratios, [F.col(id_col).alias("doc_id"), row], text_col)
    return again.filter(F.col("gumbel_key") >= _threshold(keys, labels, k)).select("row.*")
