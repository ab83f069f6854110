"""Document fingerprints: bottom-k sketches of word-shingle hashes, in built-in functions only.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's five-word shingles (a
shorter text's whole word sequence is its one shingle; no words, no hashes). The k smallest of two sketches
together are the sketch of both parts, so sketches merge in any order. A sketch with fewer than k hashes holds
all of them and its estimates are exact. Two empty sketches are alike to the full; an empty and another one not at all.

``with_next`` pairs each document with the next by ascending id (null ids first, repeated ids by the hash of their text; after
the last comes the first). Rows are cut into ranges of about RANGE_ROWS rows, at least LEAST_RANGES and at most MOST_RANGES
of them, by id, then text hash, then place in the table: one id with many texts and one row that repeats are split like
others. The range partitioner finds the cuts on these three numbers alone; the least row of each range is a table of
MOST_RANGES rows at most, which is broadcast. A range also receives a copy of the least row of the range behind it, so no
task ever needs more than its own range, and texts move once.

Null or empty text has the empty sketch. Very long texts are sketched whole. Repeated rows follow one another and each have their
own result; equal ids are put in order by their text's hash, and equal hashes (ties) are one member of a sketch. An empty table gives an
empty result. The places of rows must come out alike when a task runs again, as those of rows read from files do. Further columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .quality_rules import words
from .shared import let, text_of

SKETCH = 128
SHINGLE = 5
#: Documents per range that are aimed at, and the fewest and most ranges.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 4000, 512, 4096


def shingle_hashes(tokens: Column, shingle: int = SHINGLE) -> Column:
    each = F.transform(F.sequence(F.lit(1), F.size(tokens) - shingle + 1), lambda i: F.xxhash64(F.slice(tokens, i, shingle)))
    return F.when(F.size(tokens) == 0, F.array().cast("array<bigint>")).when(F.size(tokens) < shingle, F.array(F.xxhash64(tokens))).otherwise(each)


def sketch(text: Column, k: int = SKETCH, shingle: int = SHINGLE) -> Column:
    hashes = let(words(text), lambda tokens: shingle_hashes(tokens, shingle))
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = SKETCH) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def merge_sketches(sketches: DataFrame, by: list[str], sketch_col: str = "sketch", k: int = SKETCH) -> DataFrame:
    """One sketch per group from many parts': hashes are made distinct before the shuffle, and only the k smallest stay."""
    each = sketches.select(*by, F.explode(sketch_col).alias("hash")).distinct()
    ranked = each.withColumn("n", F.row_number().over(Window.partitionBy(*by).orderBy("hash"))).filter(F.col("n") <= k)
    return ranked.groupBy(*by).agg(F.sort_array(F.collect_list("hash")).alias(sketch_col))


def distinct_count(s: Column, k: int = SKETCH) -> Column:
    """The estimated number of distinct shingles; exact below k."""
    share = (F.element_at(s, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise((k - 1) / share)


def resemblance(a: Column, b: Column, k: int = SKETCH) -> Column:
    """The estimated Jaccard resemblance of the shingle sets of two sketches."""
    both = F.array_intersect(a, b)
    whole = (F.size(a) < k) & (F.size(b) < k)
    union = F.array_union(a, b)
    exact = F.size(both) / F.size(union)
    least = let(F.slice(F.sort_array(union), 1, k), lambda u: F.size(F.array_intersect(u, both)) / F.size(u))
    return F.when(F.size(union) == 0, F.lit(1.0)).when(whole, exact).otherwise(least).cast("double")


def containment(a: Column, b: Column, k: int = SKETCH) -> Column:
    """The estimated share of a's shingles that b has."""
    r = resemblance(a, b, k)
    overlap = r / (1 + r) * (distinct_count(a, k) + distinct_count(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), overlap / distinct_count(a, k)))


def written(s: Column) -> Column:
    """A sketch as text: the hashes' bytes in base64."""
    return F.base64(F.unhex(F.array_join(F.transform(s, lambda h: F.lpad(F.hex(h), 16, "0")), "")))


def with_next(docs: DataFrame, id_col: str, derive: dict[str, Column], lead: list[str]) -> DataFrame:
    """docs with the columns of derive (made from ``id`` and ``text`` after the shuffle) and, for those in lead, ``next_<name>`` of the next document."""
    spark = docs.sparkSession
    ranges = min(MOST_RANGES, max(LEAST_RANGES, -(-docs.count() // RANGE_ROWS)))
    place = F.struct(F.coalesce("id", F.lit(-(2**63))).alias("o"), F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("row"))
    placed = docs.select("id", "text", place.alias("at"))
    cut = placed.select("at.*").repartitionByRange(ranges, "o", "h", "row").select(F.struct("o", "h", "row").alias("at"), F.spark_partition_id().alias("part"))
    least = sorted(tuple(r["least"]) for r in cut.groupBy("part").agg(F.min("at").alias("least")).collect())  # a row for each range
    step = max(1, int(len(least) ** 0.5))
    kind = "array<struct<o:bigint,h:bigint,row:bigint>>"
    # One row: every step-th range's least row, and those of the ranges from each of these on.
    table = spark.createDataFrame([(least[::step], [least[i : i + step] for i in range(0, len(least), step)])], f"__coarse {kind}, __fine array<{kind}>")
    high = F.size(F.filter("__coarse", lambda c: c <= F.col("at")))
    low = F.size(F.filter(F.get("__fine", high - 1), lambda c: c <= F.col("at")))
    number = F.when(high == 0, F.lit(0)).otherwise((high - 1) * step + low - 1)
    own = placed.crossJoin(F.broadcast(table)).select("id", "text", "at.o", "at.h", number.cast("int").alias("range"), F.lit(0).alias("copy"))
    # The least row of each range goes to the range before it, that of the first to the last. Rows that are equal are one
    # row here, each task's own before anything moves; several ranges can have the same least id and text.
    names = [(o, h, (n - 1) % len(least)) for n, (o, h, _) in enumerate(least)]
    known = F.broadcast(spark.createDataFrame(sorted({x[:2] for x in names}), "o long, h long"))
    first = docs.select("id", "text", place["o"].alias("o"), place["h"].alias("h")).join(known, ["o", "h"], "left_semi").groupBy("o", "h").agg(F.min("id").alias("id"), F.min("text").alias("text"))
    copies = first.join(F.broadcast(spark.createDataFrame(names, "o long, h long, range int")), ["o", "h"]).select("id", "text", "o", "h", "range", F.lit(1).alias("copy"))
    dealt = own.unionByName(copies).repartition("range")
    dealt = dealt.select("*", *[c.alias(name) for name, c in derive.items()])
    w = Window.partitionBy("range").orderBy("copy", "o", "h", "text")
    return dealt.select("*", *[F.lead(c).over(w).alias(f"next_{c}") for c in lead]).filter("copy = 0").drop("o", "h", "copy", "range")


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SKETCH) -> DataFrame:
    """(doc_id, text, sketch, next_text, next_sketch, edited, edited_sketch, near_edited, near_next)."""
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    paired = with_next(base, "id", {"sketch": sketch(F.col("text"), k)}, ["text", "sketch"])
    part = F.floor(F.length("text") / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - part), F.substring(F.col("next_text"), F.lit(1), part))
    done = paired.withColumn("edited", edited).withColumn("edited_sketch", sketch(F.col("edited"), k))
    return done.select(F.col("id").alias("doc_id"), "text", "sketch", "next_text", "next_sketch", "edited", "edited_sketch", resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"), resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, the estimated number of distinct shingles and the containment in the edited text."""
    d = compared(docs)
    return d.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("sketch")).alias("fingerprint"),
        written(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        distinct_count(F.col("sketch")).alias("n_shingles_estimate"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("kept_in_edited"),
    )
