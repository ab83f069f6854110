"""Helpers that the corpus operators share: worker imports, shared checkpoints, null-safe text."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.folders import checkpointed, shared_folder

__all__ = ["WORD_BREAK", "checkpointed", "joined_by_hot_key", "keyed", "let", "ready", "settled", "shared_folder", "small", "table", "text_of"]

#: ASCII white space that separates words in every contract here: space and \x09-\x0D.
WORD_BREAK = r"[\x20\x09-\x0D]+"


def ready(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever the session was started from."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (env.get("PYTHONPATH"), root) if x)
    return spark


def text_of(column: str | Column) -> Column:
    """The text, with null read as empty."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def let(value: Column, body) -> Column:
    """Bind value once and use it many times in body (a lambda over a one-element array)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(row, key_id, key_hash): docs' columns packed away, so that no name of theirs can clash, and what tells texts apart."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("key_id"), F.xxhash64(text_of(text_col)).alias("key_hash"))


def settled(value: Column) -> Column:
    """value, unchanged, in a form that the optimizer computes once: filters on it aren't copied below it."""
    return F.when(F.spark_partition_id() >= 0, value)


#: Rows that may be broadcast once counted, and rows of one key that may meet in one task: so many, or this part of all.
SMALL_ROWS, KEY_ROWS, KEY_PART = 100_000, 1_000_000, 1 / 512


def small(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df, for a broadcast where it is counted to have at most so many (narrow) rows; else as it is, for a shuffle."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def joined_by_hot_key(left: DataFrame, right: DataFrame, key: str, spread: list[str], how: str = "inner") -> DataFrame:
    """left joined with right (at most one row per key), whose few hot keys are dealt over many tasks.

    A key with over KEY_ROWS rows or KEY_PART of all rows of left is hot: its rows get a number from a hash of the
    columns in spread, and its row of right one copy for each number. There are at most 1 / KEY_PART hot keys, or one
    per KEY_ROWS rows, so their list is broadcast. left is read twice: for the counts, and for the join.
    """
    counts = left.groupBy(key).agg(F.count("*").alias("n"))
    total = left.count()
    most = max(1, min(KEY_ROWS, int(total * KEY_PART)))
    hot = checkpointed(counts.filter(F.col("n") > most).select(F.col(key).alias("__hot"), F.ceil(F.col("n") / most).cast("int").alias("__parts")))
    many = F.coalesce("__parts", F.lit(1))
    lefts = left.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__part", F.pmod(F.xxhash64(*spread), many).cast("int")).drop("__hot", "__parts")
    rights = right.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left").withColumn("__part", F.explode(F.sequence(F.lit(0), many - 1))).drop("__hot", "__parts")
    return lefts.join(rights, [key, "__part"], how).drop("__part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
