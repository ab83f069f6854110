"""Stored tables that grow by small batches: the crawl log, in which a batch rewrites the buckets it touches, and the store of relations.

Both are Parquet in folders by bucket, a hash of the key, so that one batch reads and writes few folders and a lookup opens
one. The number of buckets belongs to a table and can't change while it lives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwell.functions.folders import checkpointed

BUCKETS = 64


def _bucket(keys: list[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _rewrite(rows: DataFrame, path: str) -> None:
    """Replace the folders of the buckets in rows, and no others; a bucket's rows are written by few tasks."""
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)


def _touched(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame | None:
    """What is stored in the buckets that rows touch (at most as many numbers as the table has buckets); None without a table."""
    if not _exists(spark, path):
        return None
    return spark.read.parquet(path).filter(F.col("bucket").isin([r["bucket"] for r in rows.select("bucket").distinct().collect()]))


class CrawlLog:
    """The latest crawl of each (service, url), stored in buckets."""

    KEYS = ("service", "url")

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def upsert(self, rows: DataFrame, ts: str = "ts", tie: str | None = None) -> None:
        """Insert rows or replace those of the same key, the latest by ts (then tie) winning; a batch that is run again changes nothing."""
        new = checkpointed(rows.withColumn("bucket", _bucket([F.col(k) for k in self.KEYS], self.buckets)))
        old = _touched(self.spark, self.path, new)
        both = new if old is None else old.select(*new.columns).unionByName(new)
        order = F.struct(ts, tie) if tie else F.col(ts)
        latest = both.groupBy("bucket", *self.KEYS).agg(F.max_by(F.struct(*[c for c in new.columns if c not in (*self.KEYS, "bucket")]), order).alias("row"))
        _rewrite(checkpointed(latest.select("bucket", *self.KEYS, "row.*")), self.path)  # stored apart before its own source is replaced

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def at(self, service, url) -> DataFrame:
        """The crawl of one key; the bucket is a constant, so one folder is listed and read, with the key pushed to its files."""
        return self.read().filter((F.col("bucket") == _bucket([F.lit(service), F.lit(url)], self.buckets)) & (F.col("service") == service) & (F.col("url") == url)).drop("bucket")

    def of(self, wanted: DataFrame) -> DataFrame:
        """The crawls of many keys (service, url), joined bucket by bucket."""
        keys = wanted.select(*self.KEYS).distinct().withColumn("bucket", _bucket([F.col(k) for k in self.KEYS], self.buckets))
        return self.read().join(keys, ["bucket", *self.KEYS], "left_semi").drop("bucket")


class EdgeStore:
    """Relations (from_service, to_value, type, identifier, confidence) with the time they were first stored."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.buckets = spark, path, buckets

    def append(self, edges: DataFrame, at: Column) -> None:
        """Store the edges that aren't there yet, stamped with at; those that are keep their time. Files that are there stay as they are."""
        new = edges.dropDuplicates(["from_service", "identifier"]).withColumn("bucket", _bucket([F.col("from_service"), F.col("identifier")], self.buckets))
        new = checkpointed(new)
        old = _touched(self.spark, self.path, new)
        if old is not None:
            new = new.join(old.select("bucket", "from_service", "identifier"), ["bucket", "from_service", "identifier"], "left_anti")
        stamped = new.withColumn("stored_at", at.cast("timestamp")).select("from_service", "to_value", "type", "identifier", "confidence", "stored_at", "bucket")
        stamped.repartition("bucket").write.mode("append").partitionBy("bucket").parquet(self.path)

    def query(self, service: str | None = None, type_: str | None = None) -> DataFrame:
        rows = self.spark.read.parquet(self.path).drop("bucket")
        rows = rows if service is None else rows.filter(F.col("from_service") == service)
        return rows if type_ is None else rows.filter(F.col("type") == type_)

    def newest(self, each: int, service: str | None = None, type_: str | None = None) -> DataFrame:
        """The newest edges of each service, each at most, with place from 1; of one time the smallest type and value first.

        Tasks keep the first ``each`` rows of a service before anything is shuffled, so a hot service sends that many a task.
        """
        place = F.row_number().over(Window.partitionBy("from_service").orderBy(F.desc("stored_at"), "type", "to_value"))
        return self.query(service, type_).withColumn("place", place).filter(F.col("place") <= each)
