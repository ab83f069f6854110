"""The same checks over a stream of arriving captures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def captures(spark: SparkSession, folder: str, schema, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def recent_once(stream: DataFrame, ts: str, keys: list[str], window: str) -> DataFrame:
    """Each key once per window of event time; state is bounded by the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, window).dropDuplicatesWithinWatermark(keys)


def findings_to(stream: DataFrame, detector: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """Write a detector's findings batch by batch; a batch that is run again overwrites its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        detector(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
