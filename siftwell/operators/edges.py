"""Relationships: services that share an identifier."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def edges(findings: DataFrame, confidence: float = 1.0) -> DataFrame:
    """(from_service, to_value, type, identifier, confidence)."""
    one = findings.select(F.col("service").alias("from_service"), F.col("value").alias("to_value"), "type").distinct()
    return one.withColumn("identifier", F.sha2(F.concat_ws("|", "type", "to_value"), 256)).withColumn("confidence", F.lit(confidence))


def query(frame: DataFrame, service: str | None = None, type_: str | None = None) -> DataFrame:
    if service is not None:
        frame = frame.filter(F.col("from_service") == service)
    return frame if type_ is None else frame.filter(F.col("type") == type_)


def shared(findings: DataFrame) -> DataFrame:
    """(type, value, n, services): values on more than one service, how many have them, and all of these by name; (service, value) is distinct before the lists."""
    one = findings.select("service", "type", "value").distinct()
    return one.groupBy("type", "value").agg(F.count("service").alias("n"), F.array_sort(F.collect_list("service")).alias("services")).filter("n > 1")


def linked(findings: DataFrame) -> DataFrame:
    """(type, value, hub, service): each sharing service linked to the first of its value, so a value of n services has n - 1 links."""
    one = findings.select("service", "type", "value").distinct()
    hub = one.groupBy("type", "value").agg(F.min("service").alias("hub"))
    return one.join(hub, ["type", "value"]).filter("service <> hub").select("type", "value", "hub", "service")
