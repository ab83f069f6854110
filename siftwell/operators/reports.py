"""The tables behind reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.rules import SEVERITIES


def summary(findings: DataFrame) -> DataFrame:
    """(severity_text, n): a row per severity that occurs and the total."""
    names = F.array(*map(F.lit, SEVERITIES))
    return findings.rollup("severity").agg(F.count("*").alias("n")).select(F.coalesce(F.get(names, F.col("severity")), F.lit("TOTAL")).alias("severity_text"), "n")


def cell(value: Column, most: int) -> Column:
    value = F.coalesce(F.nullif(value, F.lit("")), F.lit("-"))
    return F.when(F.length(value) > most, F.concat(F.left(value, F.lit(most - 3)), F.lit("..."))).otherwise(value)


def rows(findings: DataFrame) -> DataFrame:
    """(service, severity, title, value, location, recommendation), as a report shows them: worst first within a service, then as they were found.

    The order is a sort by ranges over the whole table, so a hot service is spread over tasks.
    """
    shown = findings.select("service", "severity", "seq", cell(F.col("title"), 60).alias("title"), cell(F.col("value"), 50).alias("value"), cell(F.col("location"), 40).alias("location"), cell(F.col("recommendation"), 60).alias("recommendation"))
    return shown.orderBy("service", F.desc("severity"), "seq", "title", "value").drop("seq")


def alert() -> Column:
    """Over the columns of by_severity."""
    return F.when(F.col("critical_count") > 0, "caution").when(F.col("high_count") > 0, "warning").when(F.col("medium_count") > 0, "important").when(F.col("total") > 0, "note").otherwise("tip")


def status(timed_out: Column, error: Column) -> Column:
    return F.when(timed_out, "timed out").when(F.coalesce(error, F.lit("")) != "", F.concat(F.lit("error: "), error)).otherwise("complete")
