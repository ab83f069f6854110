"""Set operations on findings (service, scan_id, seq, type, title, severity, value, location)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import dims
from siftwell.functions.rules import INFO, SEVERITIES


def dedup_worst(findings: DataFrame, scope: list[str]) -> DataFrame:
    """One row per scope, title and value: the worst severity, of equal ones the first by seq, and how many pages hit."""
    keys = [*scope, "title", "value"]
    best = findings.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in findings.columns if c not in keys]), F.struct("severity", -F.col("seq"))).alias("row"), F.countDistinct("location").alias("pages_hit"))
    return best.select(*keys, "row.*", "pages_hit")


def dedup_key(findings: DataFrame, scope: list[str]) -> DataFrame:
    """One row per scope, type, value and location: the first by seq."""
    keys = [*scope, "type", "value", "location"]
    best = findings.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in findings.columns if c not in keys]), "seq").alias("row"))
    return best.select(*keys, "row.*")


def by_severity(findings: DataFrame, scope: list[str]) -> DataFrame:
    """Five counts and the total per scope, in one aggregation."""
    counts = [F.count_if(F.col("severity") == n).alias(f"{name.lower()}_count") for n, name in enumerate(SEVERITIES)]
    return findings.groupBy(*scope).agg(*counts, F.count("*").alias("total"), F.bool_or(F.col("severity") == 4).alias("has_critical"), F.bool_or(F.col("severity") >= 3).alias("has_high"))


def enriched(findings: DataFrame) -> DataFrame:
    """With severity text, impact and recommendation; the detector's own severity stands."""
    spark = findings.sparkSession
    told = findings.join(F.broadcast(dims.finding_types(spark)), "type", "left").join(F.broadcast(dims.severities(spark)), "severity", "left")
    return told.withColumn("impact", F.coalesce("impact", F.lit(dims.UNKNOWN[0]))).withColumn("recommendation", F.coalesce("recommendation", F.lit(dims.UNKNOWN[1]))).withColumn("map_severity", F.coalesce("map_severity", F.lit(0)))


def identifiers(findings: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, type, value): the distinct values of each type, a row each, so that none grows with a hot scope."""
    return findings.select(*scope, "type", "value").distinct()


def identifier_sets(findings: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, type, values, n): all distinct values of each type in order, and how many; they are made distinct before the lists are built."""
    return identifiers(findings, scope).groupBy(*scope, "type").agg(F.array_sort(F.collect_list("value")).alias("values"), F.count("value").alias("n"))


def identifier_counts(findings: DataFrame, scope: list[str]) -> DataFrame:
    """(scope, type, n): how many distinct values of each type."""
    return identifiers(findings, scope).groupBy(*scope, "type").agg(F.count("*").alias("n"))


def rolled_up(findings: DataFrame) -> DataFrame:
    """(service, type, title, severity, value): the distinct identifiers of each service as typed findings, with the type's own severity."""
    spark = findings.sparkSession
    names = spark.createDataFrame([(k, t, title) for k, (t, title) in dims.ROLLED_UP.items()], "from_type string, to_type string, to_title string")
    levels = dims.finding_types(spark).filter("type = map_type").select(F.col("type").alias("to_type"), "map_severity").distinct()
    each = findings.select("service", F.col("type").alias("from_type"), "value").distinct().join(F.broadcast(names.join(levels, "to_type", "left")), "from_type")
    return each.select("service", F.col("to_type").alias("type"), F.col("to_title").alias("title"), F.coalesce("map_severity", F.lit(INFO)).alias("severity"), "value").distinct()


def at_least(findings: DataFrame, severity: int) -> DataFrame:
    """Findings of a severity or a worse one."""
    return findings.filter(F.col("severity") >= severity)


def platform_of(names: DataFrame, column: str) -> DataFrame:
    """Canonical platform of free-form names; null if there is none."""
    return names.join(F.broadcast(dims.platforms(names.sparkSession)), F.lower(F.trim(column)) == F.col("alias"), "left").drop("alias")


def kind_of(names: DataFrame, column: str, family: str) -> DataFrame:
    """names with kind, severity, cloud and currency of a free-form name of one family (social, analytics, address); an unknown name has no kind and the family's own severity."""
    other = {"social": dims.UNKNOWN_SOCIAL, "analytics": dims.UNKNOWN_ANALYTICS, "address": dims.UNKNOWN_ADDRESS}[family]
    known = F.broadcast(dims.kinds(names.sparkSession).filter(F.col("family") == family).drop("family"))
    out = names.join(known, names[column] == known["name"], "left").drop("name") if column != "name" else names.join(known, "name", "left")
    return out.withColumn("severity", F.coalesce("severity", F.lit(other))).withColumn("cloud", F.coalesce("cloud", F.lit(True)) if family == "analytics" else F.col("cloud"))


def risk_score(row: str = "") -> Column:
    weights = {"critical_count": 100, "high_count": 50, "medium_count": 10, "low_count": 5, "info_count": 1}
    total = F.lit(0)
    for name, w in weights.items():
        total = total + F.coalesce(F.col(f"{row}{name}"), F.lit(0)) * w
    return total


def risk_text() -> Column:
    """``C:1 H:2`` or ``No findings``, from the five counts."""
    parts = [F.when(F.col(f"{n.lower()}_count") > 0, F.concat(F.lit(f"{n[0]}:"), F.col(f"{n.lower()}_count"))) for n in reversed(SEVERITIES)]
    text = F.array_join(F.array_compact(F.array(*parts)), " ")
    return F.when(F.col("total").isNull(), "N/A").when(text == "", "No findings").otherwise(text)
