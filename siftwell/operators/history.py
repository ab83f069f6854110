"""Scan history and comparison, for every service at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.sources.captures import latest_by

from .findings import by_severity, risk_score

KEY = ["service", "type", "value", "location"]


def services(scans: DataFrame) -> DataFrame:
    return scans.select("service").distinct()


def latest(scans: DataFrame) -> DataFrame:
    return latest_by(scans, ["service"], [F.desc("scanned_at"), F.desc("scan_id")])


def with_previous(scans: DataFrame) -> DataFrame:
    """Each scan with the one before it."""
    w = Window.partitionBy("service").orderBy("scanned_at", "scan_id")
    return scans.withColumn("previous_id", F.lag("scan_id").over(w)).withColumn("age", F.row_number().over(Window.partitionBy("service").orderBy(F.desc("scanned_at"), F.desc("scan_id"))))


def since(scans: DataFrame, date: str) -> DataFrame:
    """(service, scan_id, baseline_id): the latest scan against the oldest other one on or after date."""
    now = latest(scans).select("service", "scan_id")
    rest = scans.withColumnRenamed("scan_id", "baseline_id").filter(F.col("scanned_at") >= F.lit(date).cast("timestamp")).join(now, "service").filter(F.col("baseline_id") != F.col("scan_id"))
    return rest.groupBy("service", "scan_id").agg(F.min_by("baseline_id", F.struct("scanned_at", "baseline_id")).alias("baseline_id"))


def baseline_by_id(scans: DataFrame, asked: DataFrame) -> DataFrame:
    """(service, scan_id, baseline_id, state) for asked (service, baseline_id): the latest scan against a given one, which must be of the same service."""
    now = latest(scans).select("service", "scan_id")
    known = scans.select(F.col("scan_id").alias("baseline_id"), F.col("service").alias("owner")).distinct()
    each = asked.join(known, "baseline_id", "left").groupBy("service", "baseline_id").agg(F.count("owner").alias("n"), F.bool_or(F.col("owner") == F.col("service")).alias("own"))
    state = F.when(F.col("n") == 0, "not found").when(F.col("own"), "ok").otherwise("other service")
    return each.join(now, "service", "left").select("service", "scan_id", "baseline_id", state.alias("state"))


def metadata(scans: DataFrame, findings: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs (service, scan_id, baseline_id): date, total and five counts of both scans, under current_ and previous_."""
    counts = by_severity(findings, ["service", "scan_id"]).drop("has_critical", "has_high")
    names = ["critical_count", "high_count", "medium_count", "low_count", "info_count", "total"]
    each = scans.select("service", "scan_id", "scanned_at").join(counts, ["service", "scan_id"], "left").select("service", "scan_id", "scanned_at", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])
    side = lambda prefix, key: each.select("service", F.col("scan_id").alias(key), *[F.col(n).alias(f"{prefix}_{n}") for n in ("scanned_at", *names)])
    return pairs.join(side("current", "scan_id"), ["service", "scan_id"]).join(side("previous", "baseline_id"), ["service", "baseline_id"])


def compared(before: DataFrame, after: DataFrame) -> DataFrame:
    """(KEY, state): new, resolved or unchanged, from one full outer join of the distinct keys."""
    a = after.select(*KEY).distinct().withColumn("now", F.lit(True))
    b = before.select(*KEY).distinct().withColumn("then", F.lit(True))
    state = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "resolved").otherwise("unchanged")
    return a.join(b, KEY, "full").select(*KEY, state.alias("state"))


def delta_text(delta: Column) -> Column:
    return F.when(delta > 0, F.concat(F.lit("+"), delta)).otherwise(delta.cast("string"))


def risk_change(before: DataFrame, after: DataFrame) -> DataFrame:
    """Counts before and after, deltas with their signs, and the direction by weighted score."""
    b, a = by_severity(before, ["service"]), by_severity(after, ["service"])
    names = ["critical_count", "high_count", "medium_count", "low_count", "info_count"]
    both = a.select("service", *[F.col(n).alias(f"a_{n}") for n in names]).join(b.select("service", *[F.col(n).alias(f"b_{n}") for n in names]), "service", "full")
    delta = {n: F.coalesce(f"a_{n}", F.lit(0)) - F.coalesce(f"b_{n}", F.lit(0)) for n in names}
    now, then = risk_score("a_"), risk_score("b_")
    direction = F.when(now < then, "IMPROVED (risk decreased)").when(now > then, "WORSENED (risk increased)").otherwise("UNCHANGED")
    return both.select("service", *[delta_text(d).alias(n.replace("_count", "_delta")) for n, d in delta.items()], direction.alias("direction"))


def as_of_baselines(scans: DataFrame, asked: DataFrame, part: str = "MONTH") -> DataFrame:
    """asked (service, since, and what else it has) with baseline_id and baseline_at: the service's first scan at since or later; null without one.

    Scans and requests are put into one line by time, and a running value carries each scan back to the requests before it.
    Lines are cut by service and calendar part, so a hot service is no single group; a request without a scan in its own
    part takes the first scan of the next one that has any, from a table of a row per service and part.
    """
    one = F.struct(F.col("scanned_at").alias("at"), F.col("scan_id").alias("id"))
    marks = scans.select("service", F.date_trunc(part, "scanned_at").alias("part"), F.col("scanned_at").alias("at"), one.alias("scan"), F.lit(None).cast(asked.select(F.struct("*")).schema[0].dataType).alias("ask"))
    asks = asked.select("service", F.date_trunc(part, "since").alias("part"), F.col("since").alias("at"), F.lit(None).cast("struct<at:timestamp,id:bigint>").alias("scan"), F.struct(*[F.col(c) for c in asked.columns]).alias("ask"))
    line = marks.select("service", "part", "at", F.col("scan").cast("struct<at:timestamp,id:bigint>").alias("scan"), "ask").unionByName(asks)
    back = Window.partitionBy("service", "part").orderBy(F.desc("at"), F.col("scan").isNull(), F.desc("scan")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = line.withColumn("first", F.last("scan", ignorenulls=True).over(back)).filter("ask IS NOT NULL")
    firsts = line.groupBy("service", "part").agg(F.min("scan").alias("scan"))
    later = Window.partitionBy("service").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    after = firsts.select("service", "part", F.last("scan", ignorenulls=True).over(later).alias("next"))
    joined = found.join(after, ["service", "part"], "left").withColumn("got", F.coalesce("first", "next"))
    return joined.select("ask.*", F.col("got.id").alias("baseline_id"), F.col("got.at").alias("baseline_at"))


def every_baseline(scans: DataFrame, since: Column) -> DataFrame:
    """(service, scan_id, since, baseline_id, baseline_at): for every scan its service's oldest earlier scan at since or later; since is an expression over scans."""
    asked = scans.select("service", "scan_id", F.col("scanned_at").cast("timestamp").alias("scanned_at"), since.cast("timestamp").alias("since"))
    got = as_of_baselines(scans.select("service", "scan_id", F.col("scanned_at").cast("timestamp").alias("scanned_at")), asked)
    earlier = F.struct(F.col("baseline_at").alias("at"), F.col("baseline_id").alias("id")) < F.struct(F.col("scanned_at").alias("at"), F.col("scan_id").alias("id"))
    return got.select("service", "scan_id", "since", F.when(earlier, F.col("baseline_id")).alias("baseline_id"), F.when(earlier, F.col("baseline_at")).alias("baseline_at"))
