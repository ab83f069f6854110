"""Sources and sinks of captured pages: load, normalise, crawl log, scan reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SNAPSHOT_BYTES = 512 * 1024
RAW_BYTES = 5 * 1024 * 1024

REPORT = "service string, scan_id long, part int, scanned_at timestamp, findings array<struct<type:string,severity:int,title:string,value:string,location:string>>"


def host(url: Column) -> Column:
    """Lower-case host without port; null for relative and malformed URLs."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def load_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page captures with service (the URL's host) and seq (capture order)."""
    pages = spark.read.parquet(path)
    return pages.withColumn("service", host(F.col("url"))).withColumn("seq", F.col("page_id"))


def normalize_pages(pages: DataFrame) -> DataFrame:
    """Content hash, bounded snapshot, and what the content type says."""
    raw = F.substring(F.encode("html", "utf-8"), 1, RAW_BYTES)
    kind = F.lower(F.coalesce("content_type", F.lit(""))) if "content_type" in pages.columns else F.lit("text/html")
    return (
        pages.withColumn("raw_hash", F.when(F.coalesce(F.octet_length("html"), F.lit(0)) == 0, "").otherwise(F.sha2(raw, 256)))
        .withColumn("snapshot", F.when(F.octet_length("html") <= SNAPSHOT_BYTES, F.col("html")).otherwise(F.left("html", F.lit(SNAPSHOT_BYTES))))
        .withColumn("is_html", kind.startswith("text/html") | kind.startswith("application/xhtml"))
        .withColumn("is_image", kind.startswith("image/"))
    )


def upsert_crawls(old: DataFrame, new: DataFrame, ts: str = "ts", tie: str | None = None) -> DataFrame:
    """The latest row of each (url, service); of equal times the largest tie."""
    both = old.unionByName(new)
    newest = both.groupBy("url", "service").agg(F.max_by(F.struct(*both.columns), F.struct(ts, tie) if tie else F.col(ts)).alias("row"))
    return newest.select("row.*")


def crawl_at(crawls: DataFrame, url: str, service: str) -> DataFrame:
    return crawls.filter((F.col("service") == service) & (F.col("url") == url))


def recent(crawls: DataFrame, as_of: Column, window: str) -> DataFrame:
    """Crawls within window (an interval) before as_of."""
    return crawls.filter(F.col("ts") > as_of - F.expr(f"INTERVAL {window}"))


def to_fetch(wanted: DataFrame, crawls: DataFrame, as_of: Column, window: str) -> DataFrame:
    """Of wanted (url, service) those without a recent crawl."""
    return wanted.join(recent(crawls, as_of, window), ["url", "service"], "left_anti")


def load_targets(lines: DataFrame, column: str = "value") -> DataFrame:
    from siftwell.operators.urls import normal_address

    return lines.filter(F.trim(column) != "").select(normal_address(F.col(column)).alias("service")).distinct()


def risk_summary(findings: DataFrame) -> DataFrame:
    """(service, scan_id, risk): counts by severity name as JSON."""
    from siftwell.functions.rules import SEVERITIES

    names = F.array(*map(F.lit, SEVERITIES))
    counts = findings.groupBy("service", "scan_id", "severity").agg(F.count("*").cast("int").alias("n"))
    pairs = F.array_sort(F.collect_list(F.struct(F.get(names, F.col("severity")).alias("key"), F.col("n").alias("value"))))
    return counts.groupBy("service", "scan_id").agg(F.to_json(F.map_from_entries(pairs)).alias("risk"))


def write_scan(findings: DataFrame, path: str) -> None:
    """Findings of whole scans as Parquet, one folder per scan; a service's rows stay together, those of a hot one in several files. A repeated write replaces its scans."""
    findings.hint("rebalance", "scan_id", "service").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("scan_id").parquet(path)


#: Findings in one part of a report.
REPORT_ROWS = 10_000


def reports(findings: DataFrame, rows: int = REPORT_ROWS) -> DataFrame:
    """Nested reports (service, scan_id, part, scanned_at, findings): one per (service, scan), and where it has over rows findings several parts of about so many, numbered from 0."""
    one = F.struct("type", F.col("severity").cast("int").alias("severity"), "title", "value", "location")
    sizes = findings.groupBy("service", "scan_id").agg(F.count("*").alias("n"))
    large = sizes.filter(F.col("n") > rows).select("service", "scan_id", F.ceil(F.col("n") / rows).cast("int").alias("parts"))
    each = findings.join(large, ["service", "scan_id"], "left")
    part = F.pmod(F.xxhash64("type", "value", "location"), F.coalesce("parts", F.lit(1))).cast("int")
    return each.groupBy("service", "scan_id", part.alias("part")).agg(F.max("scanned_at").alias("scanned_at"), F.array_sort(F.collect_list(one)).alias("findings"))


def write_report_json(report: DataFrame, path: str, version: str | None = None) -> None:
    out = report if version is None else report.select(F.lit(version).alias("version"), F.struct(*report.columns).alias("report"))
    out.write.mode("overwrite").json(path)


def read_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(scans, findings) from report lines, plain or wrapped with a version; malformed lines are left out. A scan in several parts is one scan."""
    lines = spark.read.text(path)
    bare = F.coalesce(F.get_json_object("value", "$.report"), F.col("value"))
    parsed = lines.select(F.get_json_object("value", "$.version").alias("version"), F.from_json(bare, REPORT + ", _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("version", "r.*")
    good = parsed.filter("_corrupt_record IS NULL AND service IS NOT NULL").drop("_corrupt_record")
    scans = good.groupBy("service", "scan_id").agg(F.max("scanned_at").alias("scanned_at"), F.max("version").alias("version"))
    return scans, good.select("service", "scan_id", "scanned_at", F.inline("findings"))


def write_all(frame: DataFrame, sinks: list) -> None:
    """One computation, several sinks (callables that take the frame)."""
    frame.persist()
    try:
        for sink in sinks:
            sink(frame)
    finally:
        frame.unpersist()


def load_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, body): binary files as Latin-1 text, in which metadata patterns are found."""
    return spark.read.format("binaryFile").load(path).select("path", F.decode("content", "ISO-8859-1").alias("body"))


def latest_by(frame: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return frame.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
