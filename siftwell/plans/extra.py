"""Queries over files, presence, crawl statistics, the whole audit, reports on disk and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from siftwell.functions.folders import shared_folder
from siftwell.functions import rules as R
from siftwell.operators import detect, extract, files, urls
from siftwell.sources import captures
from siftwell.streaming import feed

from . import seeds
from .catalog import FOUND_SQL, KEEP, LINKS_SQL, PLAIN, PLAIN_TAGS, SHOWN, TAGS, P, emails_sql, family_sql, found, pages, plain, query
from .seeds import quoted

_TAGS = [*files.TAGS, ("ColorSpace", None, 0)]
_tag_names = [t for t, _, _ in _TAGS]


@query(PLAIN + f"SELECT service, m.type, m.severity, tag || ': v' || page_id AS value, url || ' -> /img/' || page_id AS location FROM (SELECT *, {seeds.sql_pick(_tag_names)} AS tag FROM p) JOIN (VALUES {', '.join(f'({quoted(t)}, {quoted(k)}, {s})' for t, k, s in _TAGS if k)}) AS m(tag, type, severity) USING (tag)")
def image_tag_findings(spark, d):
    tag = seeds.pick([F.lit(t) for t in _tag_names], "page_id")
    tags = plain(spark, d).select("service", F.concat(F.lit("/img/"), F.col("page_id")).alias("image_url"), F.col("url").alias("page_url"), tag.alias("tag"), F.concat(F.lit("v"), F.col("page_id")).alias("value"))
    return files.image_tags(tags)


_zone = quoted("D:2024+09'00'")


@query(f"SELECT doc_id, 'pdf_author' AS type, 3 AS severity, 'Jane ' || doc_id AS value FROM documents WHERE doc_id % 4 = 0 UNION ALL SELECT doc_id, 'pdf_author', 3, 'ABCD' FROM documents WHERE doc_id % 4 = 1 UNION ALL SELECT doc_id, 'pdf_timezone', 2, {_zone} FROM documents WHERE doc_id % 4 = 2 UNION ALL SELECT doc_id, 'pdf_creator', 2, 'Tool ' || source FROM documents WHERE doc_id % 4 = 2")
def document_metadata(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    body = [F.concat(F.lit("%PDF /Author ("), F.lit("Jane "), F.col("doc_id"), F.lit(")")), F.lit("/Author <FEFF0041004200430044>"), F.concat(F.lit("/CreationDate (D:2024+09'00') xmp:CreatorTool>Tool "), F.col("source"), F.lit("<")), F.lit("/Author (ab)")]
    held = docs.select(F.col("doc_id").alias("path"), seeds.pick(body, "doc_id").alias("body"))
    return files.document_metadata(held).select(F.col("path").alias("doc_id"), "type", "severity", "value")


@query(P + r"SELECT page_id, 'form_detected' AS type FROM p WHERE regexp_matches(html, '(?i)<form[\s>]') UNION ALL SELECT page_id, 'google_fonts' FROM p WHERE regexp_matches(html, '(?i)fonts\.(?:googleapis|gstatic)\.com') UNION ALL SELECT page_id, 'websocket_external' FROM p WHERE regexp_matches(html, '(?i)wss?://') UNION ALL SELECT page_id, 'robots_txt' FROM p WHERE regexp_matches(url, '(?i)/robots\.txt')")
def page_presence(spark, d):
    return detect.presence(pages(spark, d)).select("page_id", "type")


@query(P + f"SELECT page_id, kind, octet_length(from_base64(b)) AS bytes, sha256(from_base64(b)) AS sha256 FROM (SELECT page_id, regexp_extract(x, {quoted(extract.DATA_IMAGE)}, 1) AS kind, regexp_extract(x, {quoted(extract.DATA_IMAGE)}, 2) AS b FROM (SELECT page_id, unnest(regexp_extract_all(html, {quoted(extract.DATA_IMAGE)})) AS x FROM p))")
def inline_images(spark, d):
    return extract.inline_images(pages(spark, d))


@query(TAGS + f"SELECT DISTINCT page_id, regexp_extract(url, '^[A-Za-z]+://[^/?#]*') || x AS target FROM (SELECT page_id, url, unnest(regexp_extract_all(html, {quoted(extract.PDF)}, 1)) AS x FROM p)")
def pdf_links(spark, d):
    return extract.pdf_links(pages(spark, d))


@query(PLAIN + "SELECT service, canon, min(page_id) AS page_id FROM (SELECT service, page_id, regexp_replace(url, '#.*', '') AS canon FROM p) GROUP BY ALL")
def first_visits(spark, d):
    return urls.first_visits(plain(spark, d)).select("service", "canon", "page_id")


@query(PLAIN_TAGS + f", t AS ({LINKS_SQL}) SELECT service, pages, urls_seen FROM (SELECT service, count(*) AS pages FROM p GROUP BY service) JOIN (SELECT service, count(DISTINCT regexp_replace(u, '#.*', '')) AS urls_seen FROM (SELECT service, url AS u FROM p UNION ALL SELECT service, target FROM t WHERE target IS NOT NULL) GROUP BY service) USING (service)")
def crawl_stats(spark, d):
    p = plain(spark, d)
    return urls.crawl_stats(p, extract.links(p).select("service", F.col("target").alias("dst")))


@query("SELECT DISTINCT source AS site, CASE WHEN source IN ('src1', 'src2') THEN 'id=' || source ELSE 'base=1' END AS cookie, CASE WHEN source = 'src2' THEN 7 ELSE 100 END AS depth, CASE WHEN source = 'src1' THEN 'mine' ELSE 'agent' END AS agent FROM documents WHERE source IS NOT NULL")
def site_overlay(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("source IS NOT NULL").select(F.col("source").alias("site")).distinct()
    own = docs.select("site", F.when(F.col("site").isin("src1", "src2"), F.concat(F.lit("id="), "site")).alias("cookie"), F.when(F.col("site") == "src2", 7).alias("depth"), F.when(F.col("site") == "src1", F.create_map(F.lit("user-agent"), F.lit("mine"))).alias("headers"), F.lit(None).cast("array<string>").alias("ignore"), F.lit(None).cast("array<string>").alias("follow"))
    done = urls.with_defaults(own, {"cookie": "base=1", "depth": 100, "headers": {"user-agent": "agent"}})
    return done.select("site", "cookie", "depth", F.col("headers")["user-agent"].alias("agent"))


_PLAIN_FAMILIES = ("keys", "apileak", "cloud", "analytics", "social", "fingerprint", "malicious")
_each = " UNION ALL ".join(f"SELECT DISTINCT page_id, type, value FROM ({family_sql(R.BY_FAMILY[f], SHOWN.get(f, lambda r: 'hit'), KEEP.get(f, lambda r: 'true'))})" for f in _PLAIN_FAMILIES)


@query(P + f"SELECT type, count(*) AS n FROM ({_each} UNION ALL SELECT page_id, 'email' AS type, value FROM ({emails_sql('p')})) GROUP BY type")
def audit_counts(spark, d):
    """All pattern families in one scan."""
    rules = [r for f in (*_PLAIN_FAMILIES, "email") for r in R.BY_FAMILY[f]]
    return detect.detect(pages(spark, d), rules).select("page_id", "type", "value").distinct().groupBy("type").agg(F.count("*").alias("n"))


@query(P + r"SELECT page_id, a AS address, CASE WHEN regexp_matches(a, '^[a-z2-7]{54}[aiqy]d\.onion$') THEN 'v3' WHEN length(a) = 22 THEN 'v2' ELSE 'invalid' END AS class FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(lower(html), '[a-z2-7]{16,56}\.onion'))) AS a FROM p)")
def address_classes(spark, d):
    each = extract.onion_addresses(pages(spark, d))
    return each.select("page_id", urls.normal_address(F.upper("address")).alias("address"), urls.address_class(F.col("address")).alias("class"))


def _scratch(spark) -> str:
    return f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}"


@query(P + emails_sql("p"))
def stream_findings(spark, d):
    """The e-mail detector over a stream of the pages table, drained; the SQL is the batch query's."""
    folder = _scratch(spark)
    schema = spark.read.parquet(f"{d}/pages.parquet").schema
    stream = feed.captures(spark, f"{d}/pages.parque[t]", schema).withColumn("service", captures.host(F.col("url")))
    feed.findings_to(stream, lambda b: detect.emails(seeds.seeded(b)), f"{folder}/out", f"{folder}/log").awaitTermination()
    return spark.read.parquet(f"{folder}/out").select("page_id", "service", "url", "value", "severity")


@query("SELECT DISTINCT user_id, event_type FROM events")
def stream_recency(spark, d):
    """Each key once over the whole feed: the window spans all of the table's month."""
    folder = _scratch(spark)
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    once = feed.recent_once(feed.captures(spark, f"{d}/events.parque[t]", schema), "ts", ["user_id", "event_type"], "40 days").select("user_id", "event_type")
    once.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query(f"SELECT service, count(*) AS n, max(severity) AS worst FROM ({FOUND_SQL}) GROUP BY service")
def report_json_round_trip(spark, d):
    """Findings as nested JSON reports, written and read back."""
    folder = _scratch(spark)
    one = found(spark, d).select("service", F.lit(1).alias("scan_id"), F.lit("2025-01-01").cast("timestamp").alias("scanned_at"), "type", "severity", "title", "value", "location")
    captures.write_report_json(captures.reports(one), folder)
    return captures.read_reports(spark, folder)[1].groupBy("service").agg(F.count("*").alias("n"), F.max("severity").alias("worst"))

