"""The whole audit of captured pages: content, headers, links out and presence in one scan, then one row per service and finding."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions import rules as R
from siftwell.functions.rules import INFO

from . import banners as B
from . import detect, headers, links

HITS = "array<struct<type:string,title:string,severity:int,value:string,key:string,pos:int>>"
TITLES = R.OTHER_TITLES | R.MARK_TITLES


def _title(kind: Column) -> Column:
    """The title of a type; of one without, the type."""
    return F.coalesce(F.from_json(F.lit(json.dumps(TITLES)), "map<string,string>")[kind], kind)


def page_findings(pages: DataFrame) -> DataFrame:
    """(page_id, service, type, title, severity, value, key, pos) of pages (page_id, service, url, html, headers), a row per hit; the text is read once."""
    content, names = detect.content_hits(), detect.presence_names()
    both = detect.Detector(lambda p: p, detect.distinct([*content.text_specs, *names.text_specs]), detect.distinct([*content.url_specs, *names.url_specs]))
    seen = lambda kind, title, level, value: F.struct(kind.alias("type"), title.alias("title"), level.alias("severity"), value.alias("value"), value.alias("key"), F.lit(0).alias("pos"))

    def of(p):
        found = F.transform(content.of(p), lambda h: seen(h["type"], h["title"], h["severity"], h["value"]))
        shown = F.transform(names.of(p), lambda name: seen(name, _title(name), F.lit(INFO), F.lit("")))
        outside = F.transform(F.coalesce(links.outside_hits(p["text"], p["url"], p["service"]), F.array().cast(links.HITS)), lambda h: F.struct(h["type"], _title(h["type"]).alias("title"), h["severity"], h["value"], h["key"], h["pos"]))
        return F.flatten(F.array(found, shown, outside))

    page = detect.one_page(pages.sparkSession, F.col("html"), both, [F.col("service")])
    checked = F.flatten(F.array(*[F.coalesce(h, F.array().cast(headers.HITS)) for h in headers.all_hits(pages)]))
    told = pages.select("page_id", "service", page.alias("page"), F.transform(checked, lambda h: seen(h["type"], _title(h["type"]), h["severity"], h["value"])).alias("checked"))
    return told.select("page_id", "service", F.inline(F.concat(detect.bound(F.col("page"), of), "checked")))


def audit_all(pages: DataFrame) -> DataFrame:
    """(service, type, severity, value, page_id): each finding of a service once, at its first page; outside elements once per host. Only small rows are shuffled."""
    each = page_findings(pages)
    first = F.min_by(F.struct("severity", "value", "page_id"), F.struct("page_id", "pos"))
    return each.groupBy("service", "type", "key").agg(first.alias("r")).select("service", "type", "r.*")


def report(pages: DataFrame, banners: DataFrame | None = None, certificates: DataFrame | None = None) -> DataFrame:
    """(service, title, value, type, severity, page_id, times): all that is found about a service in pages, banners and certificates, each title and value once; outside elements once per host.

    The worst severity stays, of equal ones the first page's finding (banners and certificates have no page and come after
    pages), then the first type. Values are small rows by then; each task merges its own before anything is shuffled.
    """
    columns = ["service", "title", "key", "value", "type", "severity", "page_id", "pos"]
    each = page_findings(pages).select(*columns)
    for frame, find in ((banners, B.banner_findings), (certificates, B.certificate_findings)):
        if frame is not None:
            each = each.unionByName(find(frame).select("service", _title(F.col("type")).alias("title"), F.col("value").alias("key"), "value", "type", "severity", F.lit(None).cast("long").alias("page_id"), F.lit(0).alias("pos")))
    order = F.struct(-F.col("severity"), F.col("page_id").isNull(), "page_id", "pos", "type")
    best = each.groupBy("service", "title", "key").agg(F.min_by(F.struct("value", "type", "severity", "page_id"), order).alias("r"), F.count("*").alias("times"))
    return best.select("service", "title", "r.*", "times")
