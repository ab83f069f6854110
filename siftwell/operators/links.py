"""Findings from links, scripts, images and forms that lead outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.patterns import find_all
from siftwell.functions.rules import HIGH, MEDIUM
from siftwell.sources.captures import host

from . import extract
from .markup import tags_only
from .urls import resolve

# Fixed values.
SOCIAL_DOMAINS = ["twitter.com", "x.com", "facebook.com", "instagram.com", "linkedin.com", "github.com", "reddit.com", "youtube.com"]
# End of the fixed values.

HITS = "array<struct<type:string,severity:int,value:string,key:string,pos:int>>"


def _outside(target: Column, service: Column) -> Column:
    h = host(target)
    return h.isNotNull() & ~h.endswith(".onion") & (h != service)


def _level(h: Column) -> Column:
    return F.when(F.exists(F.array(*map(F.lit, SOCIAL_DOMAINS)), lambda name: h.contains(name)), HIGH).otherwise(MEDIUM)


def outside_hits(html: Column, url: Column, service: Column) -> Column:
    """A page's links, scripts and images that lead outside and forms that post there: array of (type, severity, value, key, pos); of equal keys of a service the first counts."""

    def found(type_: str, sources: Column) -> Column:
        placed = F.transform(sources, lambda x, i: F.struct(x.alias("x"), i.alias("i"), host(x).alias("h")))
        out = F.filter(placed, lambda e: F.coalesce(e["h"].isNotNull() & ~e["h"].endswith(".onion") & (e["h"] != service), F.lit(False)))
        one = lambda e: F.struct(F.lit(type_).alias("type"), (_level(e["h"]) if type_ == "clearnet_link" else F.lit(HIGH)).cast("int").alias("severity"), (e["h"] if type_ == "clearnet_link" else e["x"]).alias("value"), e["h"].alias("key"), e["i"].alias("pos"))
        return F.transform(out, one)

    def of(tags: Column) -> Column:
        targets = F.transform(find_all(tags, extract.A_HREF, 1), lambda x: resolve(url, x))
        actions = F.transform(find_all(tags, extract.FORM), lambda x: F.coalesce(extract.attribute(F.regexp_extract(x, r"(?i)^<form[^>]*>", 0), "action"), F.lit("")))
        leaks = F.filter(actions, lambda x: F.lower(x).rlike("^https?://") & ~F.lower(x).contains(".onion"))
        posted = F.transform(leaks, lambda x, i: F.struct(F.lit("form_action_leak").alias("type"), F.lit(HIGH).alias("severity"), x.alias("value"), x.alias("key"), i.alias("pos")))
        return F.concat(found("clearnet_link", targets), found("external_script", find_all(tags, extract.SCRIPT_SRC, 1)), found("external_image", F.array_union(find_all(tags, extract.IMG_SRC, 1), find_all(tags, extract.ICON, 1))), posted)

    return F.flatten(F.transform(F.array(tags_only(html)), of))


def clearnet_links(pages: DataFrame) -> DataFrame:
    """(service, value, severity, page_id): each outside host of a service once, at its first page."""
    each = extract.links(pages).filter(_outside(F.col("target"), F.col("service"))).withColumn("value", host(F.col("target")))
    return each.groupBy("service", "value").agg(F.min("page_id").alias("page_id")).withColumn("severity", _level(F.col("value")))


def outer_elements(pages: DataFrame) -> DataFrame:
    """(service, type, value, page_id): scripts and images from outside, one per host."""
    found = None
    for kind, frame in (("external_script", extract.scripts(pages)), ("external_image", extract.images(pages))):
        each = frame.filter(_outside(F.col("src"), F.col("service")))
        best = each.groupBy("service", host(F.col("src")).alias("h")).agg(F.min_by(F.struct(F.col("src").alias("value"), "page_id"), F.struct("page_id", "pos")).alias("r"))
        one = best.select("service", F.lit(kind).alias("type"), "r.value", "r.page_id")
        found = one if found is None else found.unionByName(one)
    return found


def form_leaks(pages: DataFrame) -> DataFrame:
    low = F.lower("action")
    return extract.forms(pages).filter((low.startswith("http://") | low.startswith("https://")) & ~low.contains(".onion")).select("page_id", "service", "url", F.lit("form_action_leak").alias("type"), F.lit(HIGH).alias("severity"), F.col("action").alias("value"))


def related_domains(pages: DataFrame) -> DataFrame:
    """(service, domain): the outside domains of each service, a row each."""
    return clearnet_links(pages).select("service", F.col("value").alias("domain"))
