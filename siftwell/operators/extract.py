"""What captured markup holds: links, scripts, images, forms, metadata, comments, addresses. One row per element.

Tags are those that a reader of the page meets (markup.py): none of comments, scripts and other raw elements.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.patterns import find_all, find_first
from siftwell.functions.rules import EMAIL

from .markup import comments_only, tags_only
from .urls import link_class, resolve

A_HREF = r"""(?i)<a\s[^>]*?href\s*=\s*["']([^"']*)["']"""
SCRIPT_SRC = r"""(?i)<script\s[^>]*?src\s*=\s*["']([^"']*)["']"""
IMG_SRC = r"""(?i)<img\s[^>]*?src\s*=\s*["']([^"']*)["']"""
ICON = r"""(?i)<link\s[^>]*?rel\s*=\s*["'](?:shortcut )?icon["'][^>]*?href\s*=\s*["']([^"']*)["']"""
COMMENT = r"(?s)<!--(.*?)-->"
TITLE = r"(?i)<title[^>]*>([^<]*)"
META = r"(?i)<meta\s[^>]*>"
FORM = r"(?is)<form[^>]*>.*?</form>"
FIELD = r"(?i)<(?:input|select|textarea)[^>]*>"
ONION = r"(?i)[a-z2-7]{16,56}\.onion"
PDF = r"""(?i)href\s*=\s*["']([^"']+\.pdf(?:\?[^"']*)?)["']"""
DATA_IMAGE = r"data:image/([a-z]+);base64,([A-Za-z0-9+/=]+)"


def attribute(tag: Column, name: str) -> Column:
    return find_first(tag, rf"""(?i)\s{name}\s*=\s*["']([^"']*)["']""", 1)


def _each(pages: DataFrame, found: Column, name: str) -> DataFrame:
    return pages.select("page_id", "service", "url", F.posexplode(found).alias("pos", name))


def links(pages: DataFrame) -> DataFrame:
    """(page_id, service, url, pos, href, target, class); targets that are no pages are left out."""
    each = _each(pages, find_all(tags_only(F.col("html")), A_HREF, 1), "href").withColumn("target", resolve(F.col("url"), F.col("href")))
    return each.filter("target IS NOT NULL").withColumn("class", link_class(F.col("target"), F.col("service")))


def scripts(pages: DataFrame) -> DataFrame:
    return _each(pages, find_all(tags_only(F.col("html")), SCRIPT_SRC, 1), "src")


def images(pages: DataFrame) -> DataFrame:
    return _each(pages, F.flatten(F.transform(F.array(tags_only(F.col("html"))), lambda m: F.array_union(find_all(m, IMG_SRC, 1), find_all(m, ICON, 1)))), "src")


def forms(pages: DataFrame) -> DataFrame:
    """(…, form, action, method)."""
    each = _each(pages, find_all(tags_only(F.col("html")), FORM), "form")
    tag = F.regexp_extract("form", r"(?i)^<form[^>]*>", 0)
    return each.select("page_id", "service", "url", "pos", "form", F.coalesce(attribute(tag, "action"), F.lit("")).alias("action"), F.upper(F.coalesce(attribute(tag, "method"), F.lit("GET"))).alias("method"))


def form_fields(pages: DataFrame) -> DataFrame:
    """Named fields of every form: (…, pos, field, name, type)."""
    each = forms(pages).select("page_id", "service", "url", "pos", F.posexplode(find_all(F.col("form"), FIELD)).alias("field", "tag"))
    kind = F.lower(F.regexp_extract("tag", r"(?i)^<([a-z]+)", 1))
    named = each.withColumn("name", attribute(F.col("tag"), "name")).filter(F.coalesce("name", F.lit("")) != "")
    return named.select("page_id", "service", "url", "pos", "field", "name", F.coalesce(F.when(kind == "input", attribute(F.col("tag"), "type")), F.when(kind == "input", F.lit("text")).otherwise(kind)).alias("type"))


def meta_tags(pages: DataFrame) -> DataFrame:
    """(page_id, name, content): by name, else property; the last of a name wins."""
    each = _each(pages, find_all(tags_only(F.col("html")), META), "tag")
    each = each.select("page_id", "pos", F.coalesce(attribute(F.col("tag"), "name"), attribute(F.col("tag"), "property")).alias("name"), F.coalesce(attribute(F.col("tag"), "content"), F.lit("")).alias("content"))
    return each.filter("name IS NOT NULL").groupBy("page_id", "name").agg(F.max_by("content", "pos").alias("content"))


def comments(pages: DataFrame) -> DataFrame:
    return _each(pages, find_all(comments_only(F.col("html")), COMMENT, 1), "comment")


def titles(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "service", "url", F.trim(F.coalesce(find_first(tags_only(F.col("html")), TITLE, 1), F.lit(""))).alias("title"))


def emails(pages: DataFrame) -> DataFrame:
    """(page_id, service, url, pos, email): each address of a page once, in lower case, in the order of the page."""
    return _each(pages, F.array_distinct(F.transform(find_all(F.col("html"), EMAIL), lambda x: F.lower(x))), "email")


def onion_addresses(pages: DataFrame) -> DataFrame:
    return _each(pages, F.array_distinct(F.transform(find_all(F.col("html"), ONION), lambda x: F.lower(x))), "address")


def pdf_links(pages: DataFrame) -> DataFrame:
    """(page_id, target): hrefs of PDF files and pages that are themselves one."""
    linked = _each(pages, find_all(tags_only(F.col("html")), PDF, 1), "href").select("page_id", resolve(F.col("url"), F.col("href")).alias("target"))
    own = pages.filter(F.col("url").rlike(r"(?i)\.pdf(?:\?.*)?$")).select("page_id", F.col("url").alias("target"))
    return linked.union(own).filter("target IS NOT NULL").distinct()


def inline_images(pages: DataFrame) -> DataFrame:
    """(page_id, kind, bytes, sha256) of images in data URLs."""
    each = _each(pages, find_all(F.col("html"), DATA_IMAGE), "data")
    body = F.try_to_binary(F.regexp_extract("data", DATA_IMAGE, 2), F.lit("base64"))
    return each.select("page_id", F.regexp_extract("data", DATA_IMAGE, 1).alias("kind"), F.octet_length(body).alias("bytes"), F.sha2(body, 256).alias("sha256")).filter("bytes IS NOT NULL")


def csp(policy: Column) -> Column:
    """Directives of a Content-Security-Policy as a map; the first of a name counts."""
    parts = F.filter(F.transform(F.split(policy, ";"), lambda x: F.trim(x)), lambda x: x != "")
    entries = F.transform(parts, lambda x: F.struct(F.lower(F.element_at(F.split(x, r"\s+"), 1)).alias("key"), F.slice(F.split(x, r"\s+"), 2, 1000).alias("value")))
    first = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, 1, i), lambda before: before["key"] == e["key"]))
    return F.map_from_entries(first)
