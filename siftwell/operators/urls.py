"""URL, address and scope operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.folders import checkpointed
from siftwell.sources.captures import host


def canonical(url: Column) -> Column:
    """Without fragment, scheme and host in lower case, an empty path as ``/``."""
    bare = F.regexp_replace(url, "#.*", "")
    head = F.regexp_extract(bare, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?]*)", 1)
    rest = F.substring(bare, F.length(head) + 1, F.length(bare))
    rest = F.when(rest == "", "/").when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.when(head == "", bare).otherwise(F.concat(F.lower(head), rest))


def resolve(base: Column, href: Column) -> Column:
    """href as an absolute URL on base; null for fragments and schemes that aren't pages."""
    href = F.trim(href)
    scheme, root = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*", ""), r"^([A-Za-z][A-Za-z0-9+.-]*://[^/]*)(/.*/|/)?[^/]*$", "$1$2")
    low = F.lower(href)
    drop = (href == "") | href.startswith("#") | low.rlike("^(javascript|mailto|tel|data):")
    page = F.regexp_replace(base, r"[?#].*", "")
    return (
        F.when(drop, None)
        .when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(scheme, href))
        .when(href.startswith("/"), F.concat(root, href))
        .when(href.startswith("?"), F.concat(page, href))
        .otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), href))
    )


def link_class(url: Column, service: Column) -> Column:
    h = host(url)
    return F.when(h == F.lower(service), "internal").when(h.endswith(".onion"), "hidden_service").otherwise("clearnet")


def normal_address(address: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(address)), r"^https?://", ""), r"[/?#].*", "")
    return F.when(bare.endswith(".onion"), bare).otherwise(F.concat(bare, F.lit(".onion")))


def address_class(address: Column) -> Column:
    """v3 (with its version byte checked), v2 or invalid."""
    name = F.regexp_replace(normal_address(address), r"\.onion$", "")
    return F.when(name.rlike(r"^[a-z2-7]{54}[aiqy]d$"), "v3").when(name.rlike(r"^[a-z2-7]{16}$"), "v2").otherwise("invalid")


def glob_regex(glob: str) -> str:
    """A scope glob as a pattern for URL paths: ``/x/*`` takes the folder and all below, ``*.ext`` any depth."""
    if glob.endswith("/*") and not set("*?[") & set(glob[:-2]):
        return f"^{re.escape(glob[:-2])}(?:/.*)?$"
    body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in glob)
    if glob.startswith("*.") and not set("*?[") & set(glob[2:]):
        return f"{re.escape(glob[1:])}$"
    if "*" in glob and "/" not in glob:
        return f"(?:^|/){body}$"
    return f"^{body}$"


def in_scope(urls: DataFrame, url_col: str, ignore: list[str], follow: list[str]) -> DataFrame:
    """Ignore beats follow; with follow globs only what one of them takes stays."""
    path = F.coalesce(F.nullif(F.try_parse_url(F.col(url_col), F.lit("PATH")), F.lit("")), F.lit("/"))
    out = urls
    if ignore:
        out = out.filter(~path.rlike("|".join(map(glob_regex, ignore))))
    if follow:
        out = out.filter(path.rlike("|".join(map(glob_regex, follow))))
    return out


def with_defaults(sites: DataFrame, defaults: dict) -> DataFrame:
    """Site configuration over defaults: cookie and depth by coalesce, headers merged (site wins), lists replaced."""
    site = F.coalesce("headers", F.create_map().cast("map<string,string>"))
    base = F.create_map(*[F.lit(x) for kv in defaults.get("headers", {}).items() for x in kv]).cast("map<string,string>")
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(site), k))
    lists = lambda c: F.when(F.size(F.coalesce(c, F.array().cast("array<string>"))) > 0, F.col(c)).otherwise(F.array(*map(F.lit, defaults.get(c, []))).cast("array<string>"))
    return sites.select("site", F.coalesce(F.nullif("cookie", F.lit("")), F.lit(defaults.get("cookie", ""))).alias("cookie"), F.coalesce(F.nullif("depth", F.lit(0)), F.lit(defaults.get("depth", 100))).alias("depth"), F.map_concat(kept, site).alias("headers"), lists("ignore").alias("ignore"), lists("follow").alias("follow"))


def first_visits(pages: DataFrame) -> DataFrame:
    """One row per (service, canonical URL): the first by seq."""
    canon = pages.withColumn("canon", canonical(F.col("url")))
    return canon.groupBy("service", "canon").agg(F.min_by(F.struct(*pages.columns), "seq").alias("row")).select("canon", "row.*")


def address_in_url(url: Column) -> Column:
    """The hidden-service address that ends in the first ``.onion`` of a URL; null if that is none."""
    found = F.nullif(F.regexp_extract(F.lower(url), r"([a-z2-7]*\.onion)", 1), F.lit(""))
    return F.when(address_class(found) != "invalid", found)


def breadth_first(links: DataFrame, seeds: DataFrame, max_depth: int = 5, budget: int = 100) -> DataFrame:
    """(service, node, depth) reached from seeds over links (service, src, dst), at most budget nodes a service.

    A level is one join of the frontier with the links, less what was visited; levels are checkpointed in the shared folder.
    """
    visited = checkpointed(seeds.select("service", "node").distinct().withColumn("depth", F.lit(0)))
    frontier = visited
    for depth in range(1, max_depth + 1):
        step = links.join(frontier.select("service", F.col("node").alias("src")), ["service", "src"])
        frontier = checkpointed(step.select("service", F.col("dst").alias("node")).distinct().join(visited, ["service", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)  # levels that are stored already
    w = Window.partitionBy("service").orderBy("depth", "node")
    return visited.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= budget).drop("_n")


def crawl_stats(pages: DataFrame, links: DataFrame) -> DataFrame:
    seen = pages.select("service", canonical(F.col("url")).alias("u")).union(links.select("service", canonical(F.col("dst")).alias("u")))
    return pages.groupBy("service").agg(F.count("*").alias("pages")).join(seen.groupBy("service").agg(F.countDistinct("u").alias("urls_seen")), "service")
