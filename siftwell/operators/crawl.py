"""Crawling by captured pages: first-in-first-out search within a page budget, and marks of the same service and origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.folders import checkpointed
from siftwell.sources.captures import host

#: Rows of a frontier that are broadcast once they are counted.
SMALL_ROWS = 100_000


def same_service(base: Column, url: Column) -> Column:
    """Whether a URL's host and port are those of base, whatever their case; false without a host."""
    place = lambda x: F.lower(F.try_parse_url(x, F.lit("AUTHORITY")))
    return F.coalesce(place(base) == place(url), F.lit(False))


def may_fetch(resource: Column, service: Column, other_services: bool = False) -> Column:
    """Whether a resource comes from the service itself; with other_services also from other hidden services. Never from clearnet hosts."""
    h = host(resource)
    own = h == F.lower(service)
    return F.coalesce(own | h.endswith(".onion") if other_services else own, F.lit(False))


def _broadcast_if_small(frame: DataFrame) -> DataFrame:
    return F.broadcast(frame) if frame.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS else frame


def search(links: DataFrame, seeds: DataFrame, max_depth: int = 5, budget: int = 100, captured: DataFrame | None = None) -> DataFrame:
    """(service, node, depth, n): the first budget pages of each service that a queue starting with its seeds would fetch, numbered from 1.

    links (service, src, pos, dst): pos is a link's place in its page. seeds (service, node, pos). captured (service, node): the
    pages that answer; others take no budget and lead nowhere.

    A level is one join of the links with the last level's pages alone, and these are at most what the budget left: a level's
    pages are ranked in the order of the queue (by their first parent, then its link) and cut at the service's rest of the budget. So no level, and
    no frontier, is larger than budget pages a service, and services without a rest take no part any more. The constant cut at
    the budget is made before the shuffle as well. Levels are checkpointed in the shared folder.
    """
    in_queue = Window.partitionBy("service").orderBy("by", "place", "node")

    def cut(found: DataFrame, taken: DataFrame | None) -> DataFrame:
        """Of found (service, node, by, place) what is new and fits, with n."""
        first = found.groupBy("service", "node").agg(F.min(F.struct("by", "place")).alias("at")).select("service", "node", "at.*")
        first = first.join(captured.select("service", "node").distinct(), ["service", "node"], "left_semi") if captured is not None else first
        if taken is not None:
            first = first.join(taken.select("service", "node"), ["service", "node"], "left_anti")
        ranked = first.withColumn("n", F.row_number().over(in_queue)).filter(F.col("n") <= budget)
        if taken is None:
            return ranked.select("service", "node", "n")
        used = taken.groupBy("service").agg(F.max("n").alias("used"))
        return ranked.join(_broadcast_if_small(used), "service").filter(F.col("n") + F.col("used") <= budget).select("service", "node", (F.col("n") + F.col("used")).cast("int").alias("n"))

    visited = checkpointed(cut(seeds.select("service", "node", F.lit(0).alias("by"), F.col("pos").alias("place")), None).withColumn("depth", F.lit(0)))
    frontier = visited
    for depth in range(1, max_depth + 1):
        open_ = visited.groupBy("service").agg(F.max("n").alias("used")).filter(F.col("used") < budget).select("service")
        last = _broadcast_if_small(frontier.join(open_, "service", "left_semi").select("service", F.col("node").alias("src"), F.col("n").alias("by")))
        step = links.join(last, ["service", "src"]).select("service", F.col("dst").alias("node"), "by", F.col("pos").alias("place"))
        frontier = checkpointed(cut(step, visited).withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)  # levels that are stored already
    return visited.select("service", "node", "depth", "n")
