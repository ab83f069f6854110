"""Best-fit packing with conflicts: documents of one source or duplicate cluster keep apart.

Rows are dealt to packs of about PACK_ROWS by the hash of id and text, so that packs are even whatever source or
cluster is hot; only lengths and hashes move, never texts. Rows that repeat id and text are counted where they lie and dealt
by COPIES copies, each under a hash of its own, so a row that makes up a third of the table is spread like any other. Within a pack, pieces go from long to short. Open bins are
held in order of the space they have left and carry two bitmaps: the sources of which they hold PER_SOURCE pieces and
the duplicate clusters they hold. For each piece the search starts at the tightest bin that has room and goes on
to the next one up until a bin's bitmaps allow it; else a bin is opened. Neighbouring bins stand in blocks, which hold
what all their bins' bitmaps have in common: a block that is closed to a source or a cluster as a whole is passed in one step.

Lengths are code points. A document longer than a bin is cut into full bins and a remainder, and all of it is packed.
Null or empty text has length zero and is placed like any other. A null source counts as one source. Repeated rows are
one cluster and so come to lie in different bins. Of pieces of one length the smaller id goes first (null last), then the
smaller text hash, then the smaller source hash. An empty table gives an empty result. Further columns of docs, whatever their names, are not read.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import ready, text_of

CAPACITY = 16_384
PER_SOURCE = 2
PACK_ROWS = 2_000
#: Copies of one row that are dealt together, and bins in a block.
COPIES, BLOCK = 128, 48


class OpenBins:
    """Open bins (space left, number) in order, in blocks that know the source and cluster bits that all their bins share."""

    def __init__(self) -> None:
        self.blocks: list[list[tuple[int, int]]] = [[]]
        self.lasts: list[tuple[int, int]] = []  # the last bin of each block but the last block's
        self.shared: list[tuple[int, int]] = [(-1, -1)]
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def _settle(self, at: int) -> None:
        sources = clusters = -1
        for _, number in self.blocks[at]:
            sources &= self.sources[number]
            clusters &= self.clusters[number]
        self.shared[at] = (sources, clusters)

    def put(self, left: int, number: int) -> None:
        at = bisect_left(self.lasts, (left, number))
        block = self.blocks[at]
        insort(block, (left, number))
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks[at : at + 1] = [block[:half], block[half:]]
            self.lasts.insert(at, block[half - 1])
            self.shared.insert(at, (-1, -1))
            self._settle(at + 1)
        self._settle(at)

    def take(self, length: int, source_bit: int, cluster_bit: int) -> tuple[int, int] | None:
        """The tightest bin with room for length that has neither bit, removed from the open ones; None without one."""
        first = bisect_left(self.lasts, (length, -1))
        for at in range(first, len(self.blocks)):
            sources, clusters = self.shared[at]
            block = self.blocks[at]
            if not block or sources & source_bit or clusters & cluster_bit:
                continue
            for i in range(bisect_left(block, (length, -1)) if at == first else 0, len(block)):
                number = block[i][1]
                if not (self.sources[number] & source_bit or self.clusters[number] & cluster_bit):
                    found = block.pop(i)
                    if not block and len(self.blocks) > 1:
                        del self.blocks[at], self.shared[at], self.lasts[min(at, len(self.lasts) - 1)]
                    else:
                        if i == len(block) and at < len(self.lasts) and block:
                            self.lasts[at] = block[-1]
                        self._settle(at)
                    return found
        return None


def best_fit(pieces: list[tuple[int, int, int]], capacity: int, per_source: int = PER_SOURCE) -> list[int]:
    """The bin of each piece (length, source bit, cluster bit or -1), given from long to short."""
    bins = OpenBins()
    held: list[dict[int, int]] = []
    out = []
    for length, source, cluster in pieces:
        source_bit, cluster_bit = 1 << source, 1 << cluster if cluster >= 0 else 0
        left, number = bins.take(length, source_bit, cluster_bit) or (capacity, len(held))
        if number == len(held):
            held.append({})
            bins.sources.append(0)
            bins.clusters.append(0)
        held[number][source] = held[number].get(source, 0) + 1
        if held[number][source] >= per_source:
            bins.sources[number] |= source_bit
        bins.clusters[number] |= cluster_bit
        bins.put(left - length, number)
        out.append(number)
    return out


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cluster: Column | None = None, capacity: int = CAPACITY, per_source: int = PER_SOURCE, pack_rows: int = PACK_ROWS) -> DataFrame:
    """(doc_id, piece, n_pieces, start, length, bin_id, bin_used): a row per piece of every row of docs.

    cluster: what duplicates share, in place of the hash of the text.
    """
    ready(docs.sparkSession)
    text = text_of(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        F.length(text).cast("long").alias("chars"),
        F.xxhash64(F.coalesce(F.col(source_col).cast("string"), F.lit(""))).alias("source"),
        (F.xxhash64(text) if cluster is None else F.xxhash64(cluster)).alias("cluster"),
        F.xxhash64(F.col(id_col), text).alias("deal"),
    )
    packs = max(1, -(-docs.count() // pack_rows))
    # Equal rows are one row with a count until they are dealt; a count of a thousand million makes some eight million parts.
    counted = rows.groupBy("doc_id", "chars", "source", "cluster", "deal").agg(F.count("*").alias("n"))
    parts = counted.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n") / COPIES).cast("int") - 1)).alias("part"))
    dealt = parts.select("doc_id", "chars", "source", "cluster", F.least(F.lit(COPIES), F.col("n") - F.col("part") * COPIES).cast("int").alias("copies"), F.pmod(F.xxhash64("deal", "part"), F.lit(packs)).alias("pack"))

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        group = group.loc[group.index.repeat(group["copies"])].sort_values(["doc_id", "cluster", "source", "chars"], kind="stable")
        many = group["cluster"].map(group["cluster"].value_counts())
        cluster_bit = dict.fromkeys(group["cluster"][many > 1].tolist())
        cluster_bit = {c: n for n, c in enumerate(cluster_bit)}
        source_bit = {s: n for n, s in enumerate(dict.fromkeys(group["source"].tolist()))}
        pieces = []
        for row, (chars, source, c) in enumerate(zip(group["chars"].tolist(), group["source"].tolist(), group["cluster"].tolist())):
            count = max(1, -(-chars // capacity))
            for k in range(count):
                # Full pieces of a long document fill a bin and meet nothing; its remainder keeps the document's marks.
                pieces.append((min(capacity, chars - k * capacity), source_bit[source], cluster_bit.get(c, -1), row, k, count))
        pieces.sort(key=lambda p: (-p[0], p[3], p[4]))
        bins = best_fit([p[:3] for p in pieces], capacity, per_source)
        ids, number = group["doc_id"].tolist(), int(group["pack"].iloc[0])
        used: dict[int, int] = {}
        for p, b in zip(pieces, bins):
            used[b] = used.get(b, 0) + p[0]
        out = [(ids[p[3]], p[4], p[5], p[4] * capacity, p[0], (number << 24) + b, used[b]) for p, b in zip(pieces, bins)]
        frame = pd.DataFrame(out, columns=["doc_id", "piece", "n_pieces", "start", "length", "bin_id", "bin_used"])
        return frame.astype({"doc_id": "Int64"})

    return dealt.groupBy("pack").applyInPandas(pack, "doc_id long, piece long, n_pieces long, start long, length long, bin_id long, bin_used long")
