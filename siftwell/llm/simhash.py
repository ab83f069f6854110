"""SimHash near-duplicates through a Gray-order hierarchical index.

1. A fingerprint per document: the bitwise majority of its word-shingle hashes.
2. Equal fingerprints collapse to one class with its smallest id, so copies cost nothing further.
3. The bits are cut into ``distance + 1`` or more blocks; two fingerprints within the distance agree on
   all but ``distance`` blocks, so every close pair meets under some key made of the blocks that agree.
4. Under a key, fingerprints are sorted by Gray rank and a tree is built over the order: a node holds
   the bits that all its fingerprints share (mask and pattern). Node pairs are compared from the root
   down; differences add up along the way and a pair of nodes beyond the distance is dropped whole.
5. Keys with many fingerprints are cut into Gray-ordered blocks, blocks that are still large into smaller ones, and
   so on: upper nodes of the same hierarchy. A pair of blocks whose masks and patterns are too far apart is
   dropped before any of its rows or smaller blocks are looked at; what is left is compared in separate tasks. The number of
   blocks follows the number of fingerprints; none is capped.
6. Tasks return spanning links only (never all pairs of a group); components follow by minimum-label
   hooking with pointer jumping, checkpointed in the shared folder, until nothing changes.

Null or empty text has fingerprint zero and links like any other. Very long texts are hashed whole, in parts. Repeated rows
each keep a row in the result, and so do other copies: a fingerprint that a third of all rows share is dealt over many tasks.
A null id never names a component unless all its members have none. A bit that is set in exactly half the shingles (a
tie) is 0. An empty table gives an empty result. Further columns of docs, whatever their names, are not read;
``drop_near_duplicates`` packs them into one struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, joined_by_hot_key, keyed, ready, small, text_of

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: Fingerprints under one key that one task compares; larger keys are cut into blocks of this size.
GROUP_ROWS = 512
#: Children of a node of the tree, and blocks that a large block is cut into.
FANOUT, SPLIT = 8, 16
#: Node pairs that are expanded at a time.
FRONTIER = 1 << 20


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit fingerprint of one text."""
    words = text.encode().translate(LOWER).split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(shingle, len(words))
    pairs = zip(starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], seed) for a, b in pairs], np.uint64)
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, text_hash, fp): one row per row of docs, fp as the signed long with the same bits."""
    ready(docs.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            fps = [fingerprint(t, shingle) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "text_hash", "fp"])

    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(batches, "doc_id long, text_hash long, fp long")


def gray_rank(fp: Column) -> Column:
    """The position of a bit pattern in Gray order, as a long (unsigned order holds below the top bit)."""
    for shift in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, shift))
    return fp


def _count_bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


class GrayTree:
    """A tree over fingerprints that are sorted by (group, Gray rank): runs of FANOUT nodes of a group share a parent."""

    def __init__(self, group: np.ndarray, fps: np.ndarray):
        self.levels = [(group, np.full(len(fps), ~np.uint64(0)), fps, np.arange(len(fps)), np.arange(len(fps)) + 1)]
        while True:
            group, mask, pattern, _, _ = self.levels[-1]
            edge = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
            if len(edge) == len(group):
                break
            place = np.arange(len(group)) - np.repeat(edge, np.diff(np.append(edge, len(group))))
            first = np.flatnonzero(place % FANOUT == 0)
            both = np.bitwise_and.reduceat(pattern, first)
            any_ = np.bitwise_or.reduceat(pattern & mask, first)
            shared = np.bitwise_and.reduceat(mask, first) & ~(both ^ any_)
            self.levels.append((group[first], shared, both & shared, first, np.append(first[1:], len(group))))

    def close_pairs(self, distance: int, settled: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of positions (i < j) within the distance, in parts of bounded size; without those of two settled ones, if told."""
        done = [] if settled is None else [settled]
        for _, _, _, first, _ in self.levels[1:] if done else []:
            done.append(np.logical_and.reduceat(done[-1], first))
        roots = np.arange(len(self.levels[-1][0]))
        work = [(len(self.levels) - 1, roots[a : a + FRONTIER], roots[a : a + FRONTIER], np.zeros(min(FRONTIER, len(roots) - a), np.int64)) for a in range(0, len(roots), FRONTIER)]
        while work:
            level, left, right, so_far = work.pop()
            if level == 0:
                keep = left < right
                if keep.any():
                    yield left[keep], right[keep]
                continue
            above_mask, (_, mask, pattern, _, _) = self.levels[level][1], self.levels[level - 1]
            first, last = self.levels[level][3], self.levels[level][4]
            step = max(1, FRONTIER // FANOUT**2)
            for a in range(0, len(left), step):
                x, y, d = left[a : a + step], right[a : a + step], so_far[a : a + step]
                wide, tall = last[x] - first[x], last[y] - first[y]
                n = wide * tall
                pair = np.repeat(np.arange(len(x)), n)
                k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                cx, cy = first[x][pair] + k // tall[pair], first[y][pair] + k % tall[pair]
                keep = cx <= cy
                cx, cy, pair = cx[keep], cy[keep], pair[keep]
                # Bits both parents share were counted on the way here; only what the children add is counted now.
                counted = above_mask[x][pair] & above_mask[y][pair]
                total = d[pair] + _count_bits((pattern[cx] ^ pattern[cy]) & mask[cx] & mask[cy] & ~counted)
                keep = total <= distance
                if done:
                    keep &= ~(done[level - 1][cx] & done[level - 1][cy])
                if keep.any():
                    work.append((level - 1, cx[keep], cy[keep], total[keep]))


def united(root: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """root (a smallest position per component) once the pairs (left, right) are joined too."""
    while True:
        a, b = root[left], root[right]
        open_ = a != b
        if not open_.any():
            return root
        left, right, a, b = left[open_], right[open_], a[open_], b[open_]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]) is not None and (up != root).any():
            root = up


def spanning_links(group: np.ndarray, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) for each fingerprint whose local component has a smaller position: a star per component."""
    root = np.arange(len(fps))
    for left, right in GrayTree(group, fps).close_pairs(distance):
        root = united(root, left, right)
    member = np.flatnonzero(root != np.arange(len(fps)))
    return fps[member], fps[root[member]]


def _links(keyed: DataFrame, distance: int) -> DataFrame:
    """Spanning links (a, b) of every group of keyed (key, fp); a group's rows meet in one task, in Gray order."""
    ready(keyed.sparkSession)

    def tasks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_key, rest_fp = np.empty(0, np.int64), np.empty(0, np.uint64)

        def close(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = spanning_links(keys, fps, distance)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for part in parts:
            keys = np.concatenate((rest_key, part.column(0).to_numpy()))
            fps = np.concatenate((rest_fp, part.column(1).to_numpy().view(np.uint64)))
            whole = int(np.searchsorted(keys == keys[-1], True)) if len(keys) else 0  # the last group may go on
            if whole and keys[0] != keys[-1]:
                yield close(keys[:whole], fps[:whole])
                keys, fps = keys[whole:], fps[whole:]
            rest_key, rest_fp = keys, fps
        if len(rest_key):
            yield close(rest_key, rest_fp)

    ordered = keyed.repartition("key").sortWithinPartitions("key", gray_rank(F.col("fp")))
    return ordered.select("key", "fp").mapInArrow(tasks, "a long, b long")


def _blocks(distance: int, count: int) -> list[tuple[int, int]]:
    """(shift, width) of the blocks of the bits: more and so longer keys for more fingerprints."""
    n = distance + 1 + (count > 1 << 22) + (count > 1 << 31)
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def _keys(fp: Column, distance: int, count: int) -> Column:
    """All keys of a fingerprint: the number of the choice of blocks, then those blocks' bits."""
    from itertools import combinations

    blocks, keys = _blocks(distance, count), []
    for number, chosen in enumerate(combinations(blocks, len(blocks) - distance)):
        key = F.lit(number).cast("long")
        for shift, width in chosen:
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    return F.array(*keys)


def _nodes(rows: DataFrame) -> DataFrame:
    """(part, n, pattern, mask): the bits that all fingerprints of a part share."""
    each = rows.groupBy("part").agg(F.count("*").alias("n"), F.bit_and("fp").alias("both"), F.bit_or("fp").alias("any"))
    return each.select("part", "n", F.col("both").alias("pattern"), F.bitwise_not(F.col("both").bitwiseXOR(F.col("any"))).alias("mask"))


def _hot_parts(keyed: DataFrame, hot: DataFrame, distance: int, group_rows: int) -> DataFrame:
    """Rows of hot keys, keyed anew by the pairs of Gray-ordered blocks that may hold close pairs."""
    rows = keyed.join(small(hot), "key").select("fp", F.col("key").alias("part"), F.shiftrightunsigned(gray_rank(F.col("fp")), 1).alias("gray"))
    rows = checkpointed(rows)
    pairs = rows.select(F.col("part").alias("x"), F.col("part").alias("y")).distinct()
    while True:
        large = checkpointed(_nodes(rows).filter(F.col("n") > 2 * group_rows).select("part", "n"))
        if large.isEmpty():
            break
        # Large parts are cut in SPLIT by Gray rank, the others stay; a part's children are the next level's nodes.
        cuts = rows.join(large, "part", "left_semi").groupBy("part").agg(F.percentile_approx("gray", [i / SPLIT for i in range(1, SPLIT)], 8 * SPLIT).alias("cuts"))
        place = F.size(F.filter("cuts", lambda cut: cut < F.col("gray")))
        cut = rows.join(small(cuts), "part", "left").select("fp", "gray", F.col("part").alias("above"), F.when(F.col("cuts").isNull(), F.col("part")).otherwise(F.xxhash64("part", place)).alias("part"))
        cut = checkpointed(cut)
        nodes = checkpointed(_nodes(cut).join(cut.select("part", "above").distinct(), "part"))
        left = nodes.select(F.col("above").alias("x"), F.col("part").alias("a"), F.col("pattern").alias("p"), F.col("mask").alias("m"))
        right = nodes.select(F.col("above").alias("y"), F.col("part").alias("b"), F.col("pattern").alias("q"), F.col("mask").alias("k"))
        apart = F.bit_count(F.col("p").bitwiseXOR(F.col("q")).bitwiseAND(F.col("m")).bitwiseAND(F.col("k")))
        down = pairs.join(left, "x").join(right, "y").filter(((F.col("x") != F.col("y")) | (F.col("a") <= F.col("b"))) & (apart <= distance))
        pairs = checkpointed(down.select(F.col("a").alias("x"), F.col("b").alias("y")))
        rows = cut.select("fp", "part", "gray")
    task = F.xxhash64("x", "y").alias("key")
    sides = pairs.select(task, F.explode(F.array_distinct(F.array("x", "y"))).alias("part"))
    return rows.join(sides, "part").select("key", "fp")


def links(classes: DataFrame, distance: int = 3, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links (a, b) that span every component of distinct fingerprints within the distance of one another."""
    keyed = classes.select("fp", F.explode(_keys(F.col("fp"), distance, classes.count())).alias("key"))
    hot = checkpointed(keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > 2 * group_rows).select("key"))
    found = _links(keyed.join(small(hot), "key", "left_anti"), distance)
    if not hot.isEmpty():
        found = found.unionByName(_links(_hot_parts(keyed, hot, distance, group_rows), distance))
    return found.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b) that isn't the smallest of its component.

    Alternating large-star and small-star rounds: each sends neighbours to the smallest node in sight, so that
    edges turn into stars; no list of neighbours is ever gathered.
    """
    edges = checkpointed(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:  # a fixed point is reached in about the square of the logarithm of the rows
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        edges = checkpointed(small.select("e.*").filter("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, distance: int = 3, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(doc_id, text_hash, fp, root, component_id): a row per row of docs; component_id is the smallest id reachable by links."""
    prints = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    classes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    stars = components(links(classes, distance, group_rows))
    member = classes.join(stars, F.col("fp") == F.col("node"), "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    names = member.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = member.join(names, "root").select("fp", "root", "component_id")
    # Copies share a fingerprint, so one may stand for a third of all rows.
    return joined_by_hot_key(prints, named, "fp", ["doc_id", "text_hash"]).select("doc_id", "text_hash", "fp", "root", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns of near_duplicates."""
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each near-duplicate group of docs, with all its columns: the smallest id (null last), then the smallest text hash."""
    each = near_duplicates(docs, id_col, text_col)
    best = each.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")).alias("b")).select("b.doc_id", "b.text_hash")
    same = F.col("key_id").eqNullSafe(F.col("doc_id")) & (F.col("key_hash") == F.col("text_hash"))
    kept = keyed(docs, id_col, text_col).join(best, same, "left_semi")
    return kept.dropDuplicates(["key_id", "key_hash"]).select("row.*")
