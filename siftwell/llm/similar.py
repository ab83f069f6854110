"""Near-duplicates by the Jaccard similarity of word-shingle sets: operator 4's SimHash index proposes, exact sets decide.

1. Texts with equal shingle sets are one class, named by the hash of the set, so copies cost nothing further.
2. A class has ``PRINTS`` fingerprints, each the bitwise majority of its shingle hashes under another seed. At a similarity
   of 0.8 two sets differ in 0.152 of the bits at most (an angle of arccos(8/9)): in about ten of 64, so one fingerprint can't find
   them by few differing bits, but many can by agreeing blocks.
3. Every block of ``BLOCK`` bits of every fingerprint is a key: a pair at 0.8 shares one of the 136 with probability
   1 - (1 - 0.848**16)**136, which is 0.9999. Under a key the fingerprints stand in Gray order below operator 4's tree
   of shared masks and patterns, and those within ``APART`` bits (``APART_TWO`` with the next fingerprint, which such a pair keeps but
   for 0.0005 of the keys) are one meeting. What is that close to the middle of the order is settled at once, and nodes of settled
   ones aren't compared, so a large group of near copies costs no pairs. Meetings are named by their smallest class and what
   that leads to, and those of one name go on as one, so such a group costs few rows a class.
4. Few shingles often tie, and a tie is 0, so sets of ``FEW`` shingles at most also meet under each of these.
5. A star to one of a meeting's classes, the one that meets most others, is checked first, exactly, on the sets
   themselves, one star for a class and round; what links is one component. Classes of meetings that are still in two components are then joined on the rare ones of
   their shingles (a prefix filter, which loses no similar pair), so that a passage that many texts share proposes
   nothing. Nothing is capped, and no estimate makes a link.

Texts of fewer words than a shingle are one shingle. Null or empty text is the empty set, similar to itself alone. Very long
texts are compared whole. Of a group the smallest id stays (null last), then the smallest text hash; of repeated rows
one stays. An empty table gives an empty result. Further columns of docs, whatever their names, are packed into one struct.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed, joined_by_hot_key, ready, small, text_of
from .simhash import LOWER, GrayTree, components, gray_rank, united

#: Words of a shingle and the least similarity of near-duplicates.
WORDS, LEAST = 5, 0.8
#: Fingerprints of a set, bits of a block (a divisor of 64), and keys.
PRINTS, BLOCK = 34, 16
KEYS = PRINTS * 64 // BLOCK
#: Most differing bits of the key's fingerprint, and of it and the next one.
APART, APART_TWO = 16, 33
#: Shingles of sets that meet under these as well.
FEW = 25
#: Rounds of stars, each to another component, before the prefix filter.
STAR_ROUNDS = 2
#: Sizes of sets by which hashes meet grow by this factor.
SIZE_STEP = 1.05
#: Hashes (eight bytes each) that may be broadcast.
BROADCAST_HASHES = 1_000_000

SEEDS, TIMES, MIX = np.random.default_rng(42).integers(0, 1 << 63, (3, PRINTS), np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles."""
    split = text.encode().translate(LOWER).split()
    if not split:
        return np.empty(0, np.uint64)
    joined = memoryview(b" ".join(split))
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(words, len(split))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b]) for a, b in zip(starts[: len(split) - span + 1].tolist(), ends[span - 1 :].tolist(), strict=True)], np.uint64))


def set_hash(hashes: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(hashes.tobytes())


def fingerprints(hashes: np.ndarray) -> np.ndarray:
    """The set's SimHash under every seed, a tie being 0; none for the empty set."""
    if not len(hashes):
        return np.empty(0, np.uint64)
    counts = np.zeros(64 * PRINTS, np.int64)
    for at in range(0, len(hashes), 255):  # so many fit a byte
        x = hashes[at : at + 255, None] ^ SEEDS
        x = (x ^ (x >> np.uint64(32))) * TIMES
        x = (x ^ (x >> np.uint64(29))) * MIX
        x ^= x >> np.uint64(32)
        counts += np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(hashes), bitorder="little").view(np.uint64)


def _sketches(docs: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """(doc_id, text_hash, c, n, prints, few): a row per row of docs, with its class, the size of its set, its fingerprints and, of few, its shingles."""
    ready(docs.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [shingles(t, words) for t in part.column(2).to_pylist()]
            c = np.array([set_hash(s) for s in sets], np.uint64).view(np.int64)
            prints = pa.array([fingerprints(s).view(np.int64) for s in sets], pa.list_(pa.int64()))
            few = pa.array([s.view(np.int64) if len(s) <= FEW else None for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(c), pa.array([len(s) for s in sets], pa.int32()), prints, few], ["doc_id", "text_hash", "c", "n", "prints", "few"])

    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text")).mapInArrow(batches, "doc_id long, text_hash long, c long, n int, prints array<long>, few array<long>")


def meetings_of(key: np.ndarray, fps: np.ndarray, more: np.ndarray) -> np.ndarray:
    """For rows in order of key and Gray rank, the smallest position that close rows of the same key lead to."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size, place = np.diff(np.append(edge, len(key))), np.arange(len(key))

    def close(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        apart = np.bitwise_count(fps[a] ^ fps[b])
        return (apart <= APART) & (apart + np.bitwise_count(more[a] ^ more[b]) <= APART_TWO)

    settled = close(place, np.repeat(edge + size // 2, size))
    root = np.where(settled, np.repeat(np.minimum.reduceat(np.where(settled, place, len(key)), edge), size), place)
    for left, right in GrayTree(key, fps).close_pairs(APART, settled):
        keep = close(left, right)
        root = united(root, left[keep], right[keep])
    return root


def _meetings(classes: DataFrame) -> DataFrame:
    """(key, c): the classes of every meeting of two or more; meetings of one name count as one."""
    return _counted_meetings(classes).select("key", "c")


def _counted_meetings(classes: DataFrame) -> DataFrame:
    """(key, c, met): a row per class of a meeting; met sums the sizes of the meetings of that name that the class is in.

    A group of near copies meets under most of the 136 keys, each time with other members. A meeting's smallest class leads to
    the smallest one that it meets anywhere, and that names the meeting: a class of the group has a row for each of a few names,
    not for each key, and whoever meets still shares a name.
    """
    ready(classes.sparkSession)
    names = ["least", "c", "met"]

    def met(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        key, fps, more, c = (np.concatenate(x) for x in zip(*held))
        edge = np.concatenate(([True], key[1:] != key[:-1], [True]))
        many = ~(edge[1:] & edge[:-1])
        key, fps, more, c = key[many], fps[many].view(np.uint64), more[many].view(np.uint64), c[many]
        if not len(key):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, names)
        root = meetings_of(key, fps, more)
        least, many = np.full(len(root), np.iinfo(np.int64).max), np.bincount(root, minlength=len(root))[root]
        np.minimum.at(least, root, c)
        keep = many > 1
        return pa.RecordBatch.from_arrays([pa.array(least[root[keep]]), pa.array(c[keep]), pa.array(many[keep])], names)

    def tasks(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # rows of the key that may go on
        for part in parts:
            now = [part.column(i).to_numpy() for i in range(4)]
            if not len(now[0]):
                continue
            cut = int(np.argmax(now[0] == now[0][-1]))
            if cut:
                yield met([*held, [x[:cut] for x in now]])
                held = [[x[cut:] for x in now]]
            elif held and held[-1][0][-1] != now[0][0]:
                yield met(held)
                held = [now]
            else:
                held.append(now)
        if held:
            yield met(held)

    each = classes.filter("n > 0").select("c", "prints", F.explode(F.sequence(F.lit(0), F.lit(KEYS - 1))).alias("k"))
    number, block = F.floor(F.col("k") / (64 // BLOCK)).cast("int"), F.col("k") % (64 // BLOCK)
    each = each.select("c", "k", (block * BLOCK).alias("shift"), F.get("prints", number).alias("fp"), F.get("prints", (number + 1) % PRINTS).alias("more"))
    bits = F.expr(f"shiftrightunsigned(fp, shift) & {(1 << BLOCK) - 1}")
    rows = each.select((F.col("k").cast("long") * (1 << BLOCK) + bits).alias("key"), "fp", "more", "c")
    rows = rows.repartition("key").sortWithinPartitions("key", gray_rank(F.col("fp")))
    found = checkpointed(rows.mapInArrow(tasks, "least long, c long, met long").groupBy("least", "c").agg(F.sum("met").alias("met")))
    name = checkpointed(found.groupBy(F.col("c").alias("least")).agg(F.min("least").alias("key")))
    found = found.join(small(name, BROADCAST_HASHES), "least").groupBy("key", "c").agg(F.sum("met").alias("met"))
    few = classes.select(F.explode("few").alias("h"), "c")
    often = checkpointed(few.groupBy("h").agg(F.count("*").alias("met")).filter("met > 1"))
    return found.unionByName(few.join(small(often, BROADCAST_HASHES), "h").select(F.xxhash64("h").alias("key"), "c", "met"))


def _sets(docs: DataFrame, wanted: DataFrame, text_col: str, words: int) -> DataFrame:
    """(c, hashes) of the classes whose text hashes are wanted."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sets = [shingles(t, words) for t in part.column(0).to_pylist()]
            c = np.array([set_hash(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(c), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["c", "hashes"])

    text = text_of(text_col)
    texts = docs.select(F.xxhash64(text).alias("text_hash"), text.alias("text")).join(small(wanted, BROADCAST_HASHES), "text_hash", "left_semi").dropDuplicates(["text_hash"])
    return texts.select("text").mapInArrow(batches, "c long, hashes array<long>")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are similar, by the sets themselves."""
    pairs = checkpointed(pairs)
    few = small(pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct(), BROADCAST_HASHES)
    sets = sets.join(few, "c", "left_semi")  # only those that a pair asks for move
    left, right = sets.select(F.col("c").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("c").alias("b"), F.col("hashes").alias("y"))
    shared = pairs.join(left, "a").join(right, "b").select("a", "b", (F.size("x") + F.size("y")).alias("both"), F.size(F.array_intersect("x", "y")).alias("shared"))
    return checkpointed(shared.filter(F.col("shared") >= least * (F.col("both") - F.col("shared")) - 1e-9).select("a", "b"))


def _prefix_pairs(classes: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(c, n, d, m) of the classes of different roots that may be similar: all pairs that are, and few others.

    With hashes in order from rare to frequent, of two similar sets the smaller one has one of its first
    m - ceil(2 * least / (1 + least) * m) + 1 among the first n - ceil(least * n) + 1 of the larger: what many texts have in common
    comes last and proposes nothing. Where the two positions leave too few hashes to share, the pair is dropped too.
    """
    each = sets.join(small(classes, BROADCAST_HASHES), "c").select("c", "n", "root", F.explode("hashes").alias("h"))
    often = each.groupBy("h").agg(F.count("*").alias("often"))
    order = Window.partitionBy("c").orderBy("often", "h")
    ranked = each.join(often, "h").withColumn("at", F.row_number().over(order))
    first = lambda size, share: F.col("at") <= F.col(size) - F.ceil(share * F.col(size) - 1e-9) + 1
    large = checkpointed(ranked.filter(first("n", least) & (F.col("often") > 1)).select("h", "c", "n", "root", "at"))
    # A position in the larger set bounds the size of the smaller one from above, so hashes meet by classes of size.
    share = least / (1 + least)
    step = lambda size: F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.log(F.lit(SIZE_STEP)) + 1e-9).cast("int")
    low, high = F.ceil(least * F.col("n") - 1e-9), F.least(F.col("n"), F.floor((F.col("n") - F.col("at") + 1) / share - F.col("n") + 1e-6))
    large = large.withColumn("low", low).withColumn("high", high)
    few = large.filter(first("n", 2 * share)).select("h", F.col("c").alias("d"), F.col("n").alias("m"), F.col("root").alias("other"), F.col("at").alias("place"), step(F.col("n")).alias("size"))
    probes = large.filter("low <= high").select("h", "c", "n", "root", "at", F.explode(F.sequence(step(F.col("low")), step(F.col("high")))).alias("size"))
    smaller = (F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("d") < F.col("c")))
    enough = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("place")) + 1 >= share * (F.col("n") + F.col("m")) - 1e-9
    p, f = probes.alias("p"), few.alias("f")
    met = p.join(f, (F.col("p.h") == F.col("f.h")) & (F.col("p.size") == F.col("f.size")) & smaller & (F.col("root") != F.col("other")) & enough)
    return met.select("c", "n", "d", "m").distinct()


def similar_links(docs: DataFrame, classes: DataFrame, text_col: str, words: int = WORDS, least: float = LEAST) -> DataFrame:
    """(node, root) for every class that isn't the smallest of its component of similar ones."""
    each = checkpointed(_counted_meetings(classes))
    # The middle of a group meets the most others: what copies were made from shares more keys than the copies do.
    middle = checkpointed(classes.select("c", "n", "text_hash").join(each.groupBy("c").agg(F.sum("met").alias("meets")), "c"))
    sets = checkpointed(_sets(docs, middle.select("text_hash").distinct(), text_col, words))
    rows, links, stars = checkpointed(each.select("key", "c").join(middle.select("c", "n", "meets"), "c").select("key", "c", "n", "meets")), None, None
    fits = F.least("n", "m") >= least * F.greatest("n", "m") - 1e-9
    pair = F.least("c", "d").alias("a"), F.greatest("c", "d").alias("b")
    for at in range(STAR_ROUNDS + 1):
        if stars is not None:
            named = rows.select("key", "c", "n", "meets").join(stars, F.col("c") == F.col("node"), "left").select("key", "c", "n", "meets", F.coalesce("root", "c").alias("root"))
            open_ = named.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("key")
            rows = checkpointed(named.join(open_, "key"))
        else:
            rows = rows.withColumn("root", F.col("c"))
        if at < STAR_ROUNDS:
            order = F.struct((-F.col("meets")).alias("o"), F.col("c").alias("d"), F.col("n").alias("m"), F.col("root").alias("other"))
            others = rows.groupBy("key").agg(F.min(order).alias("s")).select("key", "s.o", "s.d", "s.m", "s.other")
            if at:  # the next best outside the component of the best, which was tried
                rest = rows.join(others.select("key", F.col("other").alias("tried")), "key").filter("root <> tried")
                others = rest.groupBy("key").agg(F.min(order).alias("s")).select("key", "s.o", "s.d", "s.m", "s.other")
            asked = rows.join(others, "key").filter((F.col("root") != F.col("other")) & fits)
            # A class asks the best of all that it meets, so a group of many meetings has one link a class.
            asked = asked.groupBy("c").agg(F.min(F.struct("o", "d")).alias("s")).select("c", "s.d")
        else:
            asked = _prefix_pairs(rows.select("c", "n", "root").distinct(), sets, least).filter(fits)
        found = _similar(asked.select(*pair).distinct(), sets, least)
        links = found if links is None else links.unionByName(found)
        stars = components(links)
    return stars


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """(doc_id, text_hash, n, root, kept): a row per distinct id and text, how often it occurs, its group, and whether it is the one that stays."""
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "text_hash")
    sketched = checkpointed(_sketches(docs, id_col, text_col, words))
    classes = checkpointed(sketched.groupBy("c").agg(F.min("text_hash").alias("text_hash"), F.first("n").alias("n"), F.first("prints").alias("prints"), F.first("few").alias("few")))
    stars = similar_links(docs, classes, text_col, words, least)
    roots = classes.select("c").join(stars, F.col("c") == F.col("node"), "left").select("c", F.coalesce("root", "c").alias("root"))
    # A class may hold a third of all rows, so rows meet their root dealt over many tasks.
    named = joined_by_hot_key(sketched.select("doc_id", "text_hash", "c"), roots, "c", ["doc_id", "text_hash"])
    each = checkpointed(named.groupBy("doc_id", "text_hash", "root").agg(F.count("*").alias("n")))
    best = each.groupBy("root").agg(F.min(first).alias("best"))
    told = joined_by_hot_key(each, best, "root", ["doc_id", "text_hash"])
    return told.select("doc_id", "text_hash", "n", "root", (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("text_hash") == F.col("best.text_hash"))).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """One row of each group of docs that links of similarity least join, with all its columns.

    What meets the texts is the list of ids that go and of those that stay once but occur more often. Where it is counted to be
    small it is broadcast, and no text moves but repeated rows.
    """
    each = near_duplicates(docs, id_col, text_col, words, least)
    marks = checkpointed(each.filter("NOT kept OR n > 1").select(F.struct("doc_id", "text_hash").alias("key"), "kept"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.struct(F.col(id_col).alias("doc_id"), F.xxhash64(text_of(text_col)).alias("text_hash")).alias("key"))
    once = rows.join(small(marks), "key", "left_anti")
    again = rows.join(small(marks.filter("kept").select("key")), "key", "left_semi").dropDuplicates(["key"])
    return once.select("row.*").unionByName(again.select("row.*"))
