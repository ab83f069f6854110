"""Hard-negative mining by exact integer scores, with Four-Russians tables.

Components become integers (floor(scale * x)). For each group of eight dimensions an anchor has a table of 256 numbers:
the sum of its components over every subset of the group. A candidate's components are cut into bit planes (two's
complement; the highest plane counts negative), and the eight bits of a plane in a group are one byte. The inner product is then

    sum over planes of 2**plane * (sum over groups of table[group][byte]),

added from the highest plane down with one shift for each. No product of components is formed and no score is rounded.

Anchors are a stated query set. They are taken in chunks of at most CHUNK anchors (with the dimensions a proven
size), each broadcast and compared with all rows where these lie: rows are dealt evenly over tasks, whatever label they have,
and of each task only the best few of every anchor go on. Two passes share the work between them: rows of the
anchor's label are scored for positives, and once those are known, rows of other labels for negatives.

* A row with a null id, null label, null vector, or any null or non-finite component takes no part.
* An anchor's positives are its best ``positives`` other rows of the same label by (score descending, id ascending).
* A positive's negatives are the best ``negatives`` rows of other labels with 80 * positive_score <= 100 * score <= 100 * positive_score.

Fewer where there are fewer; an anchor without positives and a positive without negatives give no row. Other rows are
rows of another id. Of rows that repeat id and score for an anchor one counts; repeated anchors count once. Vectors of other
lengths are padded with zeros. Integers beyond 31 bits, or scores beyond 62, raise an error, as they are no
embeddings. An empty table gives an empty result. Further columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import checkpointed, ready

SCALE = 256
POSITIVES, NEGATIVES = 5, 5
LOW, HIGH = 80, 100
#: Anchors in one broadcast, anchors and candidates whose scores are held at once, and pairs that one task scores.
CHUNK, ANCHORS_AT_ONCE, ROWS_AT_ONCE, TASK_PAIRS = 16_384, 128, 2048, 40_000_000
MOST = (1 << 31) - 1


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Integer components (rows, width) of a list array, shorter vectors padded with zeros; width is a multiple of eight."""
    lengths = np.diff(vectors.offsets.to_numpy())
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(vectors), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def bit_planes(rows: np.ndarray) -> np.ndarray:
    """(planes, groups, rows) bytes of two's complement components, the highest plane (which counts negative) first."""
    most = int(max(rows.max(initial=0), -(rows.min(initial=0) + 1)))
    planes = most.bit_length() + 1
    places = np.arange(planes - 1, -1, -1)
    bits = ((rows[None, :, :] >> places[:, None, None]) & 1).astype(np.uint8)
    return np.packbits(bits, axis=2, bitorder="little").transpose(0, 2, 1).copy()


def subset_sums(anchors: np.ndarray, kind: type) -> np.ndarray:
    """(groups, 256, anchors): for each byte the sum of a group's components at its set bits, by doubling."""
    count, width = anchors.shape
    out = np.zeros((width // 8, 256, count), kind)
    for g in range(width // 8):
        for bit in range(8):
            out[g, 1 << bit : 2 << bit] = out[g, : 1 << bit] + anchors[:, 8 * g + bit].astype(kind)
    return out


def scores(planes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """(rows, anchors) exact inner products from looked-up sums, shifted and added."""
    total = np.zeros((planes.shape[2], sums.shape[2]), sums.dtype)
    for n, plane in enumerate(planes):
        if n:
            total <<= 1
        for g, at in enumerate(plane):
            if n:
                total += sums[g].take(at, axis=0)
            else:
                total -= sums[g].take(at, axis=0)
    return total


def _number(anchors: np.ndarray, rows: np.ndarray) -> type:
    """32 bits where no partial sum can leave them, else 64."""
    most = float(np.abs(anchors).max(initial=0)) * float(np.abs(rows).max(initial=0)) * 4 * anchors.shape[1]
    if most >= 2.0**62:
        raise ValueError("scores don't fit in 62 bits")
    return np.int32 if most < 2.0**31 else np.int64


class Best:
    """The best k (score, id) of each slot, by score descending and id ascending; an equal pair counts once."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score = np.full((slots, k), np.iinfo(np.int64).min)
        self.row = np.full((slots, k), np.iinfo(np.int64).max)
        self.taken = np.zeros((slots, k), bool)

    def add(self, slot: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        if not len(slot):
            return
        met = np.unique(slot)
        a, b = np.nonzero(self.taken[met])
        slot = np.concatenate((met[a], slot))
        score, row = np.concatenate((self.score[met][a, b], score)), np.concatenate((self.row[met][a, b], row))
        order = np.lexsort((row, -score, slot))
        slot, score, row = slot[order], score[order], row[order]
        new = np.ones(len(slot), bool)
        new[1:] = (slot[1:] != slot[:-1]) | (score[1:] != score[:-1]) | (row[1:] != row[:-1])
        slot, score, row = slot[new], score[new], row[new]
        first = np.flatnonzero(np.concatenate(([True], slot[1:] != slot[:-1])))
        place = np.arange(len(slot)) - np.repeat(first, np.diff(np.append(first, len(slot))))
        best = place < self.k
        slot, place = slot[best], place[best]
        self.taken[met] = False
        self.score[slot, place], self.row[slot, place], self.taken[slot, place] = score[best], row[best], True

    def least(self, slots: np.ndarray) -> np.ndarray:
        """The score that a further row needs at least."""
        return np.where(self.taken[slots, -1], self.score[slots, -1], np.iinfo(np.int64).min)


class Anchors:
    """A chunk of anchors in order of their labels, as numpy arrays."""

    def __init__(self, ids: list[int], labels: list, vectors: list[list[int]], numbers: list[int], windows: list[list[int]] | None = None):
        order = sorted(range(len(ids)), key=lambda i: (str(labels[i]), numbers[i]))
        self.ids, self.numbers = np.array([ids[i] for i in order], np.int64), np.array([numbers[i] for i in order], np.int64)
        self.labels = [labels[i] for i in order]
        width = -(-max((len(v) for v in vectors), default=0) // 8) * 8
        self.rows = np.zeros((len(ids), width), np.int64)
        for n, i in enumerate(order):
            self.rows[n, : len(vectors[i])] = vectors[i]
        self.windows = [windows[i] for i in order] if windows else None
        self.spans: dict = {}
        for n, label in enumerate(self.labels):
            self.spans[label] = (self.spans.get(label, (n, 0))[0], n + 1)

    def of(self, label: object, same: bool) -> list[tuple[int, int]]:
        """Ranges of anchors with this label, or with another."""
        span = self.spans.get(label)
        if same:
            return [span] if span else []
        return [(a, b) for a, b in ((0, len(self.ids)),) if b > a] if span is None else [(a, b) for a, b in ((0, span[0]), (span[1], len(self.ids))) if b > a]


def _blocks(ranges: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Ranges cut where ANCHORS_AT_ONCE divides, so that a block's tables serve every label."""
    for start, stop in ranges:
        while start < stop:
            end = min(stop, (start // ANCHORS_AT_ONCE + 1) * ANCHORS_AT_ONCE)
            yield start, end
            start = end


def best_of(anchors: Anchors, ids: np.ndarray, labels: list, rows: np.ndarray, best: Best, same: bool) -> None:
    """Add to best what these candidates bring: positives (same), a slot per anchor; or negatives, a slot per anchor and positive."""
    places: dict = {}
    for n, label in enumerate(labels):
        places.setdefault(label, []).append(n)
    kind = _number(anchors.rows, rows)
    width = anchors.rows.shape[1]
    work: dict[int, list[tuple[int, int, np.ndarray]]] = {}
    for label, at in places.items():
        for start, stop in _blocks(anchors.of(label, same)):
            work.setdefault(start // ANCHORS_AT_ONCE, []).append((start, stop, np.array(at)))
    planes = bit_planes(rows[:, :width]) if work else None  # what lies beyond the anchors' width meets zeros
    for block, parts in work.items():
        low = block * ANCHORS_AT_ONCE
        sums = subset_sums(anchors.rows[low : low + ANCHORS_AT_ONCE], kind)
        for start, stop, at in parts:
            size = 64  # few at first: thresholds are open then
            here = sums[:, :, start - low : stop - low]
            here = here if here.shape[2] == sums.shape[2] else here.copy()
            while len(at):
                some, at = at[:size], at[size:]
                size = min(ROWS_AT_ONCE, size * 4)
                got = scores(planes[:, :, some], here)
                if same:
                    slots = np.arange(start, stop)
                    wanted = (got >= best.least(slots)) & (ids[some][:, None] != anchors.ids[None, start:stop])
                    r, a = np.nonzero(wanted)
                    best.add(a + start, got[r, a].astype(np.int64), ids[some][r])
                else:
                    for j in range(max(map(len, anchors.windows[start:stop]), default=0)):
                        top = np.array([w[j] if len(w) > j else np.iinfo(np.int64).min // (2 * HIGH) for w in anchors.windows[start:stop]], np.int64)
                        slots = np.arange(start, stop) * POSITIVES + j
                        # 80 * top <= 100 * score, in whole numbers: score >= ceil(80 * top / 100)
                        least = np.maximum(-((-LOW * top) // HIGH), best.least(slots))
                        r, a = np.nonzero((got >= least) & (got <= top))
                        best.add((a + start) * POSITIVES + j, got[r, a].astype(np.int64), ids[some][r])


def usable(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label: Column | None = None, scale: int = SCALE) -> DataFrame:
    """(id, label, v): the rows that take part, with integer components."""
    label = F.col("label") if label is None else label
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    sound = rows.filter("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL").filter(finite)
    whole = lambda c: F.when(F.abs(c) <= MOST / scale, F.floor(c * scale).cast("int")).otherwise(F.raise_error(F.lit("a component is too large for an embedding")).cast("int"))
    return sound.select("id", "label", F.transform("x", whole).alias("v"))


def _pass(rows: DataFrame, anchors: Anchors, same: bool) -> DataFrame:
    """(number, slot, score, id): for every anchor (and positive) the best rows of each task."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(anchors)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held.value
        best = Best(len(own.ids) * (1 if same else POSITIVES), POSITIVES if same else NEGATIVES)
        for part in parts:
            vectors = part.column(2)
            width = max(own.rows.shape[1], -(-int(np.diff(vectors.offsets.to_numpy()).max(initial=0)) // 8) * 8)
            best_of(own, part.column(0).to_numpy(zero_copy_only=False), part.column(1).to_pylist(), matrix(vectors, width), best, same)
        slot, place = np.nonzero(best.taken)
        anchor, j = (slot, np.zeros_like(slot)) if same else np.divmod(slot, POSITIVES)
        yield pa.RecordBatch.from_arrays([pa.array(own.numbers[anchor]), pa.array(j), pa.array(best.score[slot, place]), pa.array(best.row[slot, place])], ["number", "slot", "score", "id"])

    return rows.mapInArrow(batches, "number long, slot long, score long, id long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """(number, slot, score, id, rank): of each (number, slot) the best k, from one shuffle; no group is collected."""
    each = found.repartition("number", "slot").dropDuplicates(["number", "slot", "score", "id"])
    place = F.row_number().over(Window.partitionBy("number", "slot").orderBy(F.desc("score"), "id"))
    return each.withColumn("rank", place).filter(F.col("rank") <= k)


def mined(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for anchors, both as usable() gives them."""
    spark = ready(rows.sparkSession)
    numbered = checkpointed(anchors.distinct().select("id", "label", "v", F.xxhash64("id", "label", "v").alias("key")))
    count = numbered.count()
    chunks = max(1, -(-count // CHUNK))
    tasks = max(spark.sparkContext.defaultParallelism, -(-rows.count() * min(count, CHUNK) // TASK_PAIRS))
    dealt = checkpointed(rows.repartition(tasks, F.xxhash64("id", "v")))
    out = None
    for part in range(chunks):
        mine = numbered.filter(F.pmod("key", F.lit(chunks)) == part).select("id", "label", "v").collect()  # about CHUNK rows
        if not mine:
            continue
        ids, labels, vectors = ([r[c] for r in mine] for c in ("id", "label", "v"))
        numbers = list(range(len(mine)))
        near: dict[int, list] = {}
        for r in sorted(_ranked(_pass(dealt, Anchors(ids, labels, vectors, numbers), True), POSITIVES).collect(), key=lambda r: r["rank"]):  # POSITIVES rows for each anchor
            near.setdefault(r["number"], []).append(r)
        kept = [n for n in numbers if n in near]
        if not kept:
            continue
        windows = [[x["score"] for x in near[n]] for n in kept]
        own = Anchors([ids[n] for n in kept], [labels[n] for n in kept], [vectors[n] for n in kept], kept, windows)
        told = [(n, j, ids[n], x["id"], x["score"]) for n in kept for j, x in enumerate(near[n])]
        names = spark.createDataFrame(told, "number long, slot long, anchor_id long, positive_id long, positive_score long")
        best = _ranked(_pass(dealt, own, False), NEGATIVES).join(F.broadcast(names), ["number", "slot"])  # CHUNK * POSITIVES names
        each = best.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        each = checkpointed(each) if chunks > 1 else each
        out = each if out is None else out.unionByName(each)
    return out if out is not None else spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def digest(embeddings: DataFrame) -> DataFrame:
    """Anchors are the rows whose vec_id is divisible by 100; where it is divisible by 7 the label moves up by one, modulo 10."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = usable(embeddings, label=label)
    return mined(rows, rows.filter("id % 100 = 0"))


def oracle_sql() -> str:
    """The same rows from all anchors and all rows, in DuckDB."""
    return """WITH r AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT anchor_id, positive_id, CAST(rank AS INT) AS rank, negative_id, positive_score, negative_score FROM (
        SELECT anchor_id, positive_id, positive_score, vec_id AS negative_id, score AS negative_score, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS rank
        FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score) WHERE rank <= 5"""
