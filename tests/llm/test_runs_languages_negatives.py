"""Periodic runs, language identification and hard negatives against brute force, held-out accuracy and awkward tables."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwell.llm import hard_negatives, language_id, periodic_runs

SF = "/root/testdata/sf0.001"
CLASHING = "doc_id long, text string, lang string, source string, n_words long, runs string, collapsed string, id string, share long, key string, score double, held_out string, __text string"


def awkward_rows():
    texts = [None, "", " \t\n", "a", "a " * 40, "a b " * 4000, "x y z " * 3 + "x y", "1 2 3 !", "ß É ô 日本", "same text here", "same text here", "w " * 30000]
    rows = [(i, t, "en" if i % 2 else None, "src", 1, "r", "c", "i", 1, "k", 0.5, "h", "t") for i, t in enumerate(texts)]
    return [*rows, rows[9], (None, "no id no id no id no id", "fr", None, None, None, None, None, None, None, None, None, None)]


# --- 11 -----------------------------------------------------------------------------------------------------------


def plain_runs(words):
    """Every maximal stretch of agreeing words for every distance, kept where the distance is its smallest period."""
    n, found = len(words), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=60), max_size=5))
def test_runs_equal_brute_force(texts):
    assert periodic_runs.runs_of(texts) == [plain_runs(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=7), st.integers(1, 9)), min_size=1, max_size=12))
def test_runs_of_planted_repetitions(parts):
    text = [w for block, times in parts for w in block * times]
    assert periodic_runs.runs_of([text, text, [9, *text]]) == [plain_runs(text), plain_runs(text), plain_runs([9, *text])]


def test_extensions_equal_word_by_word():
    rng = np.random.default_rng(5)
    for size, letters in ((40, 2), (300, 3), (2000, 50)):
        words = np.concatenate(([1000], rng.integers(0, letters, size), [1001]))
        words[size // 3 : size // 2] = words[size // 4 : size // 4 + size // 2 - size // 3]
        a, b = np.sort(rng.choice(np.arange(1, size + 1), (400, 2)), axis=1).T
        a, b = a[a != b], b[a != b]
        grammar = periodic_runs.Grammar(words)
        for i, j, n, m in zip(a, b, grammar.agreeing(a, b), grammar.agreeing(a, b, forwards=False)):
            x = next(k for k in range(size + 2) if words[i + k] != words[j + k])
            y = next(k for k in range(size + 2) if words[i - k] != words[j - k])
            assert (n, m) == (x, y)


def op11_row(doc_id, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 == 0 and n:
        a = h // 10 % n
        p = 1 + (n - a) // (3 + h // 10 % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    told = hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest()
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, told, hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest())


def test_run_digest_equals_brute_force(spark):
    # Brute force takes n * n / 4 steps, so texts are taken up to 1500 words; the awkward rows hold long ones.
    table = spark.read.parquet(f"{SF}/documents.parquet").filter("size(split(text, ' ')) < 1500")
    awkward = spark.createDataFrame([r for r in awkward_rows() if len(r[1] or "") < 20000], CLASHING)
    for frame in (table, awkward):
        got = collections.Counter(tuple(r)[:8] for r in periodic_runs.digest(frame).collect())
        assert got == collections.Counter(op11_row(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect())


def test_long_repetitive_texts(spark):
    own = {r.doc_id: r for r in periodic_runs.digest(spark.createDataFrame(awkward_rows(), CLASHING)).collect()}
    whole = "w " * 30000
    assert (own[11].n_runs, own[11].start, own[11].length, own[11].period) == (1, 0, 30000, 1)
    assert own[11].collapsed_sha256 == hashlib.sha256(b"w").hexdigest() and own[11].n_words == len(whole.split())
    assert own[0].n_runs == own[1].n_runs == own[2].n_runs == 0 and own[0].start is None
    assert periodic_runs.runs_of([["a", "b"] * 50000, ["c"] * 7]) == [[(0, 100000, 2)], [(0, 7, 1)]]


def test_runs_of_an_empty_table(spark):
    assert periodic_runs.digest(spark.createDataFrame([], CLASHING)).count() == 0


# --- 12 -----------------------------------------------------------------------------------------------------------


def test_languages_of_the_held_out_fold(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.digest(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    assert len(out) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    held = [r for r in out if r.held_out and r.lang]
    assert len(held) > 100 and sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)


def test_predictions_equal_naive_bayes_gram_by_gram(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    train = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 and r.lang]
    counts, texts = collections.defaultdict(collections.Counter), collections.Counter()
    for r in train:
        counts[r.lang].update(language_id.ngrams(language_id.letters(r.text or ""), language_id.BUCKETS).tolist())
        texts[r.lang] += 1
    names = sorted(counts)
    totals = {k: sum(counts[k].values()) + language_id.SMOOTH * language_id.BUCKETS for k in names}
    got = {r.doc_id: r for r in language_id.digest(docs).collect()}
    for r in rows[:60]:
        grams = collections.Counter(language_id.ngrams(language_id.letters(r.text or ""), language_id.BUCKETS).tolist())
        logs = {k: np.log((texts[k] + 1) / (len(train) + len(names))) + sum(n * np.log((counts[k][g] + language_id.SMOOTH) / totals[k]) for g, n in grams.items()) for k in names}
        best = max(names, key=lambda k: logs[k])
        assert got[r.doc_id].lang_pred == best
        scale = max(1, sum(grams.values()) / language_id.EVIDENCE)
        assert got[r.doc_id].score == pytest.approx(1 / sum(np.exp((v - logs[best]) / scale) for v in logs.values()), abs=1e-3)


def test_ngrams_are_all_stretches():
    points = language_id.letters("Ab1  cÉ")
    assert "".join(map(chr, points)) == " ab cé "
    assert len(language_id.ngrams(points, 1 << 15)) == 7 + 6 + 5 + 4
    assert (language_id.ngrams(points, 1 << 12) < 1 << 12).all() and "".join(map(chr, language_id.letters("!!"))) == " "
    assert language_id.ngrams(language_id.letters(""), 1 << 15).size == 1


def test_language_of_awkward_rows(spark):
    out = language_id.digest(spark.createDataFrame(awkward_rows(), CLASHING)).collect()
    assert len(out) == len(awkward_rows())
    by = collections.defaultdict(list)
    for r in out:
        by[r.doc_id].append(r)
    assert all(by[i][0].lang_pred == "und" and by[i][0].score == 0 for i in (0, 1, 2, 7))
    assert all(r.lang_pred in ("en", "fr") for i in (3, 4, 8, 9, 10, 11, None) for r in by[i])
    assert by[9][0] == by[9][1] and by[None][0].held_out
    empty = language_id.digest(spark.createDataFrame([], CLASHING))
    assert empty.count() == 0 and empty.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    unlabelled = spark.createDataFrame(awkward_rows(), CLASHING).withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.digest(unlabelled).collect()} == {"und"}


def test_a_frequent_language_is_sampled_and_a_rare_one_is_not(spark):
    rows = [(i, f"wie geht es dir heute {i}", "de") for i in range(400)] + [(1000 + i, f"hyvää päivää ystävä {i}", "fi") for i in range(9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    languages, taken = language_id._sample(docs.select(F.col("doc_id").cast("string").alias("id"), "lang", "text"), 50)
    n = collections.Counter(r.lang for r in taken.collect())
    assert languages == {"de": 400, "fi": 9} and n["fi"] == 9 and 20 < n["de"] < 90
    model = language_id.fitted(docs, F.lit(True), most=50)
    got = language_id.predicted(docs, model, [F.col("doc_id"), F.col("lang")]).collect()
    assert all(r.lang == r.lang_pred for r in got)


def test_many_languages_keep_the_matrix_bounded(spark, monkeypatch):
    monkeypatch.setattr(language_id, "CELLS", 1 << 13)
    rows = [(i, " ".join([chr(97 + i % 6) * 3] * 5), f"l{i % 6}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fitted(docs, F.lit(True))
    assert model.log_probability.size <= 1 << 13 and len(model.languages) == 6
    assert all(r.lang == r.lang_pred for r in language_id.predicted(docs, model, [F.col("lang")]).collect())
    monkeypatch.setattr(language_id, "CELLS", 4 * language_id.LEAST_BUCKETS)
    with pytest.raises(ValueError):
        language_id.fitted(docs, F.lit(True))


def test_pieces_of_a_text_add_up(monkeypatch):
    rng = np.random.default_rng(3)
    model = language_id.Model(["a", "b"], rng.random((1 << 10, 2)).astype(np.float32), np.zeros(2))
    texts = [rng.integers(0, 1 << 10, n) for n in (0, 5, 5000, 1, 0, 700)]
    want = np.array([model.log_probability[t].sum(axis=0, dtype=np.float64) for t in texts])
    monkeypatch.setattr(language_id, "GATHER", 64)
    assert np.allclose(language_id.likelihoods(texts, model), want)


# --- 13 -----------------------------------------------------------------------------------------------------------


def brute_negatives(rows, is_anchor=lambda i: i % 100 == 0):
    """rows: (id, label, integer vector)."""
    rows = [(i, label, tuple(v)) for i, label, v in rows]
    out = set()
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for i, label, v in {r for r in rows if is_anchor(r[0])}:
        scored = {(-dot(v, w), j, l == label) for j, l, w in rows if j != i}
        for s, p, _ in sorted(x for x in scored if x[2])[:5]:
            near = sorted(x[:2] for x in scored if not x[2] and 80 * -s <= 100 * -x[0] <= 100 * -s)[:5]
            out |= {(i, p, n + 1, j, -s, -t) for n, (t, j) in enumerate(near)}
    return out


def negatives(spark, rows, schema="vec_id long, embedding array<float>, label int"):
    return {tuple(r) for r in hard_negatives.digest(spark.createDataFrame(rows, schema)).collect()}


def whole(rows):
    return [(i, (label + 1) % 10 if i % 7 == 0 else label, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v, label in rows]


def test_negatives_equal_sql(spark):
    own = hard_negatives.digest(spark.read.parquet(f"{SF}/embeddings.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    want = con.sql(hard_negatives.oracle_sql()).fetchall()
    names = [x[0] for x in con.sql(hard_negatives.oracle_sql()).description]
    got = [tuple(r) for r in own.select(*names).collect()]
    assert len(got) > 50 and sorted(got) == sorted(want)


def test_negatives_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "CHUNK", 4)  # several chunks, blocks of anchors and of rows
    monkeypatch.setattr(hard_negatives, "ANCHORS_AT_ONCE", 3)
    monkeypatch.setattr(hard_negatives, "ROWS_AT_ONCE", 70)
    rng = random.Random(7)
    centre = [[rng.gauss(0, 0.4) for _ in range(11)] for _ in range(4)]
    rows = [(i * 10, [c + rng.gauss(0, 0.2) for c in centre[i % 4]], rng.choice([i % 4, i % 4, 3])) for i in range(150)]
    assert len(brute_negatives(whole(rows))) > 30
    assert negatives(spark, rows) == brute_negatives(whole(rows))


def test_ties_hot_vectors_and_one_label(spark):
    rows = [(i, [0.5, 0.25, -0.5], 1) for i in range(0, 400, 2)] + [(i, [0.5, 0.25, -0.5] if i % 3 else [0.5, 0.2, -0.5], 2) for i in range(1, 400, 2)]
    assert negatives(spark, rows) == brute_negatives(whole(rows)) != set()
    alone = [(i, [1.0, 2.0], 5) for i in range(1, 300) if i % 7]
    assert negatives(spark, alone) == set()


def test_rows_that_take_no_part(spark):
    good = [(i, [0.1 * (i % 9), 0.3, 0.2], i % 3) for i in range(0, 330, 5)]
    bad = [(100, None, 1), (200, [0.1, float("nan"), 0.1], 1), (3, [float("inf"), 0.0, 0.0], 2), (4, [0.5, None, 0.1], 1), (6, [9.0, 9.0, 9.0], None), (None, [9.0, 9.0, 9.0], 1)]
    assert negatives(spark, good + bad) == brute_negatives(whole(good))
    assert negatives(spark, []) == set() and negatives(spark, bad) == set()
    assert negatives(spark, good + good) == brute_negatives(whole(good))
    named = spark.createDataFrame([(*r, "x", 1, 2) for r in good], "vec_id long, embedding array<float>, label int, id string, v long, number long")
    assert {tuple(r) for r in hard_negatives.digest(named).collect()} == brute_negatives(whole(good))


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 19), st.integers(1, 30), st.integers(0, 2**30), st.sampled_from([2, 300, 70000]))
def test_table_scores_are_inner_products(width, rows, seed, most):
    rng = np.random.default_rng(seed)
    wide = -(-width // 8) * 8
    a, b = (np.pad(rng.integers(-most, most, (n, width)), ((0, 0), (0, wide - width))) for n in (5, rows))
    kind = hard_negatives._number(a, b)
    got = hard_negatives.scores(hard_negatives.bit_planes(b), hard_negatives.subset_sums(a, kind))
    assert (got == b @ a.T).all()


def test_vectors_of_other_lengths_and_too_large_numbers(spark):
    rows = [(i, [0.5] * (1 + i % 12), i % 2) for i in range(0, 300, 10)]
    padded = [(i, label, v + [0] * (12 - len(v))) for i, label, v in whole(rows)]
    assert negatives(spark, rows) == brute_negatives(padded)
    with pytest.raises(Exception, match="too large"):
        negatives(spark, [(100, [1e30, 0.0], 1), (1, [1.0, 1.0], 1)])
