"""Toxicity by Levenshtein automata over a learned lexicon.

From labelled rows outside the held-out fold: words that are used (not only quoted) in toxic documents and hardly
ever in others form the lexicon, with the share of toxic documents as their weight; word beginnings that many words share
and no harmless word has become stems. All lexicon terms of FUZZY_CHARS letters or more are a trie, but for those whose
misspellings stand mostly in harmless training rows. Its product with the Levenshtein automaton (distance one; two for terms of LONG_CHARS
letters or more) is built lazily, state by state, as words are read: a state is the set of (trie node, edits so far),
and a word is dropped as soon as the set is empty. A window of words around a match tells quotation (quote marks on
both sides or words of reported speech near it) from use.

How much each kind of match counts (exact, stem, misspelled by number and kind of edits and length of the term; used or quoted)
is learned from training documents that have matches of that kind alone; kinds without evidence keep a prior. The
score is one less the product of what every distinct match (of misspellings the strongest) leaves of harmlessness. Only the text enters a score.

The model is bounded by its training sample of about TRAIN_ROWS labelled rows, and by nothing else. Null or empty text scores
the score of no match. Very long texts are scored whole. Repeated rows score alike, and of equal training texts one is learned from; if
equal texts differ in their label each label counts once. Of terms equally near to a word the first in order is matched. An empty
table gives an empty result, and a table without toxic labels a score of zero everywhere. Further columns of docs are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, ready, text_of

#: Training documents at most (about), and the least share of toxic documents of a term.
TRAIN_ROWS, LEAST_SHARE = 20_000, 0.9
LEAST_DOCS, LEAST_PART = 3, 0.004
#: Letters from which on a term is matched with one edit and with two, and the least toxic share of a term's
#: misspellings, and of a kind of misspelling, in training rows: what is below tells nothing and doesn't count.
FUZZY_CHARS, LONG_CHARS, FUZZY_SHARE = 4, 8, 0.5
STEM_CHARS = (4, 5, 6)
WINDOW = 6
THRESHOLD = 0.3
TOKEN = re.compile(r"[^\W_]+|[\"“”«»„‘’]")
QUOTES = frozenset("\"“”«»„‘’")
#: Words of reported speech, per language of the corpus.
REPORTING = frozenset("said says wrote writes quoted quote called saying sagte schrieb zitat dit écrit cité dijo escribió cita".split())
#: Shares of kinds of match that training rows say nothing about.
PRIORS = {"exact": 0.9, "stem": 0.9, "fuzzy": 0.2, "quoted": 0.5}
REMEMBERED = 1 << 17


def fold(doc_id: Column) -> Column:
    """0 to 3; 2 is held out."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


class Automaton:
    """The lazily built product of a trie and Levenshtein automata: one edit, or two for terms of LONG_CHARS letters or more."""

    def __init__(self, terms: list[str]):
        self.children, self.term, self.most = [{}], [None], [1]
        for t in terms:
            node, edits = 0, self.edits(t)
            self.most[0] = max(self.most[0], edits)
            for ch in t:
                if ch not in self.children[node]:
                    self.children[node][ch] = len(self.children)
                    self.children.append({})
                    self.term.append(None)
                    self.most.append(1)
                node = self.children[node][ch]
                self.most[node] = max(self.most[node], edits)
            self.term[node] = t
        self.reset()

    @staticmethod
    def edits(term: str) -> int:
        return 2 if len(term) >= LONG_CHARS else 1

    def reset(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.best: list[tuple[int, str] | None] = []
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """The number of a set of pairs, closed under leaving out letters of a term; -1 if empty."""
        least: dict[int, int] = {}
        work = sorted(pairs, key=lambda p: p[1])
        while work:
            node, edits = work.pop()
            if edits > self.most[node] or least.get(node, 9) <= edits:
                continue
            least[node] = edits
            work += [(child, edits + 1) for child in self.children[node].values()]
        if not least:
            return -1
        closed = frozenset(least.items())
        if closed not in self.number:
            self.number[closed] = len(self.states)
            self.states.append(closed)
            self.next.append({})
            ends = sorted((e, self.term[n]) for n, e in closed if self.term[n] is not None and e <= self.edits(self.term[n]))
            self.best.append(ends[0] if ends else None)
        return self.number[closed]

    def _step(self, state: int, ch: str) -> int:
        out = set()
        for node, edits in self.states[state]:
            child = self.children[node].get(ch)
            if child is not None:
                out.add((child, edits))
            out.add((node, edits + 1))
            out.update((c, edits + 1) for c in self.children[node].values())
        return self._state(out)

    def match(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest term within the edits that it allows."""
        if len(self.states) > 100_000:
            self.reset()
        state = self.start
        for ch in word:
            if state < 0:
                return None
            to = self.next[state].get(ch)
            if to is None:
                to = self.next[state][ch] = self._step(state, ch)
            state = to
        return self.best[state] if state >= 0 else None


def in_quotation(tokens: list[str], i: int) -> bool:
    """Whether the window around a token has quote marks on both sides or a word of reported speech."""
    before, after = tokens[max(0, i - WINDOW) : i], tokens[i + 1 : i + WINDOW + 1]
    return not QUOTES.isdisjoint(before) and not QUOTES.isdisjoint(after) or not REPORTING.isdisjoint(before) or not REPORTING.isdisjoint(after)


class Scorer:
    """Matches and scores of texts under a model (a plain dict, so that it travels to tasks)."""

    def __init__(self, model: dict):
        self.words, self.known = model["words"], model["harmless"]
        self.stems = frozenset(model["stems"])
        self.automaton = Automaton(model["fuzzy"]) if model["fuzzy"] else None
        self.rates, self.none = model["rates"], model["none"]
        self.seen: dict[str, tuple[str, str] | None] = {}

    def kind(self, word: str) -> tuple[str, str] | None:
        """(kind of match, term) of a word, or None."""
        if word in self.seen:
            return self.seen[word]
        found = None
        if word in self.words:
            found = ("exact", word)
        elif word not in self.known:
            stem = next((word[:n] for n in STEM_CHARS if word[:n] in self.stems and len(word) > n), None)
            if stem:
                found = ("stem", stem)
            elif self.automaton is not None and (near := self.automaton.match(word)):
                edits, term = near
                edit = "swap" if len(word) == len(term) else "more" if len(word) > len(term) else "less"
                found = (f"fuzzy-{'long' if len(term) >= LONG_CHARS else 'short'}-{edits}-{edit}-{'first' if word[:1] != term[:1] else 'inner'}", term)
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        self.seen[word] = found
        return found

    def matches(self, text: str) -> dict[tuple[str, str], bool]:
        """Each distinct match with whether every time it stands in a quotation."""
        tokens = TOKEN.findall(text.lower())
        seen, out = self.seen, {}
        for i, word in enumerate(tokens):
            found = seen[word] if word in seen else self.kind(word)
            if found is not None:
                out[found] = out.get(found, True) and in_quotation(tokens, i)
        return out

    def score(self, text: str) -> float:
        harmless, worst = 1 - self.none, 0.0
        for (kind, term), quoted in self.matches(text).items():
            group = kind.split("-")[0]
            share = self.words[term] if kind == "exact" else self.rates.get(kind, PRIORS[group])
            if group == "fuzzy" and share < FUZZY_SHARE and kind in self.rates:
                continue
            share *= self.rates.get("quoted", PRIORS["quoted"]) if quoted else 1
            # Long texts have look-alikes by chance: of all misspellings only the strongest counts.
            if group == "fuzzy":
                worst = max(worst, share)
            else:
                harmless *= 1 - share
        return min(1.0, max(0.0, 1 - harmless * (1 - worst)))


def _training(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """(text, toxic) of labelled rows outside the held-out fold, about most of them, by the hash of their id."""
    rows = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__id")).agg(F.max("toxic").alias("toxic")).filter(fold(F.col("__id")) != 2)
    share = min(1.0, most / max(1, rows.count()))
    rows = rows.filter(F.pmod(F.xxhash64("__id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    text = docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("text"))
    joined = text.join(F.broadcast(rows), "__id")  # about TRAIN_ROWS ids
    # Copies would count a word again and again: of equal texts one stays.
    return joined.groupBy(F.xxhash64("text").alias("same"), "toxic").agg(F.min("text").alias("text")).select("text", "toxic")


def _word_counts(train: DataFrame) -> DataFrame:
    """(word, toxic, total): documents that use the word, quotations apart (they have the word in angle brackets); each task adds up its own before the shuffle."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, list[int]] = {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([c[0] for c in counts.values()], pa.int64()), pa.array([c[1] for c in counts.values()], pa.int64())], ["word", "toxic", "total"])
            counts.clear()
            return out

        for part in parts:
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                tokens = TOKEN.findall(text.lower())
                own = set(tokens)
                if not QUOTES.isdisjoint(own) or not REPORTING.isdisjoint(own):
                    used = {w for i, w in enumerate(tokens) if not in_quotation(tokens, i)}
                    own = used | {f"<{w}>" for w in own - used}
                for word in own:
                    c = counts.setdefault(word, [0, 0])
                    c[0] += toxic
                    c[1] += 1
                if len(counts) > 200_000:
                    yield flush()
        yield flush()

    each = train.mapInArrow(batches, "word string, toxic long, total long")
    return each.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("total").alias("total"))


def _misspelled(counts: DataFrame, model: dict) -> DataFrame:
    """(word, term, toxic, total) of the words that a term's automaton takes for its misspellings."""
    told = counts.sparkSession.sparkContext.broadcast(model)

    def near(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(told.value)
        for part in parts:
            rows = [(w, k[1], t, n) for w, t, n in zip(*(part.column(i).to_pylist() for i in range(3))) if (k := s.kind(w)) and k[0] not in ("exact", "stem")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64()))], ["word", "term", "toxic", "total"])

    return counts.select("word", "toxic", "total").mapInArrow(near, "word string, term string, toxic long, total long")


def fitted(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_ROWS) -> dict:
    """The model: lexicon with shares, stems, fuzzy terms, harmless neighbours and the rates of each kind of match.

    What is collected comes from about ``most`` documents: words that LEAST_DOCS of them or more have.
    """
    spark = ready(docs.sparkSession)
    train = checkpointed(_training(docs, labels, id_col, text_col, most))
    n_toxic, n = train.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count("*")).first()
    empty = {"words": {}, "stems": [], "fuzzy": [], "harmless": frozenset(), "rates": {}, "none": 0.0}
    if not n_toxic:
        return empty
    counts = checkpointed(_word_counts(train)).filter(~F.col("word").startswith("<"))
    # So many toxic documents in a row would not befall any of the words by chance.
    chance = math.log(max(2, counts.filter(F.col("total") >= LEAST_DOCS).count())) / max(0.1, -math.log(n_toxic / n))
    least = max(LEAST_DOCS, math.ceil(chance), int(LEAST_PART * n_toxic))
    # A term that every document has says nothing; the share must stand out from the labels' own.
    floor = max(LEAST_SHARE, min(0.99, 1.5 * n_toxic / n))
    lexicon = counts.filter((F.col("toxic") >= least) & (F.col("toxic") >= floor * F.col("total"))).orderBy(F.desc("toxic"), "word").collect()
    words = {r["word"]: (r["toxic"] + 0.5) / (r["total"] + 1) for r in lexicon}
    stems: list[str] = []
    for length in STEM_CHARS:
        part = counts.filter(F.length("word") > length).groupBy(F.substring("word", 1, length).alias("stem"))
        good = part.agg(F.sum("toxic").alias("toxic"), F.sum("total").alias("total"), F.count("*").alias("n")).filter((F.col("n") >= 4) & (F.col("toxic") >= 2 * least) & (F.col("toxic") >= 0.97 * F.col("total")))
        stems += [r["stem"] for r in good.orderBy(F.desc("toxic"), "stem").collect()]
    model = empty | {"words": words, "stems": stems, "fuzzy": [r["word"] for r in lexicon if len(r["word"]) >= FUZZY_CHARS]}
    # Known words that only look like a term: met in LEAST_DOCS documents or more, mostly harmless ones.
    known = (F.col("total") >= LEAST_DOCS) & (F.col("toxic") < 0.5 * F.col("total"))
    near = checkpointed(_misspelled(counts, model))
    model["harmless"] = frozenset(r["word"] for r in near.filter(known).select("word").collect())
    # Terms whose other misspellings stand mostly in harmless rows are matched exactly only.
    noisy = near.filter(~known).groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("total").alias("total")).filter((F.col("total") >= LEAST_DOCS) & (F.col("toxic") < FUZZY_SHARE * F.col("total")))
    drop = {r["term"] for r in noisy.collect()}
    model["fuzzy"] = [t for t in model["fuzzy"] if t not in drop]
    told = spark.sparkContext.broadcast(model)

    def kinds(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, out = Scorer(told.value), {}
        for part in parts:
            for text, toxic in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found = s.matches(text)
                own = {"quoted" if quoted and kind == "exact" else kind for (kind, _), quoted in found.items()} or {"none"}
                if len(own) == 1:
                    c = out.setdefault(own.pop(), [0, 0])
                    c[0] += toxic
                    c[1] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(out), pa.string()), pa.array([c[0] for c in out.values()], pa.int64()), pa.array([c[1] for c in out.values()], pa.int64())], ["kind", "toxic", "total"])

    rows = train.mapInArrow(kinds, "kind string, toxic long, total long").groupBy("kind").agg(F.sum("toxic").alias("toxic"), F.sum("total").alias("total")).collect()
    for r in rows:
        if r["kind"] == "none":
            model["none"] = min(0.25, r["toxic"] / (r["total"] + 1))
        elif r["kind"] != "exact":
            prior = PRIORS[r["kind"].split("-")[0]]
            model["rates"][r["kind"]] = (r["toxic"] + 5 * prior) / (r["total"] + 5)
    return model


def scored(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), a row per row of docs."""
    spark = ready(docs.sparkSession)
    held = spark.sparkContext.broadcast(model)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Scorer(held.value)
        for part in parts:
            scores = [s.score(t) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array([int(x >= THRESHOLD) for x in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(fold(F.col(id_col)) == 2, F.lit(False)).alias("held_out"), text_of(text_col).alias("text"))
    return rows.mapInArrow(batches, "doc_id long, held_out boolean, score double, predicted int")


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return scored(docs, fitted(docs, labels))
