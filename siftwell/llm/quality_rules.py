"""Quality rules by distribution divergence, in built-in functions only.

Each language's reference comes from the whole table: its character-class histogram and the histogram of its
common words (of any length: those with at least COMMON_SHARE of the language's words, the COMMON_WORDS most frequent; of
equal counts the first in order). A document is compared with its language's reference by Jensen-Shannon distance (base
2, so 0 to 1) on both histograms. Short documents carry too little evidence: the distances count only from MIN_WORDS
words on. Documents without a language are a language of their own. References are a table joined by language, however
many languages there are; it is broadcast only where it is counted to be small.

Null or empty text has no words and fails the base rule (fewer than 20 words). Very long texts are judged whole. Repeated
rows are judged alike; they count in the references as often as they occur. An empty table gives an empty result. A language whose
words are all rare, or that is written without spaces, has no common words: its word distance is then zero
and its classes alone are judged. Further columns of docs, whatever their names, are packed into one struct.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD_BREAK, checkpointed, joined_by_hot_key, let, settled, small, text_of

COMMON_WORDS = 24
COMMON_SHARE = 1 / 500
#: Hashes by which words are counted first.
BUCKETS = 1 << 16
#: Fewest words from which the distances count.
MIN_WORDS = 50
MOST_CLASS_DISTANCE = 0.30
MOST_WORD_DISTANCE = 0.55
#: References (some 40 numbers and words each) that may be broadcast; more are joined by a shuffle.
BROADCAST_LANGUAGES = 10_000
WINDOW = 8
CLASSES = {"upper": r"\p{Lu}", "digit": "[0-9]", "mark": r"[.,;:!?'\"()\[\]{}/_=+@~^-]", "symbol": "[#*$%&|<>]"}


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, WORD_BREAK, -1), "")


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """Words that lie in a window of so many words (a power of two) which occurs twice or more in tokens."""

    def covered(at: Column) -> Column:
        return F.aggregate(F.transform(at, lambda x, i: F.least(F.lit(window), F.coalesce(F.get(at, i + 1) - x, F.lit(window)))), F.lit(0), lambda a, x: a + x)

    def twice(order: Column) -> Column:
        again = F.filter(order, lambda s, i: (F.get(order, i - 1)["hash"] == s["hash"]) | (F.get(order, i + 1)["hash"] == s["hash"]))
        return let(F.array_sort(F.transform(again, lambda s: s["at"])), covered)

    def count(hashes: Column) -> Column:
        order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("hash"), i.alias("at"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(order, twice))

    def doubled(each: Column, n: int) -> Column:
        return let(each, lambda h: F.zip_with(F.slice(h, 1, F.size(h) - n), F.slice(h, n + 1, F.size(h) - n), lambda a, b: F.xxhash64(a, b)))

    def windows(each: Column) -> Column:
        # Hashes of one word, two, four and eight words, each from two of the size before.
        n = 1
        while n < window:
            each, n = doubled(each, n), 2 * n
        return each

    hashes = let(F.transform(tokens, lambda w: F.xxhash64(w)), windows)
    return F.when(F.size(tokens) < window, F.lit(0)).otherwise(let(hashes, count))


def _classes(text: Column, tokens: Column) -> Column:
    """Characters of each class: those of CLASSES, white space, and all others."""

    def rest(counts: Column) -> Column:
        return F.concat(counts, F.array(F.length(text).cast("long") - F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)))

    space = (F.length(text) - F.length(F.array_join(tokens, ""))).cast("long")
    return let(F.array(*[F.regexp_count(text, F.lit(p)).cast("long") for p in CLASSES.values()], space), rest)


def js_distance(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of counts; 0 if either is empty."""

    def term(x: Column, m: Column) -> Column:
        return F.when((x <= 0) | (m <= 0), F.lit(0.0)).otherwise(x * F.log2(x / m))

    total = lambda h: F.aggregate(h, F.lit(0.0), lambda a, x: a + x)
    pair = F.struct(p.cast("array<double>").alias("p"), q.cast("array<double>").alias("q"))

    def distance(b: Column) -> Column:
        def norm(n: Column) -> Column:
            each = F.zip_with(b["p"], b["q"], lambda x, y: term(x / n["p"], (x / n["p"] + y / n["q"]) / 2) + term(y / n["q"], (x / n["p"] + y / n["q"]) / 2))
            return F.when((n["p"] <= 0) | (n["q"] <= 0), F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.lit(0.0), total(each) / 2)))

        return let(F.struct(total(b["p"]).alias("p"), total(b["q"]).alias("q")), norm)

    return let(pair, distance)


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, words, word_counts, class_counts), a row per language of docs; the last of word_counts are all other words.

    Distinct words can be nearly as many as words, so they aren't counted one by one: words are counted by BUCKETS hashes first, a table
    of fixed size per language, and a common word can only be one of a bucket that is common; then the words of common
    buckets are counted exactly.
    """
    base = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), text_of(text_col).alias("text"))
    each = base.select("lang", F.explode(words(F.lower("text"))).alias("word")).withColumn("bucket", F.pmod(F.xxhash64("word"), F.lit(BUCKETS)).cast("int"))
    buckets = checkpointed(each.groupBy("lang", "bucket").agg(F.count("*").alias("n"), F.sum(F.length("word").cast("long")).alias("chars")))
    sums = buckets.groupBy("lang").agg(F.sum("n").alias("total"), F.sum("chars").alias("word_chars"))
    shown = base.groupBy("lang").agg(F.sum(F.length("text").cast("long")).alias("chars"), *[F.sum(F.regexp_count("text", F.lit(p)).cast("long")).alias(f"c_{name}") for name, p in CLASSES.items()])
    zero = lambda name: F.coalesce(name, F.lit(0).cast("long"))
    inner = [F.col(f"c_{name}") for name in CLASSES]
    others = zero("word_chars")
    for c in inner:
        others = others - c
    totals = shown.join(sums, "lang", "left").select("lang", zero("total").alias("total"), F.array(*inner, F.col("chars") - zero("word_chars"), others).alias("class_counts"))
    totals = checkpointed(totals)
    # At most 1 / COMMON_SHARE buckets and words of a language.
    common = lambda df: df.join(totals.select("lang", "total"), "lang").filter(F.col("n") >= COMMON_SHARE * F.col("total"))
    heavy = checkpointed(common(buckets).select("lang", "bucket"))
    counted = checkpointed(each.join(small(heavy), ["lang", "bucket"], "left_semi").groupBy("lang", "word").agg(F.count("*").alias("n")))
    best = common(counted).groupBy("lang").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word"))), 1, COMMON_WORDS).alias("best"))
    most = F.coalesce(F.transform("best", lambda b: -b["n"]), F.array().cast("array<bigint>"))
    rest = F.col("total") - F.aggregate(most, F.lit(0).cast("long"), lambda a, x: a + x)
    return totals.join(best, "lang", "left").select("lang", F.coalesce("best.word", F.array().cast("array<string>")).alias("words"), F.concat(most, F.array(rest)).alias("word_counts"), "class_counts")


def judged(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", refs: DataFrame | None = None) -> DataFrame:
    """(row, rules): the row of docs as a struct, and its counts, both distances, base_failed and kept.

    refs: references of another table; a language that they lack has distance zero.
    """
    refs = checkpointed(references(docs, text_col, lang_col)) if refs is None else refs
    refs = refs.select(F.col("lang").alias("__lang"), F.struct("words", "word_counts", "class_counts", F.coalesce(F.array_max(F.transform("words", F.length)), F.lit(0)).alias("longest")).alias("__ref"))
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), text_of(text_col).alias("__text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("__lang"))
    if refs.count() <= BROADCAST_LANGUAGES:
        held = packed.join(F.broadcast(refs), "__lang", "left")
    else:
        held = joined_by_hot_key(packed, refs, "__lang", ["__text"], "left")
    held = held.withColumn("__words", words(F.col("__text")))
    lines = F.filter(F.split("__text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # No longer word than the longest common one can be counted below.
    short = F.filter(words(F.lower("__text")), lambda w: F.length(w) <= F.col("__ref.longest"))
    hits = let(short, lambda s: F.transform("__ref.words", lambda w: (F.size(s) - F.size(F.array_remove(s, w))).cast("long")))
    spread = let(hits, lambda h: F.concat(h, F.array(F.size("__words").cast("long") - F.aggregate(h, F.lit(0).cast("long"), lambda a, x: a + x))))
    out = held.withColumn("__classes", _classes(F.col("__text"), F.col("__words"))).withColumn(
        "__counts",
        F.struct(
            F.size("__words").cast("long").alias("n_words"),
            (F.length("__text") - F.col("__classes")[len(CLASSES)]).cast("long").alias("word_chars"),
            F.col("__classes")[list(CLASSES).index("symbol")].alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            repeated_words(F.col("__words")).cast("long").alias("n_repeat_words"),
            F.coalesce(F.round(js_distance(F.col("__classes"), F.col("__ref.class_counts")), 6), F.lit(0.0)).alias("class_distance"),
            F.coalesce(F.round(js_distance(spread, F.col("__ref.word_counts")), 6), F.lit(0.0)).alias("word_distance"),
        ),
    )
    c = lambda name: F.col(f"__counts.{name}")
    failed = (c("n_words") < 20) | (100 * c("n_repeat_words") > 30 * c("n_words"))
    far = (c("n_words") >= MIN_WORDS) & ((c("class_distance") > MOST_CLASS_DISTANCE) | (c("word_distance") > MOST_WORD_DISTANCE))
    return out.select("row", settled(F.struct("__counts.*", failed.alias("base_failed"), (~failed & ~far).alias("kept"))).alias("rules"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns and both distances."""
    return judged(docs.select("doc_id", "text", "lang")).select("row.doc_id", "rules.*")


def _sql_js(p: str, q: str) -> str:
    """js_distance of two DuckDB lists of equal length, rounded."""
    x, y = f"{p}[i] / list_sum({p})", f"{q}[i] / list_sum({q})"
    term = lambda v: f"(CASE WHEN {v} <= 0 THEN 0 ELSE {v} * log2({v} / (({x} + {y}) / 2)) END)"
    return f"round(CASE WHEN coalesce(list_sum({p}), 0) <= 0 OR coalesce(list_sum({q}), 0) <= 0 THEN 0 ELSE sqrt(greatest(0, list_sum(list_transform(range(1, len({p}) + 1), lambda i: {term(x)} + {term(y)})) / 2)) END, 6)"


def oracle_sql() -> str:
    """digest in DuckDB."""
    lit = lambda t: "'" + t.replace("'", "''") + "'"
    names = [*CLASSES, "space"]
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lang, '') AS lang FROM documents),
    w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words, {", ".join(f"len(regexp_extract_all(t, {lit(p)}))::DOUBLE AS c_{n}" for n, p in (CLASSES | {"space": r"[\x20\x09-\x0D]"}).items())} FROM d),
    c AS (SELECT *, len(words) AS n_words, [{", ".join(f"c_{n}" for n in names)}, length(t) - ({" + ".join(f"c_{n}" for n in names)})] AS own FROM w),
    win AS (SELECT doc_id, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS g FROM (SELECT doc_id, words, unnest(range(1, n_words - {WINDOW - 2})) AS i FROM c WHERE n_words >= {WINDOW})),
    again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
    covered AS (SELECT doc_id, sum(n) AS n FROM (SELECT doc_id, least({WINDOW}, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, {WINDOW})) AS n FROM again) GROUP BY doc_id),
    totals AS (SELECT lang, sum(n_words) AS total, [{", ".join(f"sum(own[{i + 1}])" for i in range(len(names) + 1))}] AS class_ref FROM c GROUP BY lang),
    common AS (SELECT lang, word, n FROM (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(string_split_regex(lower(t), '[\x20\x09-\x0D]+')) AS word FROM d) WHERE length(word) > 0 GROUP BY ALL) JOIN totals USING (lang) WHERE n >= {COMMON_SHARE}::DOUBLE * total QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) <= {COMMON_WORDS}),
    lists AS (SELECT lang, list(word ORDER BY n DESC, word) AS rw, list(n::DOUBLE ORDER BY n DESC, word) AS rn FROM common GROUP BY lang),
    refs AS (SELECT lang, class_ref, coalesce(rw, []) AS rw, list_append(coalesce(rn, []), total - coalesce(list_sum(rn), 0))::DOUBLE[] AS word_ref FROM totals LEFT JOIN lists USING (lang)),
    s AS (SELECT *, list_transform(words, lambda x: lower(x)) AS short FROM c),
    h AS (SELECT *, list_transform(rw, lambda x: len(list_filter(short, lambda y: y = x)))::DOUBLE[] AS hits FROM s JOIN refs USING (lang)),
    m AS (SELECT *, list_append(hits, n_words - coalesce(list_sum(hits), 0))::DOUBLE[] AS word_own, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM h),
    r AS (SELECT doc_id, n_words, CAST(length(t) - c_space AS BIGINT) AS word_chars, CAST(c_symbol AS BIGINT) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, CAST(coalesce(covered.n, 0) AS BIGINT) AS n_repeat_words,
        {_sql_js("own", "class_ref")} AS class_distance, {_sql_js("word_own", "word_ref")} AS word_distance FROM m LEFT JOIN covered USING (doc_id))
    SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
        NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT (n_words >= {MIN_WORDS} AND (class_distance > {MOST_CLASS_DISTANCE} OR word_distance > {MOST_WORD_DISTANCE})) AS kept FROM r"""


def keep_good(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with their own columns."""
    return judged(docs).filter("rules.kept").select("row.*")
