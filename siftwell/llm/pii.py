"""Personal data by candidate gradient boosting, in built-in functions only.

Base patterns with their checks (octets, Luhn, digit counts) give spans that always stay. High-recall generators propose
more, overlapping spans: spelled-out and bracketed addresses, other separators, numbers without the international
sign, numbers inside longer runs of digits. Every candidate has a set of format and context bits; none of them is one
of the checks. Boosted trees of depth two tell from the bits how likely a candidate is personal data.

What the trees learn from doesn't depend on the base patterns:

* ``planted()``: texts made by a fixed rule, PLANTED of each form, that say where their personal data stands. Every kind
  has negatives, also such as pass the kind's check: versions, prices, order and part numbers, ranges and measures,
  sentences with "at" and "dot" (file names, places, ellipses).
* all candidates of the corpus whose label is plain: what is left without its disguise fails the kind's check (octets, check
  sum, digit count, a domain that ends in letters), or passes it beside a word that speaks for it. One that
  passes without such a word is not labelled. Their weight is at most that of the planted rows.

Both enter as a table of distinct bit sets with counts, whose size the number of features bounds. A fifth of both, by
hash, is held out; per kind and form (plain, disguised or spelled out in bare words) the threshold is the lowest score from which on MOST_SURE of the
held-out weight is personal data. Candidates from there on that also pass the kind's check become spans, unless a base
span or an earlier candidate of their kind overlaps them. ``report`` gives held-out precision and recall.

Null or empty text has no spans. Very long texts are searched whole, in time linear in their candidates. Repeated rows each
have their own result. Of candidates that start together the longest comes first. In an empty table the trees
learn from the planted rows alone. Further columns of docs, whatever their names, are not read; ``redacted`` packs them away.
"""

from __future__ import annotations

import math
import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import checkpointed, keyed, settled, small, text_of
from .spans import merged, replaced, spans, written

KINDS = ("email", "ip", "card", "phone")
ROUNDS, RATE = 60, 0.3
#: The share of held-out weight above a threshold that is personal data, the fewest held-out candidates that show it, and the least score.
MOST_SURE, LEAST_SEEN, LEAST_SCORE = 0.95, 10, 0.5
#: Characters of context on either side, and planted texts per form.
CONTEXT, PLANTED = 24, 240

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
OCTETS = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])$"

_AT = r"\x20?(?:@|[\[({]\x20?(?:at|AT|@)\x20?[\])}])\x20?"
_DOT = r"(?:\.|\x20?[\[({]\x20?(?:dot|DOT|\.)\x20?[\])}]\x20?|\x20(?:dot|DOT)\x20)"
_LOCAL, _LABEL = r"[A-Za-z0-9._%+-]{1,64}", r"[A-Za-z0-9-]{1,63}"
#: (kind, pattern, a literal test without which it can't match).
GENERATORS = [
    ("email", rf"(?<![A-Za-z0-9._%+-]){_LOCAL}{_AT}{_LABEL}(?:{_DOT}{_LABEL}){{1,8}}+", r"@|[\[({]\x20?(?:at|AT)\x20?[\])}]"),
    ("email", rf"(?<![A-Za-z0-9._%+-]){_LOCAL}(?:\x20(?:dot|DOT)\x20{_LOCAL}){{0,3}}\x20(?:at|AT)\x20{_LABEL}(?:\x20(?:dot|DOT)\x20{_LABEL}){{1,8}}+", r"\x20(?:dot|DOT)\x20"),
    ("ip", rf"(?<![0-9.])[0-9]{{1,3}}+(?:{_DOT}[0-9]{{1,3}}+){{3}}(?![0-9])", None),
    ("card", r"(?<![0-9])[0-9]{4}(?:[\x20._/-]{0,2}[0-9]{4}){3}(?![0-9])", None),
    ("card", r"(?<![0-9])3[0-9]{3}[\x20._/-]?[0-9]{6}[\x20._/-]?[0-9]{5}(?![0-9])", None),
    ("phone", r"(?<![0-9+.-])(?:(?:\+|00)[\x20.-]?[0-9]{1,3}[\x20./-]?)?\(?[0-9]{3}\)?[\x20./-]?[0-9]{3}[\x20./-][0-9]{4}(?![0-9])", None),
    ("phone", r"(?<![0-9+.-])(?:\+[0-9]{1,3}[\x20./-]?)?\(?0[1-9][0-9]{1,4}\)?[\x20/-][0-9]{3,4}[\x20-]?[0-9]{3,5}(?![0-9])", None),
]
HINTS = {
    "email": (r"mail|contact|write|reply|reach|from:|to:", r"price|each|cost|meet|look|arrive|version|commit"),
    "ip": (r"\bip\b|host|server|addr|from|client|login|node|peer", r"version|release|build|section|chapter|update|firmware|\bv$"),
    "card": (r"card|visa|master|amex|pay|credit|debit|charge", r"order|track|serial|isbn|part|invoice|account|ref|item|batch"),
    "phone": (r"tel|phone|call|fax|mobile|dial|ring|reach|sms", r"order|isbn|part|invoice|serial|ref|item|model|batch|track"),
}


def _luhn(digits: Column) -> Column:
    """Whether the digits' check sum is right."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int")) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10 == 0


def _card(s: Column) -> Column:
    digits = F.regexp_replace(s["found"], "[^0-9]", "")
    return F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)


def base_spans(text: Column) -> dict[str, Column]:
    return {
        "email": spans(text, EMAIL, text.contains("@")),
        "ip": F.filter(spans(text, IP), lambda s: s["found"].rlike(OCTETS)),
        "card": F.filter(spans(text, CARD), _card),
        "phone": F.filter(spans(text, PHONE, text.contains("+")), lambda s: F.length(F.regexp_replace(s["found"], "[^0-9]", "")).between(9, 15)),
    }


def checked(kind: str, s: Column) -> Column:
    """Whether a candidate, without its disguise, passes the check of its kind."""
    if kind == "card":
        return _card(s)
    if kind == "phone":
        return F.length(F.regexp_replace(s["found"], "[^0-9]", "")).between(9, 15)
    plain = F.regexp_replace(F.regexp_replace(s["found"], rf"(?:{_AT}|\x20(?:at|AT)\x20)", "@"), _DOT, ".")
    return plain.rlike(OCTETS) if kind == "ip" else plain.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,24}$")


#: Names of the feature bits, lowest first.
FEATURES = ("hint", "counter_hint", "hint_after", "left_open", "left_joined", "right_open", "right_joined", "disguised", "spelled", "spaced", "letters_last", "even_groups", "first_high", "marked", "long_last", "known_end", "plain_name", "bare_words")
DISGUISED, BARE = 1 << FEATURES.index("disguised"), 1 << FEATURES.index("bare_words")
HINTED = 1 << FEATURES.index("hint") | 1 << FEATURES.index("hint_after")
#: Endings of domains that are common; an address with another one needs other evidence.
ENDINGS = "com|org|net|edu|gov|mil|int|info|biz|name|app|dev|io|me|tv|ai|eu|de|fr|es|uk|it|nl|be|ch|at|pl|pt|se|no|fi|dk|cz|ru|ua|us|ca|mx|br|ar|cl|co|in|cn|jp|kr|au|nz|za|ie|gr|hu|ro|tr|il"


def _bits(kind: str, s: Column) -> Column:
    """The features of a candidate as the bits of an int."""
    found, before, after = s["found"], F.lower(s["before"]), F.lower(s["after"])
    left, right = F.right(before, F.lit(1)), F.left(after, F.lit(1))
    hint, against = HINTS[kind]
    tests = (
        before.rlike(hint),
        before.rlike(against),
        after.rlike(hint),
        (left == "") | left.rlike(r"[\s\"'(<\[:;,=]"),
        left.rlike(r"[\p{L}0-9_.#/-]"),
        (right == "") | right.rlike(r"[\s\"')>\];,.!?]"),
        right.rlike(r"[\p{L}0-9_/-]"),
        found.rlike(r"[\[({]\x20?(?:at|AT|dot|DOT|@|\.)\x20?[\])}]|\x20(?:at|AT|dot|DOT)\x20") if kind in ("email", "ip") else found.rlike(r"[0-9][._/][0-9]"),
        found.rlike("(?i)at|dot") if kind == "ip" else found.rlike(r"[\[({\x20](?:at|AT|dot|DOT)[\])}\x20]"),
        found.contains(" "),
        found.rlike(r"[A-Za-z]{2,6}$"),
        found.rlike(r"^[^)]*[0-9]{3}([\x20./-]?)[0-9]{3}\1[0-9]{4}$") if kind == "phone" else found.rlike(r"^[0-9]{4}([\x20._/-]{0,2})[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"),
        found.rlike("^[^0-9]*[2-9]" if kind == "phone" else "^[^0-9]*[3-6]"),
        found.rlike(r"^(?:\+|00|\()|\)"),
        found.rlike(r"(?:\.|dot)[\])}\x20]*[0-9]{3}$") if kind == "ip" else found.rlike(r"[A-Za-z0-9]{4,}$"),
        found.rlike(rf"(?i)[^A-Za-z](?:{ENDINGS})$") if kind == "email" else after.rlike(r"^\x20?(?:tons?|kg|km|miles?|euros?|dollars?|pieces|people|rows|%)"),
        found.rlike("^[a-z]+[^A-Za-z0-9._%+-]") if kind == "email" else before.rlike(r"(?:see|about|some|only|from|than|over|nearly|of)\x20$"),
        found.rlike(r"\x20(?:at|AT)\x20") if kind == "email" else F.lit(False),
    )
    total = F.lit(0)
    for n, test in enumerate(tests):
        total = total + F.when(test, 1 << n).otherwise(0)
    return total


def candidates(text: Column) -> Column:
    """All candidates of a text: array of (start, rank, stop, kind, bits, sound), sound being the check of their kind."""

    def told(n: int) -> Column:
        kind, pattern, test = GENERATORS[n]
        found = spans(text, pattern, None if test is None else text.rlike(test), CONTEXT)
        return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), s["stop"].alias("stop"), F.lit(kind).alias("kind"), _bits(kind, s).alias("bits"), checked(kind, s).alias("sound")))

    return F.array_distinct(F.concat(*[told(n) for n in range(len(GENERATORS))]))


# --- what the trees learn from ------------------------------------------------------------------------------------

_NAMES = ["anna.berg", "j.ruiz", "tom", "lee_wong", "info", "m-dupont", "sara99", "office", "k.tanaka", "noor"]
_HOSTS = ["example", "mail-host", "uni", "northwind", "acme", "web3", "firma", "correo"]
_ENDS = ["com", "org", "net", "de", "fr", "es", "io", "edu"]
_WORDS = ["and", "then", "ouvert", "heute", "casa", "the", "river", "list", "mit", "pour", "often", "leaf"]
_VERBS = ["look", "met", "arrived", "stayed", "work", "ended", "started", "waiting", "stop", "laugh", "shown", "bought"]
_PLACES = ["node", "noon", "london", "night", "home", "line", "page", "server", "point", "market", "example", "river"]
_FILES = ["js", "py", "txt", "cfg", "dot", "park", "street", "zero", "exe", "png", "md", "five"]
#: Frames that speak for no kind, and those that name measures.
_NEUTRAL = ["{w} {} {w}", "{w} {w} {} for it", "he {w} {} and {w}", "{w} {w}: {}. {w}", "{} {w} {w}"]
_MEASURES = ["see {} tons", "about {} people", "from {} to {w}", "{w} {} km", "only {} {w}", "{w} {} {w}"]
_AROUND = {
    "email": ["write to {} for more", "contact: {}", "e-mail {} today", "{w} {} {w}", "({})", "{w} {w}: {}. {w}", "{}"],
    "ip": ["host {} is up", "login from {} failed", "server {}", "{w} {} {w}", "addr={}", "({})", "{w} {w}: {}. {w}"],
    "card": ["card {} exp", "visa {}", "pay with {} now", "{w} {} {w}", "credit card: {}", "{w} {w}: {}. {w}"],
    "phone": ["call {} now", "tel. {}", "phone: {}", "{w} {} {w}", "fax {} or", "({w}) {}", "{w} {w}: {}. {w}"],
}
_AGAINST = {
    "email": ["price {} each", "meet {w} {}", "{w} {} {w}", "commit {}"],
    "ip": ["version {}", "release {} is out", "firmware build {}", "see section {} and", "{w} v{} {w}", "{w}-{}-{w}"],
    "card": ["order {} sent", "tracking {}", "serial no {}", "invoice {} of", "isbn {}", "item-{}", "{w}_{} {w}", "ref {}"],
    "phone": ["order {} sent", "isbn {}", "part no {}", "serial {} is", "invoice {}", "{w}-{}-{w}", "ref {}", "model {}"],
}


def _with_check_digit(digits: str) -> str:
    total = sum(sum(divmod(2 * int(d), 10)) if i % 2 == 0 else int(d) for i, d in enumerate(reversed(digits)))
    return digits + str(-total % 10)


def _values(rng: random.Random) -> list[tuple[str, str, bool]]:
    """(kind, value, personal) of every form once."""
    name, host, end = rng.choice(_NAMES), rng.choice(_HOSTS), rng.choice(_ENDS)
    octets = [str(rng.randrange(1, 256)) for _ in range(4)]
    wild = [str(rng.randrange(256, 999)), *octets[1:]]
    card = _with_check_digit(rng.choice("3456") + "".join(rng.choices("0123456789", k=14)))
    fours = [card[i : i + 4] for i in range(0, 16, 4)]
    stray = "".join(rng.choices("0123456789", k=16))
    a, b, c = str(rng.randrange(200, 990)), str(rng.randrange(200, 990)), f"{rng.randrange(10000):04}"
    at, dot = rng.choice([" [at] ", "[at]", "(at)", " (at) ", "{at}", " [AT] "]), rng.choice([" [dot] ", "[dot]", "(dot)", " (dot) ", "[.]", " dot "])
    plain_dot = rng.choice(["[.]", "(.)", " [dot] ", "[dot]", " dot "])
    verb, place = rng.choice(_VERBS), rng.choice(_PLACES)
    return [
        ("email", f"{name}@{host}.{end}", True),
        ("email", f"{name} @ {host}.{end}", True),
        ("email", f"{name}{at}{host}{dot}{end}", True),
        ("email", f"{name}{at}{host}.{end}", True),
        ("email", f"{name} at {host} dot {end}", True),
        ("email", f"{rng.randrange(1, 90)} @ {rng.randrange(1, 90)}.{rng.randrange(10, 99)}", False),
        ("email", f"{rng.choice(_WORDS)}@{rng.randrange(1, 9)}.{rng.randrange(10)}", False),
        ("email", f"{rng.choice(_WORDS)} (at) {rng.choice(_WORDS)}.{rng.randrange(10, 99)}", False),
        ("email", f"{rng.choice(_WORDS)} at {rng.choice(_WORDS)} dot {rng.randrange(10)}", False),
        ("email", f"{verb} at {place} dot {rng.choice(_ENDS)}", False),
        ("email", f"{verb} at {place} dot {rng.choice(_FILES)}", False),
        ("email", f"{rng.choice(_NAMES)} at {place} dot {rng.choice(_FILES)}", False),
        ("email", f"{verb} at {place}" + " dot" * rng.randrange(2, 5), False),
        ("email", f"{verb} (at) {place}.{rng.choice(_FILES)}", False),
        ("email", f"{verb} [at] {place} [dot] {rng.choice(_FILES)}", False),
        ("ip", ".".join(octets), True),
        ("ip", plain_dot.join(octets), True),
        ("ip", ".".join(wild), False),
        ("ip", plain_dot.join(wild), False),
        ("card", "".join(fours), True),
        ("card", rng.choice(" -").join(fours), True),
        ("card", rng.choice("._/").join(fours), True),
        ("card", "".join(fours) + f" {rng.randrange(10, 99)}", True),
        ("card", stray, False),
        ("card", rng.choice(" -._/").join(stray[i : i + 4] for i in range(0, 16, 4)), False),
        ("phone", f"+{rng.randrange(1, 99)} {a} {b} {c}", True),
        ("phone", f"00{rng.randrange(1, 99)} {a} {b} {c}", True),
        ("phone", f"({a}) {b}-{c}", True),
        ("phone", f"{a}{(s := rng.choice('-. '))}{b}{s}{c}", True),
        ("phone", f"0{a} {b}{c}", True),
        ("phone", f"{rng.randrange(100, 990)} {b}-{c}", False),
        ("phone", f"{rng.randrange(100, 200)}{(t := rng.choice(' .'))}{b}{t}{c}", False),
        ("phone", f"{a}-{b} {c}", False),
    ]


def planted(seed: int = 11, rounds: int = PLANTED) -> list[tuple[int, str, str, int, int]]:
    """(row, text, kind, start, stop): texts that say where their personal data stands (-1: they hold none), by a fixed rule."""
    rng, rows = random.Random(seed), []

    def put(kind: str, value: str, around: str, personal: bool) -> None:
        frame = around
        while "{w}" in frame:
            frame = frame.replace("{w}", rng.choice(_WORDS), 1)
        start = frame.index("{}")
        length = len(value) - 3 if kind == "card" and personal and value[-3] == " " else len(value)
        rows.append((len(rows), frame.replace("{}", value), kind, start if personal else -1, start + length if personal else -1))

    for _ in range(rounds):
        for kind, value, personal in _values(rng):
            bare = kind == "email" and " at " in value
            if not personal and kind == "email" and value.split()[0].split("@")[0] in (*_VERBS, *_NAMES):
                frames = _NEUTRAL
            elif not personal and kind == "phone":
                frames = _MEASURES
            elif personal and bare and value.split()[0].isalpha():
                frames = _AROUND[kind][:3]  # in bare words a plain name is an address only where something says so
            else:
                frames = _AROUND[kind] if personal else _AROUND[kind] + _AGAINST[kind]
            put(kind, value, rng.choice(frames), personal)
            if personal and kind != "email":  # what looks the same where it is something else
                put(kind, value, rng.choice(_AGAINST[kind]), False)
    return rows


class Trees:
    """Boosted trees of depth two over bit sets, for one kind: each is (first bit, bits of its two sides, four leaves)."""

    def __init__(self, bits: np.ndarray, yes: np.ndarray, no: np.ndarray, rounds: int = ROUNDS, rate: float = RATE):
        on = (bits[:, None] >> np.arange(len(FEATURES))) & 1
        weight = yes + no
        self.start = math.log((yes.sum() + 1) / (no.sum() + 1))
        score, self.trees = np.full(len(bits), self.start), []
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-score))
            grad, hess = yes - weight * p, weight * p * (1 - p)

            def gain(rows: np.ndarray, grad: np.ndarray = grad, hess: np.ndarray = hess) -> np.ndarray:
                g, h = (on[rows] * grad[rows, None]).sum(0), (on[rows] * hess[rows, None]).sum(0)
                og, oh = grad[rows].sum() - g, hess[rows].sum() - h
                return g * g / (h + 1) + og * og / (oh + 1)

            top = int(gain(np.arange(len(bits))).argmax())
            tree, step = [top], np.zeros(len(bits))
            for side in (0, 1):
                rows = np.flatnonzero(on[:, top] == side)
                bit = int(gain(rows).argmax()) if len(rows) else 0
                leaves = []
                for value in (0, 1):
                    leaf = rows[on[rows, bit] == value]
                    leaves.append(rate * float(grad[leaf].sum() / (hess[leaf].sum() + 1)))
                    step[leaf] = leaves[-1]
                tree += [bit, *leaves]
            score = score + step
            self.trees.append(tuple(tree))

    def scores(self, bits: np.ndarray) -> np.ndarray:
        total, has = np.full(len(bits), self.start), lambda n: (bits >> n) & 1 == 1
        for top, bit0, a, b, bit1, c, d in self.trees:
            total = total + np.where(has(top), np.where(has(bit1), d, c), np.where(has(bit0), b, a))
        return 1 / (1 + np.exp(-total))

    def column(self, bits: Column) -> Column:
        total, has = F.lit(self.start), lambda n: bits.bitwiseAND(F.lit(1 << n)) != 0
        for top, bit0, a, b, bit1, c, d in self.trees:
            total = total + F.when(has(top), F.when(has(bit1), d).otherwise(c)).otherwise(F.when(has(bit0), b).otherwise(a))
        return 1 / (1 + F.exp(-total))


#: Ends of a candidate may differ by so many characters from those of the planted span.
NEAR = 2


def _cells(spark: SparkSession, found: DataFrame) -> list:
    """Rows (held, kind, bits, yes, made, sound, n) of planted and corpus candidates; at most 2 ** len(FEATURES) bit sets a kind."""
    made = spark.createDataFrame(planted(), "row long, text string, own string, first int, last int")
    put = made.select("row", "own", "first", "last", F.explode(candidates(F.col("text"))).alias("c"))
    true = (F.col("first") >= 0) & (F.abs(F.col("c.start") - F.col("first")) <= NEAR) & (F.abs(F.col("c.stop") - F.col("last")) <= NEAR)
    put = put.filter(F.col("own") == F.col("c.kind")).select(F.xxhash64("row").alias("h"), "c.kind", "c.bits", "c.sound", true.alias("yes"), F.lit(True).alias("made"))
    own = found.select(F.xxhash64("doc_id", "text_hash").alias("h"), F.explode("candidates").alias("c")).select("h", "c.kind", "c.bits", "c.sound", F.col("c.sound").alias("yes"), F.lit(False).alias("made"))
    return put.unionByName(own).groupBy((F.pmod("h", F.lit(5)) == 0).alias("held"), "kind", "bits", "yes", "made", "sound").agg(F.count("*").alias("n")).collect()


def _table(rows: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bits, weight of personal data, weight of others) from (bits, yes, weight)."""
    table: dict[int, list[float]] = {}
    for bits, yes, weight in rows:
        table.setdefault(bits, [0.0, 0.0])[0 if yes else 1] += weight
    keys = sorted(table)
    return np.array(keys, np.int64), np.array([table[b][0] for b in keys]), np.array([table[b][1] for b in keys])


def _forms(bits: np.ndarray) -> list[tuple[str, np.ndarray]]:
    bare = bits & BARE != 0
    return [("plain", (bits & DISGUISED == 0) & ~bare), ("disguised", (bits & DISGUISED != 0) & ~bare), ("bare", bare)]


def fitted(spark: SparkSession, found: DataFrame) -> tuple[dict[str, list[int]], list[tuple[str, str, float, float, float]]]:
    """({kind: the corpus' bit sets that are selected}, [(kind, form, threshold, precision, recall)]); a threshold of 2 is never met.

    Precision is that of what would be selected: candidates that pass their check. It is told from the planted rows; a number of the
    corpus that fails the check sum stands for one ninth of another that passes it by chance. The trees score bit sets, not
    candidates: every bit set of the corpus is in the table of cells, so what is selected is a list of numbers.
    """
    cells, chosen, told = _cells(spark, found), {}, []
    for kind in KINDS:
        every = [r for r in cells if r["kind"] == kind]
        own = [r for r in every if r["made"] or not r["sound"] or r["bits"] & HINTED]  # what passes its check without a hint has no label
        n_made, n_corpus = (sum(r["n"] for r in own if r["made"] is made) for made in (True, False))
        scale = min(1.0, n_made / n_corpus) if n_corpus else 0.0
        trees = Trees(*_table([(r["bits"], r["yes"], r["n"] * (1.0 if r["made"] else scale)) for r in own if not r["held"]]))
        bits, yes, no = _table([(r["bits"], r["yes"], r["n"]) for r in own if r["held"] and r["made"] and r["sound"]] + [(r["bits"], False, r["n"] * scale / 9) for r in own if kind == "card" and r["held"] and not r["made"] and not r["sound"]])
        score, least = trees.scores(bits), []
        for form, part in _forms(bits):
            best = (2.0, 0.0, 0.0)
            for t in sorted({x for x in score[part].tolist() if x >= LEAST_SCORE}, reverse=True):
                at = part & (score >= t - 1e-12)
                y, n = yes[at].sum(), no[at].sum()
                if y >= LEAST_SEEN and y >= MOST_SURE * (y + n):
                    best = (t, float(y / (y + n)), float(y / yes[part].sum()))
            least.append(best[0])
            told.append((kind, form, *best))
        seen = np.array(sorted({r["bits"] for r in every if not r["made"]}), np.int64)
        score, good = trees.scores(seen), np.zeros(len(seen), bool)
        for (_, part), t in zip(_forms(seen), least):
            good |= part & (score >= t - 1e-9)
        chosen[kind] = seen[good].tolist()
    return chosen, told


def searched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per row of docs, small and materialised: base spans and all candidates."""
    text = text_of(text_col)
    slim = F.transform(merged(base_spans(text)), lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind")))
    return checkpointed(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("text_hash"), slim.alias("base"), candidates(text).alias("candidates")))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, str, float, float, float]]:
    """(kind, form, threshold, precision, recall) on the held-out fifth."""
    return fitted(docs.sparkSession, searched(docs, id_col, text_col))[1]


def detected(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, base, spans, n_added): spans are the base ones and the candidates that the trees select."""
    found = searched(docs, id_col, text_col)
    selected, _ = fitted(docs.sparkSession, found)

    def chosen(c: Column) -> Column:
        sure = F.lit(False)
        for kind, bits in selected.items():
            sure = sure | ((c["kind"] == kind) & c["bits"].isin(bits)) if bits else sure
        return c["sound"] & sure

    slim = lambda c: F.struct(c["start"].alias("start"), c["rank"].alias("rank"), c["stop"].alias("stop"), c["kind"].alias("kind"))
    new = found.select("doc_id", "text_hash", "base", settled(F.array_except(F.transform(F.filter("candidates", chosen), slim), F.col("base"))).alias("new")).filter(F.size("new") > 0)
    mark = lambda name, is_base: F.transform(name, lambda c: F.struct(c.alias("s"), F.lit(is_base).alias("is_base")))
    each = new.select("doc_id", "text_hash", F.explode(F.concat(mark("base", True), mark("new", False))).alias("e")).distinct().select("doc_id", "text_hash", "e.s", "e.is_base")
    # Spans of one kind in one text by their start, the longest first: what overlaps a base span or an earlier span goes.
    w = Window.partitionBy("doc_id", "text_hash", "s.kind").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max("s.stop").over(w.orderBy("s.start", F.desc("s.stop")))
    behind = F.min(F.when(F.col("is_base"), F.col("s.start"))).over(w.orderBy(F.desc("s.start"), "s.stop"))
    free = each.withColumn("before", before).withColumn("behind", behind).filter(~F.col("is_base") & (F.coalesce("before", F.lit(0)) <= F.col("s.start")) & (F.col("behind").isNull() | (F.col("behind") >= F.col("s.stop"))))
    added = free.groupBy("doc_id", "text_hash").agg(F.collect_list("s").alias("added"))
    left, right = found.alias("l"), added.alias("r")
    both = left.join(right, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_hash") == F.col("r.text_hash")), "left")
    more = F.coalesce("r.added", F.array().cast(found.schema["base"].dataType))
    return both.select("l.doc_id", "l.text_hash", "l.base", F.array_sort(F.concat("l.base", more)).alias("spans"), F.size(more).cast("long").alias("n_added"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns and n_added."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return detected(docs).select("doc_id", *[count(k) for k in KINDS], F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), "n_added")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[PRIVATE]") -> DataFrame:
    """docs with every detected span replaced in the text."""
    found = checkpointed(detected(docs, id_col, text_col).filter(F.size("spans") > 0).select("doc_id", "text_hash", "spans").dropDuplicates(["doc_id", "text_hash"]))
    same = F.col("key_id").eqNullSafe(F.col("doc_id")) & (F.col("key_hash") == F.col("text_hash"))
    both = keyed(docs, id_col, text_col).join(small(found), same, "left")
    text = F.col("row")[text_col]
    clean = F.when(F.col("spans").isNull(), text).otherwise(replaced(text, F.col("spans"), F.lit(mark)))
    return both.select(*[(clean if c == text_col else F.col("row")[c]).alias(c) for c in docs.columns])
