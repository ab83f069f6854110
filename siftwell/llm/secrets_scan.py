"""Secret scans with corpus-wide ownership frequency, in built-in functions only.

Base patterns find assignments, access keys and long hex runs. Wider generators propose further candidates:
vendor-prefixed tokens, signed web tokens, private-key headers and values given to credential-like names.
Every candidate's value is hashed in the projection that finds it (no found text is stored or shuffled) and counted over
the whole corpus by distinct repositories and distinct owners; (hash, owner, repository) is made distinct
map-side first. A value is widely copied from COPIED_OWNERS owners or COPIED_REPOSITORIES repositories on: an
example, a template, a test key. A value is live if it looks live (enough characters, enough distinct ones,
digits and letters mixed, no placeholder word) and isn't widely copied: one or two owners in few repositories.
Live wider candidates become spans; base spans stay whatever their frequency, which separates them into live and
copied ones too (n_live, n_copied). A private key's value is its body, not the header line.

By default the repository is the column ``repository`` if there is one, else ``source``; the owner is what stands before the
first slash of the repository's name. Both are parameters.

Null or empty text has no spans. Very long texts are searched whole. Repeated rows each have their own result and count
once (one owner, one repository). A null owner counts as one owner. Ties can't occur: counts are compared with fixed
bounds. An empty table gives an empty result. Further columns of docs, whatever their names, don't matter:
only the id, the text and the expressions for owner and repository are read, and ``redacted`` packs the row away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import checkpointed, joined_by_hot_key, keyed, let, small, text_of
from .spans import merged, replaced, spans, written

#: Owners and repositories from which on a value counts as a widely copied example.
COPIED_OWNERS, COPIED_REPOSITORIES = 3, 6
#: The fewest characters and distinct characters of a live-looking value.
LIVE_CHARS, LIVE_DISTINCT = 16, 8

NAMES = "password|passwd|secret|token|api_?key"
ASSIGN = rf"""(?i:{NAMES})["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]++"""
VALUE = rf"""^(?i:{NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
#: Shorter matches are dropped without a second try, which is to match only long ones: a part of a run never outgrows it.
ACCESS = "AKIA[A-Z0-9]{16,}+"
HEX = "(?<![0-9a-f])[0-9a-f]{24,}+"
PLACEHOLDER = "(?i)example|sample|dummy|changeme|placeholder|xxxx|your[-_]|test[-_]|1234567|abcdef"

#: White space, also as the escapes of a string in source code.
BREAK = r"(?:\s|\\[rnt])"

WIDER = {
    "vendor": r"(?<![A-Za-z0-9])(?:gh[pousr]_[A-Za-z0-9]{20,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_(?:live|test)_[A-Za-z0-9]{16,}+|AIza[A-Za-z0-9_-]{30,}+|glpat-[A-Za-z0-9_-]{16,}+)",
    "signed": r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+",
    # The header, then what there is of the key: header fields, lines of 16 characters or more, and a last line before the end line.
    "pem": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP |ENCRYPTED )?PRIVATE KEY(?: BLOCK)?-----"
    rf"(?:{BREAK}*+(?:Proc-Type|DEK-Info|Version|Comment|Hash): [^\r\n\\]*+)*+(?:{BREAK}*+[A-Za-z0-9+/=]{{16,}}+)*+"
    rf"(?:{BREAK}*+[A-Za-z0-9+/=]*+{BREAK}*+(?:=[A-Za-z0-9+/]{{4}}{BREAK}*+)?-----END [A-Z ]*PRIVATE KEY(?: BLOCK)?-----)?",
    "named": r"""(?i:access[-_]?key|private[-_]?key|client[-_]?id|auth|credential|pwd|bearer)["']?\x20*[:=]?\x20*["']?(?=[A-Za-z0-9+/_.=-]{16})[A-Za-z0-9+/_.=-]++""",
}


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each base kind; the value of an assignment needs six characters."""
    low = F.lower(text)
    named = low.contains("pass") | low.contains("secret") | low.contains("token") | low.contains("api")
    assign = F.filter(spans(text, ASSIGN, named), lambda s: F.length(F.regexp_extract(s["found"], VALUE, 1)) >= 6)
    return {"assign": assign, "access": spans(text, ACCESS, text.contains("AKIA")), "hex": spans(text, HEX)}


def wider_spans(text: Column) -> dict[str, Column]:
    low = F.lower(text)
    named = low.rlike("key|client|auth|credential|pwd|bearer")
    return {
        "vendor": spans(text, WIDER["vendor"], text.rlike("gh[pousr]_|xox|sk_|AIza|glpat-")),
        "signed": spans(text, WIDER["signed"], text.contains("eyJ")),
        "pem": spans(text, WIDER["pem"], text.contains("PRIVATE KEY")),
        "named": spans(text, WIDER["named"], named),
    }


def _value(kind: Column, found: Column) -> Column:
    """The secret itself: what follows the name and its sign."""
    tail = F.regexp_extract(found, r"""([A-Za-z0-9+/_.=-]+)$""", 1)
    assigned = F.regexp_extract(found, VALUE, 1)
    body = F.regexp_replace(F.regexp_replace(found, "-----[A-Z ]+-----", ""), BREAK, "")
    return F.when(kind == "assign", assigned).when(kind == "named", tail).when(kind == "pem", body).otherwise(found)


def looks_live(kind: Column, value: Column) -> Column:
    distinct = F.size(F.array_distinct(F.split(value, "")))
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    strong = (F.length(value) >= LIVE_CHARS) & (distinct >= LIVE_DISTINCT) & mixed
    return (strong & ~value.rlike(PLACEHOLDER)) | (kind == "pem")


def candidates(docs: DataFrame, id_col: str, text_col: str, owner: Column, repository: Column) -> DataFrame:
    """A row per row of docs, small and materialised: base spans, wider spans (hashes in place of what was found), owner, repository and the text's hash."""
    text = text_of(text_col)

    def slim(s: Column) -> Column:
        return let(_value(s["kind"], s["found"]), lambda v: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["stop"].alias("stop"), s["kind"].alias("kind"), F.sha2(v, 256).alias("hash"), looks_live(s["kind"], v).alias("live")))

    found = docs.select(
        F.col(id_col).alias("doc_id"),
        F.xxhash64(text).alias("text_hash"),
        F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
        F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
        F.transform(merged(base_spans(text)), slim).alias("base"),
        F.transform(merged(wider_spans(text)), slim).alias("wider"),
    )
    return checkpointed(found)


def ownership(found: DataFrame) -> DataFrame:
    """(hash, owners, repositories): over the whole corpus, for every candidate value."""
    each = found.filter((F.size("base") > 0) | (F.size("wider") > 0)).select("owner", "repository", F.explode(F.concat("base.hash", "wider.hash")).alias("hash"))
    pairs = each.distinct().groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return pairs.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | None = None, repository: Column | None = None) -> DataFrame:
    """(doc_id, text_hash, base, spans, n_live, n_copied, most_owners, most_repositories): spans are base ones and the wider ones that passed.

    most_owners and most_repositories are the widest spread of any value in the text, 0 without one.
    """
    repository = F.col("repository" if "repository" in docs.columns else "source") if repository is None else repository
    owner = F.substring_index(repository.cast("string"), "/", 1) if owner is None else owner
    found = candidates(docs, id_col, text_col, owner, repository)
    some = found.filter((F.size("base") > 0) | (F.size("wider") > 0)).select("doc_id", "text_hash", F.explode(F.array_distinct(F.concat("base", "wider"))).alias("s")).distinct()
    some = checkpointed(some.select("doc_id", "text_hash", "s", F.col("s.hash").alias("hash"), F.col("s.start").alias("at")))
    # One value may stand in a third of all documents: its rows are dealt over many tasks.
    told = joined_by_hot_key(some, ownership(found), "hash", ["doc_id", "text_hash", "at"])
    # A header without a key has no value that could be copied.
    bare = (F.col("s.kind") == "pem") & (F.col("hash") == F.sha2(F.lit(""), 256))
    copied = ((F.col("owners") >= COPIED_OWNERS) | (F.col("repositories") >= COPIED_REPOSITORIES)) & ~bare
    own = F.col("s.live") & ~copied
    is_base = F.col("s.kind").isin("assign", "access", "hex")
    # What a row of docs gets back is at most one entry per candidate of its own text.
    verdict = told.groupBy("doc_id", "text_hash").agg(
        F.collect_list(F.when(own & ~is_base, F.col("s"))).alias("added"),
        F.sum(own.cast("long")).alias("n_live"),
        F.sum(copied.cast("long")).alias("n_copied"),
        F.max("owners").alias("most_owners"),
        F.max("repositories").alias("most_repositories"),
    )
    left, right = found.alias("l"), verdict.alias("r")
    both = left.join(right, F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_hash") == F.col("r.text_hash")), "left")
    added = F.coalesce("r.added", F.array().cast(found.schema["base"].dataType))
    numbers = [F.coalesce(f"r.{c}", F.lit(0)).alias(c) for c in ("n_live", "n_copied", "most_owners", "most_repositories")]
    return both.select("l.doc_id", "l.text_hash", "l.base", F.array_sort(F.concat("l.base", F.array_except(added, F.col("l.base")))).alias("spans"), *numbers)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns, n_live, n_copied, most_owners and most_repositories."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scanned(docs).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), "n_live", "n_copied", "most_owners", "most_repositories")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span of a secret replaced in the text, and n_chars, if there, counted anew."""
    found = checkpointed(scanned(docs, id_col, text_col).filter(F.size("spans") > 0).select("doc_id", "text_hash", "spans").dropDuplicates(["doc_id", "text_hash"]))
    same = F.col("key_id").eqNullSafe(F.col("doc_id")) & (F.col("key_hash") == F.col("text_hash"))
    # Where few documents hold secrets they are broadcast and the texts stay where they are.
    both = keyed(docs, id_col, text_col).join(small(found), same, "left")
    text = F.col("row")[text_col]
    clean = F.when(F.col("spans").isNull(), text).otherwise(replaced(text, F.col("spans"), F.lit(mark)))
    out = {c: F.col("row")[c] for c in docs.columns} | {text_col: clean}
    if "n_chars" in docs.columns:
        out["n_chars"] = F.when(F.col("spans").isNull(), F.col("row.n_chars")).otherwise(F.length(clean).cast(docs.schema["n_chars"].dataType))
    return both.select(*[c.alias(n) for n, c in out.items()])
