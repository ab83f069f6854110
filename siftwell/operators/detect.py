"""Content detectors: pages to findings in one scan.

A detector is what it looks for (specs of matching.py) and a function from a page, which holds what was found, to the array of its
findings (HIT). So any number of detectors are one search and one projection of one scan, and its plan stays small
however many rules there are. Values are redacted there.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions import dims
from siftwell.functions import rules as R
from siftwell.functions.patterns import find_first

from . import redact
from .matching import FOUND, Spec, distinct, found

FINDING = ["page_id", "service", "url", "rule_no", "type", "title", "severity", "value", "value_sha256"]
HIT = "struct<rule_no:int,type:string,title:string,severity:int,value:string,value_sha256:string,family:string,category:string>"
RULES = "array<struct<rule_no:int,type:string,title:string,severity:int,family:string,category:string,outer:boolean>>"


class Detector(NamedTuple):
    """of: from a page (a struct, see one_page) to its findings, by what texts and addresses are searched for."""

    of: Callable[[Column], Column]
    text_specs: tuple[Spec, ...] = ()
    url_specs: tuple[Spec, ...] = ()


def one_page(spark: SparkSession, text: Column, detector: Detector, more: list[Column] | None = None) -> Column:
    """What detectors read of a page: its text, never null; its address; what was found in both; and more."""
    text = F.coalesce(text, F.lit(""))
    return F.struct(text.alias("text"), F.col("url").alias("url"), found(spark, text, detector.text_specs).alias("found"), found(spark, F.col("url"), detector.url_specs).alias("found_url"), *(more or []))


def bound(page: Column, of: Callable[[Column], Column]) -> Column:
    """of(page), with page worked out once: named in the lambdas of a detector it would be for every rule and match."""
    return F.flatten(F.transform(F.array(page), of))


def all_of(*detectors: Detector) -> Detector:
    return Detector(lambda p: F.flatten(F.array(*[d.of(p) for d in detectors])), distinct([s for d in detectors for s in d.text_specs]), distinct([s for d in detectors for s in d.url_specs]))


def rows(pages: DataFrame, detector: Detector, text_col: str = "html") -> DataFrame:
    """A row per finding, from one scan."""
    page = one_page(pages.sparkSession, F.col(text_col), detector)
    return pages.select("page_id", "service", "url", page.alias("page")).select("page_id", "service", "url", F.inline(bound(F.col("page"), detector.of)))


def _rule_array(rules: list[R.Rule]) -> Column:
    told = [{"rule_no": n, "type": r.id, "title": r.title, "severity": r.severity, "family": r.family, "category": r.category, "outer": r.type_is_outer} for n, r in enumerate(rules)]
    return F.from_json(F.lit(json.dumps(told)), RULES)


def _or_none(hits: Column, kind: str = HIT) -> Column:
    return F.coalesce(hits, F.array().cast(f"array<{kind}>"))


def _outer(value: Column) -> Column:
    low = F.lower(value)
    return (low.startswith("http://") | low.startswith("https://")) & ~low.contains(".onion")


def _spec(r: R.Rule) -> Spec:
    return Spec(r.id, r.pattern, r.literals, r.group, r.mode, r.fixed, r.run, fold=r.family == "email")


def _of_specs(found_: Column, specs: list[Spec]) -> Column:
    """Of what was found the values of these specs."""
    return F.transform(F.filter(_or_none(found_, FOUND[6:-1]), lambda f: f["key"].isin([s.key for s in specs])), lambda f: f["value"])


def _shown(value: Column, rule: Column) -> Column:
    return (
        F.when(rule["family"] == "keys", redact.key_material(value, rule["type"]))
        .when(rule["family"] == "apileak", redact.leak(value, rule["type"]))
        .when(rule["family"] == "social", redact.shortened(value, 100))
        .otherwise(value)
    )


def email_severity(email: Column) -> Column:
    parts = F.split(email, "@")
    return F.when((F.size(parts) != 2) | F.element_at(parts, -1).isin(*R.FREE_MAIL), R.MEDIUM).otherwise(R.HIGH)


def _hit(rule: Column, value: Column, shown: Column, digest: Column, severity: Column) -> Column:
    return F.struct(rule["rule_no"].alias("rule_no"), rule["type"].alias("type"), rule["title"].alias("title"), severity.cast("int").alias("severity"), shown.alias("value"), digest.alias("value_sha256"), rule["family"].alias("family"), rule["category"].alias("category"))


def rule_hits(rules: list[R.Rule]) -> Detector:
    """What pattern rules find."""
    specs = [_spec(r) for r in rules]
    noise = "|".join(x.replace(".", r"\.") for x in R.SOCIAL_NOISE)

    def of(p: Column) -> Column:
        keys = F.from_json(F.lit(json.dumps([s.key for s in specs])), "array<int>")
        placed = F.transform(_or_none(p["found"], FOUND[6:-1]), lambda f: F.struct(F.array_position(keys, f["key"]).cast("int").alias("n"), f["value"].alias("value")))
        named = F.transform(F.filter(placed, lambda x: x["n"] > 0), lambda x: F.struct(F.get(_rule_array(rules), x["n"] - 1).alias("rule"), x["value"].alias("value")))
        wanted = F.filter(named, lambda x: ((x["rule"]["family"] != "social") | ~F.lower(x["value"]).rlike(noise)) & (~x["rule"]["outer"] | _outer(x["value"])))
        level = lambda r, v: F.when(r["family"] == "email", email_severity(v)).otherwise(r["severity"])
        return F.transform(wanted, lambda x: _hit(x["rule"], x["value"], _shown(x["value"], x["rule"]), F.sha2(x["value"], 256), level(x["rule"], x["value"])))

    return Detector(of, distinct(specs))


def detect(pages: DataFrame, rules: list[R.Rule], text_col: str = "html") -> DataFrame:
    """Findings (FINDING, family, category) of rules over pages (page_id, service, url and the text)."""
    return rows(pages, rule_hits(rules), text_col).select(*FINDING, "family", "category")


def _plain_hits(type_: str, title: str, severity: int, values: Column) -> Column:
    """One finding for each element of the array values, in the shape of rule_hits."""
    named = F.struct(F.lit(-1).alias("rule_no"), F.lit(type_).alias("type"), F.lit(title).alias("title"), F.lit("").alias("family"), F.lit("").alias("category"))
    return _or_none(F.transform(values, lambda v: _hit(named, v, v, F.sha2(v, 256), F.lit(severity))))


def _firsts(items: Column, key: str) -> Column:
    """Of structs that share their first field key the one that comes first by the others."""
    in_order = F.array(F.array_sort(items))
    return F.get(F.transform(in_order, lambda s: F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1)[key] != x[key]))), 0)


def crypto_hits() -> Detector:
    """Currency addresses; one that several rules match belongs to the first rule."""
    rules = rule_hits(R.BY_FAMILY["crypto"])

    def of(p: Column) -> Column:
        each = F.transform(rules.of(p), lambda h: F.struct(h["value"].alias("key"), h["rule_no"].alias("n"), h.alias("hit")))
        return F.transform(_firsts(each, "key"), lambda x: x["hit"])

    return Detector(of, rules.text_specs)


def handle_hits() -> Detector:
    """Handles; of spellings that differ in case the first stays."""
    specs = [Spec("handle", R.HANDLE, ("@",), 1)]

    def of(p: Column) -> Column:
        each = F.filter(_of_specs(p["found"], specs), lambda h: ~F.lower(h).isin(*R.NO_HANDLES))
        first = _firsts(F.transform(each, lambda h, i: F.struct(F.lower(h).alias("key"), i.alias("n"), h.alias("handle"))), "key")
        return _plain_hits("social_twitter_handle", "Twitter/X Handle Reference Found", R.MEDIUM, F.transform(first, lambda x: F.concat(F.lit("@"), x["handle"])))

    return Detector(of, tuple(specs))


def combined_hits() -> Detector:
    specs = [Spec(f"technique {name}", "|".join(parts), tuple(x.lower() for x in parts), mode="flag", fixed=name) for name, parts in R.TECHNIQUES]

    def of(p: Column) -> Column:
        used = _of_specs(p["found"], specs)
        return _plain_hits("fingerprint_combined", "Multiple Fingerprinting Techniques Detected", R.CRITICAL, F.when(F.size(used) >= 3, F.array(F.array_join(used, ", "))))

    return Detector(of, tuple(specs))


def obfuscation_hits() -> Detector:
    specs = [Spec(f"obfuscation {n}", shape, R.OBFUSCATION_LITERALS[n], mode="flag", fixed=shape[:50]) for n, shape in enumerate(R.OBFUSCATION)]

    def of(p: Column) -> Column:
        return _plain_hits("js_obfuscation", "Suspicious JavaScript Obfuscation", R.HIGH, F.slice(_of_specs(p["found"], specs), 1, 1))

    return Detector(of, tuple(specs))


def ipv4_hits() -> Detector:
    """Public IPv4 literals."""
    specs = [Spec("ipv4", R.IPV4, R.IPV4_LITERALS)]
    octet = lambda x, n: F.element_at(F.split(x, r"\."), n).cast("int")

    def public(x: Column) -> Column:
        a, b = octet(x, 1), octet(x, 2)
        valid = F.forall(F.split(x, r"\."), lambda o: o.cast("int") <= 255)
        private = a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
        return valid & ~private

    return Detector(lambda p: _plain_hits("clearnet_ip", "Clearnet IP Address Found", R.CRITICAL, F.filter(_of_specs(p["found"], specs), public)), tuple(specs))


def onion_hits() -> Detector:
    v3, v2 = (Spec(f"onion {n}", rf"(?<![a-z2-7])[a-z2-7]{{{n}}}\.onion", (".onion",), low=True) for n in (56, 16))

    def of(p: Column) -> Column:
        return F.flatten(F.array(_plain_hits("onion_link_v3", "Linked Hidden Service", R.INFO, _of_specs(p["found"], [v3])), _plain_hits("onion_link_v2", "Linked Hidden Service", R.INFO, _of_specs(p["found"], [v2]))))

    return Detector(of, (v3, v2))


def url_hits() -> Detector:
    """Rules for endpoints, documentation and debugging on the page's own URL."""
    rules = [r for r in R.BY_FAMILY["apileak"] if r.category in ("endpoint", "documentation", "debug")]
    specs = [_spec(r)._replace(mode="flag", fixed=str(n)) for n, r in enumerate(rules)]

    def of(p: Column) -> Column:
        met = F.transform(_of_specs(p["found_url"], specs), lambda n: F.get(_rule_array(rules), n.cast("int")))
        return F.transform(met, lambda r: _hit(r, p["url"], redact.leak(p["url"], r["type"]), F.sha2(redact.leak(p["url"], r["type"]), 256), r["severity"]))

    return Detector(of, (), distinct(specs))


def _alone(detector: Detector, pages: DataFrame, text_col: str = "html") -> DataFrame:
    return rows(pages, detector, text_col).select(*FINDING)


def emails(pages: DataFrame) -> DataFrame:
    return _alone(rule_hits(R.BY_FAMILY["email"]), pages)


def keys_in_both(pages: DataFrame, text_col: str = "snapshot", raw_col: str = "raw") -> DataFrame:
    """Key material of the text, then of the raw body where the two differ; of equal (type, shown value) of a page the first. A body that equals its text is not searched again."""
    spark, keys = pages.sparkSession, rule_hits(R.BY_FAMILY["keys"])
    body = F.col(raw_col) if dict(pages.dtypes)[raw_col] == "string" else F.decode(raw_col, "ISO-8859-1")
    text = F.coalesce(F.col(text_col), F.lit(""))
    other = F.when(body != text, body)
    both = pages.select("page_id", "service", "url", one_page(spark, text, keys).alias("page"), one_page(spark, other, keys).alias("more"))
    hits = F.concat(bound(F.col("page"), keys.of), bound(F.col("more"), keys.of))
    placed = F.transform(hits, lambda h, i: F.struct(F.concat_ws("|", h["type"], h["value"]).alias("key"), i.alias("n"), h.alias("hit")))
    once = F.transform(F.array_sort(F.transform(_firsts(placed, "key"), lambda x: F.struct(x["n"], x["hit"]))), lambda x: x["hit"])
    return both.select("page_id", "service", "url", F.inline(once)).select(*FINDING)


def crypto(pages: DataFrame) -> DataFrame:
    return _alone(crypto_hits(), pages)


def handles(pages: DataFrame) -> DataFrame:
    return _alone(handle_hits(), pages)


def combined_fingerprinting(pages: DataFrame) -> DataFrame:
    return _alone(combined_hits(), pages)


def obfuscation(pages: DataFrame) -> DataFrame:
    return _alone(obfuscation_hits(), pages)


def ipv4(pages: DataFrame, text_col: str = "html") -> DataFrame:
    return _alone(ipv4_hits(), pages, text_col)


def onion_links(pages: DataFrame) -> DataFrame:
    return _alone(onion_hits(), pages)


def url_leaks(pages: DataFrame) -> DataFrame:
    return _alone(url_hits(), pages)


#: What a page's path shows by itself, and what its body does.
PRESENCE_URL = {"robots_txt": r"(?i)/robots\.txt(?:\?|$)", "sitemap_xml": r"(?i)/sitemap[^/]*\.xml(?:\?|$)", "hostname_file": r"(?i)/hostname(?:\?|$)", "nginx_status": r"(?i)/nginx_status(?:\?|$)"}
PRESENCE_TEXT = {
    "open_directory": (r"(?i)<title>Index of /", ("<title>index of /",)),
    "form_detected": (r"(?i)<form[\s>]", ("<form",)),
    "pgp_key": (r"-----BEGIN PGP PUBLIC KEY BLOCK-----", ("-----begin pgp public key block-----",)),
    "google_fonts": (r"(?i)fonts\.(?:googleapis|gstatic)\.com", ("fonts.googleapis.com", "fonts.gstatic.com")),
    "websocket_external": (r"(?i)wss?://", ("ws://", "wss://")),
}


def presence_names() -> Detector:
    """Names of what a page shows, as an array of strings."""
    urls = [Spec(f"presence {n}", p, mode="flag", fixed=n) for n, p in PRESENCE_URL.items()]
    texts = [Spec(f"presence {n}", p, lit, mode="flag", fixed=n) for n, (p, lit) in PRESENCE_TEXT.items()]
    return Detector(lambda p: F.concat(_of_specs(p["found_url"], urls), _of_specs(p["found"], texts)), tuple(texts), tuple(urls))


def presence(pages: DataFrame) -> DataFrame:
    names = presence_names()
    page = one_page(pages.sparkSession, F.col("html"), names)
    return pages.select("page_id", "service", "url", page.alias("page")).select("page_id", "service", "url", F.explode(bound(F.col("page"), names.of)).alias("type"))


#: What else of the mapped types a page's body shows.
PRESENCE_MORE = {
    "external_cdn": (r"""(?i)<(?:script|link|img)\s[^>]*(?:src|href)\s*=\s*["']?(?:https?:)?//[a-z0-9.-]*(?:cloudflare\.com|jsdelivr\.net|unpkg\.com|googleapis\.com|gstatic\.com|bootstrapcdn\.com|fontawesome\.com)""", ("cloudflare.com", "jsdelivr.net", "unpkg.com", "googleapis.com", "gstatic.com", "bootstrapcdn.com", "fontawesome.com")),
    "external_api": (r"""(?i)(?:fetch|axios(?:\.[a-z]+)?|\.open|eventsource)\s*\(\s*["'`](?:[a-z]+["']\s*,\s*["'])?https?://""", ("fetch", "axios", ".open", "eventsource")),
}


def presence_findings(pages: DataFrame) -> DataFrame:
    """(page_id, service, url, type, severity): every mapped type that a page's path, body or headers show by themselves, with the mapping's severity."""
    more = [Spec(f"presence {n}", p, lit, mode="flag", fixed=n) for n, (p, lit) in PRESENCE_MORE.items()]
    names = presence_names()
    every = Detector(lambda p: F.concat(names.of(p), _of_specs(p["found"], more)), distinct([*names.text_specs, *more]), names.url_specs)
    head = lambda name: F.nullif(F.get(F.col("headers")[name], 0), F.lit(""))
    shown = F.array_compact(F.array(
        F.when(head("cf-ray").isNotNull() | F.lower(head("server")).contains("cloudflare"), "cloudflare_detected"),
        F.when(head("x-frame-options").isNull(), "x_frame_options"),
        F.when(head("server-timing").isNotNull(), "server_timing"),
    ))
    page = one_page(pages.sparkSession, F.col("html"), every)
    found = pages.select("page_id", "service", "url", page.alias("page"), shown.alias("shown")).select("page_id", "service", "url", F.explode(F.concat(bound(F.col("page"), every.of), "shown")).alias("type"))
    levels = dims.finding_types(pages.sparkSession).filter("type = map_type").select("type", F.col("map_severity").alias("severity"))
    return found.join(F.broadcast(levels), "type").select("page_id", "service", "url", "type", "severity")


def content_hits() -> Detector:
    """Every content detector as one."""
    plain = [r for f in ("keys", "apileak", "cloud", "analytics", "social", "fingerprint", "malicious", "email") for r in R.BY_FAMILY[f]]
    return all_of(rule_hits(plain), crypto_hits(), handle_hits(), combined_hits(), obfuscation_hits(), ipv4_hits(), onion_hits(), url_hits())


def all_findings(pages: DataFrame, extra: list | None = None) -> DataFrame:
    """Every content detector's findings from one scan; extra are further functions from pages to findings, each with a scan of its own."""
    out = rows(pages, content_hits()).select(*FINDING)
    for f in extra or []:
        out = out.unionByName(f(pages).select(*FINDING))
    return out


__all__ = ["all_findings", "combined_fingerprinting", "bound", "content_hits", "crypto", "detect", "emails", "find_first", "handles", "one_page", "ipv4", "obfuscation", "onion_links", "presence", "presence_names", "rows", "rule_hits", "url_leaks"]
