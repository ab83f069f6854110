"""Micro-tables: positives, near misses, duplicates and properties."""

import pytest
from pyspark.sql import functions as F

from siftwell.functions import rules as R
from siftwell.functions.patterns import java
from siftwell.operators import audit, banners, detect, extract, files, findings, headers, history, redact, urls
from siftwell.plans import seeds
from siftwell.sources import captures

PAGE = "page_id long, service string, url string, html string"


def one(spark, html, url="http://a.onion/", service="a.onion"):
    return spark.createDataFrame([(1, service, url, html)], PAGE)


def test_every_pattern_rule_has_a_page_that_shows_it(spark):
    pages = spark.createDataFrame([(n, "s", f"http://s/{n}", t) for n, t in enumerate(seeds.SNIPPETS)], PAGE)
    rules = R.catalogue()
    seen = {r["type"] for r in detect.detect(pages, rules).select("type").distinct().collect()}
    missing = {r.id for r in rules} - seen
    # Rules whose snippet isn't among the seeds have one here.
    more = {
        "tor_v2_private_key": "RSA1024 x PRIVATE KEY", "ec_private_key": "-----BEGIN EC PRIVATE KEY-----", "encrypted_private_key": "-----BEGIN ENCRYPTED PRIVATE KEY-----", "dsa_private_key": "-----BEGIN DSA PRIVATE KEY-----",
        "openssh_private_key": "-----BEGIN OPENSSH PRIVATE KEY-----", "aws_secret_key": "aws_secret_access_key='" + "A" * 40 + "'", "swagger_json": "swagger.json", "postman_collection": "x.postman_collection.json",
        "internal_api_version": "/internal/v2", "laravel_debug": "APP_DEBUG: true", "crypto_monero": "4" + "0" + "1" * 93, "crypto_zcash_shielded": "zs" + "a" * 76, "aws_lambda": "x.lambda-url.eu.on.aws", "aws_cognito": "cognito-idp.eu.amazonaws.com",
        "gcp_cloud_functions": "eu-x.cloudfunctions.net", "gcp_appengine": "x.appspot.com", "azure_functions": "x.azurestaticapps.net", "cloudflare_r2": "x.r2.dev", "bunny_cdn": "x.b-cdn.net", "digitalocean_app": "x.ondigitalocean.app",
        "fingerprint_webrtc_datachannel": "createDataChannel(", "development_mode": "debug mode", "crypto_bitcoin_legacy": "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "social_whatsapp": "https://wa.me/491", "crypto_litecoin_legacy": "LhK2kQwiaAvhjWY799cZvMyYwnQAcxkarr",
    }
    extra = spark.createDataFrame([(n, "s", "u", t) for n, t in enumerate(more.values())], PAGE)
    seen |= {r["type"] for r in detect.detect(extra, rules).select("type").distinct().collect()}
    assert missing - seen == set()


@pytest.mark.parametrize(("html", "rule"), [("UA-123-1", "analytics_google_analytics_ua"), ("AKIA123", "aws_access_key"), ("xgithub_token", "github_token"), ("0x1234", "crypto_ethereum"), ("example-web-app", "gcp_firebase")])
def test_near_misses(spark, html, rule):
    assert rule not in {r["type"] for r in detect.detect(one(spark, html), R.catalogue()).collect()}


def test_literals_do_not_change_results(spark):
    pages = spark.createDataFrame([(n, "s", f"http://s/{n}", t) for n, t in enumerate(seeds.SNIPPETS)], PAGE)
    rules = R.catalogue()
    key = lambda rs: sorted((r["page_id"], r["rule_no"], r["value"]) for r in detect.detect(pages, rs).collect())
    assert key(rules) == key([r._replace(literals=(), run=False) for r in rules])


def test_secrets_never_leave_in_full(spark):
    token = "ghp_" + "a1B2" * 10
    found = detect.detect(one(spark, f"x {token} postgres://u:hidden@h/db"), R.catalogue()).collect()
    assert found and all(token not in r["value"] and "hidden" not in r["value"] for r in found)


def test_null_and_empty_pages(spark):
    pages = spark.createDataFrame([(1, None, None, None), (2, "s", "", "")], PAGE)
    assert detect.all_findings(pages).count() == 0
    assert extract.links(pages).count() == 0


def test_canonical_urls(spark):
    table = {"HTTP://EX.com": "http://ex.com/", "http://ex.com/a#b": "http://ex.com/a", "http://EX.com?q": "http://ex.com/?q", "http://ex.com/A": "http://ex.com/A"}
    got = {r["u"]: r["c"] for r in spark.createDataFrame([(u,) for u in table], "u string").select("u", urls.canonical(F.col("u")).alias("c")).collect()}
    assert got == table


def test_resolution(spark):
    base = "http://h.onion/a/b.html?x=1"
    table = {"c.html": "http://h.onion/a/c.html", "/d": "http://h.onion/d", "//o.org/e": "http://o.org/e", "?y": "http://h.onion/a/b.html?y", "#f": None, "mailto:a@b": None, "https://z.org": "https://z.org", "javascript:x()": None}
    got = {r["h"]: r["t"] for r in spark.createDataFrame([(h,) for h in table], "h string").select("h", urls.resolve(F.lit(base), F.col("h")).alias("t")).collect()}
    assert got == table


@pytest.mark.parametrize(("glob", "path", "takes"), [("/admin/*", "/admin", True), ("/admin/*", "/admin/x/y", True), ("/admin/*", "/administer", False), ("*.pdf", "/docs/f.pdf", True), ("/api/v?", "/api/v1", True), ("/api/v?", "/api/v12", False), ("*", "/a/b", True)])
def test_globs(glob, path, takes):
    import re

    assert bool(re.search(urls.glob_regex(glob), path)) is takes


def test_addresses(spark):
    v3 = "a" * 54 + "id"
    table = {v3: "v3", v3.upper() + ".ONION": "v3", "a" * 56: "invalid", "abcdefghijklmnop": "v2", "http://abcdefghijklmnop.onion/x?y": "v2", "short": "invalid"}
    got = {r["a"]: r["c"] for r in spark.createDataFrame([(a,) for a in table], "a string").select("a", urls.address_class(F.col("a")).alias("c")).collect()}
    assert got == table


def test_breadth_first_depth_cycles_and_budget(spark):
    links = spark.createDataFrame([("s", "/", "/about"), ("s", "/", "/contact"), ("s", "/about", "/"), ("s", "/about", "/deep")], "service string, src string, dst string")
    seeds_ = spark.createDataFrame([("s", "/")], "service string, node string")
    got = {r["node"]: r["depth"] for r in urls.breadth_first(links, seeds_).collect()}
    assert got == {"/": 0, "/about": 1, "/contact": 1, "/deep": 2}
    assert urls.breadth_first(links, seeds_, budget=2).count() == 2


FINDING = "service string, type string, title string, severity int, value string, location string, seq long"


def test_worst_severity_wins_and_dedup_is_idempotent(spark):
    rows = [("s", "t", "T", 1, "v", "/a", 1), ("s", "t", "T", 3, "v", "/b", 2), ("s", "t", "T", 3, "v", "/c", 3)]
    frame = spark.createDataFrame(rows, FINDING)
    out = findings.dedup_worst(frame, ["service"])
    r = out.collect()
    assert [(x["severity"], x["location"], x["pages_hit"]) for x in r] == [(3, "/b", 3)]
    assert findings.dedup_worst(out.drop("pages_hit"), ["service"]).drop("pages_hit").collect() == out.drop("pages_hit").collect()
    assert findings.dedup_key(frame, ["service"]).count() == 3
    assert sorted(findings.dedup_worst(frame.repartition(3), ["service"]).collect()) == sorted(r)


def test_comparison_adds_up(spark):
    a = spark.createDataFrame([("s", "t", "T", 1, str(n), "/", n) for n in range(5)], FINDING)
    b = spark.createDataFrame([("s", "t", "T", 1, str(n), "/", n) for n in range(3, 9)], FINDING)
    states = {r["state"]: r["count"] for r in history.compared(a, b).groupBy("state").count().collect()}
    assert states == {"new": 4, "resolved": 3, "unchanged": 2}
    assert history.risk_change(a, b).first()["direction"] == "WORSENED (risk increased)"


def test_headers_and_policies(spark):
    h = {"content-security-policy": ["default-src 'self'; default-src x.org; img-src https://b.org:8/p"], "server": []}
    pages = spark.createDataFrame([(1, "s", "u", "", h), (2, "s", "u", "", None)], PAGE + ", headers map<string,array<string>>")
    got = {(r["page_id"], r["type"], r["value"]) for r in headers.audit(pages).collect()}
    assert (1, "csp_external_domain", "b.org") in got and (1, "csp_external_domain", "x.org") not in got and (2, "missing_x_frame_options", "x-frame-options") in got


def test_masking(spark):
    table = {"Authorization": "x", "user_token": "x", "note": "hello", "id": "A" * 32, "jwt": "eyJa.eyJb.c", "primary_key": "1"}
    got = spark.createDataFrame([(table,)], "m map<string,string>").select(redact.attributes(F.col("m")).alias("m")).first()["m"]
    assert {k for k, v in got.items() if v == redact.MASK} == {"Authorization", "user_token", "id", "jwt"}


def test_banners_without_text(spark):
    rows = spark.createDataFrame([("s", "ssh", 22, True, None), ("s", "mysql", 3306, True, None)], "service string, protocol string, port int, detected boolean, banner string")
    assert {r["type"] for r in banners.banner_findings(rows).collect()} == {"mysql_open"}
    assert banners.detected_services(rows).first()["services"] == ["SSH (22)", "MySQL (3306)"]


def test_document_fields(spark):
    rows = spark.createDataFrame([("a", "/Author (J\\(D\\)) /ModDate (D:2024Z)"), ("b", "<dc:creator><rdf:li>Me Too</rdf:li>")], "path string, body string")
    assert {(r["type"], r["value"]) for r in files.document_metadata(rows).collect()} >= {("pdf_xmp_creator", "Me Too")}


def test_reports_skip_broken_lines(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"service":"s","scan_id":1,"scanned_at":"2025-01-01T00:00:00Z","findings":[{"type":"t","severity":1,"title":"T","value":"v","location":"l"}]}\nnot json\n')
    scans, found = captures.read_reports(spark, str(tmp_path))
    assert scans.count() == 1 and found.first()["value"] == "v"


@pytest.mark.parametrize(("pattern", "text", "hit"), [("b$", "ab\n", False), ("a.b", "a\rb", True), (r"\bx1\b", "éx1é", True)])
def test_dialect(spark, pattern, text, hit):
    assert spark.createDataFrame([(text,)], "t string").filter(F.col("t").rlike(java(pattern))).count() == int(hit)


def test_fan_out_and_point_reads(spark, tmp_path):
    crawls = spark.createDataFrame([("/a", "s", 1), ("/a", "t", 2)], "url string, service string, n int")
    captures.write_all(crawls, [lambda f: f.write.parquet(str(tmp_path / "p")), lambda f: f.write.json(str(tmp_path / "j"))])
    assert spark.read.parquet(str(tmp_path / "p")).count() == spark.read.json(str(tmp_path / "j")).count() == 2
    assert captures.crawl_at(crawls, "/a", "s").first()["n"] == 1


def test_site_defaults_do_not_leak(spark):
    sites = spark.createDataFrame([("a", None, 0, {"x": "1"}, [], ["/f/*"]), ("b", "c=1", 3, None, None, None)], "site string, cookie string, depth int, headers map<string,string>, ignore array<string>, follow array<string>")
    got = {r["site"]: r for r in urls.with_defaults(sites, {"cookie": "d", "depth": 9, "headers": {"x": "0", "y": "2"}, "ignore": ["/i"]}).collect()}
    assert got["a"]["headers"] == {"x": "1", "y": "2"} and got["b"]["headers"] == {"x": "0", "y": "2"}
    assert (got["a"]["cookie"], got["a"]["depth"], got["a"]["ignore"], got["a"]["follow"]) == ("d", 9, ["/i"], ["/f/*"])
    assert (got["b"]["cookie"], got["b"]["depth"], got["b"]["follow"]) == ("c=1", 3, [])


def test_results_do_not_depend_on_partitions(spark):
    pages = spark.createDataFrame([(n, "s", f"http://s/{n}", t) for n, t in enumerate(seeds.SNIPPETS)], PAGE)
    rows = lambda p: sorted(map(tuple, detect.all_findings(p).collect()))
    assert rows(pages.repartition(7, "page_id")) == rows(pages.coalesce(1).orderBy(F.desc("page_id")))


def test_a_repeated_write_of_a_scan_replaces_it(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, "t", 1, "T", "v", "/"), ("t", 2, "t", 1, "T", "v", "/")], "service string, scan_id long, type string, severity int, title string, value string, location string")
    for frame in (rows, rows.filter("scan_id = 2")):
        captures.write_scan(frame, str(tmp_path / "scans"))
    assert sorted(r["scan_id"] for r in spark.read.parquet(str(tmp_path / "scans")).collect()) == [1, 2]


def test_the_whole_audit_takes_missing_parts(spark):
    schema = PAGE + ", headers map<string,array<string>>"
    pages = spark.createDataFrame([(1, None, None, None, None), (2, "a.onion", "http://a.onion/", "", {}), (4, "a.onion", "http://a.onion/4", "@Some_One_1 x@y.zz @some_one_1", {}), (3, "a.onion", "http://a.onion/3", '<script src="https://C.net/2.js"></script> x@y.zz', None)], schema)
    got = {(r["service"], r["type"], r["value"], r["page_id"]) for r in audit.audit_all(pages).collect()}
    assert {("a.onion", "external_script", "https://C.net/2.js", 3), ("a.onion", "email", "x@y.zz", 3), ("a.onion", "csp_missing", "No CSP header present", 2), ("a.onion", "social_twitter_handle", "@Some_One_1", 4)} <= got
    assert audit.audit_all(pages.limit(0)).count() == 0
