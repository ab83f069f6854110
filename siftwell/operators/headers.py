"""Response-header checks over pages (page_id, service, url, headers: map of lower-case name to values)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.rules import CRITICAL, HIGH, INFO, LOW, MEDIUM  # noqa: F401

from . import redact
from .extract import csp

# Fixed values.
OS_TOKENS = [("ubuntu", "Ubuntu"), ("debian", "Debian"), ("centos", "CentOS"), ("red hat", "Red Hat"), ("fedora", "Fedora"), ("win32", "Windows"), ("win64", "Windows")]
IIS_WINDOWS = [("7.0", "Windows Server 2008/Vista"), ("7.5", "Windows Server 2008 R2/Windows 7"), ("8.0", "Windows Server 2012/Windows 8"), ("8.5", "Windows Server 2012 R2/Windows 8.1"), ("10.0", "Windows Server 2016/2019/Windows 10")]
SESSION_NAMES = ["session", "sess", "sid", "phpsessid", "jsessionid", "asp.net_sessionid", "cfid", "cftoken"]
COMMON_CDNS = ["cloudflare.com", "cloudflare-ipfs.com", "cdnjs.cloudflare.com", "jsdelivr.net", "unpkg.com", "googleapis.com", "gstatic.com", "bootstrapcdn.com", "maxcdn.bootstrapcdn.com", "fontawesome.com"]
# End of the fixed values.

HITS = "array<struct<type:string,severity:int,value:string>>"


def value(name: str) -> Column:
    """The first value of a header; null if there is none or it is empty."""
    return F.nullif(F.get(F.col("headers")[name], 0), F.lit(""))


def values(name: str) -> Column:
    """All values of a header, whatever the case of its name; null if there is none."""
    return F.col("headers")[name.lower()]


def _hits(checks: list[tuple[str, Column | int, Column, Column]]) -> Column:
    """Array of (type, severity, value) of the checks (type, severity, test, value) that hold."""
    return F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), _hit(F.lit(t), s, v)) for t, s, test, v in checks]))


def _hit(type_: Column, severity: Column | int, value: Column) -> Column:
    return F.struct(type_.alias("type"), (F.lit(severity) if isinstance(severity, int) else severity).cast("int").alias("severity"), value.alias("value"))


def _rows(pages: DataFrame, *hits: Column) -> DataFrame:
    """(page_id, service, url, type, severity, value) of the arrays hits, from one scan."""
    return pages.select("page_id", "service", "url", F.inline(F.flatten(F.array(*[F.coalesce(h, F.array().cast(HITS)) for h in hits]))))


def etag_hits() -> Column:
    v = value("etag")
    return _hits([("etag_tracking", F.when(F.octet_length(v) > 20, HIGH).otherwise(MEDIUM), v.isNotNull(), v), ("etag_inode", MEDIUM, v.contains("-") & ~v.startswith("W/"), v)])


def content_policy_hits() -> Column:
    v, report = value("content-security-policy"), value("content-security-policy-report-only")
    outer = F.filter(F.regexp_extract_all(v, F.lit(r"https?://[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"), F.lit(0)), lambda x: ~x.contains(".onion"))
    return _hits([
        ("csp_missing", MEDIUM, v.isNull() & report.isNull(), F.lit("No CSP header present")),
        ("csp_unsafe_inline", MEDIUM, v.contains("'unsafe-inline'"), F.lit("'unsafe-inline'")),
        ("csp_unsafe_eval", MEDIUM, v.contains("'unsafe-eval'"), F.lit("'unsafe-eval'")),
        ("csp_external_allowed", MEDIUM, F.size(outer) > 0, v),
    ])


def policy_domain_hits() -> Column:
    """Outside domains of the policy, and where it reports to."""
    v = value("content-security-policy")
    sources = F.flatten(F.map_values(F.map_filter(csp(v), lambda k, _: k != "report-uri")))
    named = F.transform(F.filter(sources, lambda x: x.rlike(r"^(?:https?://)?[A-Za-z0-9*.-]+\.[A-Za-z]{2,}") & ~x.contains(".onion")), lambda x: F.lower(F.regexp_replace(x, r"^https?://|[/:].*$", "")))

    def of(domain: Column) -> Column:
        cdn = F.exists(F.array(*map(F.lit, COMMON_CDNS)), lambda name: domain.endswith(name))
        return _hit(F.when(cdn, "csp_cdn").otherwise("csp_external_domain"), F.when(cdn, INFO).otherwise(MEDIUM), domain)

    where = F.get(csp(v)["report-uri"], 0)
    return F.concat(F.coalesce(F.transform(F.array_distinct(named), of), F.array().cast(HITS)), _hits([("csp_report_uri", HIGH, where.isNotNull() & ~where.contains(".onion"), where)]))


def cookies_hits() -> Column:
    v = value("set-cookie")
    low, shown = F.lower(v), redact.cookie(v)
    session = F.lit(False)
    for name in SESSION_NAMES:
        session = session | low.contains(name)
    return _hits([
        ("cookie_no_httponly", MEDIUM, ~low.contains("httponly"), shown),
        ("cookie_no_samesite", LOW, ~low.contains("samesite"), shown),
        ("session_linkability", HIGH, session & ~low.contains("expires") & low.contains("max-age"), shown),
    ])


def transport_hits() -> Column:
    v = value("strict-transport-security")
    return _hits([("hsts_on_onion", LOW, v.isNotNull(), v), ("hsts_preload", MEDIUM, F.lower(v).contains("preload"), v)])


def server_hits() -> Column:
    v = value("server")
    low = F.lower(v)
    apache = low.contains("apache")
    nginx = ~apache & low.contains("nginx")
    iis = ~apache & ~nginx & (low.contains("microsoft-iis") | low.contains("iis/"))
    lighttpd = ~apache & ~nginx & ~iis & low.contains("lighttpd")
    system = F.coalesce(*[F.when(low.contains(t), F.lit(n)) for t, n in OS_TOKENS])
    windows = F.coalesce(*[F.when(v.contains(f"IIS/{n}"), F.lit(f"{w} (IIS {n})")) for n, w in IIS_WINDOWS])
    return _hits([
        ("server_version", LOW, v.contains("/"), v),
        ("os_detected", LOW, apache & system.isNotNull(), system),
        ("openssl_version", LOW, apache & low.contains("openssl"), v),
        ("php_version", LOW, apache & low.contains("php/"), v),
        ("nginx_version", INFO, nginx & v.contains("/"), v),
        ("iis_windows_version", LOW, iis & windows.isNotNull(), windows),
        ("lighttpd_server", INFO, lighttpd, v),
    ])


def technology_hits() -> Column:
    return _hits([(t, LOW, value(h).isNotNull(), value(h)) for t, h in (("x_powered_by", "x-powered-by"), ("via_header", "via"), ("aspnet_version", "x-aspnet-version"))])


def missing_hits() -> Column:
    return _hits([(f"missing_{h.replace('-', '_')}", INFO, value(h).isNull(), F.lit(h)) for h in ("content-security-policy", "x-frame-options", "x-content-type-options")])


def _named(n: Column, v: Column) -> Column:
    line = F.concat(n, F.lit(": "), v)
    brief = F.concat(n, F.lit(": "), redact.shortened(v, 50))
    either = lambda *parts: F.greatest(*[n.contains(p) for p in parts]) if len(parts) > 1 else n.contains(parts[0])
    is_server = n == "server"
    return _hits([
        ("api_version_header", LOW, n.contains("api-version"), line),
        ("debug_header", MEDIUM, n.contains("debug"), brief),
        ("cloudflare_header", MEDIUM, n.contains("cf-ray"), line),
        ("aws_header", MEDIUM, either("x-amz-", "x-amzn-"), brief),
        ("azure_header", MEDIUM, either("x-azure-", "x-ms-"), brief),
        ("gcp_header", MEDIUM, either("x-goog-", "x-guploader-"), brief),
        ("cloudflare_server", MEDIUM, is_server & F.lower(v).contains("cloudflare"), v),
        ("aws_server", MEDIUM, is_server & (F.lower(v).contains("awselb") | F.lower(v).contains("amazonec2")), v),
    ])


def named_hits() -> Column:
    """Checks on header names: API versions, debugging, cloud providers."""
    return F.flatten(F.transform(F.map_entries("headers"), lambda e: _named(e["key"], F.coalesce(F.get(e["value"], 0), F.lit("")))))


def status_page_hits(answered: Column | None = None) -> Column:
    """Captured Apache status pages of services whose server says Apache; answered tells which pages came with status 200, where that is known."""
    shown = "Apache Server Status|Server Version:|Server MPM:|Current Time:|Restart Time:|Total accesses:|CPU Usage:|requests/sec"
    hit = F.col("url").contains("/server-status") & F.lower(value("server")).contains("apache") & F.col("html").rlike(shown)
    return _hits([("apache_mod_status", HIGH, hit if answered is None else hit & answered, F.col("url"))])


def _answered(pages: DataFrame) -> Column | None:
    return F.col("status_code") == 200 if "status_code" in pages.columns else None


def status_pages(pages: DataFrame) -> DataFrame:
    return _rows(pages, status_page_hits(_answered(pages)))


def etag(pages: DataFrame) -> DataFrame:
    return _rows(pages, etag_hits())


def content_policy(pages: DataFrame) -> DataFrame:
    return _rows(pages, content_policy_hits())


def policy_domains(pages: DataFrame) -> DataFrame:
    return _rows(pages, policy_domain_hits())


def cookies(pages: DataFrame) -> DataFrame:
    return _rows(pages, cookies_hits())


def transport(pages: DataFrame) -> DataFrame:
    return _rows(pages, transport_hits())


def server(pages: DataFrame) -> DataFrame:
    return _rows(pages, server_hits())


def technology(pages: DataFrame) -> DataFrame:
    return _rows(pages, technology_hits())


def missing(pages: DataFrame) -> DataFrame:
    return _rows(pages, missing_hits())


def named(pages: DataFrame) -> DataFrame:
    return _rows(pages, named_hits())


def all_hits(pages: DataFrame) -> list[Column]:
    """Every header check, as columns over pages."""
    return [etag_hits(), content_policy_hits(), policy_domain_hits(), cookies_hits(), transport_hits(), server_hits(), technology_hits(), missing_hits(), named_hits(), status_page_hits(_answered(pages))]


def audit(pages: DataFrame) -> DataFrame:
    """All header findings, from one scan."""
    return _rows(pages, *all_hits(pages))
