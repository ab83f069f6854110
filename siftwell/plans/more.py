"""Queries whose SQL is written by hand, apart from the rule table: titles, once-per-page rules, outside elements, roll-up, baselines."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import rules as R
from siftwell.operators import audit, detect, extract, findings, headers, history, links, urls

from . import extra  # noqa: F401  (its SQL is part of the audit's)
from . import seeds
from .catalog import FOUND_SQL, IPV4_SQL, ORACLES, TAGS, P, found, pages, plain, query
from .seeds import quoted

#: Written out from the pages that the seeds make: what of each type must be found under which title.
TITLES_SQL = """SELECT page_id, title FROM (
    SELECT page_id, unnest(list_filter([
        CASE WHEN regexp_matches(html, 'UA-[0-9]{4,10}-[0-9]{1,4}') THEN 'Google Analytics UA ID Found' END,
        CASE WHEN regexp_matches(html, 'G-[A-Z0-9]{10,12}') THEN 'Google Analytics 4 ID Found' END,
        CASE WHEN regexp_matches(html, 'GTM-[A-Z0-9]{6,8}') THEN 'Google Tag Manager ID Found' END,
        CASE WHEN regexp_matches(html, '\\bbc1[a-z0-9]{39,59}\\b') THEN 'Bitcoin Bech32 Address Found' END,
        CASE WHEN regexp_matches(html, '\\b0x[a-fA-F0-9]{40}\\b') THEN 'Ethereum Address Found' END,
        CASE WHEN regexp_matches(html, '(?i)(swagger-ui|swaggerui)[^"'']*\\.(js|css|html)|swagger-ui-bundle') THEN 'Swagger UI Exposed' END,
        CASE WHEN regexp_matches(html, '(?i)__schema|__type|introspectionquery') THEN 'GraphQL Introspection Enabled' END,
        CASE WHEN regexp_matches(html, '(?i)(https?://)?[a-z0-9]+\\.cloudfront\\.net') THEN 'AWS CloudFront Distribution Detected' END,
        CASE WHEN regexp_matches(html, '(?i)(https?://)?[a-z0-9-]+\\.vercel\\.app') THEN 'Vercel Deployment Detected' END,
        CASE WHEN regexp_matches(html, '(?i)https?://(www\\.)?keybase\\.io/[A-Za-z0-9_]+') THEN 'Keybase Link Found' END,
        CASE WHEN regexp_matches(html, '(?i)https?://(www\\.)?tiktok\\.com/@[A-Za-z0-9_.]+') THEN 'TikTok Link Found' END
    ], lambda x: x IS NOT NULL)) AS title FROM p)"""
TITLED = [
    "Google Analytics UA ID Found", "Google Analytics 4 ID Found", "Google Tag Manager ID Found", "Bitcoin Bech32 Address Found", "Ethereum Address Found", "Swagger UI Exposed",
    "GraphQL Introspection Enabled", "AWS CloudFront Distribution Detected", "Vercel Deployment Detected", "Keybase Link Found", "TikTok Link Found",
]


@query(P + TITLES_SQL)
def finding_titles(spark, d):
    """Titles of findings by page, for eleven types of five families."""
    rules = [r for f in ("analytics", "crypto", "apileak", "cloud", "social") for r in R.BY_FAMILY[f]]
    return detect.detect(pages(spark, d), rules).filter(F.col("title").isin(TITLED)).select("page_id", "title").distinct()


_once = {"hidden_iframe": R.HIDDEN_IFRAMES, "debug_comments": R.COMMENTS, "error_disclosure": R.ERRORS}


@query(P + " UNION ALL ".join(f"SELECT page_id, '{name}' AS type, 1::BIGINT AS n FROM p WHERE " + " OR ".join(f"regexp_matches(html, {quoted(x)})" for x in each) for name, each in _once.items()))
def once_per_page(spark, d):
    """Findings of the rules that report a page once, whatever number of their patterns match."""
    rules = [r for r in R.BY_FAMILY["malicious"] if r.id in _once]
    return detect.detect(pages(spark, d), rules).groupBy("page_id", "type").agg(F.count("*").alias("n"))


_host = "lower(regexp_extract({}, '^[A-Za-z]+://([^/:?#]+)', 1))"
_out = f"""SELECT service, type, arg_min(src, (page_id, pos)) AS value, min(page_id) AS page_id FROM (SELECT *, {_host.format('src')} AS h FROM (
    SELECT page_id, service, 'external_script' AS type, unnest(l) AS src, generate_subscripts(l, 1) AS pos FROM (SELECT page_id, service, regexp_extract_all(html, {quoted(extract.SCRIPT_SRC)}, 1) AS l FROM p)
    UNION ALL SELECT page_id, service, 'external_image' AS type, unnest(l) AS src, generate_subscripts(l, 1) AS pos FROM (SELECT page_id, service, regexp_extract_all(html, {quoted(extract.IMG_SRC)}, 1) || regexp_extract_all(html, {quoted(extract.ICON)}, 1) AS l FROM p)
)) WHERE h <> '' AND NOT ends_with(h, '.onion') AND h <> service GROUP BY service, type, h"""


@query(TAGS + _out)
def outer_elements(spark, d):
    """Scripts and images from outside, one per service and host."""
    return links.outer_elements(pages(spark, d))


_addresses = "regexp_extract(lower(html), '([a-z2-7]*\\.onion)', 1)"


@query(P + f"SELECT page_id, CASE WHEN regexp_matches(a, '^([a-z2-7]{{54}}[aiqy]d|[a-z2-7]{{16}})\\.onion$') THEN a END AS address FROM (SELECT page_id, {_addresses} AS a FROM p WHERE contains(lower(html), '.onion'))")
def address_in_text(spark, d):
    """The address that ends in the first .onion of a text; none if that is no valid one."""
    return pages(spark, d).filter(F.lower("html").contains(".onion")).select("page_id", urls.address_in_url(F.col("html")).alias("address"))


@query(P + """SELECT DISTINCT service, 'email_address' AS type, 'Email Address Found' AS title, 2 AS severity, lower(unnest(regexp_extract_all(html, '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}'))) AS value FROM p
    UNION ALL SELECT DISTINCT service, 'ethereum_address', 'Ethereum Address', 0, unnest(regexp_extract_all(html, '\\b0x[a-fA-F0-9]{40}\\b')) FROM p
    UNION ALL SELECT DISTINCT service, 'google_analytics_ua', 'Analytics Tracker Detected', 3, unnest(regexp_extract_all(html, 'UA-[0-9]{4,10}-[0-9]{1,4}')) FROM p""")
def rolled_up(spark, d):
    """Identifiers of a service as typed findings."""
    own = pages(spark, d)
    each = detect.detect(own, [r for r in R.catalogue() if r.id in ("email", "crypto_ethereum", "analytics_google_analytics_ua", "cloud_none")])
    return findings.rolled_up(each)


@query(f"SELECT service, type, value, severity FROM ({FOUND_SQL}) WHERE severity >= 3")
def findings_at_least_high(spark, d):
    return findings.at_least(found(spark, d), R.HIGH).select("service", "type", "value", "severity")


#: Scans from orders: a customer is a service, an order a scan.
_ASKED = "SELECT o_custkey AS service, CASE WHEN o_custkey % 3 = 0 THEN -1 WHEN o_custkey % 3 = 1 THEN min(o_orderkey) ELSE min(o_orderkey) + 32 END AS baseline_id FROM orders GROUP BY o_custkey"
_LATEST = "SELECT o_custkey AS service, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS scan_id FROM orders GROUP BY o_custkey"


def _scans(spark, d):
    return spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("service"), F.col("o_orderkey").alias("scan_id"), F.col("o_orderdate").alias("scanned_at"))


@query(f"SELECT a.service, l.scan_id, a.baseline_id, CASE WHEN o.o_orderkey IS NULL THEN 'not found' WHEN o.o_custkey = a.service THEN 'ok' ELSE 'other service' END AS state FROM ({_ASKED}) a JOIN ({_LATEST}) l USING (service) LEFT JOIN orders o ON o.o_orderkey = a.baseline_id")
def baseline_by_id(spark, d):
    """The latest scan of each service against a scan asked for by its number."""
    scans = _scans(spark, d)
    first = scans.groupBy("service").agg(F.min("scan_id").alias("first"))
    asked = first.select("service", F.when(F.col("service") % 3 == 0, F.lit(-1)).when(F.col("service") % 3 == 1, F.col("first")).otherwise(F.col("first") + 32).alias("baseline_id"))
    return history.baseline_by_id(scans, asked)


_counts = ", ".join(f"count(l_orderkey) FILTER (l_linenumber % 5 = {n}) AS {name}_count" for n, name in enumerate(("info", "low", "medium", "high", "critical")))
_each = f"SELECT o_custkey AS service, o_orderkey AS scan_id, o_orderdate AS scanned_at, {_counts}, count(l_orderkey) AS total FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL"
_sides = ", ".join(f"{s}.{c} AS {p}_{c}" for s, p in (("c", "current"), ("b", "previous")) for c in ("scanned_at", "critical_count", "high_count", "medium_count", "low_count", "info_count", "total"))


@query(f"WITH e AS ({_each}) SELECT c.service, c.scan_id, b.scan_id AS baseline_id, {_sides} FROM e c JOIN ({_LATEST}) l ON l.scan_id = c.scan_id JOIN (SELECT o_custkey AS service, min(o_orderkey) AS first FROM orders GROUP BY 1) f ON f.service = c.service JOIN e b ON b.scan_id = f.first WHERE f.first <> c.scan_id")
def comparison_metadata(spark, d):
    """Date, total and counts of the latest scan and of the one with the smallest number."""
    scans = _scans(spark, d)
    lines = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("scan_id"), (F.col("l_linenumber") % 5).cast("int").alias("severity"))
    pairs = history.latest(scans).select("service", "scan_id").join(scans.groupBy("service").agg(F.min("scan_id").alias("baseline_id")), "service").filter("scan_id <> baseline_id")
    return history.metadata(scans, lines.join(scans.select("scan_id", "service"), "scan_id"), pairs)


@query(P + """SELECT page_id, CAST(CASE WHEN page_id % 3 = 0 THEN 404 ELSE 200 END AS INT) AS status_code FROM p WHERE page_id % 3 <> 0 AND contains(lower(coalesce(h_server, '')), 'apache')""")
def status_pages_answered(spark, d):
    """Status pages count only where they were answered with 200: every page here looks like one, a third of them were not found."""
    each = pages(spark, d).withColumn("status_code", F.when(F.col("page_id") % 3 == 0, 404).otherwise(200)).withColumn("url", F.concat(F.col("url"), F.lit("/server-status"))).withColumn("html", F.lit("Apache Server Status"))
    return headers.status_pages(each).select("page_id", F.lit(200).alias("status_code"))


def _of(name: str, type_: str = "type", severity: str = "severity") -> str:
    """The hits of a query's SQL as (page_id, type, severity, value)."""
    return f"SELECT page_id, {type_} AS type, {severity} AS severity, value FROM ({ORACLES[name]})"


_content = [_of(f"seeded_{name}") for name in ("keys", "apileak", "cloud", "analytics", "social", "fingerprint", "malicious", "crypto")]
_content += [_of("email_findings", "'email'"), _of("seeded_handles", "'social_twitter_handle'", "2"), _of("combined_fingerprinting", "'fingerprint_combined'", "4"), _of("js_obfuscation", "'js_obfuscation'", "3"), _of("onion_links", severity="0")]
_content += [f"SELECT page_id, 'clearnet_ip' AS type, 4 AS severity, value FROM ({P + IPV4_SQL})"]
_content += [P + f"SELECT page_id, {quoted(r.id)} AS type, {r.severity} AS severity, left(url, 100) AS value FROM p WHERE regexp_matches(url, {quoted(r.pattern)})" for r in R.BY_FAMILY["apileak"] if r.category in ("endpoint", "documentation", "debug")]
_content += [_of(f"header_{name}") for name in ("etag", "csp", "cookie", "hsts", "server", "technology", "missing", "named")]
_content += [_of("header_policy_domains", severity="CASE type WHEN 'csp_cdn' THEN 0 WHEN 'csp_external_domain' THEN 2 ELSE 3 END"), _of("form_leaks", "'form_action_leak'", "3"), f"SELECT page_id, type, 0 AS severity, '' AS value FROM ({ORACLES['page_presence']})"]
_all_hits = " UNION ALL ".join(f"SELECT * FROM ({x})" for x in _content)


@query(
    f"SELECT service, type, min(severity) AS severity, value, min(page_id) AS page_id FROM (SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS service, h.* FROM ({_all_hits}) AS h JOIN pages USING (page_id)) GROUP BY service, type, value "
    f"UNION ALL SELECT service, 'clearnet_link', severity, value, page_id FROM ({ORACLES['clearnet_links']}) UNION ALL SELECT service, type, 3, value, page_id FROM ({ORACLES['outer_elements']})"
)
def audit_all(spark, d):
    """Every content, header, link and presence check in one scan of the pages, each finding of a service once."""
    return audit.audit_all(pages(spark, d))


#: The title of every type, stated a second time and by itself, so that a change of the rules' titles shows.
_TITLES = """
admin_api|Admin API Endpoint Detected
akamai_cdn|Akamai CDN Detected
analytics_amazon_affiliate|Amazon Affiliate Tag Found
analytics_clarity|Microsoft Clarity ID Found
analytics_facebook_pixel|Facebook Pixel ID Found
analytics_google_adsense|Google AdSense Publisher ID Found
analytics_google_analytics_ga4|Google Analytics 4 ID Found
analytics_google_analytics_ua|Google Analytics UA ID Found
analytics_google_publisher|Google Publisher ID Found
analytics_google_tag_manager|Google Tag Manager ID Found
analytics_hotjar|Hotjar Site ID Found
analytics_matomo|Matomo/Piwik Site ID Found
analytics_yandex_metrica|Yandex Metrica ID Found
apache_mod_status|Apache mod_status Exposed
api_key|API Key Exposed
api_key_exposure|API Key Exposed in Response
api_version_header|API Version Header Exposed
aspnet_version|ASP.NET Version Disclosed
aws_access_key|AWS Access Key ID Found
aws_api_gateway|AWS API Gateway Detected
aws_cloudfront|AWS CloudFront Distribution Detected
aws_cognito|AWS Cognito Endpoint Detected
aws_ec2|AWS EC2 Instance Detected
aws_elb|AWS Elastic Load Balancer Detected
aws_header|AWS Header Detected
aws_lambda|AWS Lambda Function URL Detected
aws_s3_bucket|AWS S3 Bucket Detected
aws_secret_key|AWS Secret Access Key Exposed
aws_server|AWS Server Detected
azure_blob|Azure Blob Storage Detected
azure_cdn|Azure CDN Detected
azure_functions|Azure Functions Detected
azure_header|Azure Header Detected
azure_websites|Azure Web Apps Detected
base64_key_data|Potential Encoded Key Data Found
bearer_token_exposure|Bearer Token Exposed
bunny_cdn|Bunny CDN Detected
certificate_email|TLS Certificate Contains Email Address
certificate_name|TLS Certificate Contains Clearnet Domain
clearnet_ip|Clearnet IP Address Found
clearnet_link|Clearnet Link Found
cloudflare_header|Cloudflare Ray ID Detected
cloudflare_pages|Cloudflare Pages Detected
cloudflare_r2|Cloudflare R2 Storage Detected
cloudflare_server|Cloudflare Server Detected
cloudflare_workers|Cloudflare Workers Detected
config_exposure|Configuration File Exposed
cookie_no_httponly|Cookie Missing HttpOnly Flag
cookie_no_samesite|Cookie Missing SameSite Attribute
crypto_bitcoin_bech32|Bitcoin Bech32 Address Found
crypto_bitcoin_cash|Bitcoin Cash Address Found
crypto_bitcoin_legacy|Bitcoin Address Found
crypto_dash|Dash Address Found
crypto_dogecoin|Dogecoin Address Found
crypto_ethereum|Ethereum Address Found
crypto_litecoin_bech32|Litecoin Bech32 Address Found
crypto_litecoin_legacy|Litecoin Address Found
crypto_monero|Monero Address Found
crypto_zcash_shielded|Zcash Shielded Address Found
crypto_zcash_transparent|Zcash Transparent Address Found
csp_cdn|Common CDN in CSP
csp_external_allowed|CSP Allows External Domains
csp_external_domain|External Domain in CSP
csp_missing|Missing Content Security Policy
csp_report_uri|CSP Report URI Configured
csp_unsafe_eval|CSP Allows Unsafe Eval
csp_unsafe_inline|CSP Allows Unsafe Inline Scripts
database_url|Database Connection URL Exposed
debug_comments|Sensitive HTML Comments Found
debug_console|Console Debug Statements Found
debug_endpoint|Debug Endpoint Exposed
debug_header|Debug Header Detected
debug_sourcemap|Source Map Reference Found
development_mode|Development Mode Detected
digitalocean_app|DigitalOcean App Platform Detected
digitalocean_spaces|DigitalOcean Spaces Detected
django_debug|Django Debug Mode Detected
dsa_private_key|DSA Private Key Exposed
ec_private_key|EC Private Key Exposed
email|Email Address Found
encrypted_private_key|Encrypted Private Key Found
env_file|Environment File Reference Found
error_disclosure|Error Message or Stack Trace Exposed
etag_inode|ETag May Leak Inode Number
etag_tracking|ETag Tracking Risk
external_iframe|External Iframe Detected
external_image|External Image Loaded
external_script|External Script Loaded
fastly_cdn|Fastly CDN Detected
fingerprint_audio_fingerprint|AudioContext Fingerprinting Risk
fingerprint_audio_oscillator|Audio Oscillator Fingerprinting
fingerprint_canvas_getImageData|Canvas Fingerprinting Detected
fingerprint_canvas_toDataURL|Canvas Fingerprinting Detected
fingerprint_combined|Multiple Fingerprinting Techniques Detected
fingerprint_font_detection|Font Detection Fingerprinting
fingerprint_navigator_plugins|Plugin Enumeration Detected
fingerprint_webgl_getParameter|WebGL Fingerprinting Detected
fingerprint_webgl_renderer|WebGL Renderer Fingerprinting
fingerprint_webrtc_datachannel|WebRTC DataChannel Detected
fingerprint_webrtc_peer|WebRTC IP Leak Risk
fingerprint_webrtc_stun|STUN/TURN Server Reference
flask_debug|Flask Debugger Detected
fly_io|Fly.io Deployment Detected
form_action_leak|Form Submits to External URL
form_detected|Form Present
ftp_banner|FTP Banner Disclosed
ftp_hostname|FTP Banner May Contain Hostname
ftp_path|FTP Banner Contains File Path
ftp_software|FTP Software Named
gcp_appengine|Google App Engine Detected
gcp_cloud_functions|Google Cloud Functions Detected
gcp_cloud_run|Google Cloud Run Detected
gcp_firebase|Firebase Hosting/Database Detected
gcp_header|Google Cloud Header Detected
gcp_storage|Google Cloud Storage Detected
github_token|GitHub Token Exposed
google_fonts|Google Fonts Used
graphql_endpoint|GraphQL Endpoint Detected
graphql_introspection|GraphQL Introspection Enabled
health_check|Health Check Endpoint Exposed
heroku|Heroku Application Detected
hidden_iframe|Hidden Iframe Detected
hostname_file|Hostname File Exposed
hsts_on_onion|HSTS Header on Onion Service
hsts_preload|HSTS Preload Directive Found
iis_windows_version|Windows Version Determined from IIS
internal_api_version|Internal API Version Detected
js_obfuscation|Suspicious JavaScript Obfuscation
laravel_debug|Laravel Debug Mode Detected
lighttpd_server|Lighttpd Server Detected
metrics_endpoint|Metrics Endpoint Exposed
missing_content_security_policy|Missing Content-Security-Policy Header
missing_x_content_type_options|Missing X-Content-Type-Options Header
missing_x_frame_options|Missing X-Frame-Options Header
mongodb_open|MongoDB Server Detected
mysql_open|MySQL/MariaDB Server Detected
mysql_version|MySQL/MariaDB Version Disclosed
netlify|Netlify Deployment Detected
nginx_status|Nginx Status Page Exposed
nginx_version|Nginx Version Disclosed
onion_link_v2|Linked Hidden Service
onion_link_v3|Linked Hidden Service
open_directory|Open Directory
openapi_spec|OpenAPI Specification Detected
openssh_private_key|OpenSSH Private Key Exposed
openssl_version|OpenSSL Version Disclosed
os_detected|Operating System Detected from Server Header
pgp_key|PGP Public Key Present
pgp_private_key|PGP Private Key Exposed
php_version|PHP Version Disclosed
pkcs8_private_key|PKCS#8 Private Key Exposed
postgresql_open|PostgreSQL Server Detected
postman_collection|Postman Collection Reference Found
putty_private_key|PuTTY Private Key Exposed
rails_routes|Rails Debug Information Exposed
railway|Railway Deployment Detected
redis_protected|Redis Server Detected (Authentication Required)
redis_unauthenticated|Redis Server Allows Unauthenticated Access
redoc|ReDoc Documentation Exposed
render|Render Deployment Detected
robots_txt|Robots File Present
rpc_endpoint|RPC Endpoint Detected
rsa_private_key|RSA Private Key Exposed
server_version|Server Version Disclosed
session_linkability|Persistent Session Cookie Detected
sitemap_xml|Sitemap Present
smtp_banner|SMTP Banner Disclosed
smtp_hostname|SMTP Banner Reveals Hostname
smtp_software|SMTP Software Named
smtp_version|SMTP Software Version Disclosed
social_discord|Discord Link Found
social_facebook|Facebook Link Found
social_github|GitHub Link Found
social_instagram|Instagram Link Found
social_keybase|Keybase Link Found
social_linkedin|LinkedIn Link Found
social_mastodon|Mastodon Link Found
social_medium|Medium Link Found
social_patreon|Patreon Link Found
social_reddit|Reddit Link Found
social_signal|Signal Link Found
social_telegram|Telegram Link Found
social_tiktok|TikTok Link Found
social_twitter|Twitter/X Link Found
social_twitter_handle|Twitter/X Handle Reference Found
social_whatsapp|WhatsApp Link Found
social_youtube|YouTube Link Found
ssh_banner|SSH Version Banner Disclosed
ssh_dropbear|Dropbear SSH Server Detected
ssh_outdated|Outdated OpenSSH Version
ssh_protocol_1|SSH Protocol Version 1 Detected
ssh_system|Operating System Detected from SSH Banner
swagger_json|Swagger/OpenAPI Specification Found
swagger_ui|Swagger UI Exposed
tor_v2_private_key|Tor v2 Hidden Service Private Key Exposed
tor_v3_private_key|Tor v3 Hidden Service Private Key Exposed
vercel|Vercel Deployment Detected
via_header|Via Header Present
websocket_external|WebSocket Address Present
x_powered_by|X-Powered-By Header Reveals Technology
"""
_title_rows = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in (x.split("|") for x in _TITLES.strip().splitlines()))
_untitled = _content[:6] + _content[7:]  # the rules of one type have two titles there
_redirects = f"SELECT page_id, type, severity, value, CASE WHEN type = 'suspicious_redirect' THEN title END AS own FROM ({ORACLES['seeded_malicious']})"
_every = " UNION ALL ".join([f"SELECT *, NULL AS own FROM ({x})" for x in _untitled] + [f"SELECT * FROM ({_redirects})"])


@query(
    f"SELECT service, title, value, arg_min(type, (-severity, coalesce(page_id, 1000000000000000000), type)) AS type, max(severity) AS severity, arg_min(page_id, (-severity, coalesce(page_id, 1000000000000000000), type)) AS page_id FROM (SELECT a.*, coalesce(a.own, t.title) AS title FROM ("
    f"SELECT lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)) AS service, h.* FROM ({_every}) AS h JOIN pages USING (page_id) "
    f"UNION ALL SELECT service, page_id, 'clearnet_link', severity, value, NULL FROM ({ORACLES['clearnet_links']}) UNION ALL SELECT service, page_id, type, 3, value, NULL FROM ({ORACLES['outer_elements']}) "
    f"UNION ALL SELECT service, NULL, type, severity, value, NULL FROM ({ORACLES['banner_findings']}) UNION ALL SELECT service, NULL, type, severity, value, NULL FROM ({ORACLES['certificate_findings']})) AS a LEFT JOIN (VALUES {_title_rows}) AS t(type, title) ON t.type = a.type) GROUP BY service, title, value"
)
def audit_report(spark, d):
    """Everything about each service, from pages, banners and certificates, each title and value once with its worst severity."""
    own = plain(spark, d)
    certificates = own.select("service").distinct().select("service", F.array(F.concat(F.lit("www."), F.col("service")), F.lit("abc.onion")).alias("dns_names"), F.array(F.concat(F.lit("root@"), F.col("service"))).alias("email_addresses"))
    return audit.report(pages(spark, d), seeds.banners(own), certificates).select("service", "title", "value", "type", "severity", "page_id")
