"""Queries over scans, targets, dimensions and the job's own bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.functions import dims
from siftwell.functions import rules as R
from siftwell.operators import detect, edges, extract, findings, headers, history, reports
from siftwell.sources import captures

from . import seeds
from .catalog import COUNTS_SQL, FOUND_SQL, LEVELS, PLAIN, SCANS_SQL, P, family_sql, found, pages, plain, query
from .catalog import scans as scan_rows
from .seeds import quoted

#: Findings of three scans per service: the remainder of a document's id.
SCANNED = f"SELECT *, seq % 3 AS scan_id FROM ({FOUND_SQL})"


def scanned(spark, d):
    return found(spark, d).withColumn("scan_id", F.col("seq") % 3)


@query("SELECT DISTINCT o_custkey AS service FROM orders")
def scanned_services(spark, d):
    return history.services(scan_rows(spark, d))


@query(f"SELECT service, scan_id, scanned_at::DATE::VARCHAR AS day FROM ({SCANS_SQL}) WHERE scan_id IN (SELECT l_orderkey FROM lineitem)")
def scan_by_id(spark, d):
    """Scans looked up by id: those that a line item names."""
    ids = spark.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("scan_id"))
    return scan_rows(spark, d).join(ids, "scan_id", "left_semi").select("service", "scan_id", F.date_format("scanned_at", "yyyy-MM-dd").alias("day"))


_pairs = ", ".join(f"CASE WHEN {n.lower()}_count > 0 THEN '\"{n}\":' || {n.lower()}_count END" for n in sorted(R.SEVERITIES))


@query(f"SELECT service, scan_id, '{{' || array_to_string(list_filter([{_pairs}], lambda x: x IS NOT NULL), ',') || '}}' AS risk FROM ({COUNTS_SQL.format(SCANNED).replace('SELECT service,', 'SELECT service, scan_id,').replace('GROUP BY service', 'GROUP BY service, scan_id')})")
def scan_metadata(spark, d):
    return captures.risk_summary(scanned(spark, d))


@query(f"SELECT service, scan_id, count(*) AS total, max(severity) AS worst FROM ({SCANNED}) GROUP BY ALL")
def scan_partitions(spark, d):
    """Findings written by scan and read back with partition discovery."""
    from .extra import _scratch

    folder = _scratch(spark)
    captures.write_scan(scanned(spark, d), folder)
    return spark.read.parquet(folder).select("service", F.col("scan_id").cast("long").alias("scan_id"), "severity").groupBy("service", "scan_id").agg(F.count("*").alias("total"), F.max("severity").alias("worst"))


@query("SELECT DISTINCT lower(regexp_replace(regexp_replace(trim(a), '^https?://', '', 'i'), '[/?#].*', '')) || '.onion' AS service FROM (SELECT ' HTTP://' || upper(source) || '/x?y' AS a FROM documents WHERE source IS NOT NULL)")
def targets(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").filter("source IS NOT NULL")
    return captures.load_targets(docs.select(F.concat(F.lit(" HTTP://"), F.upper("source"), F.lit("/x?y")).alias("value")))


_heads = [h.get("content-security-policy") for h in seeds.HEADERS]
_directives = [(n, part.split()[0].lower(), len(part.split()) - 1) for n, h in enumerate(_heads) if h for part in h.split(";") if part.strip()]


@query(f"SELECT page_id, directive, sources FROM pages JOIN (VALUES {', '.join(f'({n}, {quoted(k)}, {c})' for n, k, c in _directives)}) AS v(n, directive, sources) ON page_id % {len(_heads)} = n")
def csp_directives(spark, d):
    policy = headers.value("content-security-policy")
    return pages(spark, d).filter(policy.isNotNull()).select("page_id", F.explode(extract.csp(policy)).alias("directive", "v")).select("page_id", "directive", F.size("v").alias("sources"))


@query(P + "SELECT page_id, service, url || '/server-status' AS value FROM p WHERE page_id % 10 IN (2, 5) AND page_id % 2 = 1")
def apache_status(spark, d):
    odd = F.col("page_id") % 2 == 1
    shown = pages(spark, d).withColumn("url", F.when(odd, F.concat("url", F.lit("/server-status"))).otherwise(F.col("url"))).withColumn("html", F.concat("html", F.lit(" Apache Server Status for x")))
    return headers.status_pages(shown).select("page_id", "service", "value")


_alias = ", ".join(f"({quoted(a)}, {quoted(p)})" for a, p in dims.PLATFORM_ALIASES.items())
_spelled = ["X", " fb ", "GitHub", "yt", "nowhere", "tg"]


@query(f"SELECT page_id, platform FROM (SELECT page_id, lower(trim({seeds.sql_pick(_spelled)})) AS a FROM pages) LEFT JOIN (VALUES {_alias}) AS v(a, platform) USING (a)")
def platform_names(spark, d):
    named = plain(spark, d).select("page_id", seeds.pick([F.lit(x) for x in _spelled], "page_id").alias("name"))
    return findings.platform_of(named, "name").select("page_id", "platform")


_coins = ", ".join(f"({quoted('crypto_' + k)}, {quoted(v)})" for k, v in dims.CURRENCIES.items())


_crypto = f"SELECT * FROM ({family_sql(R.BY_FAMILY['crypto'])}) QUALIFY row_number() OVER (PARTITION BY page_id, value ORDER BY rule_no) = 1"


@query(P + f"SELECT currency, count(*) AS n FROM ({_crypto}) JOIN (VALUES {_coins}) AS v(type, currency) USING (type) GROUP BY currency")
def currencies(spark, d):
    names = spark.createDataFrame([(f"crypto_{k}", v) for k, v in dims.CURRENCIES.items()], "type string, currency string")
    return detect.crypto(pages(spark, d)).join(F.broadcast(names), "type").groupBy("currency").agg(F.count("*").alias("n"))


@query(f"SELECT service, CASE WHEN total > 3 THEN 'timed out' WHEN total = 2 THEN 'error: two' ELSE 'complete' END AS status FROM ({COUNTS_SQL.format(FOUND_SQL)})")
def report_status(spark, d):
    each = findings.by_severity(found(spark, d), ["service"])
    return each.select("service", reports.status(F.col("total") > 3, F.when(F.col("total") == 2, "two")).alias("status"))


@query(f"SELECT {LEVELS}[severity + 1] AS severity_text, count(*) AS n FROM ({FOUND_SQL}) GROUP BY severity")
def severity_distribution(spark, d):
    return reports.summary(found(spark, d)).filter("severity_text <> 'TOTAL' AND n > 0")


@query(PLAIN + "SELECT page_id, 'title_word' AS type, regexp_extract(html, '<title>([A-Za-z]+)', 1) AS value FROM p WHERE regexp_matches(html, '<title>[A-Za-z]+')")
def custom_detector(spark, d):
    """A detector of the user's own, added as one more rule."""
    rule = R.Rule("title_word", "custom", R.INFO, "First Word of the Title", "<title>([A-Za-z]+)", ("<title>",), 1)
    return detect.detect(plain(spark, d), [rule]).select("page_id", "type", "value")


@query(f"SELECT service, step, rows FROM (SELECT service, 'pages' AS step, count(*) AS rows FROM (SELECT source AS service FROM documents) GROUP BY service UNION ALL SELECT service, 'findings', count(*) FROM ({FOUND_SQL}) GROUP BY service)")
def scan_steps(spark, d):
    """What each step of the job made, per service."""
    docs = spark.read.parquet(f"{d}/documents.parquet").groupBy(F.col("source").alias("service")).agg(F.count("*").alias("rows")).withColumn("step", F.lit("pages"))
    made = found(spark, d).groupBy("service").agg(F.count("*").alias("rows")).withColumn("step", F.lit("findings"))
    return docs.unionByName(made).select("service", "step", "rows")


@query(f"SELECT DISTINCT service AS from_service, value AS to_value FROM ({FOUND_SQL}) WHERE service = 'src1'")
def edges_of_service(spark, d):
    return edges.query(edges.edges(found(spark, d)), "src1").select("from_service", "to_value")
