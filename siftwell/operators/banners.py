"""Findings from captured service banners (service, protocol, port, detected, banner) and certificates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.rules import CRITICAL, HIGH, INFO, LOW, MEDIUM

# Fixed values.
SSH_SYSTEMS = [("ubuntu", "Ubuntu Linux"), ("debian", "Debian Linux"), ("freebsd", "FreeBSD"), ("openbsd", "OpenBSD"), ("centos", "CentOS Linux"), ("fedora", "Fedora Linux"), ("raspbian", "Raspbian (Raspberry Pi)")]
FTP_SOFTWARE = [("vsftpd", "vsFTPd"), ("proftpd", "ProFTPD"), ("pure-ftpd", "Pure-FTPd"), ("filezilla", "FileZilla Server"), ("microsoft ftp", "Microsoft IIS FTP")]
SMTP_SOFTWARE = [("postfix", "Postfix"), ("exim", "Exim"), ("sendmail", "Sendmail"), ("microsoft", "Microsoft Exchange"), ("dovecot", "Dovecot"), ("zimbra", "Zimbra")]
PORTS = [("http", "HTTP", 80), ("https", "HTTPS", 443), ("ssh", "SSH", 22), ("ftp", "FTP", 21), ("smtp", "SMTP", 25), ("mongodb", "MongoDB", 27017), ("redis", "Redis", 6379), ("postgresql", "PostgreSQL", 5432), ("mysql", "MySQL", 3306), ("bitcoin", "Bitcoin", 8333)]
# End of the fixed values.


def _named(low: Column, table: list[tuple[str, str]]) -> Column:
    return F.coalesce(*[F.when(low.contains(token), F.lit(name)) for token, name in table])


def banner_findings(banners: DataFrame) -> DataFrame:
    """(service, protocol, type, severity, value)."""
    p, b = F.col("protocol"), F.coalesce("banner", F.lit(""))
    low, up = F.lower(b), F.upper(b)
    info = F.get(F.split(b, "-", 3), 2)
    host = F.get(F.split(F.regexp_replace(b, "^220[ -]", ""), " "), 0)
    ssh, ftp, smtp, some = p == "ssh", p == "ftp", p == "smtp", b != ""
    checks = [
        ("ssh_protocol_1", HIGH, ssh & b.startswith("SSH-1"), b),
        ("ssh_banner", INFO, ssh & info.isNotNull(), b),
        ("ssh_system", LOW, ssh & _named(F.lower(info), SSH_SYSTEMS).isNotNull(), _named(F.lower(info), SSH_SYSTEMS)),
        ("ssh_outdated", MEDIUM, ssh & F.lower(info).rlike("openssh_[1-6]"), info),
        ("ssh_dropbear", INFO, ssh & F.lower(info).contains("dropbear"), info),
        ("ftp_banner", INFO, ftp & some, b),
        ("ftp_software", INFO, ftp & _named(low, FTP_SOFTWARE).isNotNull(), _named(low, FTP_SOFTWARE)),
        ("ftp_hostname", MEDIUM, ftp & low.contains("welcome to") & b.contains("."), b),
        ("ftp_path", LOW, ftp & (b.contains("/") | b.contains("\\")), b),
        ("smtp_banner", INFO, smtp & some, b),
        ("smtp_software", INFO, smtp & _named(low, SMTP_SOFTWARE).isNotNull(), _named(low, SMTP_SOFTWARE)),
        ("smtp_hostname", CRITICAL, smtp & host.contains(".") & ~host.contains("@") & ~host.endswith(".onion"), host),
        ("smtp_version", LOW, smtp & b.contains("."), b),
        ("mongodb_open", MEDIUM, (p == "mongodb") & F.col("detected"), F.lit("mongodb")),
        ("postgresql_open", MEDIUM, (p == "postgresql") & F.col("detected"), F.lit("postgresql")),
        ("redis_unauthenticated", CRITICAL, (p == "redis") & up.contains("PONG"), F.lit("PONG")),
        ("redis_protected", INFO, (p == "redis") & ~up.contains("PONG") & (up.contains("NOAUTH") | up.contains("ERR")), b),
        ("mysql_version", LOW, (p == "mysql") & some, b),
        ("mysql_open", MEDIUM, (p == "mysql") & F.col("detected") & ~some, F.lit("mysql")),
    ]
    found = [F.when(F.coalesce(test, F.lit(False)), F.struct(F.lit(t).alias("type"), F.lit(s).alias("severity"), v.alias("value"))) for t, s, test, v in checks]
    return banners.select("service", "protocol", F.inline(F.array_compact(F.array(*found))))


def certificate_findings(certificates: DataFrame) -> DataFrame:
    names = certificates.select("service", F.explode("dns_names").alias("value")).filter(~F.col("value").endswith(".onion")).select("service", F.lit("certificate_name").alias("type"), F.lit(HIGH).alias("severity"), "value")
    mails = certificates.select("service", F.explode("email_addresses").alias("value")).select("service", F.lit("certificate_email").alias("type"), F.lit(CRITICAL).alias("severity"), "value")
    return names.unionByName(mails)


def detected_services(banners: DataFrame) -> DataFrame:
    """(service, services): labels of detected protocols in a fixed order."""
    order = banners.sparkSession.createDataFrame([(n, p, f"{label} ({port})") for n, (p, label, port) in enumerate(PORTS)], "n int, protocol string, label string")
    each = banners.filter("detected").join(F.broadcast(order), "protocol").select("service", F.struct("n", "label").alias("s")).distinct()
    return each.groupBy("service").agg(F.transform(F.array_sort(F.collect_list("s")), lambda s: s["label"]).alias("services"))
