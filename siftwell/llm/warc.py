"""Legacy archives to WARC: ARC records are parsed by their version's header lines and declared lengths and
written anew with the identifiers, timestamps, types and digests that a WARC file needs.

Archives are rows of a table (archive, content), each at most about SEGMENT_BYTES long unless one record alone is
longer; a task reads and writes whole archives, one at a time. ``write_arc`` makes ARC version 1 and 2
archives from pages, ``convert`` turns ARC archives into WARC archives (a warcinfo record, then a gzip member per record),
``read_warc`` reads those back. A header line's fields are read from both ends, so addresses and content types may
hold blanks. After a record whose header line or length is wrong, reading goes on at the next header line whose declared
length ends at a record's end; what lies between is a row of ``broken_records`` (and none of ``convert``). Of a gzipped archive
that is cut off or damaged the records before the damage count, and the rest is such a row too.

Of records with one payload (at least LEAST_BYTES long) the one with the largest page id becomes the response; the
others revisit it, carry no payload and refer to its record identifier, address and date. Null html is an empty payload. Rows that
repeat the largest page id of a payload are all responses. A null page id is smaller than any other; if all of a payload's
are null they are all responses. Very long pages make a long archive each. An empty table gives no archive.
Further columns of pages, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import SMALL_ROWS, checkpointed, joined_by_hot_key, ready, small

SEGMENT_BYTES = 4 << 20
LEAST_BYTES = 0
#: What a version-1 and a version-2 archive says its header lines hold.
ARC_FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
#: An address in a header line, and the longest line that is taken for one.
ADDRESS, LONGEST_LINE = re.compile(r"[0-9a-fA-F:.]*[0-9][0-9a-fA-F:.]*|-"), 1 << 16
ARC_SCHEMA = "archive string, content binary"
RECORD_SCHEMA = "page_id long, url string, date string, ip string, mime string, version int, type string, http_head binary, payload binary"
WARC_SCHEMA = "page_id long, record_id string, url string, date string, record_type string, payload_bytes long, payload_digest string, refers_to string"
SPACE = uuid.UUID("6f2c1f0e-5b1d-5c5e-9a52-0b7a3c1d9e42")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def arc_date(page_id: int | None) -> str:
    """A capture time for pages that carry none: a second per id, from 2008 on, within a hundred years."""
    import datetime

    return (datetime.datetime(2008, 1, 1) + datetime.timedelta(seconds=(page_id or 0) % 3_000_000_000)).strftime("%Y%m%d%H%M%S")


def arc_archive(name: str, version: int, records: list[tuple[str, str, str, bytes]]) -> bytes:
    """An ARC file of (url, date, mime, network document) records."""
    block = f"{version} 0 siftwell\n{ARC_FIELDS[version]}\n".encode()
    given = {"URL": f"filedesc://{name}", "IP-address": "0.0.0.0", "Archive-date": "20080101000000", "Content-type": "text/plain"}

    def line(values: dict[str, str], length: int) -> bytes:
        return (" ".join(values.get(f, "-") if f != "Archive-length" else str(length) for f in ARC_FIELDS[version].split()) + "\n").encode()

    out, at = [line(given | {"Result-code": "200", "Filename": name, "Offset": "0"}, len(block)), block, b"\n"], 0
    at = sum(map(len, out))
    for url, date, mime, document in records:
        values = {"URL": url, "IP-address": "0.0.0.0", "Archive-date": date, "Content-type": mime, "Result-code": "200", "Checksum": hashlib.md5(document).hexdigest(), "Filename": name, "Offset": str(at)}
        out += [line(values, len(document)), document, b"\n"]
        at += sum(map(len, out[-3:]))
    return b"".join(out)


def _header(line: bytes, names: list[str]) -> dict | None:
    """The fields of a header line by name, or None. Address and content type take what the fields at both ends leave."""
    words = line.rstrip(b"\r").decode("utf-8", "replace").split(" ")
    behind = len(names) - names.index("Content-type") - 1
    if len(words) < len(names) - 1 or not words[-1].isdigit():
        return None
    for i in range(1, len(words) - behind - 1):
        if ADDRESS.fullmatch(words[i]) and words[i + 1].isdigit() and 8 <= len(words[i + 1]) <= 14:
            rest = words[len(words) - behind :]
            values = [" ".join(words[:i]), words[i], words[i + 1], " ".join(words[i + 2 : len(words) - behind]), *rest]
            return dict(zip(names, values))
    return None


def parse_arc(content: bytes) -> Iterator[dict]:
    """The records behind the version block: header fields by name, ``version`` and ``document``.

    A stretch that is no record is ``broken``: (start, length) of the bytes that were passed over.
    """
    end = content.find(b"\n")
    first = content[: max(end, 0)].split(b" ")
    if len(first) < 5 or not first[0].startswith(b"filedesc://") or not first[-1].strip().isdigit():
        if content:
            yield {"broken": True, "version": 0, "start": 0, "length": len(content)}
        return
    block = content[end + 1 : end + 1 + int(first[-1])]
    lines = block.split(b"\n")
    version = int(lines[0].split(b" ")[0]) if lines and lines[0][:1].isdigit() and lines[0].split(b" ")[0].isdigit() else 1
    names = lines[1].decode("ascii", "replace").split() if len(lines) > 1 and lines[1] else []
    if "Content-type" not in names:
        names = ARC_FIELDS.get(version, ARC_FIELDS[1]).split()
    at = end + 1 + len(block)

    def record(at: int) -> tuple[dict, int] | None:
        """The record whose header line starts at a position, and where it ends."""
        end = content.find(b"\n", at)
        fields = _header(content[at:end], names) if 0 < end - at < LONGEST_LINE else None
        stop = end + 1 + int(fields["Archive-length"]) if fields else 0
        if fields is None or stop > len(content) or stop < len(content) and content[stop : stop + 1] not in (b"\n", b"\r"):
            return None
        return fields | {"version": version, "document": content[end + 1 : stop]}, stop

    lost = -1
    while True:
        while content[at : at + 1] in (b"\n", b"\r"):
            at += 1
        found = record(at) if at < len(content) else None
        if lost >= 0 and (found or at >= len(content)):
            yield {"broken": True, "version": version, "start": lost, "length": at - lost}
            lost = -1
        if at >= len(content):
            return
        if found:
            fields, at = found
            yield fields
        else:
            lost = at if lost < 0 else lost
            at = content.find(b"\n", at) + 1 or len(content)


def _segments(rows: Iterator[tuple[int, object]], close) -> Iterator[bytes]:
    """close(list) for runs of rows (size, row) of about SEGMENT_BYTES."""
    held, size = [], 0
    for n, row in rows:
        if held and size + n > SEGMENT_BYTES:
            yield close(held)
            held, size = [], 0
        held.append(row)
        size += n
    if held:
        yield close(held)


def write_arc(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", zipped: bool = True) -> DataFrame:
    """ARC archives (archive, content) of pages, of both versions in turn; zipped as they would lie on disk."""
    ready(pages.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = 0

        def records() -> Iterator[tuple[int, tuple]]:
            for part in parts:
                for page_id, url, html in zip(*(part.column(i).to_pylist() for i in range(3))):
                    payload = (html or "").encode()
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nX-Page-Id: {'' if page_id is None else page_id}\r\n\r\n".encode()
                    yield len(payload) + 400, (quote(url or "about:blank", safe="/:?#[]@!$&'()*+,;=%~"), arc_date(page_id), "text/html", head + payload)

        def close(held: list) -> pa.RecordBatch:
            nonlocal number
            number += 1
            name = f"pages-{hashlib.sha1(held[0][3]).hexdigest()[:16]}-{number:05}.arc.gz"
            content = arc_archive(name, 1 + number % 2, held)
            content = gzip.compress(content, 1, mtime=0) if zipped else content
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["archive", "content"])

        yield from _segments(records(), close)

    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(batches, ARC_SCHEMA)


def _plain(content: bytes) -> tuple[bytes, int]:
    """An archive's bytes, unzipped where it is gzipped (member by member), and how many compressed bytes at its end can't be read."""
    if content[:2] != b"\x1f\x8b":
        return content, 0
    out, at = [], 0
    while at < len(content):
        unpack = zlib.decompressobj(31)
        try:
            out.append(unpack.decompress(content[at:]))
        except zlib.error:  # what the member gives up to the damage
            unpack, step = zlib.decompressobj(31), 512
            for begin in range(at, len(content), step):
                try:
                    out.append(unpack.decompress(content[begin : begin + step]))
                except zlib.error:
                    return b"".join(out), len(content) - begin
        if not unpack.eof:
            return b"".join(out), len(content) - at
        at = len(content) - len(unpack.unused_data)
    return b"".join(out), 0


def read_arc(archives: DataFrame) -> DataFrame:
    """A row per record of ARC archives, plain or gzipped, in RECORD_SCHEMA: the HTTP head apart from the payload."""
    return _records(archives, False).drop("hash", "bytes")


def _records(archives: DataFrame, small: bool) -> DataFrame:
    """read_arc's rows with the payload's SHA-1 and length. small: payloads deflated, for a shuffle."""
    ready(archives.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("date", pa.string()), ("ip", pa.string()), ("mime", pa.string()), ("version", pa.int32()), ("type", pa.string()), ("http_head", pa.binary()), ("payload", pa.binary()), ("hash", pa.string()), ("bytes", pa.int64())])

    def told(row: tuple) -> tuple:
        payload = row[-1]
        return *row[:-1], zlib.compress(payload, 1) if small else payload, hashlib.sha1(payload).hexdigest(), len(payload)

    def record(r: dict) -> tuple:
        if r.get("broken"):
            return None, None, None, None, None, r["version"], "broken", b"", b""
        document, url = r["document"], r["URL"]
        if document.startswith(b"HTTP/"):
            head, _, payload = document.partition(b"\r\n\r\n")
            page = next((x[11:].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"x-page-id:")), b"")
            return int(page) if page.lstrip(b"-").isdigit() else None, url, r["Archive-date"], r["IP-address"], r["Content-type"], r["version"], "response", head + b"\r\n\r\n", payload
        return None, url, r["Archive-date"], r["IP-address"], r["Content-type"], r["version"], "resource", b"", document

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for content in part.column(0).to_pylist():
                plain, unread = _plain(content)
                rows = [told(record(r)) for r in (*parse_arc(plain), *([{"broken": True, "version": 0}] if unread else []))]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return archives.select("content").mapInArrow(batches, RECORD_SCHEMA + ", hash string, bytes long")


def broken_records(archives: DataFrame) -> DataFrame:
    """(archive, start, length) of every stretch of an ARC archive that could not be read as a record; of a damaged gzip archive the start in what was unzipped and the number of compressed bytes left."""
    ready(archives.sparkSession)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for name, content in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                plain, unread = _plain(content)
                rows = [(name, r["start"], r["length"]) for r in parse_arc(plain) if r.get("broken")] + ([(name, len(plain), unread)] if unread else [])
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "start", "length"])

    return archives.select("archive", "content").mapInArrow(batches, "archive string, start long, length long")


def _stamp(date: str) -> str:
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z" if len(date) == 14 and date.isdigit() else "1970-01-01T00:00:00Z"


def record_id(page_id: int | None, url: str, date: str, digest: str) -> str:
    """An identifier that a record always gets again, whichever task makes it."""
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}|{url}|{date}|{digest}')}>"


def _member(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))]) + "\r\n"
    pack = zlib.compressobj(3, zlib.DEFLATED, 31)
    return pack.compress(head.encode() + block + b"\r\n\r\n") + pack.flush()


def warc_record(row: dict) -> bytes:
    """One WARC record as a gzip member. refers_to: the response's (page_id, url, date), or None."""
    first = row["refers_to"]
    kind = "revisit" if first is not None else row["type"]
    digest, block = digest32(row["payload"]), row["http_head"] + (b"" if first is not None else row["payload"])
    fields = [("WARC-Type", kind), ("WARC-Record-ID", record_id(row["page_id"], row["url"], row["date"], digest)), ("WARC-Date", _stamp(row["date"])), ("WARC-Target-URI", row["url"]), ("WARC-IP-Address", row["ip"])]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("WARC-Block-Digest", f"sha1:{digest32(block)}")]
    if first is not None:
        fields += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", record_id(first["page_id"], first["url"], first["date"], digest)),
            ("WARC-Refers-To-Target-URI", first["url"]),
            ("WARC-Refers-To-Date", _stamp(first["date"])),
            ("X-Payload-Length", str(len(row["payload"]))),
        ]
    fields += [("Content-Type", "application/http; msgtype=response" if kind in ("response", "revisit") else row["mime"] or "application/octet-stream")]
    return _member(fields, block)


def warcinfo(content: bytes) -> bytes:
    """The record that opens an archive: which software wrote it, under an identifier made from its records."""
    block = b"software: siftwell\r\nformat: WARC File Format 1.1\r\n"
    name = uuid.uuid5(SPACE, hashlib.sha1(content).hexdigest())
    return _member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{name}>"), ("WARC-Date", "2008-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], block)


def convert(archives: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """WARC archives (archive, content) from ARC archives, equal payloads as revisits of one response.

    The ARC archives are read once: their records are stored deflated. Which payload is whose is told by a row per payload
    that occurs twice or more; only where those are many do records move to meet them.
    """
    ready(archives.sparkSession)
    records = checkpointed(_records(archives, True).filter("type <> 'broken'").drop("version"))
    some = records.filter((F.col("bytes") >= least_bytes) & (F.col("type") == "response"))
    last = some.groupBy("hash").agg(F.max(F.struct("page_id", "url", "date")).alias("last"), F.count("*").alias("n")).filter("n > 1 AND last.page_id IS NOT NULL").select("hash", "last")
    last = checkpointed(last)
    few = small(last)
    told = records.join(few, "hash", "left") if last.count() <= SMALL_ROWS else joined_by_hot_key(records, few, "hash", ["page_id", "url"], "left")
    refers = F.when((F.col("type") == "response") & ~F.col("page_id").eqNullSafe(F.col("last.page_id")), F.col("last"))
    told = told.select("page_id", "url", "date", "ip", "mime", "type", "http_head", "payload", refers.alias("refers_to"))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple[int, bytes]]:
            for part in parts:
                for row in part.to_pylist():
                    record = warc_record(row | {"payload": zlib.decompress(row["payload"])})
                    yield len(record), record

        def close(held: list[bytes]) -> pa.RecordBatch:
            content = b"".join(held)
            content = warcinfo(content) + content
            return pa.RecordBatch.from_arrays([pa.array([f"pages-{hashlib.sha1(content).hexdigest()[:20]}.warc.gz"]), pa.array([content], pa.binary())], ["archive", "content"])

        yield from _segments(made(), close)

    return told.mapInArrow(batches, ARC_SCHEMA)


def parse_warc(content: bytes, step: int = 4096) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of every record of a WARC file with a gzip member per record, one record in memory at a time."""
    at, whole = 0, memoryview(content)
    while at < len(content):
        unpack, plain = zlib.decompressobj(31), []
        while not unpack.eof and at < len(content):
            plain.append(unpack.decompress(whole[at : at + step]))
            at += step
        at = min(at, len(content)) - len(unpack.unused_data)
        head, _, rest = b"".join(plain).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n")[1:] if ": " in x)
        yield fields, rest[: int(fields["Content-Length"])]


def read_warc(archives: DataFrame) -> DataFrame:
    """A row per record of WARC archives but warcinfo, in WARC_SCHEMA; digests are made again from what was read. refers_to is a record identifier."""
    ready(archives.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("date", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string())])

    def record(fields: dict[str, str], block: bytes) -> tuple:
        kind = fields["WARC-Type"]
        head, _, payload = block.partition(b"\r\n\r\n") if kind in ("response", "revisit") else (b"", b"", block)
        page = next((x[11:].strip() for x in head.split(b"\r\n") if x.lower().startswith(b"x-page-id:")), b"")
        stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        if kind != "revisit" and digest32(payload) != stated:
            raise ValueError(f"payload digest differs in {fields['WARC-Record-ID']}")
        size = int(fields["X-Payload-Length"]) if kind == "revisit" else len(payload)
        return int(page) if page.lstrip(b"-").isdigit() else None, fields["WARC-Record-ID"], fields["WARC-Target-URI"], fields["WARC-Date"], kind, size, stated, fields.get("WARC-Refers-To")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for content in part.column(0).to_pylist():
                rows = [record(*r) for r in parse_warc(content) if r[0]["WARC-Type"] != "warcinfo"]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return archives.select("content").mapInArrow(batches, WARC_SCHEMA)


def digest(pages: DataFrame) -> DataFrame:
    """The contract's columns: pages are written as ARC, converted to stored WARC archives, and read back from those.

    A revisit's response is found by the record identifier that it refers to.
    """
    rows = checkpointed(read_warc(checkpointed(convert(write_arc(pages, zipped=False)))).drop("url", "date"))
    targets = rows.filter("record_type = 'response'").groupBy(F.col("record_id").alias("refers_to")).agg(F.max("page_id").alias("target"))
    again = joined_by_hot_key(rows.filter("refers_to IS NOT NULL"), targets, "refers_to", ["page_id", "record_id"])
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type"]
    first = rows.filter("refers_to IS NULL").select(*columns, F.lit(None).cast("long").alias("refers_to"))
    return first.unionByName(again.select(*columns, F.col("target").alias("refers_to")))
