"""Findings from file metadata: decoded image tags, and document bytes as Latin-1 text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.rules import CRITICAL, HIGH, LOW, MEDIUM

# Fixed values.
TAGS = [
    ("GPSLatitude", "exif_gps", CRITICAL),
    ("GPSLongitude", "exif_gps", CRITICAL),
    ("GPSLatitudeRef", "exif_gps", CRITICAL),
    ("GPSLongitudeRef", "exif_gps", CRITICAL),
    ("Make", "exif_camera", MEDIUM),
    ("Model", "exif_camera", MEDIUM),
    ("SerialNumber", "exif_serial", HIGH),
    ("CameraSerialNumber", "exif_serial", HIGH),
    ("BodySerialNumber", "exif_serial", HIGH),
    ("LensSerialNumber", "exif_serial", HIGH),
    ("Software", "exif_software", LOW),
    ("ProcessingSoftware", "exif_software", LOW),
    ("Artist", "exif_author", HIGH),
    ("Author", "exif_author", HIGH),
    ("Copyright", "exif_author", HIGH),
    ("XPAuthor", "exif_author", HIGH),
    ("DateTimeOriginal", "exif_datetime", LOW),
    ("DateTimeDigitized", "exif_datetime", LOW),
    ("DateTime", "exif_datetime", LOW),
    ("HostComputer", "exif_computer", MEDIUM),
]
INFO_FIELDS = {"author": "Author", "creator": "Creator", "producer": "Producer", "title": "Title", "subject": "Subject", "keywords": "Keywords", "creationDate": "CreationDate", "modDate": "ModDate"}
XMP_FIELDS = {
    "xmp_creator": r"<dc:creator[^>]*>.*?<rdf:li[^>]*>([^<]+)</rdf:li>",
    "xmp_tool": r"xmp:CreatorTool>([^<]+)<",
    "xmp_producer": r"pdf:Producer>([^<]+)<",
    "xmp_documentId": r"xmpMM:DocumentID>([^<]+)<",
    "xmp_instanceId": r"xmpMM:InstanceID>([^<]+)<",
    "xmp_originalDocId": r"xmpMM:OriginalDocumentID>([^<]+)<",
}
FIELD_TYPES = {
    "author": ("pdf_author", HIGH), "creator": ("pdf_creator", MEDIUM), "xmp_tool": ("pdf_creator", MEDIUM), "producer": ("pdf_producer", LOW), "xmp_producer": ("pdf_producer", LOW),
    "xmp_documentId": ("pdf_document_id", MEDIUM), "xmp_instanceId": ("pdf_document_id", MEDIUM), "xmp_originalDocId": ("pdf_document_id", MEDIUM), "xmp_creator": ("pdf_xmp_creator", HIGH),
    "creationDate": ("pdf_timezone", MEDIUM), "modDate": ("pdf_timezone", MEDIUM),
}
# End of the fixed values.


def image_tags(tags: DataFrame) -> DataFrame:
    """tags (service, image_url, page_url, tag, value) to findings."""
    kinds = tags.sparkSession.createDataFrame(TAGS, "tag string, type string, severity int")
    found = tags.join(F.broadcast(kinds), "tag")
    return found.select("service", "type", "severity", F.concat("tag", F.lit(": "), "value").alias("value"), F.concat("page_url", F.lit(" -> "), "image_url").alias("location"))


def _decoded(raw: Column) -> Column:
    hexed = F.try_to_binary(F.substring(raw, F.lit(5), F.length(raw)), F.lit("hex"))
    plain = raw
    for mark, char in (("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\\(", "("), ("\\)", ")"), ("\\\\", "\\")):
        plain = F.replace(plain, F.lit(mark), F.lit(char))
    return F.when(F.upper(F.left(raw, F.lit(4))) == "FEFF", F.decode(hexed, "UTF-16BE")).otherwise(F.trim(plain))


def document_metadata(files: DataFrame) -> DataFrame:
    """files (path, body) to findings; values under three characters and dates without a zone say nothing."""
    fields = []
    for name, key in INFO_FIELDS.items():
        shape = rf"/{key}\s*\(([^)]+)\)|/{key}\s*<([^>]+)>"
        first = F.coalesce(F.nullif(F.regexp_extract("body", shape, 1), F.lit("")), F.nullif(F.regexp_extract("body", shape, 2), F.lit("")))
        fields.append((name, _decoded(first)))
    fields += [(name, F.nullif(F.regexp_extract("body", shape, 1), F.lit(""))) for name, shape in XMP_FIELDS.items()]
    pairs = [F.struct(F.lit(name).alias("field"), F.lit(FIELD_TYPES[name][0]).alias("type"), F.lit(FIELD_TYPES[name][1]).alias("severity"), value.alias("value")) for name, value in fields if name in FIELD_TYPES]
    each = files.select("path", F.inline(F.array(*pairs))).filter(F.length("value") >= 3)
    return each.filter((F.col("type") != "pdf_timezone") | F.col("value").rlike("[+-]"))
