"""Columns about files and names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweft.functions.extract import present

#: Content signatures: offset (from 1), bytes in hex, format.
SIGNATURES = [(1, "255044462D", "pdf"), (1, "FFD8FF", "jpeg"), (1, "89504E470D0A1A0A", "png"), (1, "49492A00", "tiff"), (1, "4D4D002A", "tiff")]
# Extensions that count where no signature is found.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "tif", "tiff", "webp"]
OFFICE_EXTENSIONS = ["doc", "docx", "odt", "rtf", "xls", "xlsx", "ods", "ppt", "pptx", "odp"]


def file_format(content: Column, name: Column) -> Column:
    """S3: the format that the first bytes show; else that of a known extension; ``unknown`` otherwise, so also for a file
    that only calls itself a document."""
    out = None
    for at, signature, kind in SIGNATURES:
        test = F.hex(F.substring(content, at, len(signature) // 2)) == signature
        out = F.when(test, kind) if out is None else out.when(test, kind)
    head = F.hex(F.substring(content, 1, 12))
    out = out.when(head.startswith("52494646") & head.endswith("57454250"), "webp")
    extension = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))
    return out.when(extension.isin(*IMAGE_EXTENSIONS), "image").when(extension.isin(*OFFICE_EXTENSIONS), "office").otherwise("unknown")


def safe_name(c: Column, longest: int = 80) -> Column:
    """a part of a file name: no reserved or control signs, single blanks, nothing but letters at its ends."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r'[<>:"/\\|?*\x00-\x1f]', " ")
    return F.left(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), r"^[ .\-_–—]+|[ .\-_–—]+$", ""), F.lit(longest))


def canonical_filename(original: Column, subject: Column, authority: Column, date: Column, reference: Column) -> Column:
    """``date_authority_subject_reference.ext`` of the parts that are there; the original's name without a subject."""
    original = F.coalesce(present(original), F.lit("document"))
    extension = F.lower(F.regexp_extract(original, r".(\.[^./]+)$", 1))
    stem = F.regexp_replace(original, r"(?<=.)\.[^./]+$", "")
    parts = [(date, 10), (authority, 55), (F.coalesce(present(subject), stem), 90), (reference, 45)]
    named = [F.when(present(p).isNotNull(), safe_name(p, n)) for p, n in parts]
    whole = F.coalesce(present(F.concat_ws("_", *named)), present(safe_name(stem, 100)), F.lit("document"))
    return F.concat(safe_name(whole, 180), F.coalesce(present(extension), F.lit(".pdf")))


def object_key(prefix: Column, date: Column, key: Column, name: Column) -> Column:
    """``prefix/yyyy-MM-dd/id/name``."""
    return F.concat_ws("/", prefix, F.date_format(date, "yyyy-MM-dd"), key.cast("string"), safe_name(name))


def digest(content: Column) -> Column:
    """SHA-256 in hex."""
    return F.sha2(content, 256)


def delivered_as(content: Column, name: Column) -> Column:
    """(format, output_name, converted): pictures and office files are delivered as pdf."""
    kind = file_format(content, name)
    converted = kind.isin("jpeg", "png", "tiff", "webp", "image", "office")
    stem = F.regexp_replace(F.coalesce(present(name), F.lit("document")), r"(?<=.)\.[^./]+$", "")
    out = F.when(converted | (kind == "pdf"), F.concat(safe_name(stem, 100), F.lit(".pdf"))).otherwise(name)
    return F.struct(kind.alias("format"), out.alias("output_name"), converted.alias("converted"))
