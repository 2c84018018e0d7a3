"""Formats that can be read, and how a file's format is told: by content first, then name, then declared type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Extensions and media types of each parser.
EXTENSIONS = {
    "pdf": [".pdf"],
    "docx": [".docx", ".docm"],
    "odf": [".odt", ".odp", ".ods"],
    "rtf": [".rtf"],
    "epub": [".epub"],
    "doc_binary": [".doc"],
    "pptx": [".pptx", ".pptm"],
    "ppt_binary": [".ppt"],
    "xlsx": [".xlsx", ".xlsm"],
    "csv": [".csv", ".tsv"],
    "xls_binary": [".xls"],
    "text": [".txt", ".md", ".markdown", ".jsonl", ".ndjson", ".yaml", ".yml", ".log", ".sql", ".ini", ".conf", ".cfg", ".env", ".rst", ".tex"],
    "html": [".html", ".htm", ".xhtml"],
    "json": [".json"],
    "xml": [".xml"],
    "eml": [".eml"],
    "image_ocr": [".png", ".jpg", ".jpeg", ".tif", ".tiff", ".bmp", ".webp"],
}
MEDIA = {
    "application/pdf": "pdf",
    "wordprocessingml": "docx",
    "spreadsheetml": "xlsx",
    "presentationml": "pptx",
    "application/json": "json",
    "image/": "image_ocr",
    "text/": "text",
}
#: Formats that need a provider which is not part of this engine.
NEED_PROVIDER = {"pdf", "image_ocr"}
OLE = bytes.fromhex("d0cf11e0a1b11ae1")
_BY_EXTENSION = {e: parser for parser, es in EXTENSIONS.items() for e in es}


def parser_for(name: str, content: bytes = b"", mime: str = "") -> str:
    """The parser of a file, or an empty string."""
    suffix = "." + name.rsplit(".", 1)[-1].lower() if "." in name else ""
    head = content[:1024].lstrip().lower()
    if content.startswith(b"%PDF"):
        return "pdf"
    if head.startswith(b"{\\rtf"):
        return "rtf"
    if head.startswith((b"<!doctype html", b"<html")) or head.startswith(b"<?xml") and b"<html" in head:
        return "html"
    if content.startswith(OLE):
        from tarn.sources.legacy import kind_of

        if kind := kind_of(content):
            return kind
    if suffix in _BY_EXTENSION:
        return _BY_EXTENSION[suffix]
    return next((p for part, p in MEDIA.items() if part in mime.lower()), "")


def parser_column(name: Column, head: Column, mime: Column) -> Column:
    """As ``parser_for``, over a file's first bytes, but for containers of old office files, which need all of it."""
    low = F.lower(F.regexp_replace(F.decode(F.substring(head, 1, 1024), "ISO-8859-1"), r"^\s+", ""))
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    by_name = F.coalesce(*[F.when(suffix.isin(*es), p) for p, es in EXTENSIONS.items()])
    by_mime = F.coalesce(*[F.when(F.contains(F.lower(F.coalesce(mime, F.lit(""))), F.lit(m)), p) for m, p in MEDIA.items()])
    html = F.startswith(low, F.lit("<!doctype html")) | F.startswith(low, F.lit("<html")) | (F.startswith(low, F.lit("<?xml")) & F.contains(low, F.lit("<html")))
    return (
        F.when(F.startswith(F.hex(head), F.lit("25504446")), "pdf")
        .when(F.startswith(low, F.lit("{\\rtf")), "rtf")
        .when(html, "html")
        .otherwise(F.coalesce(by_name, by_mime, F.lit("")))
    )


#: Names of one media type.
MEDIA_ALIASES = {"application/x-pdf": "application/pdf", "text/xml": "application/xml"}
LONGEST_NAME = 180


def suffix_of(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"[^./\\](\.[^./\\]+)$", 1))


def safe_name(name: Column) -> Column:
    """A file's name without folders, every other sign an underscore, none at either end."""
    base = F.regexp_replace(F.coalesce(F.nullif(name, F.lit("")), F.lit("document")), r"^.*/(?=[^/])|/+$", "")
    clean = F.trim(F.regexp_replace(base, r"[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    return F.substring(F.coalesce(F.nullif(clean, F.lit("")), F.lit("document")), 1, LONGEST_NAME)


def upload_refusal(name: Column, head: Column, size: Column, mime: Column, most_bytes: int, suffixes: tuple[str, ...] | None = None) -> Column:
    """Why an upload is refused before anything is stored, or null."""
    known = suffixes or tuple(sorted(_BY_EXTENSION))
    low = F.lower(F.coalesce(mime, F.lit("")))
    named = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in MEDIA_ALIASES.items() for x in pair]), low), low)
    typed = F.coalesce(*[F.when(F.contains(named, F.lit(part)), F.lit(True)) for part in MEDIA], F.lit(False))
    return (
        F.when(F.coalesce(size, F.lit(0)) == 0, "empty")
        .when(size > most_bytes, "too_large")
        .when(~suffix_of(name).isin(*known) & ~typed, "unsupported")
        .when(F.startswith(F.hex(head), F.lit("25504446")) & (suffix_of(name) != ".pdf"), "not_named_pdf")
    )


def label_refused(label: Column, suffixes: tuple[str, ...] | None = None) -> Column:
    """Whether a document's label claims a type that is not stored; a label needs no extension."""
    suffix = suffix_of(label)
    return (suffix != "") & ~suffix.isin(*(suffixes or tuple(sorted(_BY_EXTENSION))))
