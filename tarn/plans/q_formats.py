"""Files of every format, made from all documents by executors, and read back: pages and rows as the readers see them."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.session import materialize, small_batches
from tarn.sources import reader

#: Lines on a slide or in a chapter.
PAGE_LINES = 20


def lines_of(text: str | None) -> list[str]:
    """Lines that are not blank, with single blanks and without control characters."""
    plain = re.sub(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "", re.sub(r"\r\n?", "\n", text or ""))
    return [x for x in (re.sub(r"[ \t\xa0]+", " ", line).strip(" ") for line in plain.split("\n")) if x]


def _zip(members: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


def _paged(lines: list[str]) -> list[list[str]]:
    return [lines[i : i + PAGE_LINES] for i in range(0, len(lines), PAGE_LINES)] or [[]]


def _csv(lines: list[str]) -> bytes:
    out = io.StringIO()
    csv.writer(out).writerows([["Nomor", "Isi"], *([str(i), x] for i, x in enumerate(lines, 1))])
    return out.getvalue().encode()


def _xml(lines: list[str]) -> bytes:
    return ("<?xml version='1.0'?><doc><!-- x -->\n" + "\n".join(f"<line>{escape(x)}</line>" for x in lines) + "\n</doc>").encode()


def _docx(lines: list[str]) -> bytes:
    runs = "".join(f"<w:p><w:r><w:t>{escape(x[:7])}</w:t></w:r><w:r><w:t>{escape(x[7:])}</w:t></w:r></w:p>" for x in lines)
    return _zip({"word/document.xml": f"<w:document xmlns:w='w'><w:body>{runs}</w:body></w:document>"})


def _pptx(lines: list[str]) -> bytes:
    slide = lambda part: "<p:sld xmlns:p='p' xmlns:a='a'>" + "".join(f"<a:p><a:r><a:t>{escape(x)}</a:t></a:r></a:p>" for x in part) + "</p:sld>"
    return _zip({f"ppt/slides/slide{i}.xml": slide(part) for i, part in enumerate(_paged(lines), 1)})


def _epub(lines: list[str]) -> bytes:
    chapters = _paged(lines)
    opf = "".join(f"<item id='c{i}' href='c{i}.xhtml'/>" for i in range(len(chapters))) + "".join(f"<itemref idref='c{i}'/>" for i in range(len(chapters)))
    made = {f"O/c{i}.xhtml": "<html><body>" + "".join(f"<p>{escape(x)}</p>" for x in part) + "</body></html>" for i, part in enumerate(chapters)}
    return _zip({"META-INF/container.xml": "<c><rootfile full-path='O/b.opf'/></c>", "O/b.opf": f"<p>{opf}</p>", **made})


def _xlsx(lines: list[str]) -> bytes:
    """Numbers as numbers, texts as shared strings."""
    row = lambda r, a, b: f"<row r='{r}'>{a}{b}</row>"
    text = lambda ref, k: f"<c r='{ref}' t='s'><v>{k}</v></c>"
    body = row(1, text("A1", 0), text("B1", 1)) + "".join(row(i + 1, f"<c r='A{i + 1}'><v>{i}</v></c>", text(f"B{i + 1}", i + 1)) for i in range(1, len(lines) + 1))
    shared = "".join(f"<si><t>{escape(x)}</t></si>" for x in ["Nomor", "Isi", *lines])
    return _zip({"xl/workbook.xml": "<workbook xmlns:r='r'><sheets><sheet name='Baris' r:id='r1'/></sheets></workbook>", "xl/_rels/workbook.xml.rels": "<x><Relationship Id='r1' Target='worksheets/sheet1.xml'/></x>",
                 "xl/sharedStrings.xml": f"<sst>{shared}</sst>", "xl/worksheets/sheet1.xml": f"<worksheet><sheetData>{body}</sheetData></worksheet>"})


def _ods(lines: list[str]) -> bytes:
    row = lambda *cells: f"<t:table-row>{''.join(cells)}</t:table-row>"
    text = lambda x: f"<t:table-cell><p>{escape(x)}</p></t:table-cell>"
    rows = row(text("Nomor"), text("Isi")) + "".join(row(f"<t:table-cell o:value='{i}'/>", text(x)) for i, x in enumerate(lines, 1))
    return _zip({"content.xml": f"<o xmlns:t='t' xmlns:o='o'><t:table t:name='Baris'>{rows}</t:table></o>"})


def _rtf(lines: list[str]) -> bytes:
    def written(x: str) -> str:
        units = x.encode("utf-16-le", "surrogatepass")
        codes = [int.from_bytes(units[i : i + 2], "little") for i in range(0, len(units), 2)]
        return "".join(("\\" + chr(c) if chr(c) in "\\{}" else chr(c)) if c < 128 else f"\\u{c if c < 32768 else c - 65536}?" for c in codes)

    return (r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}" + r"\par ".join(map(written, lines)) + "}").encode("latin-1")


def _eml(lines: list[str]) -> bytes:
    from email.message import EmailMessage

    message = EmailMessage()
    message["From"], message["Subject"] = "a@b.example", "Baris"
    message.set_content("\n".join(lines) + "\n", cte="base64")
    return message.as_bytes()


BUILDERS: dict[str, Callable[[list[str]], bytes]] = {
    "csv": _csv, "xml": _xml, "docx": _docx, "pptx": _pptx, "epub": _epub, "xlsx": _xlsx, "ods": _ods, "rtf": _rtf, "eml": _eml,
}


def files_of(spark, d, kind: str) -> DataFrame:
    """(path, content): a file of one format for every document that has text, as a written table."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [(f"/in/{i}.{kind}", BUILDERS[kind](lines)) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True) if (lines := lines_of(t))]
            yield pd.DataFrame(made, columns=["path", "content"])

    small_batches(spark)  # a batch's files are held at once
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    return materialize(docs.mapInPandas(run, "path string, content binary"), f"files-{kind}")


def _id(df: DataFrame) -> DataFrame:
    return df.withColumn("doc_id", F.regexp_extract("path", r"(\d+)\.\w+$", 1).cast("long"))


def _pages_query(kind: str):
    def run(spark, d):
        found = _id(reader.pages_of(files_of(spark, d, kind)))
        return found.select("doc_id", "parser", "page", F.md5("text").alias("digest"), F.coalesce("error", F.lit("")).alias("error"))

    run.__name__ = f"format_{kind}"
    return run


def _tables_query(kind: str):
    def run(spark, d):
        found = _id(reader.tables_in(files_of(spark, d, kind)))
        return found.select("doc_id", "sheet", F.array_join("headers", "|").alias("headers"), "row_index", F.md5(F.array_join("values", "|")).alias("digest"), "truncated")

    run.__name__ = f"sheet_{kind}"
    return run


QUERIES = {f.__name__: f for f in [*map(_pages_query, BUILDERS), *map(_tables_query, ("csv", "xlsx", "ods"))]}

_L = r"""WITH c AS (SELECT doc_id, regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'), '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g') AS t FROM documents),
l AS (SELECT doc_id, list_filter([trim(regexp_replace(x, '[ \t\x{a0}]+', ' ', 'g'), ' ') FOR x IN string_split(t, chr(10))], lambda x: x <> '') AS l FROM c),
n AS (SELECT doc_id, l, len(l) AS n FROM l WHERE len(l) > 0)
"""


def _whole(parser: str, text: str) -> str:
    return _L + f"SELECT doc_id, '{parser}' AS parser, 1 AS page, md5({text}) AS digest, '' AS error FROM n"


#: A line whose cells are parted by single bars, none at either end, as text of HTML is read.
_BARRED = "list_filter([array_to_string(list_filter([trim(y, ' ') FOR y IN string_split(x, '|')], lambda y: y <> ''), ' | ') FOR x IN {l}], lambda x: x <> '')"


def _in_pages(parser: str, shown: str = "{l}") -> str:
    lines = shown.format(l=f"l[p * {PAGE_LINES} + 1:(p + 1) * {PAGE_LINES}]")
    return _L + f"""SELECT doc_id, '{parser}' AS parser, (p + 1)::INT AS page, md5(array_to_string({lines}, chr(10))) AS digest, '' AS error
FROM n, range(0, 100000) AS r(p) WHERE p * {PAGE_LINES} < n"""


_ROWS = _L + """SELECT doc_id, '{sheet}' AS sheet, 'Nomor|Isi' AS headers, (i - 1)::BIGINT AS row_index, md5(i || '|' || l[i]) AS digest, false AS truncated FROM n, range(1, 1000000) AS r(i) WHERE i <= n"""
_JOIN = "array_to_string(l, chr(10))"
ORACLE_SQL: dict[str, str] = {
    "format_csv": _whole("csv", "'baris 1: Nomor | Isi' || chr(10) || array_to_string(['baris ' || (i + 1) || ': ' || i || ' | ' || l[i] FOR i IN range(1, n + 1)], chr(10))"),
    "format_xml": _whole("xml", _JOIN),
    "format_docx": _whole("docx", _JOIN),
    "format_pptx": _in_pages("pptx"),
    "format_epub": _in_pages("epub", _BARRED),
    "format_xlsx": _whole("xlsx", "'Baris' || chr(10) || 'baris 1: A=Nomor | B=Isi' || chr(10) || array_to_string(['baris ' || (i + 1) || ': A=' || i || ' | B=' || l[i] FOR i IN range(1, n + 1)], chr(10))"),
    "format_ods": _whole("odf", "'Nomor | Isi' || chr(10) || array_to_string([i || ' | ' || l[i] FOR i IN range(1, n + 1)], chr(10))"),
    "format_rtf": _whole("rtf", _JOIN),
    "format_eml": _whole("eml", f"'From: a@b.example' || chr(10) || chr(10) || 'Subject: Baris' || chr(10) || chr(10) || {_JOIN}"),
    "sheet_csv": _ROWS.replace("'{sheet}'", "doc_id::VARCHAR"),
    "sheet_xlsx": _ROWS.replace("{sheet}", "Baris"),
    "sheet_ods": _ROWS.replace("{sheet}", "Baris"),
}
