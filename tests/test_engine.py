"""The engine's golden cases: expected values, invariants, and every registered query against SQL."""

import io
import os
import zipfile

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarn.functions import numbers, stem, text, urls
from tarn.functions.embed import hash_vector
from tarn.operators import chunker, context, evaluate, ratelimit, rerank, routing, search, tables
from tarn.plans import catalogue
from tarn.sources import formats, legacy, parsers, reader, sheets
from tarn.sources.archive import Archive, Unreadable
from tarn.sources.html import reading_text

SMALL = "/root/testdata/sf0.001"


def column(spark, values, expression, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_numbers(spark):
    cases = {"18000": 18000, "18.000": 18000, "1.234,56": 1234.56, "1,234.56": 1234.56, "Rp 25.000": 25000, "(1.500)": -1500, "-12": -12, "15%": 15, "2026-08-02": None,
             "PRD-001": None, "": None, "tidak ada data": None, "30,5": 30.5, "1234.567": 1234567, "1,234,567": None, "Rp1.500": None, " 7 ": 7}
    assert column(spark, list(cases), numbers.parse_number) == list(cases.values())
    assert column(spark, [14830000.0, 184.0, 1234.5, None], numbers.format_number, "double") == ["14.830.000", "184", "1.234,5", ""]
    assert column(spark, [46075.0, 46075.5, -1.0], numbers.excel_serial, "double") == ["2026-02-22", "2026-02-22 12:00:00", None]
    assert column(spark, [0.0], lambda c: numbers.excel_serial(c, True), "double") == ["1904-01-01"]


def test_tokens(spark):
    assert column(spark, ["Bagaimana cara mengajukan cuti yang benar?"], text.keywords) == [["mengajukan", "cuti", "benar"]]
    found = column(spark, ["Biaya Rp1.500.000 sesuai SOP-12/2026 dan ISO-27001"], text.surface_tokens)[0]
    assert {"rp1500000", "1500000", "sop-12", "iso-27001"} <= set(found)
    same = ["Biaya Rp1.500.000 sesuai SOP-12/2026 dan ISO-27001, a_b c-d.e 3.5", "", "--", "12/3 x", None]
    assert column(spark, same, text.keywords) == [rerank.words_of(t) for t in same]


def test_stems():
    forms = [set(stem.stem_forms(w)) for w in ("pengajuan", "diajukan", "mengajukan")]
    assert forms[0] & forms[1] and forms[1] & forms[2]
    for word, root in (("kebijakan", "bijak"), ("keterlambatan", "lambat"), ("penurunan", "turun"), ("menyapu", "sapu"), ("memakai", "pakai"), ("diperbaiki", "baik")):
        assert root in stem.stem_forms(word)
    assert stem.stem_forms("pegawai") == ["pegawai"] and "mbang" not in stem.stem_forms("dikembangkan")


def test_texts(spark):
    assert column(spark, ["Cuti 12 hari [1][7]. Lembur [2]."], lambda c: text.clean_citations(c, F.lit(2))) == ["Cuti 12 hari [1]. Lembur [2]."]
    assert column(spark, ["  Apa  ITU?! ", None, "..."], text.query_key) == ["apa itu", "", ""]
    assert column(spark, ["a\r\n\x00b \t c  \n\n\n\nd e", None], text.clean_text) == ["a\nb c\n\nd e", ""]
    assert column(spark, ["", "kata", "x" * 60, None], text.estimate_tokens) == [0, 2, 10, 0]
    assert [chunker.tokens_of(x) for x in ("", "kata", "x" * 60)] == [0, 2, 10]


def test_addresses():
    for bad in ("ftp://a.b/", "http://u:p@a.b/", "http://localhost/", "http://10.0.0.1/", "http://100.64.1.1/", "http://[::1]/", "http://x.internal/", "http://2001:db8::1/", ""):
        assert urls.refusal(bad), bad
    assert urls.refusal("https://example.com/a") is None and urls.refusal("http://8.8.8.8/") is None


def test_table_plans(spark):
    rows = [(0, "Ayam", "Makanan", "25"), (1, "Es Teh", "Minuman", "42"), (2, "Ayam", "Makanan", "18"), (3, "Kopi", "Minuman", "30"), (4, "Es Teh", "Minuman", "8")]
    t = spark.createDataFrame(rows, "row_index int, Produk string, Kategori string, Jumlah string")
    run = lambda plan: [r.asDict() for r in tables.run(plan, t, "row_index").collect()]
    assert [(r["key"], r["value"]) for r in run(tables.Plan("top_n", "jumlah", "produk", limit=2))] == [("Es Teh", 50), ("Ayam", 43)]
    assert run(tables.Plan("avg", "Jumlah", where=tables.Where("Kategori", "=", "minuman")))[0]["value"] == pytest.approx(26.6667)
    odd = spark.createDataFrame([(i, v) for i, v in enumerate(["10", "20", "tidak ada", "30,5"])], "row_index int, Jumlah string")
    found = tables.run(tables.Plan("sum", "Jumlah"), odd, "row_index").first()
    assert (found.value, found.rows_matched, found.rows_skipped) == (60.5, 4, 1)
    for plan in (tables.Plan("sum", "Harga"), tables.Plan("sum", "Produk"), tables.Plan("top_n", "Jumlah", "x"), tables.Plan("count", where=tables.Where("x", "=", "1"))):
        with pytest.raises(tables.PlanError):
            tables.run(plan, t, "row_index")
    assert tables.plan_from_json({"operation": "drop_table"}) is None
    assert tables.plan_from_json({"operation": "SUM", "metric": " Jumlah ", "limit": 999, "where": {"column": "a", "operator": "~", "value": 1}}) == tables.Plan("sum", "Jumlah", None, tables.Where("a", "=", "1"), "desc", 50)
    assert tables.facts(tables.Plan("count"), t, "row_index")["rows_matched"] == 5
    assert tables.run(tables.Plan("count"), t.limit(0), "row_index").first().value == 0


def test_fusion_and_gate(spark):
    make = lambda xs: search.ranked(spark.createDataFrame(xs, "key string, score double"), "key")
    out = search.rrf(make([("only", 0.91), ("both", 0.88)]), make([("both", 12.0), ("lex", 9.0)]), "key").orderBy(F.desc("score"), "key").collect()
    assert out[0].key == "both" and out[0].score == 1.0 and len(out) == 3
    none = spark.createDataFrame([], "key string, score double")
    assert search.relevance_gate(none, "score").first().gate == "no_candidates"
    docs = spark.createDataFrame([("a", "en", ["cuti", "hari"], False), ("b", "en", ["gaji"], False), ("c", "en", ["cuti"], True)], "k string, l string, t array<string>, s boolean")
    assert [r.k for r in search.bm25_scan(docs, "k", "t", ["cuti"], hidden=F.col("s")).collect()] == ["a"]
    focus = spark.createDataFrame([("a", 0.74), ("a", 0.70), ("b", 0.62), ("c", 0.51), ("d", 0.40)], "d string, s double")
    assert {r.d for r in search.focus_documents(focus, "d", "s").collect()} == {"a", "b"}


def test_rerank():
    query = "jatah cuti tahunan"
    good, weak, none = rerank.lexical_scores(query, ["Jatah cuti tahunan adalah 12 hari", "Tahunan rapat besar sekali di kantor pusat", "Resep ayam goreng"])
    assert good >= 0.8 > weak and none == 0.0
    assert rerank.lexical_scores("Apa itu?", ["x", "y"]) == [0.0, 0.0]
    assert rerank.shortest_span([[0, 9], [10], [3, 12]]) == 4


def test_chunks_keep_everything():
    words = " ".join(f"kata{i}." for i in range(900))
    table = "A | B | C\n" + "\n".join(f"{i} | x{i} | y{i}" for i in range(300))
    pages = [(1, f"# Judul\n\nIntro singkat.\n\n{words}\n\n## Tabel\n\n{table}", "", "")]
    found = chunker.chunk(pages, "d", 120, 0, 10)
    whole = "\n".join(c["content"] for c in found)
    assert all(f"kata{i}." in whole and i < 300 and f"{i} | x{i} | y{i}" in whole or i >= 300 and f"kata{i}." in whole for i in range(900))
    assert all(c["token_count"] <= 180 for c in found) and found[-1]["section"] == "Judul / Tabel"
    assert all(c["content"].split("\n")[0] == "A | B | C" for c in found if c["is_table"] and not c["content"].startswith("##"))
    lapped = chunker.chunk(pages, "d", 120, 20, 10)
    assert len(lapped) == len(found) and lapped[1]["content"] != found[1]["content"]


def _chunk_rows(spark, tokens, hits=(), query=1):
    rows = [(query, "x", i, i, t, "text", i in hits) for i, t in enumerate(tokens)]
    return spark.createDataFrame(rows, "query_id long, document_id string, chunk_index int, rank int, tokens int, content string, hit boolean")


def test_expansion(spark):
    def expand(tokens, hits, budget, n, whole=None):
        rows = _chunk_rows(spark, tokens, hits)
        found = context.expanded(rows.where("hit"), rows, budget + len(hits) * context.HIT_OVERHEAD + sum(tokens[i] for i in hits), n, whole)
        return [(r.chunk_index, r.upto) for r in found.orderBy("upto").collect()]

    # a large document: neighbours, nearest first; one that does not fit is skipped
    assert [i for i, _ in expand([2000] * 10, (5,), 5000, 1)] == [4, 6]
    assert [i for i, _ in expand([2000, 2000, 10, 9000, 10, 2000], (2,), 4010, 2)] == [1, 0, 4]
    assert [i for i, _ in expand([2000, 2000, 10, 9000, 10, 2000], (2,), 4009, 2)] == [1, 0]
    # a small one, or one that is asked for: whole, up to the first part that does not fit
    assert [i for i, _ in expand([10, 10, 10], (1,), 15, 0)] == [0]
    assert [i for i, _ in expand([10, 50, 10, 10], (0,), 45, 0)] == []
    assert [i for i, _ in expand([2000] * 5, (3,), 6000, 0, "hit")] == [0, 1, 2]
    assert expand([10], (0,), 100, 1) == []


def test_summary_stages(spark):
    rows = _chunk_rows(spark, [5, 5, 5, 20, 1])
    got = context.grouped(rows, 10, most_parts=4).orderBy("chunk_index").collect()
    assert [(r.stage, r.covered) for r in got] == [(0, True), (0, True), (1, True), (2, True), (3, False)]

    class Lengths:
        def complete(self, prompt: str) -> str:
            return f"<{prompt}>"

    staged = rows.join(context.grouped(rows, 10, most_parts=4).select("chunk_index", "stage", "covered"), "chunk_index").withColumn("content", F.col("chunk_index").cast("string"))
    assert [tuple(r) for r in context.summarised(staged, Lengths()).collect()] == [("x", "<<0\n1>\n<2>\n<3>>", True)]
    one = staged.where("stage = 0")
    assert [tuple(r) for r in context.summarised(one, Lengths()).collect()] == [("x", "<0\n1>", False)]


def test_items_are_found_whole(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j k"), (2, "xa b c d e f g h i"), (3, "c\nd"), (4, None), (5, "c d c d")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "b  c d e f g h i j"), (2, "c d"), (3, ""), (4, "d e f g h i j z"), (5, None)], "item_id long, text string")
    got = sorted(map(tuple, evaluate.holding(docs, "doc_id", items, "item_id").collect()))
    assert got == [(1, 1), (2, 1), (2, 2), (2, 3), (2, 5)]


def test_limits_of_busy_identities(spark):
    times = [("a", i, float(t)) for i, t in enumerate([0, 1, 2, 59, 61, 62, 300, 301, 302, 303, 3600])] + [("b", 100 + i, 30.0 * i) for i in range(40)]
    rows = spark.createDataFrame(times, "identity string, id long, seconds double").repartition(5)
    got = {r.id: r.passed for r in ratelimit.replay(rows, 2).collect()}
    for who in "ab":
        mine = [x for x in times if x[0] == who]
        assert [got[i] for _, i, _ in mine] == ratelimit.decide([t for _, _, t in mine], 2)
    spans = spark.createDataFrame([("a", 0, 50), ("a", 10, 2_000), ("a", 1_990, 2_500), ("a", 1_995, 1_999), ("b", 5, 5)], "identity string, start long, end long")
    assert {r.identity: r.most_open for r in ratelimit.concurrent(spans, 1000).collect()} == {"a": 3, "b": 0}


def test_router_names(spark):
    rows = spark.createDataFrame([(" RAG ",), ("knowledge-extract",), ("Summarise",), ("dance",), (None,)], "name string")
    assert [r[0] for r in rows.select(routing.capability(F.col("name"))).collect()] == ["knowledge_query", "knowledge_extract", "knowledge_summary", None, None]


def test_packing():
    items = [("a", 50, False), ("b", 80, False), ("c", 20, False), ("s", 30, True)]
    assert context.pack(items, 100, 8) == ["a", "c", "s"]
    assert context.pack([("a", 500, False), ("b", 1, False)], 100) == ["a"]
    assert ratelimit.decide([0, 1, 2, 59, 61, 62], 2) == [True, True, False, False, True, True]


def test_embedding():
    import numpy as np

    v = hash_vector("Satu dua dua")
    assert v.shape == (384,) and abs(float(np.dot(v, v)) - 1) < 1e-5 and not hash_vector("").any()


def test_html():
    assert reading_text("<table><tr><th>Kolom A</th><th>Kolom B</th></tr><tr><td>1</td><td>2</td></tr></table>") == "Kolom A | Kolom B\n1 | 2"
    page = "<div class='cookie'>c</div><nav>n</nav><ol class='breadcrumb'><li>x</li></ol><p>Isi berita yang sah.</p><div class='share'>s</div><aside>a</aside>"
    assert reading_text(page) == "Isi berita yang sah."
    assert "isi" in reading_text(f"<div class='with-sidebar sidebar'><p>{'isi ' * 300}</p></div>")


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/").replace("_DOT_", "."), body)
    return out.getvalue()


def _tables(parser, name, data, **limits):
    return [sheets.Table(t.sheet, t.headers, list(rows), t.truncated, t.notes) for t, rows in sheets.tables_of(parser, name, data, **limits)]


def test_office_files():
    docx = zipped(word__document_DOT_xml="<w:document xmlns:w='w'><w:body><w:p><w:r><w:t>Halo</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>",
                  word__header1_DOT_xml="<w:hdr xmlns:w='w'><w:p><w:r><w:t>Kop</w:t></w:r></w:p></w:hdr>")
    assert parsers.parse("a.docx", docx) == ("docx", [(1, "Halo\na | b"), (2, "[Header1]\nKop")])
    row = lambda n, *cells: f"<row r='{n}'>{''.join(cells)}</row>"
    s, i, n = (lambda r, v: f"<c r='{r}' t='s'><v>{v}</v></c>"), (lambda r, v: f"<c r='{r}' t='inlineStr'><is><t>{v}</t></is></c>"), (lambda r, v: f"<c r='{r}'><v>{v}</v></c>")
    sheet = "<worksheet><sheetData>" + row(1, s("A1", 0), i("B1", "Kategori"), i("C1", "Jumlah"), i("D1", "Harga")) + row(2, i("A2", "Ayam Geprek"), n("C2", 25), n("D2", 25000)) + row(3, i("A3", "Teh"), i("B3", "Minuman"), n("C3", 3), n("D3", 5000)) + "</sheetData></worksheet>"
    xlsx = zipped(xl__workbook_DOT_xml="<workbook xmlns:r='r'><sheets><sheet name='Penjualan' r:id='rId1'/></sheets></workbook>", xl___rels__workbook_DOT_xml_DOT_rels="<x><Relationship Id='rId1' Target='worksheets/sheet1.xml'/></x>",
                  xl__sharedStrings_DOT_xml="<sst><si><t>Produk</t></si></sst>", xl__worksheets__sheet1_DOT_xml=sheet)
    table = _tables("xlsx", "b.xlsx", xlsx)[0]
    assert table.sheet == "Penjualan" and table.headers == ["Produk", "Kategori", "Jumlah", "Harga"] and table.rows[0] == ["Ayam Geprek", "", "25", "25000"]
    assert parsers.parse("b.xlsx", xlsx)[1][0][1].split("\n")[2] == "baris 2: A=Ayam Geprek | C=25 | D=25000"
    pptx = zipped(ppt__slides__slide2_DOT_xml="<s xmlns:a='a'><a:p><a:r><a:t>dua</a:t></a:r></a:p></s>", ppt__slides__slide1_DOT_xml="<s xmlns:a='a'><a:p><a:r><a:t>satu</a:t></a:r></a:p></s>")
    assert parsers.parse("c.pptx", pptx)[1] == [(1, "satu"), (2, "dua")]
    ods = zipped(content_DOT_xml="<o xmlns:t='t' xmlns:o='o'><t:table t:name='S'><t:table-row><t:table-cell><p>A</p></t:table-cell><t:table-cell><p>B</p></t:table-cell></t:table-row><t:table-row><t:table-cell o:value='3'/><t:table-cell o:date-value='2026-01-02'/></t:table-row></t:table></o>")
    assert _tables("odf", "d.ods", ods)[0].rows == [["3", "2026-01-02"]] and parsers.parse("d.ods", ods)[1] == [(1, "A | B\n3 | 2026-01-02")]
    epub = zipped(**{"META-INF__container_DOT_xml": "<c><rootfile full-path='O/c.opf'/></c>", "O__c_DOT_opf": "<p><item id='a' href='a.xhtml'/><item id='n' href='n.xhtml' properties='nav'/><itemref idref='n'/><itemref idref='a'/></p>", "O__a_DOT_xhtml": "<p>Bab</p>", "O__n_DOT_xhtml": "<p>nav</p>"})
    assert parsers.parse("e.epub", epub)[1] == [(1, "Bab")]
    with pytest.raises(Unreadable):
        Archive(zipped(x="0" * (11 << 20)))
    with pytest.raises(Unreadable):
        parsers.parse("x.pdf", b"%PDF-1.4")


def test_plain_files():
    assert parsers.parse_text(b"a\fb") == [(1, "a"), (2, "b")] and parsers.parse_text(b"[page 3]\nx\n[page 4]\ny") == [(3, "x"), (4, "y")]
    assert parsers.parse_json(b'{"pages": [{"page": 2, "text": "x"}, "y"]}') == [(2, "x"), (2, "y")]
    assert parsers.parse_rtf(rb"{\rtf1\ansi{\fonttbl{\f0 Arial;}}Satu\par Dua \'e9\parKuota {\*\generator x}}") == [(1, "Satu\nDua é\nKuota")]
    mail = b"From: a@b.c\nSubject: Hai\nContent-Type: text/html\n\n<p>isi</p>"
    assert parsers.parse_eml(mail) == [(1, "From: a@b.c\n\nSubject: Hai\n\nisi")] or "isi" in parsers.parse_eml(mail)[0][1]
    assert sheets.build("s", list(sheets.delimited_rows("﻿Produk;Jumlah\nA;1\nB;2\n".encode()))).headers == ["Produk", "Jumlah"]
    titled = sheets.build("s", [["Ringkasan"], ["A", "B", "C"], ["1", "2", "3"]])
    assert titled.headers == ["A", "B", "C"] and "judul lembar" in titled.notes[0]
    ragged = sheets.build("s", [["A", "B"], ["1"], ["1", "2", "3"]])
    assert len(ragged.headers) == 3 and ragged.rows[0] == ["1", "", ""]
    capped = sheets.build("s", [["A", "B"]] + [["1", "2"]] * 10, max_rows=2)
    assert capped.truncated and len(capped.rows) == 2 and capped.notes
    assert sheets.build("s", [["Nama", "Kosong", "Nilai"], ["a", "", "1"]]).headers == ["Nama", "Nilai"]
    assert formats.parser_for("x.doc", b"{\\rtf1 x}") == "rtf" and formats.parser_for("x", b"", "text/plain") == "text" and formats.parser_for("x.xyz") == ""


def test_sheets_arrive_whole(spark, tmp_path):
    (tmp_path / "long.csv").write_text("Kode;Nilai\n" + "".join(f"k{i};{i * 7}\n" for i in range(300_000)))
    (tmp_path / "wide.csv").write_text("\n".join(",".join(f"{r}.{c}" for c in range(80)) for r in range(4)))
    cell = lambda r, c, v: f"<c r='{c}{r}' t='inlineStr'><is><t>{v}</t></is></c>"
    with zipfile.ZipFile(tmp_path / "long.xlsx", "w", zipfile.ZIP_DEFLATED) as z:
        rows = "".join(f"<row r='{r}'>{cell(r, 'A', f'x{r * r % 99991}')}{cell(r, 'B', f'y{r * 31 % 77777}')}</row>" for r in range(1, 210_002))
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet><sheetData>{rows}</sheetData></worksheet>")
    filler = "<table-cell n='{n}' number-columns-repeated='16000'/>"
    with zipfile.ZipFile(tmp_path / "odd.ods", "w") as z:
        z.writestr("content.xml", "<d><table name='one'><table-row><table-cell><p>A</p></table-cell><table-cell><p>B</p></table-cell>" + filler + "</table-row><table-row number-rows-repeated='3'><table-cell value='1' number-columns-repeated='2'/></table-row>"
                   "<table-row number-rows-repeated='1000000'><table-cell number-columns-repeated='16000'/></table-row></table><table name='two'><table-row><table-cell><p>C</p></table-cell><table-cell/><table-cell><p>D</p></table-cell></table-row><table-row><table-cell value='5'/><table-cell/><table-cell value='6'/></table-row></table></d>")  # fmt: skip
    found = reader.read_tables(spark, str(tmp_path)).where("error IS NULL").cache()
    counts = {(r.name, r.sheet): (r.n, r.w, r.top, r.cut) for r in found.groupBy(F.regexp_extract("path", "[^/]+$", 0).alias("name"), "sheet").agg(F.count("*").alias("n"), F.max(F.size("values")).alias("w"), F.max("row_index").alias("top"), F.bool_or("truncated").alias("cut")).collect()}
    assert counts == {("long.csv", "long"): (300_000, 2, 299_999, False), ("wide.csv", "wide"): (3, 80, 2, False), ("long.xlsx", "sheet1"): (210_000, 2, 209_999, False), ("odd.ods", "one"): (3, 2, 2, False), ("odd.ods", "two"): (1, 2, 0, False)}
    assert found.where("path LIKE '%long.csv'").agg(F.sum(F.element_at("values", 2).cast("long"))).first()[0] == 7 * 299_999 * 300_000 // 2
    found.unpersist()
    some = reader.read_tables(spark, str(tmp_path / "long.csv"), max_rows=10).select("truncated", F.array_join("notes", " ").alias("notes")).collect()
    assert len(some) == 10 and all(r.truncated and "10 baris pertama dari 300000 baris" in r.notes for r in some)
    narrow = reader.read_tables(spark, str(tmp_path / "wide.csv"), max_columns=64).first()
    assert len(narrow["values"]) == 64 and "aslinya 80" in narrow.notes[0]
    split = reader.read_delimited(spark, str(tmp_path / "long.csv"))
    assert split.columns == ["Kode", "Nilai"] and split.count() == 300_000
    (tmp_path / "latin").mkdir()
    (tmp_path / "latin" / "a.csv").write_bytes("Café\tPrix\ncrème\t5\n".encode("cp1252") * 2)
    assert reader.sniffed(spark, str(tmp_path / "latin")) == ("\t", "windows-1252") and reader.read_delimited(spark, str(tmp_path / "latin")).columns == ["Café", "Prix"]
    assert reader.read_delimited(spark, str(tmp_path / "latin")).first().asDict() == {"Café": "crème", "Prix": "5"}


def compound(**streams):
    """A compound file with streams above the size of the mini stream."""
    import struct

    size, bodies = 512, {k: v.ljust(4096, b"\0") for k, v in streams.items()}
    sectors, fat, starts = [], [], {}
    for name, body in bodies.items():
        starts[name] = len(sectors)
        parts = [body[i : i + size].ljust(size, b"\0") for i in range(0, len(body), size)]
        fat += [len(sectors) + i + 1 for i in range(len(parts) - 1)] + [0xFFFFFFFE]
        sectors += parts
    entry = lambda name, kind, start, n: (name.encode("utf-16-le").ljust(64, b"\0") + struct.pack("<HB", 2 * len(name) + 2, kind) + b"\0" * 49 + struct.pack("<IQ", start, n))
    directory = b"".join([entry("Root Entry", 5, 0xFFFFFFFE, 0), *(entry(n, 2, starts[n], len(bodies[n])) for n in bodies)])
    first = len(sectors)
    for i in range(0, len(directory), size):
        sectors.append(directory[i : i + size].ljust(size, b"\0"))
        fat.append(first + i // size + 1 if i + size < len(directory) else 0xFFFFFFFE)
    table = len(sectors)
    fat.append(0xFFFFFFFD)
    head = bytes.fromhex("d0cf11e0a1b11ae1") + b"\0" * 16 + struct.pack("<HHHHH", 62, 3, 0xFFFE, 9, 6) + b"\0" * 10 + struct.pack("<9I", 1, first, 0, 4096, 0xFFFFFFFE, 0, 0xFFFFFFFE, 0, table) + b"\xff" * (4 * 108)
    return head.ljust(512, b"\xff")[:512] + b"".join(sectors) + struct.pack(f"<{len(fat)}I", *fat).ljust(size, b"\xff")


def test_old_office_files():
    import struct

    record = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    strings = struct.pack("<II", 2, 2) + b"".join(struct.pack("<HB", len(s), 0) + s for s in (b"Produk", b"Jumlah"))
    head = record(0x809, b"\0" * 16) + record(0xE0, struct.pack("<HH", 0, 14) + b"\0" * 16)
    globals_ = lambda at: head + record(0x85, struct.pack("<IH", at, 0) + b"\x02\x00S1") + record(0xFC, strings) + record(0x0A, b"")
    at = len(globals_(0))
    cells = record(0x809, b"\0" * 16) + record(0xFD, struct.pack("<HHHI", 0, 0, 5, 0)) + record(0xFD, struct.pack("<HHHI", 0, 1, 5, 1)) + record(0x203, struct.pack("<HHHd", 1, 0, 5, 2.5)) + record(0x27E, struct.pack("<HHHI", 1, 1, 0, (46075 << 2) | 2)) + record(0x0A, b"")
    xls = compound(Workbook=globals_(at) + cells)
    assert legacy.kind_of(xls) == "xls_binary" and legacy.xls_sheets(xls) == [("S1", [["Produk", "Jumlah"], ["2.5", "2026-02-22"]])]
    atom = lambda kind, body, v=0: struct.pack("<HHI", v, kind, len(body)) + body
    ppt = compound(**{"PowerPoint Document": atom(1006, atom(4008, b"Satu") + atom(4000, "Dua é".encode("utf-16-le")), 0xF)})
    assert parsers.parse("x.ppt", ppt) == ("ppt_binary", [(1, "Satu\nDua é")])
    words = b"Halo\rDunia"
    main = bytearray(0x400)
    main[0:2], main[10:12] = b"\xec\xa5", struct.pack("<H", 0x0200)
    main[0x1A2:0x1AA] = struct.pack("<II", 0, 21)
    main[0x300 : 0x300 + len(words)] = words
    clx = b"\x02" + struct.pack("<I", 16) + struct.pack("<II", 0, len(words)) + struct.pack("<HIH", 0, 0x40000000 | 0x600, 0)
    doc = compound(**{"WordDocument": bytes(main), "1Table": clx})
    assert parsers.parse("x.doc", doc) == ("doc_binary", [(1, "Halo\nDunia")])


def test_readers(spark, tmp_path):
    from tarn.sources import reader

    (tmp_path / "a.txt").write_text("satu dan dua\fdua")
    (tmp_path / "b.csv").write_text("A,B\n1,2\n3,4\n")
    (tmp_path / "c.pdf").write_bytes(b"%PDF-1.4")
    got = {(r.path.rsplit("/", 1)[-1], r.page): (r.text, r.error) for r in reader.read_documents(spark, str(tmp_path)).collect()}
    assert got["a.txt", 1][0] == "satu dan dua" and got["c.pdf", None][1] and got["b.csv", 1][0].startswith("baris 1: A | B")
    rows = reader.read_tables(spark, str(tmp_path)).where("error IS NULL")
    assert [r.asDict() for r in reader.as_table(rows, ["A", "B"]).orderBy("row_index").collect()] == [{"row_index": 0, "A": "1", "B": "2"}, {"row_index": 1, "A": "3", "B": "4"}]
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "x.log").write_text('{"log": "{\\"level\\": \\"info\\", \\"logger\\": \\"a\\"}", "time": "t1"}\nplain\n{"level": "INFO", "logger": "a", "timestamp": "t0"}\n')
    assert reader.log_summary(spark, str(tmp_path / "log")).first().asDict() == {"level": "INFO", "logger": "a", "count": 2, "first": "t0", "last": "t1"}


def test_streams(spark, tmp_path):
    from tarn.streaming import events

    source = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    source.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = events.read_stream(spark, str(tmp_path / "in"), source.schema)
    query = events.windowed_counts(stream, "1 day", "400 days").writeStream.format("memory").queryName("counts").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("SELECT sum(n) FROM counts").first()[0] == source.count()
    events.write_batches(events.read_stream(spark, str(tmp_path / "in"), source.schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == source.count()


def test_tenants_do_not_mix(spark):
    """Another tenant's rows change nothing; nor does the order of partitions."""
    rows = [(i, "org_a", ["cuti", f"w{i % 3}"]) for i in range(30)]
    other = [(100 + i, "org_b", ["cuti", "cuti"]) for i in range(50)]
    make = lambda r, n: spark.createDataFrame(r, "k int, org string, t array<string>").repartition(n).where("org = 'org_a'")
    score = lambda df: [(r.k, round(r.score, 9)) for r in search.bm25_scan(df, "k", "t", ["cuti", "w1"]).orderBy("k").collect()]
    assert score(make(rows, 1)) == score(make(rows + other, 7))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(SMALL):
        c.sql(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{SMALL}/{name}'")
    return c


def plain(v):
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return tuple(plain(x) for x in v)
    if v is None or v is pd.NA:
        return None
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, float):
        return None if v != v else round(v, 6)
    return str(v) if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SMALL).toPandas()
    if name not in catalogue.ORACLE_SQL:
        assert len(got.columns)
        return
    want = duck.sql(catalogue.ORACLE_SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = lambda df: sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False)), key=repr)
    assert rows(got) == rows(want)
