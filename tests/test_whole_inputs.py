"""Queries take all rows and whole texts of their tables; each case here lies outside of what a cut would leave."""

import contextlib
import datetime
import hashlib
import io
import math
import tracemalloc
import zipfile
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tarn.functions.embed import hash_embedding
from tarn.functions.numbers import is_numeric_cell, parse_number
from tarn.functions.stem import stem_forms
from tarn.operators import context, lexical_index, search
from tarn.operators.tables import exact_sum
from tarn.plans import catalogue, q_formats
from tarn.session import BATCH_BYTES, BATCH_ROWS
from tarn.sources import archive, parsers, reader, sheets


@pytest.fixture
def tables(spark, tmp_path):
    """Writes tables into a folder that queries read."""

    def write(**made):
        for name, (rows, schema) in made.items():
            spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_context_pack_takes_all_chunks_of_all_documents(spark, tables):
    docs = [(i, "\n".join(f"line {k} of {i} " + "word " * (40 if k < 3 else 1) for k in range(6)), "en", "s", 0) for i in range(0, 130, 3)]
    got = defaultdict(dict)
    for r in catalogue.QUERIES["context_pack"](spark, tables(documents=(docs, DOCS))).collect():
        got[r.query_id][r.number] = r.key
    want = {}
    for q in range(4):
        parts = []
        for i, body, *_ in docs:
            if i // 40 == q:
                rank = {k: (i * 31 + k * 17) % 101 * 1_000_000 + i % 40 * 10_000 + k for k in range(6)}
                tokens = {k: max(1, -(-max(len(x.split()) * 134, len(x) * 100 / 6) // 100)) for k, x in enumerate(body.split("\n"))}
                parts += [((1, min(rank.values()), k), f"{i}::chunk_{k:04d}", tokens[k], False) for k in range(6)]
                if i % 7 == 0:
                    parts.append(((0, (i * 31 - 17) % 101 * 1_000_000 + i % 40 * 10_000 - 1, 0), f"{i}::chunk_summary", max(1, -(-max(len(body.split()) * 134, len(body) * 100 / 6) // 100)), True))
        want[q] = dict(enumerate(context.pack([p[1:] for p in sorted(parts)], 600, 12), 1))
    assert dict(got) == want


def test_text_queries_take_whole_texts(spark, tables):
    long = "plain words before what matters, " * 3
    turns = [(1, 0, "user", long + "first"), (1, 1, "user", "berapa " + "x" * 30), (2, 0, "user", long + "other"), (2, 1, "user", " ".join(f"kata{i}" for i in range(30)))]
    items = [(1, long + "one"), (2, long + "two")]
    docs = [(1, f"{long}one 完 end", "en", "s", 0), (2, f"{long}two перевод end", "en", "s", 0), (3, f"{long}three", "en", "s", 0)]
    d = tables(documents=(docs, DOCS), conversations=(turns, "conv_id long, turn long, role string, text string"), benchmark=(items, "item_id long, text string"))
    clean = {r.doc_id: r.clean for r in catalogue.QUERIES["strip_foreign"](spark, d).collect()}
    assert all("three" in clean[i] if i == 3 else "end" in clean[i] for i in clean)
    assert not any(c in "".join(clean.values()) for c in "完перевод")
    digest = lambda t: hashlib.md5(t.encode()).hexdigest()
    asked = {(r.conv_id, r.turn): r.digest for r in catalogue.QUERIES["follow_up_query"](spark, d).collect()}
    assert asked == {(1, 0): digest(turns[0][3]), (1, 1): digest(turns[0][3] + "\n" + turns[1][3]), (2, 0): digest(turns[2][3]), (2, 1): digest(turns[3][3])}
    found = catalogue.QUERIES["eval_recall_precision_mrr"](spark, d).first()
    # each item is in one document; three documents share its first characters
    assert found.queries == 2 and found.precision == pytest.approx(1 / 3, abs=1e-4)


@contextlib.contextmanager
def large_batches(spark):
    """Arrow batches as large as Spark makes them unless it is told otherwise; the session's own setting comes back."""
    keys = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
    had = {k: spark.conf.get(k, None) for k in keys}
    for k in keys:
        spark.conf.unset(k)
    try:
        yield lambda: (int(spark.conf.get(keys[0])), int(spark.conf.get(keys[1]).rstrip("bB")))
    finally:
        for k, v in had.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


@pytest.mark.parametrize("forms", [False, True])
def test_postings_are_made_in_small_batches(spark, forms):
    docs = spark.range(3000).select(F.col("id").alias("k"), F.array(F.lit("cuti"), F.concat(F.lit("w"), F.col("id") % 7)).alias("t"))
    with large_batches(spark) as limits:
        found = lexical_index._postings(lexical_index._rows(docs, "k", "t", []), forms)
        assert limits()[0] <= BATCH_ROWS and limits()[1] <= BATCH_BYTES
        assert found.groupBy("term").count().where("term IS NULL OR term = 'cuti'").agg(F.sum("count")).first()[0] == 6000


def _sql_rows(folder, sql, *names):
    con = duckdb.connect()
    for name in names:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return sorted(con.execute(sql).fetchall())


def test_upper_case_and_references_of_the_sql(spark, tables):
    """ß becomes two letters; a reference without its semicolon stands for its character."""
    d = tables(documents=([(50, "straße ŉ\nzwei", "de", "src1"), (51, "ß", "de", "src1")], "doc_id long, text string, lang string, source string"),
               pages=([(1, "u", "<body><h1>a &amp;&amp</h1><p>b &lt c &amp;lt; &copy;</p></body>")], "page_id long, url string, html string"))
    for name, table in (("replace_document", "documents"), ("html_text", "pages")):
        rows = sorted(tuple(r) for r in catalogue.QUERIES[name](spark, d).collect())
        assert rows == _sql_rows(d, catalogue.ORACLE_SQL[name], table)


def test_series_begin_where_seconds_are_cut(spark, tables):
    """Half a second before a step's end is in that step."""
    at = datetime.datetime(2024, 1, 1, 2, 59, 59, 600_000)
    d = tables(events=([(1, at, 5, "view", 1.0, "{}"), (2, at + datetime.timedelta(seconds=1), 5, "view", 1.0, "{}")], "event_id long, ts timestamp, user_id long, event_type string, value double, props string"))
    rows = sorted(tuple(r) for r in catalogue.QUERIES["log_series"](spark, d).collect())
    assert [r[:2] for r in rows] == [(1704067200, 1), (1704078000, 1)]
    assert rows == _sql_rows(d, catalogue.ORACLE_SQL["log_series"], "events")


def test_doubled_quotes_that_the_sniffer_does_not_see():
    line = '4734$$$ token = "40d78a45"### La%%% échmentré.### 126.57.31.34%%%'
    assert list(sheets.delimited_rows(q_formats.BUILDERS["csv"]([line]))) == [["Nomor", "Isi"], ["1", line]]


def test_sums_do_not_depend_on_the_order_of_rows(spark):
    cents = [0.1, 0.2, 33554432.07, 1e15 + 0.25] * 5000
    rows = spark.createDataFrame([(x,) for x in cents], "x double").repartition(7)
    assert rows.agg(exact_sum(F.col("x"))).first()[0] == math.fsum([1, 2, 335544320.7, 1e16 + 2.5]) * 500
    few = spark.createDataFrame([(0.5, 1), (1e30, 1), (None, 1), (1e30, 2), (None, 3)], "x double, k int")
    assert {r.k: r.v for r in few.groupBy("k").agg(exact_sum(F.col("x")).alias("v")).collect()} == {1: 1e30, 2: 1e30, 3: None}


def test_files_and_vectors_go_in_small_batches(spark):
    docs = spark.range(600).select(F.concat(F.lit("/in/"), "id", F.lit(".csv")).alias("path"), F.concat(F.lit("Nomor,Isi\n1,a"), "id", F.lit("\n2,b\n")).cast("binary").alias("content"))
    made = {
        "pages": (lambda: reader.pages_of(docs), 600),
        "rows": (lambda: reader.tables_in(docs), 1200),
        "vectors": (lambda: hash_embedding(docs.select("path"), "path"), 600),
    }
    for make, n in made.values():
        with large_batches(spark) as limits:
            found = make()
            assert limits()[0] <= BATCH_ROWS and limits()[1] <= BATCH_BYTES
            assert found.count() == n
    got = {(r.path, r.row_index): list(r["values"] or []) for r in reader.tables_in(docs.union(spark.createDataFrame([("/in/bad.xlsx", b"PK")], docs.schema))).collect()}
    assert len(got) == 1201 and got["/in/7.csv", 0] == ["1", "a7"] and got["/in/7.csv", 1] == ["2", "b"]


def test_dense_questions_keep_the_best_of_all_batches(spark):
    vectors = [(i, [float(i % 50), float(i % 7)]) for i in range(1000)]  # many ties
    rows = spark.createDataFrame(vectors, "vec_id long, v array<double>").repartition(3)
    asked = rows.where("vec_id % 100 = 0").selectExpr("vec_id AS query_id", "v AS query_vector")
    got = {(r.query_id, r["rank"]): r.vec_id for r in search.dense_many(rows, "vec_id", "v", asked, 4).collect()}
    for q, (a, b) in vectors[::100]:
        best = sorted((-(a * x + b * y), i) for i, (x, y) in vectors if i != q)[:4]
        assert [got[q, k] for k in range(1, 5)] == [i for _, i in best]
    with large_batches(spark) as limits:
        search.dense_many(rows, "vec_id", "v", asked, 4)
        assert limits()[0] <= BATCH_ROWS and limits()[1] <= BATCH_BYTES


def test_stages_are_told_from_sorted_rows(spark):
    """No group is handed to Python whole, and a document goes on in the next batch."""
    rows = spark.range(900).selectExpr("IF(id < 700, 1, IF(id < 800, 2, NULL)) AS document_id", "CAST(id AS INT) AS chunk_index", "CAST(id % 5 AS INT) AS tokens").repartition(5)
    found = context.grouped(rows, 9, most_parts=150, most_stages=20)
    assert "FlatMapGroups" not in found._jdf.queryExecution().toString()
    got = {r.chunk_index: (r.stage, r.covered) for r in found.collect()}
    for start, end in ((0, 700), (700, 800), (800, 900)):
        stage, room = 0, 9
        for i in range(start, end):
            if i > start and i % 5 > room:
                stage, room = stage + 1, 9
            room -= i % 5
            assert got[i] == (stage, stage < 20 and i - start < 150)


def test_only_asked_terms_are_shuffled_by_block(spark, tmp_path):
    docs = spark.range(300).selectExpr("id AS k", "array('cuti', concat('w', id % 9), concat('x', id)) AS t")
    index = lexical_index.LexicalIndex(spark, str(tmp_path / "index")).build(docs, "k", "t")
    asked = index._weighted(spark.createDataFrame([(1, "cuti"), (1, "w3"), (2, "w3"), (2, "x5")], "query_id int, term string"), index.state())
    for made in (index._bounds(asked, index.state()), index._scored(asked, spark.range(5).selectExpr("1 AS query_id", "CAST(id AS INT) AS block"), index.state(), None)):
        assert "LeftSemi" in made._jdf.queryExecution().optimizedPlan().toString()
    many, best = (sorted(map(tuple, how(asked.select("query_id", "term"), 5).selectExpr("query_id", "key", "round(score, 6)", "rank").collect())) for how in (index.search_many, index.search_best))
    assert best == many and len(best) == 10


@pytest.mark.parametrize("forms", [False, True])
def test_postings_are_counted_whole_and_handed_on_in_slices(forms, monkeypatch):
    """Slices cut through documents; documents without words, repeated words and words of one form keep their rows."""
    texts = [[], ["cuti"], ["mengajukan", "ajukan", "cuti", "mengajukan", "x"], [], ["é", "日本", "cuti"] * 40, [f"w{i}" for i in range(30)], []]
    batch = pa.RecordBatch.from_pydict({"key": list(range(7)), "lang": ["a", None] * 3 + ["b"], "tokens": pa.array(texts, pa.list_(pa.string()))})
    expected = set()
    for k, (lang, words) in enumerate(zip(["a", None] * 3 + ["b"], texts, strict=True)):
        table = defaultdict(list)
        for place, word in enumerate(words):
            for form in stem_forms(word) if forms else [word]:
                table[form].append(place)
        dl = sum(map(len, table.values()))
        expected |= {(k, lang, dl, len(words), term, len(at), tuple(at) if forms else None) for term, at in table.items()} | {(k, lang, dl, len(words), None, 0, None)}
    for size in (1, 7, 50_000):
        monkeypatch.setattr(lexical_index, "SLICE_POSTINGS", size)
        made = list(lexical_index._counted(batch, forms))
        assert max(b.num_rows for b in made) <= size
        rows = [r for b in made for r in b.to_pylist()]
        got = [(r["key"], r["lang"], r["dl"], r["words"], r["term"], r["tf"], tuple(r["places"]) if r.get("places") is not None else None) for r in rows]
        assert len(got) == len(expected) and set(got) == expected
    assert not sum(b.num_rows for b in lexical_index._counted(batch.slice(0, 0), forms))


def test_an_index_takes_no_null_for_a_word(spark, tmp_path):
    docs = spark.createDataFrame([(1, ["cuti", None]), (2, None), (3, [None])], "k int, t array<string>")
    index = lexical_index.LexicalIndex(spark, str(tmp_path / "index")).build(docs, "k", "t")
    assert sorted(map(tuple, index.docs().collect())) == [(1, 1, 1), (2, 0, 0), (3, 0, 0)]
    assert [tuple(r) for r in index.frequencies().collect()] == [("cuti", 1)]


def test_cells_are_read_where_a_rows_cells_meet(spark, tables):
    """Cells are neither joined nor dealt by themselves; rows that occur twice, or differ in one cell only, give each cell once."""
    day = datetime.date(2024, 5, 1)
    rows = [(1, 1, "A", "O", 1234.5, 3.0, day), (1, 1, "A", "O", 1234.5, 3.0, day), (1, 1, "A", "F", 99.0, 3.0, day), (7, 2, "N", "O", 5.0, 4.0, day), (11, 1, "R", "F", 6.0, 6.0, day)]
    d = tables(lineitem=(rows, "l_orderkey long, l_linenumber int, l_returnflag string, l_linestatus string, l_extendedprice double, l_quantity double, l_shipdate date"))
    found = catalogue.QUERIES["number_parsing"](spark, d)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Aggregate" in plan
    got = sorted(((r.row_index, r.cell, r.number, r.numeric) for r in found.collect()), key=repr)
    one = [(11, "1234.50", 1234.5, True), (11, "99.00", 99.0, True), (11, "3", 3.0, True), (11, "2024-05-01", None, False), (11, " A", None, False)]
    other = [(72, "", None, False), (72, "4", 4.0, True), (72, "2024-05-01", None, False), (72, " N", None, False), (111, "n/a", None, False), (111, "6", 6.0, True), (111, "2024-05-01", None, False), (111, " R", None, False)]
    assert got == sorted(one + other, key=repr)


def test_a_cell_is_numeric_whether_its_number_is_at_hand_or_not(spark):
    cells = ["12", " 1.234,5 ", "-3", "(4)", "5%", "$7", "Rp 8.000", "9 kg", "1/2/2024", "A1", "%", "", " ", None, "１２", "1 2", "12 juta", "٣", ",", "1e5", "K", "3 ⅓"]
    rows = spark.createDataFrame([(c,) for c in cells], "c string").withColumn("number", parse_number(F.col("c")))
    for r in rows.select("c", is_numeric_cell(F.col("c")).alias("alone"), is_numeric_cell(F.col("c"), F.col("number")).alias("beside")).collect():
        assert r.alone is r.beside, r.c


def _workbook(sheet):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    return out.getvalue()


def test_pages_of_a_workbook_hold_no_tree_of_a_sheet():
    """What a page takes beside its own text does not grow with a sheet's rows, and its edges are printed all the same."""
    n, edges = 20_000, "<headerFooter><oddHeader>&amp;LKop &amp;P</oddHeader><oddFooter>Kaki</oddFooter></headerFooter>"
    rows = "".join(f"<row r='{i}'><c r='A{i}'><v>{i}</v></c></row>" for i in range(1, n + 1))
    made = _workbook(f"<x:worksheet xmlns:x='urn:x'><sheetData>{rows}</sheetData>{edges}</x:worksheet>")
    tracemalloc.start()
    parser, pages = parsers.parse("a.xlsx", made)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (parser, pages) == ("xlsx", [(1, "\n".join(["sheet1", *(f"baris {i}: A={i}" for i in range(1, n + 1)), "Header cetak: Kop", "Footer cetak: Kaki"]))])
    assert peak < 8 * len(pages[0][1])


@pytest.mark.parametrize("over", range(-9, 2))
def test_a_sheet_that_declares_entities_is_refused_wherever_it_does(over):
    """Sheets are searched in pieces; the sign may begin before a piece's end and go on in the next."""
    head = "<w><sheetData><row><c><v>1</v></c></row></sheetData>"
    sheet = head + "x" * (archive.PIECE + over - len(head) - len("<![CDATA[")) + "<![CDATA[{}]]></w>"
    assert sheet.index("{}") == archive.PIECE + over
    assert parsers.parse("a.xlsx", _workbook(sheet.format("<!ENTIT")))[1] == [(1, "sheet1\nbaris 1: A=1")]
    with pytest.raises(parsers.Unreadable, match="declares entities"):
        parsers.parse("a.xlsx", _workbook(sheet.format("<!ENTITY")))
