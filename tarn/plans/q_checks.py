"""Uploads, stored tables, crawl rules, narrowed views and sources that are written as files first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import text, urls
from tarn.operators import chunker, crawl, logs, scope, search, tables, unanswered
from tarn.plans.q_catalog import C, _chunks
from tarn.plans.q_logs import ASKED, LOG, _asked, _log
from tarn.plans.q_tables import SHEET, _items
from tarn.plans.q_text import MARKS
from tarn.session import scratch_path
from tarn.sources import formats, reader, table_store


def _read(spark, d, t):
    return spark.read.parquet(f"{d}/{t}.parquet")


def _pick(of: str, *values):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(of) % len(values) + 1).cast("int"))


def unanswered_filtered(spark, d):
    found = unanswered.filtered(unanswered.upsert(_asked(spark, d)), "org", allowed=("kb0", "kb1"), status="open", search=" Th%e!")
    return found.select("knowledge_base_id", "query_key", "count")


def unanswered_status_change(spark, d):
    """Questions of one knowledge base are resolved, those of another go."""
    table = unanswered.upsert(_asked(spark, d))
    one = table.where("knowledge_base_id = 'kb1'").agg(F.min("query_key")).first()[0]  # one key
    changed = unanswered.without(unanswered.with_status(table, "org", one, "resolved"), table.where("knowledge_base_id = 'kb2'"))
    return changed.groupBy("knowledge_base_id", "status").agg(F.count("*").alias("n"))


def garbage_candidates(spark, d):
    made = F.when(F.col("doc_id") % 5 == 0, F.concat(F.repeat(F.lit("endobj %PDF-1 "), 2), F.repeat(F.lit("�"), (F.col("doc_id") % 3).cast("int")), F.col("text"))).otherwise(F.col("text"))
    return search.readable(_read(spark, d, "documents").select("doc_id", made.alias("content")), "content").select("doc_id")


def log_skip_paths(spark, d):
    return logs.recorded(_log(spark, d), (" /error ", "/sign", "/view/"), "/pur").groupBy("path").agg(F.count("*").alias("n"))


def tolerant_json(spark, d):
    c = _read(spark, d, "conversations")
    made = _pick("conv_id", '```json\n{"operation": "sum", "n": 1}\n```', 'Answer: {"operation": "avg", "where": {"column": "a"}} so', '{"operation": "count"}', "{broken", "")
    return c.select("conv_id", "turn", F.get_json_object(text.json_in(F.concat(made, F.when(F.col("conv_id") % 5 == 4, F.col("text")).otherwise(""))), "$.operation").alias("operation"))


def upload_checks(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("size"))
    name = _pick("doc_id", "a.PDF", "b.exe", "laporan", "c.txt", "d.docx")
    head = F.when(F.col("doc_id") % 3 == 0, "%PDF-1.7").otherwise("plain").cast("binary")
    mime = F.when(F.col("doc_id") % 4 == 0, "application/x-pdf").otherwise("application/octet-stream")
    return docs.select("doc_id", formats.upload_refusal(name, head, F.col("size") - 200, mime, 5000).alias("refusal"), formats.label_refused(name).alias("label_refused"))


def safe_names(spark, d):
    made = F.concat(_pick("doc_id", "dir/sub/Lap oran", "..a&b", "/", "x__"), F.col("doc_id").cast("string"), _pick("doc_id", ".pdf", "!", "/", "."))
    return _read(spark, d, "documents").select("doc_id", formats.safe_name(made).alias("name"))


def _stored(spark, d) -> str:
    """Nations, regions and suppliers as stored sheets."""

    def sheet(table, document, title, headers, first, *columns):
        order = F.col(columns[0]).cast("int") - first  # keys count rows, from the first one on
        rows = _read(spark, d, table).select(order.alias("row_index"), F.array(*[F.col(c).cast("string") for c in columns]).alias("values"))
        about = {"organization_id": "org", "knowledge_base_id": "kb", "document_id": document, "document_name": f"{document}.xlsx", "table_id": f"{document}#0", "sheet": title}
        return rows.withColumns({k: F.lit(v) for k, v in about.items()} | {"headers": F.array(*map(F.lit, headers)), "notes": F.array().cast("array<string>"), "truncated": F.lit(False)})

    made = [
        sheet("nation", "negara", "Negara", ["Kunci", "Nama Negara"], 0, "n_nationkey", "n_name"),
        sheet("region", "wilayah", "Wilayah", ["Kunci", "Nama Wilayah"], 0, "r_regionkey", "r_name"),
        sheet("supplier", "pemasok", "Pemasok", ["Kunci", "Nama Pemasok", "Saldo"], 1, "s_suppkey", "s_name", "s_acctbal"),
    ]
    path = scratch_path(spark, "tables")
    table_store.write(reduce(DataFrame.unionByName, made), path)
    return path


def table_listing(spark, d):
    found = table_store.listed(spark, _stored(spark, d), scope.Scope("org", ("kb",), ("negara", "pemasok")))
    return found.select("document_id", "table_id", "sheet", F.array_join("headers", "|").alias("headers"), "rows")


def table_row_scan(spark, d):
    return table_store.rows_of(spark, _stored(spark, d), "negara#0").select("row_index", F.array_join("values", "|").alias("cells"))


def table_choice(spark, d):
    questions = _read(spark, d, "conversations").where("role = 'user'").select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.concat(_pick("conv_id", "berapa saldo pemasok ", "nama wilayah dan negara ", ""), "text").alias("query"))
    listed = table_store.listed(spark, _stored(spark, d), scope.Scope("org"))
    return tables.choose(questions, listed, 2).select("query_id", "table_id", "overlap", "place")


def date_columns(spark, d):
    return tables.date_columns(_items(spark, d), "row_index")


def robots_allowed(spark, d):
    pages = _read(spark, d, "pages").select("page_id", "url")
    all_ = "User-agent: *\nDisallow: /en/7\nAllow: /en\nDisallow: /fr  # French\nDisallow:\n"
    own = "User-Agent: Tarnbot\r\nUser-agent: other\r\nDisallow: /de\r\n\r\n" + all_
    hosts = pages.select(urls.host(F.col("url")).alias("host")).distinct()
    robots = hosts.where(~F.endswith("host", F.lit(".net"))).withColumn("body", F.when(F.endswith("host", F.lit(".org")), own).otherwise(all_))
    return crawl.allowed(pages, crawl.robot_rules(robots, "tarnbot/1.0")).select("page_id", "allowed")


def scope_documents(spark, d):
    found = scope.scoped(_chunks(spark, d), scope.Scope("src3", ("en", "de"), tuple(range(0, 2000, 3))))
    return found.groupBy("document_id").agg(F.count("*").alias("n"))


def source_log_files(spark, d):
    """Log lines in files, bare or as a container's driver wraps them, and other lines between them."""
    e = _read(spark, d, "events")
    level = F.when(F.col("event_type") == "error", "error").otherwise("info")
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    bare = F.to_json(F.struct(level.alias("level"), F.col("event_type").alias("logger"), stamp.alias("timestamp")))
    wrapped = F.to_json(F.struct(F.to_json(F.struct(level.alias("level"), F.col("event_type").alias("logger"))).alias("log"), stamp.alias("time")))
    path = scratch_path(spark, "logs")
    e.select(F.when(F.col("event_id") % 7 == 0, "plain text").when(F.col("event_id") % 2 == 0, bare).otherwise(wrapped).alias("value")).write.text(path)
    return reader.log_summary(spark, path).select("level", "logger", "count", "first", "last")


def source_csv_tables(spark, d):
    """Sheets in files: written with a header each, read back by position."""
    path = scratch_path(spark, "sheets")
    _items(spark, d).select("Flag", "Status", "Jumlah Barang", "Tanggal").write.option("header", "true").option("sep", ";").csv(path)
    rows = reader.read_tables(spark, path).where("row_index IS NOT NULL")
    cells = reader.as_table(rows, ["Flag", "Status", "Jumlah Barang", "Tanggal"])
    return cells.groupBy("Flag").agg(F.count("*").alias("n"), F.sum(F.col("Jumlah Barang").cast("double")).alias("quantity"), F.min("Tanggal").alias("first"), F.sum((F.col("Status") != "").cast("long")).alias("filled"))


def text_shapes(spark, d):
    made = F.when(F.col("doc_id") % 4 == 1, F.regexp_replace("text", r" +(\S+) +", " | $1 | ")).when(F.col("doc_id") % 4 == 2, F.regexp_replace("text", r"[.] ", ".\n")).otherwise(F.col("text"))
    return _read(spark, d, "documents").select("doc_id", chunker.shape(made).alias("shape"))


def sheet_headers(spark, d):
    """The first line of each document as a sheet's header."""
    first = F.split(F.element_at(F.split("text", "\n"), 1), " ")
    cells = _read(spark, d, "documents").select(F.col("doc_id").alias("table_id"), F.posexplode(first).alias("at", "cell"))
    return tables.header_names(cells.select("table_id", (F.col("at") + 1).alias("place"), F.when(F.col("at") % 5 == 3, "  ").otherwise(F.col("cell")).alias("cell")), 12)


QUERIES = {
    f.__name__: f
    for f in (
        unanswered_filtered, unanswered_status_change, garbage_candidates, log_skip_paths, tolerant_json, upload_checks, safe_names, table_listing,
        table_row_scan, table_choice, date_columns, robots_allowed, scope_documents, source_log_files, source_csv_tables, text_shapes, sheet_headers,
    )
}
SUFFIXES = ", ".join(f"'{e}'" for es in formats.EXTENSIONS.values() for e in es)
DATES = " UNION ALL ".join(
    f"SELECT '{shown}' AS \"column\", {str(named).lower()} AND coalesce(avg(CASE WHEN {c} <> '' THEN regexp_full_match({c}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}([ T][0-9]{{2}}:[0-9]{{2}}(:[0-9]{{2}})?)?')::INT END), 0) >= 0.6 AS is_date FROM f"
    for shown, c, named in (("Flag", "flag", False), ("Status", "status", False), ("Harga", "harga", False), ("Jumlah Barang", "jumlah", False), ("Tanggal", "tanggal", True))
)
WORDS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"
ORACLE_SQL = {
    "unanswered_filtered": ASKED + "SELECT knowledge_base_id, query_key, count FROM u WHERE knowledge_base_id IN ('kb0', 'kb1') AND contains(query_key, 'the')",
    "unanswered_status_change": ASKED + ", o AS (SELECT min(query_key) AS k FROM u WHERE knowledge_base_id = 'kb1') SELECT knowledge_base_id, CASE WHEN query_key = k THEN 'resolved' ELSE status END AS status, count(*) AS n FROM u, o WHERE knowledge_base_id <> 'kb2' GROUP BY ALL",
    "garbage_candidates": rf"""WITH m AS (SELECT doc_id, substr(CASE WHEN doc_id % 5 = 0 THEN repeat('endobj %PDF-1 ', 2) || repeat('�', (doc_id % 3)::INT) || text ELSE text END, 1, 4000) AS h FROM documents),
c AS (SELECT doc_id, length(h) AS n, len(regexp_extract_all(h, '�')) AS b, len(regexp_extract_all(h, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]')) AS k, len(regexp_extract_all(h, '{MARKS}')) AS m FROM m)
SELECT doc_id FROM c WHERE coalesce(n, 0) = 0 OR NOT (b / n > 0.10 OR k > 20 OR m >= 4 OR (m >= 2 AND (b > 0 OR k > 5)))""",
    "log_skip_paths": LOG + "SELECT path, count(*) AS n FROM l WHERE path NOT LIKE '/pur%' AND path <> '/error' AND path NOT LIKE '/error/%' AND path <> '/sign' AND path NOT LIKE '/sign/%' AND path <> '/view/' AND path NOT LIKE '/view/%' GROUP BY 1",
    "tolerant_json": r"""WITH m AS (SELECT conv_id, turn, ['```json' || chr(10) || '{"operation": "sum", "n": 1}' || chr(10) || '```', 'Answer: {"operation": "avg", "where": {"column": "a"}} so', '{"operation": "count"}', '{broken', text][conv_id % 5 + 1] AS t FROM conversations),
b AS (SELECT conv_id, turn, CASE WHEN starts_with(t, '```') THEN trim(rtrim(trim(regexp_replace(t, '^```[a-zA-Z]*', ''), ' ' || chr(10)), '`'), ' ' || chr(10)) ELSE t END AS t FROM m)
SELECT conv_id, turn, json_extract_string(CASE WHEN json_valid(t) THEN t WHEN json_valid(regexp_extract(t, '(?s)\{.*\}')) THEN regexp_extract(t, '(?s)\{.*\}') END, '$.operation') AS operation FROM b""",
    "upload_checks": f"""WITH m AS (SELECT doc_id, strlen(text) - 200 AS size, ['.pdf', '.exe', '', '.txt', '.docx'][doc_id % 5 + 1] AS suffix, doc_id % 3 = 0 AS pdf, doc_id % 4 = 0 AS typed FROM documents)
SELECT doc_id, CASE WHEN coalesce(size, 0) = 0 THEN 'empty' WHEN size > 5000 THEN 'too_large' WHEN suffix NOT IN ({SUFFIXES}) AND NOT typed THEN 'unsupported' WHEN pdf AND suffix <> '.pdf' THEN 'not_named_pdf' END AS refusal,
suffix <> '' AND suffix NOT IN ({SUFFIXES}) AS label_refused FROM m""",
    "safe_names": r"""WITH m AS (SELECT doc_id, ['dir/sub/Lap oran', '..a&b', '/', 'x__'][doc_id % 4 + 1] || doc_id || ['.pdf', '!', '/', '.'][doc_id % 4 + 1] AS n FROM documents)
SELECT doc_id, coalesce(nullif(trim(regexp_replace(list_filter(string_split(n, '/'), lambda x: x <> '')[-1], '[^A-Za-z0-9._-]+', '_', 'g'), '._'), ''), 'document') AS name FROM m""",
    "table_listing": "SELECT 'negara' AS document_id, 'negara#0' AS table_id, 'Negara' AS sheet, 'Kunci|Nama Negara' AS headers, count(*) AS rows FROM nation UNION ALL SELECT 'pemasok', 'pemasok#0', 'Pemasok', 'Kunci|Nama Pemasok|Saldo', count(*) FROM supplier",
    "table_row_scan": "SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS row_index, n_nationkey || '|' || n_name AS cells FROM nation",
    "table_choice": f"""WITH q AS (SELECT conv_id * 100 + turn AS query_id, {WORDS.format("['berapa saldo pemasok ', 'nama wilayah dan negara ', ''][conv_id % 3 + 1] || text")} AS w FROM conversations WHERE role = 'user'),
t(table_id, w) AS (VALUES ('negara#0', ['negara', 'xlsx', 'kunci', 'nama']), ('wilayah#0', ['wilayah', 'xlsx', 'kunci', 'nama']), ('pemasok#0', ['pemasok', 'xlsx', 'kunci', 'nama', 'saldo'])),
o AS (SELECT query_id, table_id, len(list_intersect(q.w, t.w)) AS overlap FROM q, t),
r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, table_id))::INT AS place FROM o WHERE overlap > 0 OR table_id IN (SELECT table_id FROM t ORDER BY table_id LIMIT 2))
SELECT query_id, table_id, overlap, place FROM r WHERE place <= 2""",
    "date_columns": SHEET + f", f AS (SELECT * FROM t ORDER BY row_index LIMIT 50) {DATES}",
    "robots_allowed": r"""WITH p AS (SELECT page_id, regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1) AS h, regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^#]*)', 1) AS p FROM pages)
SELECT page_id, CASE WHEN h LIKE '%.net' THEN true WHEN h LIKE '%.org' THEN NOT starts_with(p, '/de') WHEN starts_with(p, '/en/7') THEN false WHEN starts_with(p, '/en') THEN true ELSE NOT starts_with(p, '/fr') END AS allowed FROM p""",
    "scope_documents": C + "SELECT document_id, count(*) AS n FROM ch WHERE organization_id = 'src3' AND knowledge_base_id IN ('en', 'de') AND document_id % 3 = 0 AND document_id < 2000 GROUP BY 1",
    "source_log_files": """SELECT CASE WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level, event_type AS logger, count(*) AS count, min(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS first, max(strftime(ts, '%Y-%m-%dT%H:%M:%S')) AS last FROM events WHERE event_id % 7 <> 0 GROUP BY ALL""",
    "text_shapes": r"""WITH m AS (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN regexp_replace(text, ' +(\S+) +', ' | \1 | ', 'g') WHEN 2 THEN regexp_replace(text, '[.] ', '.' || chr(10), 'g') ELSE text END AS t FROM documents),
l AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(t, '\r\n|\r|\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM m),
c AS (SELECT doc_id, len(l) AS n, len(list_filter(l, lambda x: regexp_matches(x, '^\s*\|.*\|\s*$|^[^\n\t]*\t[^\n\t]*\t|^\s*[^\n|]+\s\|\s[^\n|]+'))) AS r, list_sort(list_transform(l, lambda x: length(x))) AS s FROM l)
SELECT doc_id, CASE WHEN n > 0 AND r >= greatest(1, floor(n * 0.6::DOUBLE)) THEN 'table' WHEN n >= 8 AND s[n // 2 + 1] <= 120 THEN 'lines' ELSE 'prose' END AS shape FROM c""",
    "sheet_headers": r"""WITH a AS (SELECT doc_id AS table_id, string_split(string_split(text, chr(10))[1], ' ') AS c FROM documents),
b AS (SELECT table_id, unnest(c) AS cell, generate_subscripts(c, 1)::INT AS place FROM a),
e AS (SELECT table_id, place, CASE WHEN place % 5 = 4 OR trim(regexp_replace(cell, '\s+', ' ', 'g')) = '' THEN 'kolom_' || place ELSE trim(regexp_replace(cell, '\s+', ' ', 'g')) END AS name FROM b),
g AS (SELECT *, row_number() OVER (PARTITION BY table_id, name ORDER BY place) AS n FROM e)
SELECT table_id, place, substr(CASE WHEN n = 1 THEN name ELSE name || '_' || n END, 1, 12) AS header FROM g""",
    "source_csv_tables": SHEET + "SELECT trim(flag) AS \"Flag\", count(*) AS n, sum(q) AS quantity, min(tanggal) AS first, count(*) FILTER (WHERE trim(status) <> '') AS filled FROM n GROUP BY 1",
}
