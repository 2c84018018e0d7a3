"""Sources and generated answers over driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn import providers
from tarn.operators import answers
from tarn.sources import formats, reader


def _docs(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source")


def source_routing(spark, d):
    names = F.element_at(F.array(*map(F.lit, ["a.txt", "b.PDF", "c.docx", "d", "e.csv", "f.xyz"])), (F.col("doc_id") % 6 + 1).cast("int"))
    head = F.when(F.col("doc_id") % 7 == 0, "{\\rtf1 x").when(F.col("doc_id") % 7 == 1, " <!DOCTYPE html><p>").otherwise(F.substring("text", 1, 1024)).cast("binary")
    return _docs(spark, d).select("doc_id", formats.parser_column(names, head, F.lit("text/plain")).alias("parser"))


def source_text_pages(spark, d):
    """Line by line as pages: by form feeds, by numbered lines, or not at all."""
    numbered = F.array_join(F.transform(F.split("text", "\n"), lambda t, i: F.concat(F.lit("[Page "), (i + 7).cast("string"), F.lit("]\n"), t)), "\n")
    made = _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.regexp_replace("text", "\n", "\f")).when(F.col("doc_id") % 3 == 1, numbered).otherwise(F.col("text")).alias("raw"))
    return reader.text_pages(made, "raw").select("doc_id", "page", F.md5("page_text").alias("digest"))


def source_json_pages(spark, d):
    """Pages with and without numbers, plain pages, documents without pages, and text that is no JSON."""
    page = lambda n, t: F.struct(F.lit(n).alias("page"), t.alias("text"))
    made = _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 8 == 3, '{"title": "none", "about": {"n": [1, 2.5], "é": null}}').when(F.col("doc_id") % 8 == 7, F.concat(F.lit("{"), F.col("source"))).when(F.col("doc_id") % 4 == 2, F.to_json(F.struct(F.array("text", "source").alias("pages")))).otherwise(F.to_json(F.struct(F.array(page(3, F.col("source")), page(None, F.col("text"))).alias("pages")))).alias("raw"))
    return reader.json_pages(made, "raw").select("doc_id", F.coalesce("page", F.lit(0)).alias("page"), F.coalesce(F.md5("page_text"), F.lit("")).alias("digest"), F.col("page_error").isNotNull().alias("failed"))


def payload_sizes(spark, d):
    made = _docs(spark, d).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.base64(F.col("text").cast("binary"))).alias("base64"), "text")
    made = made.withColumn("base64", F.regexp_replace("base64", r"\s", ""))
    return made.select("doc_id", providers.payload_size().cast("long").alias("size"))


def answer_checks(spark, d):
    made = _docs(spark, d).select("doc_id", F.element_at(F.array(*map(F.lit, ["Tidak ditemukan.", "Dokumen [1] tidak memuat informasi tentang gaji.", "Cuti 12 hari [1]. Gaji tidak ditemukan.", "hanyaLEMpar pemb.cgiian Tahunan2025 baik"])), (F.col("doc_id") % 4 + 1).cast("int")).alias("answer"), F.lit("cuti").alias("context"))
    return answers.judged(made).select("doc_id", "refused", F.array_join("damaged", ",").alias("damaged"))


QUERIES = {f.__name__: f for f in (source_routing, source_text_pages, source_json_pages, payload_sizes, answer_checks)}
CLEAN = r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace({t}, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]', '', 'g'), '[ \t]{{2,}}', ' ', 'g'), '[ \t]+(\n|$)', '\1', 'g'), '^\s+', ''), '\s+$', '')"
ORACLE_SQL = {
    "source_routing": "SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'rtf' WHEN doc_id % 7 = 1 THEN 'html' ELSE ['text', 'pdf', 'docx', 'text', 'csv', 'text'][doc_id % 6 + 1] END AS parser FROM documents",
    "source_text_pages": f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i, text FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN i + 6 WHEN doc_id % 3 = 0 THEN i ELSE 1 END::INT AS page, md5({CLEAN.format(t='CASE WHEN doc_id % 3 = 2 THEN text ELSE p END')}) AS digest FROM p WHERE doc_id % 3 < 2 OR i = 1""",
    "source_json_pages": f"""SELECT doc_id, 3 AS page, md5(source) AS digest, false AS failed FROM documents WHERE doc_id % 4 < 2
UNION ALL SELECT doc_id, 2, md5({CLEAN.format(t='text')}), false FROM documents WHERE doc_id % 4 < 2
UNION ALL SELECT doc_id, 1, md5({CLEAN.format(t='text')}), false FROM documents WHERE doc_id % 4 = 2
UNION ALL SELECT doc_id, 2, md5(source), false FROM documents WHERE doc_id % 4 = 2
UNION ALL SELECT doc_id, 0, '', true FROM documents WHERE doc_id % 8 = 7
UNION ALL SELECT doc_id, 1, md5(replace('{{| "title": "none",| "about": {{| "n": [| 1,| 2.5| ],| "é": null| }}|}}', '|', chr(10))), false FROM documents WHERE doc_id % 8 = 3""",
    "payload_sizes": "SELECT doc_id, strlen(text)::BIGINT AS size FROM documents",
    "answer_checks": "SELECT doc_id, doc_id % 4 < 2 AS refused, CASE WHEN doc_id % 4 = 3 THEN 'Tahunan2025,cgiian,hanyaLEMpar,pemb.cgiian' ELSE '' END AS damaged FROM documents",
}
