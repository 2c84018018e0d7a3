"""Rules over whole tables: identifiers, generic summaries, public addresses, comparisons and heads of files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import urls
from tarn.functions.text import plain_tokens
from tarn.operators import catalog, routing, search
from tarn.plans.q_search import BM25_BATCH, index_of
from tarn.plans.q_text import KEEP, _surface_sql


def _read(spark, d, table):
    return spark.read.parquet(f"{d}/{table}.parquet")


def point_ids(spark, d):
    path = [F.col("source"), F.col("lang"), F.col("doc_id"), F.concat(F.lit("chunk_"), F.length("text").cast("string"))]
    return _read(spark, d, "documents").select("doc_id", catalog.point_id(*path, prefix="tarn:").alias("point_id"))


def generic_summaries(spark, d):
    """Requests for a summary, with and without a topic, from whole questions."""
    asked = F.element_at(F.array(*map(F.lit, ["buat ringkasan 5 poin utama", "Summarize the key points of all documents", "rangkum: ", "3 poin penting "])), (F.col("turn") % 4 + 1).cast("int"))
    text = F.when(F.col("turn") % 4 < 2, asked).otherwise(F.concat(asked, "text"))
    rows = _read(spark, d, "conversations").select("conv_id", "turn", text.alias("q"))
    return rows.select("conv_id", "turn", routing.intents(F.col("q"))["summary"].alias("summary"), routing.generic_summary(F.col("q")).alias("generic"))


#: Hosts by page: names, and addresses inside and outside of blocked networks.
HOSTS = ["example.org", "localhost", "127.0.0.1", "10.1.2.3", "172.31.0.9", "172.32.0.9", "192.168.7.7", "169.254.169.254", "8.8.8.8", "[::1]", "100.64.0.1", "files.internal"]
REFUSED = [None, "host", "address", "address", "address", None, "address", "host", None, "address", "address", "host"]


def public_urls(spark, d):
    """Addresses of all pages with their host, and with one that must not be fetched."""
    host = F.element_at(F.array(*map(F.lit, HOSTS)), (F.col("page_id") % len(HOSTS) + 1).cast("int"))
    other = F.regexp_replace("url", r"^(\w+)://[^/?#]*", F.concat(F.lit("$1://"), host))
    return _read(spark, d, "pages").select("page_id", urls.refusal_of(F.col("url")).alias("own"), urls.refusal_of(other).alias("moved"))


def comparison_focus(spark, d):
    """Every item asks, every third one for a comparison; documents of its best hits, by source."""
    items = _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("bandingkan "), "text")).otherwise(F.col("text")).alias("q"))
    asked = items.select("query_id", F.explode(F.array_distinct(plain_tokens(F.col("q")))).alias("term"))
    hits = index_of(spark, d).search_many(asked, search.pool_size(10)).withColumnRenamed("key", "doc_id")
    wide = items.select("query_id", routing.intents(F.col("q"))["multi_document"].alias("wide"))
    rows = hits.join(F.broadcast(wide), "query_id").join(_read(spark, d, "documents").select("doc_id", "source"), "doc_id")
    return search.focus_many(rows, "source", "score", F.col("wide")).select("query_id", "doc_id", "source")


QUERIES = {f.__name__: f for f in (point_ids, generic_summaries, public_urls, comparison_focus)}
ASKED = "CASE turn % 4 WHEN 0 THEN 'buat ringkasan 5 poin utama' WHEN 1 THEN 'Summarize the key points of all documents' WHEN 2 THEN 'rangkum: ' || text ELSE '3 poin penting ' || text END"
_UUID = "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || translate(substr(h, 17, 1), '0123456789abcdef', '89ab89ab89ab89ab') || substr(h, 18, 3) || '-' || substr(h, 21, 12)"
ORACLE_SQL: dict[str, str] = {
    "point_ids": f"SELECT doc_id, {_UUID} AS point_id FROM (SELECT doc_id, sha1(unhex('{catalog.URL_SPACE}') || encode('tarn:' || source || '|' || lang || '|' || doc_id || '|chunk_' || length(text))) AS h FROM documents)",
    "generic_summaries": _surface_sql("q").replace("doc_id", "id").replace("FROM documents", f"FROM (SELECT conv_id * 1000 + turn AS id, {ASKED} AS q FROM conversations)")
    + f""", n AS (SELECT id, count(*) AS n FROM w WHERE {KEEP} AND form NOT IN ({", ".join(f"'{x}'" for x in sorted(set(routing.SUMMARY_FORM)))}) AND NOT regexp_full_match(form, '\\p{{Nd}}+') GROUP BY 1)
SELECT conv_id, turn, regexp_matches({ASKED}, '{routing.SUMMARY_REQUEST}') AS summary, coalesce(n, 0) = 0 AS generic FROM conversations LEFT JOIN n ON n.id = conv_id * 1000 + turn""",
    "public_urls": f"SELECT page_id, NULL::VARCHAR AS own, [{', '.join('NULL' if r is None else repr(r) for r in REFUSED)}][page_id % {len(HOSTS)} + 1] AS moved FROM pages",
    "comparison_focus": BM25_BATCH.replace("FROM benchmark", "FROM (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'bandingkan ' || text ELSE text END AS text FROM benchmark)")
    + f""", p2 AS (SELECT r.query_id, r.doc_id, r.score, d2.source FROM r JOIN documents d2 USING (doc_id) WHERE r.rank <= 120),
w AS (SELECT item_id AS query_id, regexp_matches(CASE WHEN item_id % 3 = 0 THEN 'bandingkan ' || text ELSE text END, '{routing.MULTI_DOCUMENT}') AS wide FROM benchmark),
bs AS (SELECT query_id, source, max(score) AS best FROM p2 GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(best, 9) DESC, source) AS place, max(best) OVER (PARTITION BY query_id) AS top FROM bs JOIN w USING (query_id))
SELECT p2.query_id, p2.doc_id, p2.source FROM p2 JOIN k USING (query_id, source)
WHERE k.place <= CASE WHEN k.wide THEN 6 ELSE 3 END AND k.best >= k.top * CASE WHEN k.wide THEN 0.8::DOUBLE * 0.6::DOUBLE ELSE 0.8::DOUBLE END""",
}
