"""Pages and crawls, catalogues, mutations, context assembly and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import text, urls
from tarn.operators import catalog, context, crawl, evaluate, ratelimit, scope
from tarn.operators.chunk_store import ChunkStore
from tarn.plans.q_search import BM25_BATCH
from tarn.session import materialize
from tarn.sources.html import html_to_text


def _pages(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet")


def html_title(spark, d):
    return _pages(spark, d).select("page_id", text.html_title(F.col("html"), F.col("url")).alias("title"))


def html_links(spark, d):
    found = _pages(spark, d).select("page_id", F.posexplode(urls.links(F.col("html"), F.col("url"))).alias("place", "link"))
    return found


def url_normalize(spark, d):
    u = F.col("url")
    return _pages(spark, d).select("page_id", urls.for_visit(u).alias("visit"), urls.host(u).alias("host"), urls.without_fragment(u).alias("plain"), urls.safe_query(F.concat(F.regexp_extract(u, r"\?([^#]*)", 1), F.lit("&api_key=1"))).alias("query"))


def canonical(spark, d):
    made = F.concat(F.lit('<link rel="canonical" href="/c/'), F.col("page_id").cast("string"), F.lit('">'), F.col("html"))
    return _pages(spark, d).select("page_id", urls.canonical(made, F.col("url")).alias("canonical"))


def sniffed_types(spark, d):
    before = F.when(F.col("page_id") % 3 == 0, F.lit("%PDF-1.7")).when(F.col("page_id") % 3 == 1, F.lit("{\\rtf1")).otherwise(F.lit(""))
    head = F.substring(F.concat(before, "html"), 1, 200).cast("binary")
    return _pages(spark, d).select("page_id", urls.sniffed_type(head, F.lit("text/html")).alias("kind"))


def crawl_reach(spark, d):
    """From every tenth page, over links within its host, whether fetched or not, as deep as crawls go."""
    p = _pages(spark, d)
    return crawl.reach(crawl.edges(p), p.where("page_id % 10 = 0").select("url"))


def html_text(spark, d):
    return html_to_text(_pages(spark, d).select("page_id", "html"), "html", "text").select("page_id", F.md5("text").alias("digest"), F.length("text").cast("long").alias("n"))


def _chunks(spark, d):
    """Lines of documents as chunks; every seventh document has a summary."""
    docs = spark.read.parquet(f"{d}/documents.parquet")
    lines = docs.select(
        F.col("source").alias("organization_id"), F.col("lang").alias("knowledge_base_id"), F.col("doc_id").alias("document_id"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "content")
    )
    lines = lines.withColumn("chunk_id", F.format_string("chunk_%04d", "chunk_index")).withColumn("is_summary", F.lit(None).cast("boolean"))
    summaries = docs.where("doc_id % 7 = 0").select(
        F.col("source").alias("organization_id"), F.col("lang").alias("knowledge_base_id"), F.col("doc_id").alias("document_id"), F.lit(-1).alias("chunk_index"),
        F.col("text").alias("content"), F.lit("chunk_summary").alias("chunk_id"), F.lit(True).alias("is_summary"),
    )
    return lines.unionByName(summaries)


def _jobs(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").where("doc_id % 11 <> 0")
    base = docs.select(F.col("source").alias("organization_id"), F.col("lang").alias("knowledge_base_id"), F.col("doc_id").alias("document_id"), F.col("n_chars").alias("tokens"), F.explode(F.array(F.lit(1), F.lit(2))).alias("attempt"))
    state = F.when(F.col("attempt") == 1, "queued").when(F.col("document_id") % 5 == 0, "failed").when(F.col("document_id") % 13 == 0, "deleted").otherwise("completed")
    return base.select("organization_id", "knowledge_base_id", "document_id", state.alias("status"), (F.col("document_id") * 10 + F.col("attempt")).alias("updated_at"), F.lit(3).cast("long").alias("chunks"), "tokens")


def latest_job(spark, d):
    return catalog.latest_jobs(_jobs(spark, d)).select("document_id", "status", "updated_at")


def job_status_counts(spark, d):
    return catalog.status_counts(catalog.latest_jobs(_jobs(spark, d), True))


def document_list(spark, d):
    return catalog.documents(_jobs(spark, d), _chunks(spark, d)).select("document_id", "status", "vectors_in_store")


def jobs_without_index(spark, d):
    return catalog.missing(catalog.document_counts(_chunks(spark, d)), _jobs(spark, d), catalog.KEY[:3]).select("document_id", "chunks")


def kb_catalogue(spark, d):
    return catalog.knowledge_bases(_jobs(spark, d), _chunks(spark, d)).withColumn("updated_at", F.coalesce("updated_at", F.lit(0)))


def replace_document(spark, d):
    chunks = _chunks(spark, d)
    new = chunks.where("document_id % 50 = 0 AND chunk_index = 0").withColumn("content", F.upper("content"))
    return catalog.replace_document(chunks, new, ["document_id"]).groupBy("document_id").agg(F.count("*").alias("n"), F.max(F.md5("content")).alias("digest"))


def delete_document(spark, d):
    chunks = _chunks(spark, d)
    return catalog.delete_documents(chunks, chunks.where("document_id % 3 = 0"), ["document_id"]).groupBy("organization_id").agg(F.count("*").alias("n"))


def chunk_store_changes(spark, d):
    """A stored table of all chunks after documents were replaced, chunks changed and documents deleted."""
    chunks = _chunks(spark, d)
    store = ChunkStore(spark).create(chunks, 32)
    store.replace_documents(chunks.where("document_id % 10 = 3 AND chunk_index = 0").withColumn("content", F.concat(F.lit("first: "), "content")))
    store.upsert(chunks.where("document_id % 10 = 1 AND chunk_index = 0").withColumn("content", F.lit("new")))
    store.delete_documents(chunks.where("document_id % 10 = 7"))
    found = store.read().groupBy("organization_id", "knowledge_base_id")
    return found.agg(F.count("*").alias("n"), F.sum((F.col("content") == "new").cast("long")).alias("fresh"), F.sum(F.length("content")).alias("chars"), F.max(F.md5("content")).alias("digest"))


def upsert_chunks(spark, d):
    chunks = _chunks(spark, d)
    new = chunks.where("chunk_index = 1").withColumn("content", F.lit("new"))
    return catalog.upsert(chunks, new).groupBy("knowledge_base_id").agg(F.count("*").alias("n"), F.sum((F.col("content") == "new").cast("long")).alias("fresh"))


def migration_missing(spark, d):
    chunks = _chunks(spark, d)
    return catalog.missing(chunks, chunks.where("document_id % 2 = 0")).groupBy("organization_id").agg(F.count("*").alias("n"))


def chunk_scan(spark, d):
    return catalog.document_chunks(_chunks(spark, d), 7).select("document_id", "chunk_id", F.md5("content").alias("digest"))


def chunks_by_keys(spark, d):
    chunks = _chunks(spark, d)
    keys = chunks.where("document_id % 100 = 0").select("document_id", "chunk_id")  # the asked keys
    return catalog.by_keys(chunks, keys).select("document_id", "chunk_id", F.md5("content").alias("digest"))


def tenant_scope(spark, d):
    found = scope.without_summaries(scope.scoped(_chunks(spark, d), scope.Scope("src3", ("en", "fr"))))
    return found.groupBy("knowledge_base_id").agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("documents"))


def neighbour_expansion(spark, d):
    chunks = scope.without_summaries(_chunks(spark, d))
    hits = chunks.where("chunk_index % 5 = 2")
    return context.neighbours(hits, chunks, 2).select("document_id", "chunk_index", "distance")


def document_coverage(spark, d):
    chunks = _chunks(spark, d)
    included = chunks.where("is_summary OR (chunk_index BETWEEN 0 AND 4 AND document_id % 7 <> 0)")  # where there is a summary, it alone
    return context.coverage(included, chunks)


def _candidates(spark, d):
    """All chunks of all documents as ranked candidates: each forty documents in a row belong to one query."""
    place = F.pmod(F.col("document_id") * 31 + F.col("chunk_index") * 17, F.lit(101)) * 1_000_000 + F.col("document_id") % 40 * 10_000 + F.col("chunk_index")
    return _chunks(spark, d).withColumns({"rank": place, "document_order": F.col("chunk_index"), "query_id": F.floor(F.col("document_id") / 40).cast("long")})


def context_order(spark, d):
    return context.ordered(_candidates(spark, d), query="query_id").select("query_id", "position", "document_id", "chunk_id")


def context_union(spark, d):
    rows = _candidates(spark, d)
    hits, extras = rows.where("chunk_index % 3 = 1"), rows.where("chunk_index % 2 = 0")
    return context.merged(hits, extras, ["query_id", "document_id", "chunk_id"]).select("document_id", "chunk_id", "expanded")


def _priced(spark, d):
    return _candidates(spark, d).withColumn("tokens", text.estimate_tokens(F.col("content")))


def context_pack(spark, d):
    rows = context.ordered(_priced(spark, d), query="query_id")
    made = rows.select("query_id", F.concat_ws("::", F.col("document_id").cast("string"), "chunk_id").alias("key"), "tokens", F.coalesce("is_summary", F.lit(False)).alias("is_summary"), "position")
    return context.pack_contexts(made, 600, 12)


def overview_material(spark, d):
    rows = scope.without_summaries(_priced(spark, d))
    return context.overview(rows, rows.select("query_id", "document_id").distinct(), 24_000, query="query_id").select("document_id", "chunk_index", "upto")


def summary_attach(spark, d):
    rows = _candidates(spark, d)
    found = context.attach_summaries(rows.where("chunk_index >= 0"), _chunks(spark, d).where("is_summary"), query="query_id")
    return found.select("query_id", "document_id", "first")


def document_expansion(spark, d):
    """Every query's hits with what its documents have around them: small documents whole, neighbours in large ones, within a budget."""
    rows = materialize(scope.without_summaries(_priced(spark, d)).select("query_id", "document_id", "chunk_index", "rank", "tokens", "content"), "priced-chunks")
    return context.expanded(rows.where("chunk_index = 2"), rows, 12_000, 1).select("query_id", "document_id", "chunk_index", "upto")


def summary_stages(spark, d):
    """Every document's chunks in groups that fit a model's window."""
    rows = scope.without_summaries(_priced(spark, d))
    return context.grouped(rows, 60).select("document_id", "chunk_index", "stage", "covered")


def eval_recall_precision_mrr(spark, d):
    from tarn.plans.q_search import bm25_batch

    found = bm25_batch(spark, d).select("query_id", F.col("doc_id").alias("document_id"), "score")
    from pyspark.sql import Window

    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "document_id")))
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), "text")
    # an item's documents are those that hold all of its words in a row
    expected = evaluate.holding(docs, "doc_id", items, "query_id").select("query_id", F.col("doc_id").alias("document_id"))
    return evaluate.summary(evaluate.per_query(ranked, expected, 5))


def eval_rates(spark, d):
    made = spark.read.parquet(f"{d}/labels.parquet").select((F.col("quality") == 1).alias("answerable"), (F.col("doc_id") % 4 != 0).alias("answered"), (F.col("toxic") == 0).alias("grounded"), (F.col("doc_id") % 3 == 0).alias("cited"))
    return evaluate.rates(made)


def rate_limit_replay(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    made = e.select(F.col("event_type").alias("identity"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("seconds"))
    return ratelimit.replay(made, 2)


def most_concurrent(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    t = F.unix_micros(F.col("ts").cast("timestamp"))
    return ratelimit.concurrent(e.select(F.col("event_type").alias("identity"), t.alias("start"), (t + F.lit(900_000_000)).alias("end")))


C = r"""WITH c AS (SELECT source AS organization_id, lang AS knowledge_base_id, doc_id AS document_id, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INT AS chunk_index, unnest(string_split(text, chr(10))) AS content, false AS is_summary FROM documents
UNION ALL SELECT source, lang, doc_id, -1, text, true FROM documents WHERE doc_id % 7 = 0),
ch AS (SELECT *, CASE WHEN is_summary THEN 'chunk_summary' ELSE printf('chunk_%04d', chunk_index) END AS chunk_id FROM c),
j AS (SELECT source AS organization_id, lang AS knowledge_base_id, doc_id AS document_id, n_chars AS tokens, CASE WHEN doc_id % 5 = 0 THEN 'failed' WHEN doc_id % 13 = 0 THEN 'deleted' ELSE 'completed' END AS status, doc_id * 10 + 2 AS updated_at FROM documents WHERE doc_id % 11 <> 0),
n AS (SELECT organization_id, knowledge_base_id, document_id, count(*) AS chunks FROM ch WHERE NOT is_summary GROUP BY ALL),
cand AS (SELECT *, ((document_id * 31 + chunk_index * 17) % 101 + 101) % 101 * 1000000 + document_id % 40 * 10000 + chunk_index AS rank, document_id // 40 AS query_id FROM ch)
"""
VISIT = r"regexp_replace(regexp_replace({u}, '#.*$', ''), '/+(\?|$)', '\1')"
ROOT = r"regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1)"
LINKS = rf"""WITH r AS (SELECT page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1)) AS link, generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*"([^"]*)"', 1), 1) AS i FROM pages),
a AS (SELECT page_id, url, {ROOT} || trim(link) AS link, i FROM r),
g AS (SELECT * FROM a WHERE NOT regexp_matches(link, '{urls.SKIP_PATHS}') AND NOT regexp_matches(lower(link), '({"|".join(e.replace(".", "[.]") for e in urls.SKIP_EXTENSIONS)})$')),
l AS (SELECT page_id, url, regexp_replace(link, '#.*$', '') AS link, min(i) AS i FROM g GROUP BY ALL)
"""
QUERIES = {
    f.__name__: f
    for f in (
        html_title, html_links, url_normalize, canonical, sniffed_types, crawl_reach, html_text, latest_job, job_status_counts, document_list, jobs_without_index,
        kb_catalogue, replace_document, delete_document, upsert_chunks, chunk_store_changes, migration_missing, chunk_scan, chunks_by_keys, tenant_scope, neighbour_expansion,
        document_coverage, context_order, context_union, context_pack, overview_material, summary_attach, document_expansion, summary_stages,
        eval_recall_precision_mrr, eval_rates, rate_limit_replay, most_concurrent,
    )
}
TOK = r"CASE WHEN content = '' THEN 0 ELSE greatest(1, ceil(greatest(len(regexp_extract_all(content, '[^\s\x1c-\x1f\x{85}\x{a0}]+')) * 1.34::DOUBLE, length(content) / 6.0::DOUBLE)))::INT END"
ORDERED = C.rstrip() + """, f AS (SELECT *, CASE WHEN is_summary THEN rank ELSE min(CASE WHEN NOT is_summary THEN rank END) OVER (PARTITION BY query_id, document_id) END AS first FROM cand),
o AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY is_summary DESC, first, CASE WHEN is_summary THEN 0 ELSE chunk_index END, rank))::INT AS position FROM f)
"""


def _upper(x: str) -> str:
    """SQL for the upper case of all letters, those too that become several, as ß does; the database leaves these or takes another letter."""
    for c in map(chr, range(0x80, 0x10000)):
        if len(c.upper()) > 1:
            x = f"replace({x}, '{c}', '{c.upper()}')"
    return f"upper({x})"


ORACLE_SQL = {
    "html_title": r"SELECT page_id, CASE WHEN t <> '' THEN t ELSE url END AS title FROM (SELECT page_id, url, substr(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')), 1, 120) AS t FROM pages)",
    "html_links": LINKS + "SELECT page_id, (row_number() OVER (PARTITION BY page_id ORDER BY i) - 1)::INT AS place, link FROM l",
    "url_normalize": rf"""SELECT page_id, {VISIT.format(u='url')} AS visit, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#:]*)', 1)) AS host, regexp_replace(url, '#.*$', '') AS plain,
CASE WHEN contains(url, '?') THEN regexp_extract(url, '\?([^#]*)', 1) || '&' ELSE '' END || 'api_key=***' AS query FROM pages""",
    "canonical": f"SELECT page_id, {ROOT} || '/c/' || page_id AS canonical FROM pages",
    "sniffed_types": "SELECT page_id, ['application/pdf', 'application/rtf', 'text/html'][page_id % 3 + 1] AS kind FROM pages",
    "crawl_reach": LINKS.replace("WITH ", "WITH RECURSIVE ", 1) + f""", s AS (SELECT DISTINCT {VISIT.format(u='url')} AS url FROM pages WHERE page_id % 10 = 0), e AS (SELECT DISTINCT {VISIT.format(u='url')} AS src, {VISIT.format(u='link')} AS dst FROM l),
reach(url, depth) AS (SELECT url, 0 FROM s UNION SELECT e.dst, r.depth + 1 FROM reach r JOIN e ON e.src = r.url WHERE e.src <> e.dst AND r.depth < 5)
SELECT url, min(depth)::INT AS depth FROM reach GROUP BY url""",
    # a reference may lack its semicolon
    "html_text": r"""WITH a AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<head\b.*?</head>', ' ', 'g'), '(?is)<nav\b.*?</nav>', ' ', 'g'), '(?is)<footer\b.*?</footer>', ' ', 'g') AS t FROM pages),
b AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?i)<br\s*/?>|</(p|div|article|h1|li)>', chr(10), 'g'), '(?s)<[^>]+>', '', 'g') AS t FROM a),
c AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&quot;?', '"', 'g'), '&#x27;?', chr(39), 'g'), '&middot;?', '·', 'g'), '&copy;?', '©', 'g'), '&amp;?', '&', 'g') AS t FROM b),
e AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(replace(replace(t, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[ \t\x{a0}]+', ' ', 'g'), '[ \t]*\|[ \t]*(?:\|[ \t]*)*', ' | ', 'g'), ' *\n *', chr(10), 'g') AS t FROM c),
g AS (SELECT page_id, regexp_replace(regexp_replace(t, '(?m)^[ \t]*\|[ \t]*|[ \t]*\|[ \t]*$', '', 'g'), '\n{3,}', chr(10) || chr(10), 'g') AS t FROM e),
h AS (SELECT page_id, regexp_replace(regexp_replace(t, '^\s+', ''), '\s+$', '') AS t FROM g)
SELECT page_id, md5(t) AS digest, length(t) AS n FROM h""",
    "latest_job": C + "SELECT document_id, status, updated_at FROM j WHERE status <> 'deleted'",
    "job_status_counts": C + "SELECT status, count(*) AS count FROM j GROUP BY status",
    "document_list": C + "SELECT document_id, status, n.chunks AS vectors_in_store FROM j JOIN n USING (document_id) WHERE status <> 'deleted' UNION ALL SELECT document_id, 'completed', chunks FROM n WHERE document_id % 11 = 0",
    "jobs_without_index": C + "SELECT document_id, chunks FROM n WHERE document_id % 11 = 0",
    "kb_catalogue": C + """, a AS (SELECT organization_id, knowledge_base_id, count(*) AS jd, sum(tokens)::BIGINT AS tokens, count(*) FILTER (WHERE status = 'completed') AS completed, count(*) FILTER (WHERE status = 'failed') AS failed, max(updated_at) AS updated_at FROM j WHERE status <> 'deleted' GROUP BY ALL),
b AS (SELECT organization_id, knowledge_base_id, count(*) AS sd, sum(chunks)::BIGINT AS sc FROM n GROUP BY ALL)
SELECT b.organization_id, b.knowledge_base_id, greatest(coalesce(jd, 0), sd) AS documents, sc AS chunks, coalesce(tokens, 0) AS tokens, CASE WHEN coalesce(completed, 0) + coalesce(failed, 0) = 0 THEN sd ELSE completed END AS completed, 0::BIGINT AS processing, coalesce(failed, 0) AS failed, coalesce(updated_at, 0) AS updated_at
FROM b LEFT JOIN a USING (organization_id, knowledge_base_id)""",
    "replace_document": C + f"SELECT document_id, count(*) AS n, max(md5(CASE WHEN document_id % 50 = 0 THEN {_upper('content')} ELSE content END)) AS digest FROM ch WHERE document_id % 50 <> 0 OR chunk_index = 0 GROUP BY 1",
    "delete_document": C + "SELECT organization_id, count(*) AS n FROM ch WHERE document_id % 3 <> 0 GROUP BY 1",
    "chunk_store_changes": C + """, x AS (SELECT organization_id, knowledge_base_id, CASE WHEN document_id % 10 = 3 THEN 'first: ' || content WHEN document_id % 10 = 1 AND chunk_index = 0 THEN 'new' ELSE content END AS content
FROM ch WHERE document_id % 10 <> 7 AND (document_id % 10 <> 3 OR chunk_index = 0))
SELECT organization_id, knowledge_base_id, count(*) AS n, count(*) FILTER (WHERE content = 'new') AS fresh, sum(length(content))::BIGINT AS chars, max(md5(content)) AS digest FROM x GROUP BY 1, 2""",
    "upsert_chunks": C + "SELECT knowledge_base_id, count(*) AS n, count(*) FILTER (WHERE chunk_index = 1) AS fresh FROM ch GROUP BY 1",
    "migration_missing": C + "SELECT organization_id, count(*) AS n FROM ch WHERE document_id % 2 = 1 GROUP BY 1",
    "chunk_scan": C + "SELECT document_id, chunk_id, md5(content) AS digest FROM ch WHERE document_id = 7 AND NOT is_summary",
    "chunks_by_keys": C + "SELECT document_id, chunk_id, md5(content) AS digest FROM ch WHERE document_id % 100 = 0",
    "tenant_scope": C + "SELECT knowledge_base_id, count(*) AS n, count(DISTINCT document_id) AS documents FROM ch WHERE organization_id = 'src3' AND knowledge_base_id IN ('en', 'fr') AND NOT is_summary GROUP BY 1",
    "neighbour_expansion": C + "SELECT b.document_id, b.chunk_index, min(abs(a.chunk_index - b.chunk_index)) AS distance FROM ch a JOIN ch b ON a.document_id = b.document_id AND abs(a.chunk_index - b.chunk_index) <= 2 WHERE a.chunk_index % 5 = 2 AND NOT a.is_summary AND NOT b.is_summary GROUP BY ALL",
    "document_coverage": C + """, i AS (SELECT * FROM ch WHERE is_summary OR (chunk_index BETWEEN 0 AND 4 AND document_id % 7 <> 0)),
g AS (SELECT document_id, count(*) FILTER (WHERE NOT is_summary) AS inc, bool_or(is_summary) AS s FROM i GROUP BY 1)
SELECT document_id, CASE WHEN inc = 0 THEN 1 ELSE inc END AS included, CASE WHEN inc = 0 THEN 1 ELSE n.chunks END AS total, CASE WHEN inc = 0 THEN true ELSE inc >= n.chunks END AS complete, inc = 0 AND s AS via_summary FROM g JOIN n USING (document_id)""",
    "context_order": ORDERED + "SELECT query_id, position, document_id, chunk_id FROM o",
    "context_union": C + "SELECT document_id, chunk_id, chunk_index % 3 <> 1 AS expanded FROM cand WHERE chunk_index % 3 = 1 OR chunk_index % 2 = 0",
    # items in their order, content before summaries; each step takes the next item of every query
    "context_pack": "WITH RECURSIVE " + ORDERED.removeprefix("WITH ") + f""", p AS (SELECT query_id, document_id || '::' || chunk_id AS key, {TOK} AS tokens, is_summary, position, row_number() OVER (PARTITION BY query_id ORDER BY is_summary, position) AS k FROM o),
r(query_id, k, taken, content, spent, share) AS (SELECT DISTINCT query_id, 0::BIGINT, false, 0::BIGINT, 0::BIGINT, 400::BIGINT FROM p
UNION ALL SELECT p.query_id, p.k,
  CASE WHEN p.is_summary THEN p.tokens <= r.share AND (r.content = 0 AND r.spent = 0 OR r.spent + p.tokens <= 600) ELSE r.content < 12 AND (r.content = 0 OR r.spent + p.tokens <= 600) END AS t,
  r.content + (t AND NOT p.is_summary)::INT, r.spent + CASE WHEN t THEN p.tokens ELSE 0 END, r.share - CASE WHEN t AND p.is_summary THEN p.tokens ELSE 0 END
  FROM r JOIN p ON p.query_id = r.query_id AND p.k = r.k + 1)
SELECT query_id, key, (row_number() OVER (PARTITION BY query_id ORDER BY position))::INT AS number FROM r JOIN p USING (query_id, k) WHERE taken""",
    "overview_material": C + f"""SELECT document_id, chunk_index, upto FROM (SELECT document_id, chunk_index, query_id, sum({TOK}) OVER (PARTITION BY document_id ORDER BY chunk_index)::BIGINT AS upto FROM cand WHERE NOT is_summary)
JOIN (SELECT query_id, greatest(400, floor(24000 / count(DISTINCT document_id))) AS share FROM cand WHERE NOT is_summary GROUP BY 1) USING (query_id) WHERE upto <= share""",
    "summary_attach": C + """SELECT query_id, document_id, first FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY first, document_id) AS place FROM
(SELECT query_id, document_id, min(rank) AS first FROM cand WHERE NOT is_summary GROUP BY ALL)) WHERE place <= 3 AND document_id % 7 = 0""",
    # documents of a query by their best hit; small ones whole, others with neighbours, nearest first; a whole one stops where the budget ends, neighbours are skipped
    "document_expansion": "WITH RECURSIVE " + C.removeprefix("WITH ") + f""", x AS (SELECT query_id, document_id, chunk_index, rank, content, {TOK} AS tokens, chunk_index = 2 AS hit FROM cand WHERE NOT is_summary),
b AS (SELECT query_id, document_id, min(rank) FILTER (WHERE hit) AS best, sum(tokens) <= 3000 AS whole FROM x GROUP BY ALL),
dd AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY best, document_id) AS place FROM b WHERE best IS NOT NULL),
g AS (SELECT x.*, dd.place, dd.whole, (SELECT min(abs(h.chunk_index - x.chunk_index)) FROM x h WHERE h.hit AND h.document_id = x.document_id) AS gap FROM x JOIN dd USING (query_id, document_id) WHERE dd.place <= 4),
w AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY place, CASE WHEN whole THEN 0 ELSE gap END, chunk_index) AS k FROM g WHERE NOT hit AND trim(content, ' ' || chr(9) || chr(10) || chr(13)) <> '' AND (whole OR gap <= 1)),
s0 AS (SELECT query_id, sum(tokens + 60)::BIGINT AS spent FROM x WHERE hit GROUP BY 1),
r(query_id, k, place, taken, spent, stopped) AS (SELECT query_id, 0::BIGINT, 0::BIGINT, false, spent, false FROM s0
UNION ALL SELECT w.query_id, w.k, w.place, (NOT (r.stopped AND r.place = w.place)) AND r.spent + w.tokens <= 12000 AS t, r.spent + CASE WHEN t THEN w.tokens ELSE 0 END,
  (r.stopped AND r.place = w.place) OR (w.whole AND r.spent + w.tokens > 12000) FROM r JOIN w ON w.query_id = r.query_id AND w.k = r.k + 1)
SELECT r.query_id, w.document_id, w.chunk_index, r.spent AS upto FROM r JOIN w USING (query_id, k) WHERE r.taken""",
    "summary_stages": "WITH RECURSIVE " + C.removeprefix("WITH ") + f""", x AS (SELECT document_id, chunk_index, {TOK} AS tokens, row_number() OVER (PARTITION BY document_id ORDER BY chunk_index) AS k FROM ch WHERE NOT is_summary),
r(document_id, k, stage, room) AS (SELECT document_id, 1::BIGINT, 0::BIGINT, (60 - tokens)::BIGINT FROM x WHERE k = 1
UNION ALL SELECT x.document_id, x.k, CASE WHEN x.tokens > r.room THEN r.stage + 1 ELSE r.stage END, CASE WHEN x.tokens > r.room THEN 60 - x.tokens ELSE r.room - x.tokens END FROM r JOIN x ON x.document_id = r.document_id AND x.k = r.k + 1)
SELECT x.document_id, x.chunk_index, r.stage::INT AS stage, r.stage < 12 AND x.k <= 400 AS covered FROM r JOIN x USING (document_id, k)""",
    "eval_recall_precision_mrr": BM25_BATCH + r""", k AS (SELECT query_id, doc_id AS document_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 5) DESC, doc_id) AS rank FROM r WHERE rank <= 5),
x AS (SELECT b.item_id AS query_id, o.doc_id AS document_id FROM documents o JOIN benchmark b ON contains(' ' || trim(regexp_replace(o.text, '\s+', ' ', 'g')) || ' ', ' ' || trim(regexp_replace(b.text, '\s+', ' ', 'g')) || ' ')),
a AS (SELECT query_id FROM k UNION SELECT query_id FROM x),
m AS (SELECT a.query_id, (SELECT count(*) FROM k WHERE k.query_id = a.query_id) AS shown, (SELECT count(*) FROM x WHERE x.query_id = a.query_id) AS wanted,
  (SELECT count(*) FROM k JOIN x USING (query_id, document_id) WHERE k.query_id = a.query_id) AS hits, (SELECT min(rank) FROM k JOIN x USING (query_id, document_id) WHERE k.query_id = a.query_id) AS first FROM a),
s2 AS (SELECT CASE WHEN wanted = 0 THEN 1.0::DOUBLE ELSE hits / wanted END AS recall, CASE WHEN shown = 0 THEN 0.0::DOUBLE ELSE hits / shown END AS precision, coalesce(1.0::DOUBLE / first, 0.0) AS rr FROM m)
SELECT round(avg(recall), 4) AS recall, round(avg(precision), 4) AS precision, round(avg(rr), 4) AS mrr, round(avg((recall > 0)::INT), 4) AS hit_rate, count(*) AS queries FROM s2""",
    # each identity's requests one after another; what passed in the last minute is carried along
    "rate_limit_replay": """WITH RECURSIVE e AS (SELECT event_type AS identity, event_id AS id, epoch_us(ts) / 1e6::DOUBLE AS seconds, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts), event_id) AS k FROM events),
r(identity, k, id, seconds, passed, recent) AS (SELECT identity, k, id, seconds, true, [seconds] FROM e WHERE k = 1
UNION ALL SELECT e.identity, e.k, e.id, e.seconds, len(list_filter(r.recent, lambda x: x >= e.seconds - 60)) < 2,
  CASE WHEN len(list_filter(r.recent, lambda x: x >= e.seconds - 60)) < 2 THEN list_filter(r.recent, lambda x: x >= e.seconds - 60) || [e.seconds] ELSE list_filter(r.recent, lambda x: x >= e.seconds - 60) END
  FROM r JOIN e ON e.identity = r.identity AND e.k = r.k + 1)
SELECT identity, id, seconds, passed FROM r""",
    "eval_rates": "SELECT round(avg(CASE WHEN quality <> 1 THEN (doc_id % 4 = 0)::INT END), 4) AS refusal_rate, round(avg(CASE WHEN doc_id % 4 <> 0 THEN (toxic = 0)::INT END), 4) AS grounded_rate, round(avg(CASE WHEN doc_id % 4 <> 0 THEN (doc_id % 3 = 0)::INT END), 4) AS citation_rate FROM labels",
    "most_concurrent": """WITH s AS (SELECT event_type AS identity, epoch_us(ts) AS t, 1 AS d FROM events UNION ALL SELECT event_type, epoch_us(ts) + 900000000, -1 FROM events),
r AS (SELECT identity, sum(d) OVER (PARTITION BY identity ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS o FROM s) SELECT identity, max(o)::BIGINT AS most_open FROM r GROUP BY 1""",
}
