"""Search queries: documents as chunks, ``source`` as organisation, ``lang`` as knowledge base."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.functions.embed import hash_embedding
from tarn.functions.text import estimate_tokens, fingerprint, plain_tokens
from tarn.operators import scope, search
from tarn.operators.ball_index import BallIndex
from tarn.operators.lexical_index import LexicalIndex
from tarn.session import hadoop_path

TERMS = ["the", "that", "thand", "worthless"]


def _read(spark: SparkSession, d: str, t: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{t}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select("doc_id", "lang", "source", plain_tokens(F.col("text")).alias("tokens"))


_BUILT: dict[tuple[str, str, str], tuple[tuple, LexicalIndex]] = {}


def stored(spark: SparkSession, d: str, name: str, build) -> LexicalIndex:
    """The stored index of that name of a ``documents`` table, built when it is first asked for and whenever the table's files changed."""
    files, at = hadoop_path(spark, f"{d}/documents.parquet")
    listed = [files.getFileStatus(at)] if files.getFileStatus(at).isFile() else list(files.listStatus(at))
    seen = tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in listed))
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _BUILT or _BUILT[key][0] != seen:
        _BUILT[key] = seen, build()
    return _BUILT[key][1]


def index_of(spark: SparkSession, d: str) -> LexicalIndex:
    """The index of plain tokens."""
    return stored(spark, d, "plain", lambda: LexicalIndex(spark).build(_docs(spark, d), "doc_id", "tokens", ["lang", "source"]))


def _hits(spark, d, top_k=None, within=None) -> DataFrame:
    return index_of(spark, d).search(TERMS, top_k, within).withColumnRenamed("key", "doc_id")


def bm25_search(spark, d):
    return _hits(spark, d, 20).select("doc_id", F.round("score", 6).alias("score"))


def bm25_document_filter_keeps_idf(spark, d):
    hits = _hits(spark, d, within=(F.col("lang") == "en") & (F.col("source") != "src3"))
    return hits.select("doc_id", F.round("score", 6).alias("score"))


def bm25_scan(spark, d):
    """The same search without an index, straight from the texts: for scopes too small or too short-lived to index."""
    return search.bm25_scan(_docs(spark, d), "doc_id", "tokens", TERMS, 20).select("doc_id", F.round("score", 6).alias("score"))


def bm25_scope_stats(spark, d):
    docs = _docs(spark, d)
    return docs.groupBy("source", "lang").agg(F.count("*").alias("n"), F.sum(F.size("tokens")).alias("total_len"), F.round(F.avg(F.size("tokens")), 6).alias("avgdl"))


def bm25_postings(spark, d):
    return index_of(spark, d).live().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"), F.max("tf").alias("max_tf"))


def bm25_batch(spark, d):
    asked = _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(plain_tokens(F.col("text")))).alias("term"))
    found = index_of(spark, d).search_many(asked, 5)
    return found.select("query_id", F.col("key").alias("doc_id"), F.round("score", 5).alias("score"))


def _changed(spark, d) -> LexicalIndex:
    """An index of its own after every tenth document got more words and every tenth other one went."""
    docs = _read(spark, d, "documents")
    made = lambda df: df.select("doc_id", "lang", "source", plain_tokens(F.col("text")).alias("tokens"))
    index = LexicalIndex(spark).build(made(docs), "doc_id", "tokens", ["lang", "source"])
    index.upsert(made(docs.where("doc_id % 10 = 3").withColumn("text", F.concat(F.lit("worthless the thand "), "text"))), "doc_id", "tokens", ["lang", "source"])
    index.remove(docs.where("doc_id % 10 = 7").select("doc_id"), "doc_id")
    return index


def bm25_after_changes(spark, d):
    return _changed(spark, d).search(TERMS).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


def bm25_after_compaction(spark, d):
    index = _changed(spark, d)
    index.compact()
    return index.search(TERMS).select(F.col("key").alias("doc_id"), F.round("score", 6).alias("score"))


BM25 = r"""
WITH d AS (SELECT doc_id, lang, source, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS tokens FROM documents),
s AS (SELECT count(*) AS n, sum(len(tokens)) AS total FROM d),
t AS (SELECT unnest(['the', 'that', 'thand', 'worthless']) AS term),
f AS (SELECT d.doc_id, d.lang, d.source, len(d.tokens) AS dl, t.term, len(list_filter(d.tokens, lambda x: x = t.term)) AS tf FROM d, t),
g AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM f GROUP BY term),
h AS (SELECT f.doc_id, f.lang, f.source, sum(ln(1 + (s.n - g.df + 0.5) / (g.df + 0.5)) * (f.tf * 2.2) / (f.tf + 1.2 * (0.25 + 0.75 * f.dl / (s.total / s.n)))) AS score
      FROM f JOIN g USING (term), s WHERE f.tf > 0 GROUP BY ALL)
"""
BM25_BATCH = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS tokens FROM documents),
s AS (SELECT count(*) AS n, sum(len(tokens)) AS total FROM d),
p AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(tokens) AS dl, unnest(tokens) AS term FROM d) GROUP BY ALL),
g AS (SELECT term, count(*) AS df FROM p GROUP BY term),
q AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM benchmark),
h AS (SELECT q.query_id, p.doc_id, sum(ln(1 + (s.n - g.df + 0.5) / (g.df + 0.5)) * (p.tf * 2.2) / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / (s.total / s.n)))) AS score
      FROM q JOIN p USING (term) JOIN g USING (term), s GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM h)
"""


def _query_vector(spark, d):
    return _read(spark, d, "embeddings").where("vec_id = 0").select(F.col("embedding").alias("query_vector"))


def dense_search(spark, d):
    return search.dense_search(_read(spark, d, "embeddings"), "vec_id", "embedding", _query_vector(spark, d), 20).select("vec_id", F.round("score", 6).alias("score"))


def dense_batch_queries(spark, d):
    """Every hundredth vector asks, all vectors answer; the asking side is a stated query set, in blocks."""
    e = _read(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = search.dense_many(e, "vec_id", "embedding", asked, 5)
    return found.select("query_id", "vec_id", "rank", F.round("score", 6).alias("score"))


def dense_ball(spark, d):
    """The same questions and answers by an index of balls, which skips cells that can't hold any of them."""
    e = _read(spark, d, "embeddings")
    asked = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))
    found = BallIndex(spark).build(e, "vec_id", "embedding").search_many(asked, 5)
    return found.select("query_id", F.col("key").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


def _lists(spark, d):
    dense = search.ranked(search.dense_search(_read(spark, d, "embeddings").withColumnRenamed("vec_id", "doc_id"), "doc_id", "embedding", _query_vector(spark, d), 50), "doc_id")
    sparse = search.ranked(_hits(spark, d, 50), "doc_id")
    return dense, sparse


def rrf_fusion(spark, d):
    dense, sparse = _lists(spark, d)
    return search.rrf(dense, sparse, "doc_id", dense_weight=search.HASH_DENSE_WEIGHT).select("doc_id", F.round("score", 6).alias("score"))


def _pool(spark, d):
    dense, sparse = _lists(spark, d)
    fused = search.rrf(dense, sparse, "doc_id", dense_weight=search.HASH_DENSE_WEIGHT).orderBy(F.desc("score"), "doc_id").limit(search.POOL)
    rows = fused.collect()  # POOL rows at most: their keys reach the scan
    kept = spark.createDataFrame(rows, fused.schema)
    docs = _read(spark, d, "documents").where(F.col("doc_id").isin([r.doc_id for r in rows]))
    return docs.select("doc_id", "source", "text").join(F.broadcast(kept), "doc_id")


def hybrid_pool_dedupe(spark, d):
    return search.dedupe_content(_pool(spark, d), "text", F.desc("score"), F.col("doc_id")).select("doc_id", "source", F.round("score", 6).alias("score"))


def per_document_cap(spark, d):
    return search.cap_per_document(_pool(spark, d), "source", F.desc("score"), F.col("doc_id"), most=3).select("doc_id", "source", F.round("score", 6).alias("score"))


def document_focus(spark, d):
    return search.focus_documents(_pool(spark, d), "source", "score").select("doc_id", "source", F.round("score", 6).alias("score"))


def blended_score(spark, d):
    hits = search.normalised(_hits(spark, d)).withColumnRenamed("score", "lexical")
    semantic = _read(spark, d, "embeddings").crossJoin(F.broadcast(_query_vector(spark, d)))
    from tarn.functions.embed import dot

    semantic = semantic.select(F.col("vec_id").alias("doc_id"), dot(F.col("embedding"), F.col("query_vector")).alias("semantic"))
    return hits.join(semantic, "doc_id", "left").select("doc_id", F.round(search.blended(F.col("lexical"), F.col("semantic")), 5).alias("score"))


def relative_threshold(spark, d):
    hits = _hits(spark, d)
    return search.relative_threshold(hits, "score").select("doc_id", F.round("score", 6).alias("score"))


def relevance_gate(spark, d):
    hits = _hits(spark, d)
    return search.relevance_gate(hits, "score").select(F.round("best_score", 6).alias("best_score"), "relevant", "gate")


def relevance_gates(spark, d):
    """Every way that the gate may go, over the same hits."""
    hits = _hits(spark, d)
    ways = {
        "lexical": {}, "semantic": {"semantic": True}, "high": {"minimum": 1e9}, "off": {"minimum": 0.0}, "unranked": {"reranked": False},
    }
    cases = [search.relevance_gate(hits, "score", **how).withColumn("way", F.lit(way)) for way, how in ways.items()]
    cases.append(search.relevance_gate(hits.where("score < 0"), "score").withColumn("way", F.lit("none")))
    return reduce(DataFrame.unionByName, cases).select("way", F.round("best_score", 6).alias("best_score"), "relevant", "gate")


def payload_tenant_check(spark, d):
    """Stored rows of hits from the whole index, for one tenant."""
    stored = _read(spark, d, "documents").select("doc_id", F.col("source").alias("organization_id"), F.col("lang").alias("knowledge_base_id"), F.col("doc_id").alias("document_id"), F.md5("text").alias("digest"))
    return scope.attached(_hits(spark, d, 100).select("doc_id"), stored, ["doc_id"], scope.Scope("src3", ("en", "de"))).select("doc_id", "digest")


def noop_rerank(spark, d):
    hits = search.ranked(_hits(spark, d, 20), "doc_id")
    return hits.select("doc_id", F.round(1 - F.col("rank") / F.lit(20.0), 6).alias("score"))


def hash_embedding_norms(spark, d):
    made = hash_embedding(_read(spark, d, "documents").select("doc_id", "text"), "text")
    size = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return made.select("doc_id", F.size("embedding").alias("dim"), F.round(size, 4).alias("norm"))


def fingerprint_dedupe(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", F.md5(fingerprint(F.col("text"))).alias("fp"))
    return docs.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


def token_estimates(spark, d):
    return _read(spark, d, "documents").select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


CHANGED = BM25.replace("lower(text)", "lower(CASE WHEN doc_id % 10 = 3 THEN 'worthless the thand ' || text ELSE text END)").replace("FROM documents)", "FROM documents WHERE doc_id % 10 <> 7)") + "SELECT doc_id, round(score, 6) AS score FROM h"
DENSE = "list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
LISTS = BM25.rstrip() + f""",
dn AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM
  (SELECT e.vec_id AS doc_id, {DENSE} AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, doc_id LIMIT 50)),
sp AS (SELECT doc_id, row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) - 1 AS rank FROM (SELECT doc_id, score FROM h ORDER BY round(score, 9) DESC, doc_id LIMIT 50)),
fu AS (SELECT coalesce(dn.doc_id, sp.doc_id) AS doc_id, coalesce(0.25::DOUBLE * (1.0::DOUBLE / (60 + dn.rank + 1)), 0.0) + coalesce(1.0::DOUBLE / (60 + sp.rank + 1), 0.0) AS raw
       FROM dn FULL JOIN sp ON dn.doc_id = sp.doc_id),
fs AS (SELECT doc_id, raw / (SELECT max(raw) FROM fu) AS score FROM fu),
pool AS (SELECT d2.doc_id, d2.source, d2.text, p.score FROM (SELECT * FROM fs ORDER BY score DESC, doc_id LIMIT 120) p JOIN documents d2 USING (doc_id))
"""
FP = r"trim(regexp_replace(lower(text), '\s+', ' ', 'g'))"

QUERIES = {
    f.__name__: f
    for f in (
        bm25_search, bm25_document_filter_keeps_idf, bm25_scan, bm25_scope_stats, bm25_postings, bm25_batch, bm25_after_changes, bm25_after_compaction, dense_search, dense_batch_queries, dense_ball, rrf_fusion,
        hybrid_pool_dedupe, per_document_cap, document_focus, blended_score, relative_threshold, relevance_gate, relevance_gates, payload_tenant_check, noop_rerank, hash_embedding_norms,
        fingerprint_dedupe, token_estimates,
    )
}
ORACLE_SQL = {
    "bm25_search": BM25 + "SELECT doc_id, round(score, 6) AS score FROM h ORDER BY round(h.score, 9) DESC, doc_id LIMIT 20",
    "bm25_scan": BM25 + "SELECT doc_id, round(score, 6) AS score FROM h ORDER BY round(h.score, 9) DESC, doc_id LIMIT 20",
    "bm25_after_changes": CHANGED,
    "bm25_after_compaction": CHANGED,
    "bm25_document_filter_keeps_idf": BM25 + "SELECT doc_id, round(score, 6) AS score FROM h WHERE lang = 'en' AND source <> 'src3'",
    "bm25_scope_stats": r"""SELECT source, lang, count(*) AS n, sum(dl)::BIGINT AS total_len, round(avg(dl), 6) AS avgdl
FROM (SELECT source, lang, len(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS dl FROM documents) GROUP BY ALL""",
    "bm25_postings": r"""WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS term FROM documents) GROUP BY ALL)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf, max(tf)::INT AS max_tf FROM p GROUP BY term""",
    "bm25_batch": BM25_BATCH + "SELECT query_id, doc_id, round(score, 5) AS score FROM r WHERE rank <= 5",
    "dense_search": f"SELECT e.vec_id, round({DENSE}, 6) AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q ORDER BY {DENSE} DESC, e.vec_id LIMIT 20",
    "dense_batch_queries": f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {DENSE} AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q WHERE e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "dense_ball": f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {DENSE} AS score FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) q WHERE e.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, rank::INT AS rank, round(score, 6) AS score FROM r WHERE rank <= 5""",
    "rrf_fusion": LISTS + "SELECT doc_id, round(score, 6) AS score FROM fs",
    "hybrid_pool_dedupe": LISTS + f"""SELECT doc_id, source, round(score, 6) AS score FROM
(SELECT *, row_number() OVER (PARTITION BY {FP} ORDER BY score DESC, doc_id) AS k FROM pool) WHERE k = 1""",
    "per_document_cap": LISTS + """SELECT doc_id, source, round(score, 6) AS score FROM
(SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id) AS k FROM pool) WHERE k <= 3""",
    "document_focus": LISTS + """, bs AS (SELECT source, max(score) AS best FROM pool GROUP BY source ORDER BY best DESC, source LIMIT 3)
SELECT doc_id, source, round(score, 6) AS score FROM pool WHERE source IN (SELECT source FROM bs WHERE best >= 0.8::DOUBLE * (SELECT max(best) FROM bs))""",
    "blended_score": BM25 + f""", n AS (SELECT doc_id, score / (SELECT max(score) FROM h) AS lexical FROM h),
v AS (SELECT e.vec_id AS doc_id, {DENSE} AS semantic FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id = 0) q)
SELECT n.doc_id, round(CASE WHEN v.semantic IS NULL THEN n.lexical ELSE round(0.6::DOUBLE * least(1.0::DOUBLE, greatest(0.0::DOUBLE, (v.semantic - 0.25::DOUBLE) / 0.55::DOUBLE)) + 0.4::DOUBLE * n.lexical, 6) END, 5) AS score
FROM n LEFT JOIN v USING (doc_id)""",
    "relative_threshold": BM25 + "SELECT doc_id, round(score, 6) AS score FROM h WHERE score >= 0.35::DOUBLE * (SELECT max(score) FROM h)",
    "relevance_gate": BM25 + "SELECT round(max(score), 6) AS best_score, max(score) >= 0.28 AS relevant, CASE WHEN max(score) >= 0.28 THEN 'lexical' ELSE 'below_min_relevance' END AS gate FROM h",
    "relevance_gates": BM25 + """, m AS (SELECT max(score) AS s FROM h) SELECT way, CASE way WHEN 'none' THEN 0.0 ELSE round(s, 6) END AS best_score,
CASE way WHEN 'none' THEN false WHEN 'high' THEN false WHEN 'off' THEN true WHEN 'unranked' THEN true ELSE s >= 0.28 END AS relevant,
CASE way WHEN 'none' THEN 'no_candidates' WHEN 'high' THEN 'below_min_relevance' WHEN 'off' THEN 'gate_off' WHEN 'unranked' THEN 'reranker_off' ELSE CASE WHEN s >= 0.28 THEN way ELSE 'below_min_relevance' END END AS gate
FROM m, (VALUES ('lexical'), ('semantic'), ('high'), ('off'), ('unranked'), ('none')) AS w(way)""",
    "payload_tenant_check": BM25 + "SELECT k.doc_id, md5(o.text) AS digest FROM (SELECT doc_id FROM h ORDER BY round(h.score, 9) DESC, doc_id LIMIT 100) k JOIN documents o USING (doc_id) WHERE o.source = 'src3' AND o.lang IN ('en', 'de')",
    "noop_rerank": BM25 + """SELECT doc_id, round(1 - (row_number() OVER (ORDER BY round(score, 9) DESC, doc_id) - 1) / 20.0::DOUBLE, 6) AS score FROM
(SELECT doc_id, score FROM h ORDER BY round(score, 9) DESC, doc_id LIMIT 20)""",
    "fingerprint_dedupe": f"SELECT md5(fp) AS fp, min(doc_id) AS doc_id, count(*) AS copies FROM (SELECT doc_id, {FP} AS fp FROM documents) GROUP BY ALL",
    "token_estimates": r"""SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE greatest(1, ceil(greatest(len(regexp_extract_all(text, '[^\s\x1c-\x1f\x{85}\x{a0}]+')) * 1.34::DOUBLE, length(text) / 6.0::DOUBLE)))::INT END AS tokens FROM documents""",
}
