"""Search by word forms: stems of the whole vocabulary, BM25 over an index of forms, reranking by places from it, and searches that skip blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarn.functions import stem
from tarn.functions.text import keywords, plain_tokens
from tarn.operators import rerank
from tarn.operators.lexical_index import LexicalIndex
from tarn.plans.q_search import BM25_BATCH, index_of, stored
from tarn.plans.q_text import KEEP, STOP, _surface_sql

#: Words with affixes before every third document's text, so that forms matter in texts of invented words.
AFFIXED = "pengajuan diajukan mengajukan kebijakannya keterlambatan memperbaiki menyapu berikan pegawai penurunanlah"


def _texts(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return docs.select("doc_id", (F.col("doc_id") % 5 == 4).alias("is_summary"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(AFFIXED + " "), "text")).otherwise(F.col("text")).alias("text"))


def _questions(spark, d):
    """All benchmark items ask, each with a word in another form than the documents have it."""
    items = spark.read.parquet(f"{d}/benchmark.parquet")
    return items.select(F.col("item_id").cast("long").alias("query_id"), keywords(F.concat(F.lit("ajukan perbaikan "), "text")).alias("words"))


def forms_index(spark, d) -> LexicalIndex:
    made = lambda: LexicalIndex(spark).build(_texts(spark, d).select("doc_id", "is_summary", keywords(F.col("text")).alias("words")), "doc_id", "words", ["is_summary"], forms=True)
    return stored(spark, d, "forms", made)


def stem_forms(spark, d):
    """Every word of all documents with its forms."""
    words = _texts(spark, d).select(F.explode(keywords(F.col("text"))).alias("word"))
    return stem.with_stems(words).select("word", F.array_join(F.array_sort(F.array_distinct("forms")), ",").alias("forms"))


def _asked(spark, d):
    return rerank.asked_forms(_questions(spark, d)).select("query_id", F.col("form").alias("term")).distinct()


def bm25_forms(spark, d):
    """The best five documents of every question by any form of its words; summaries count in the statistics but are not shown."""
    found = forms_index(spark, d).search_many(_asked(spark, d), 5, ~F.col("is_summary"))
    return found.select("query_id", F.col("key").alias("doc_id"), F.round("score", 5).alias("score"))


def bm25_forms_best(spark, d):
    """The same, without scoring blocks that can't hold any of them."""
    found = forms_index(spark, d).search_best(_asked(spark, d), 5, ~F.col("is_summary"))
    return found.select("query_id", F.col("key").alias("doc_id"), F.round("score", 5).alias("score"))


def bm25_batch_best(spark, d):
    """All benchmark items against the plain index, blocks skipped."""
    asked = spark.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("query_id"), F.explode(F.array_distinct(plain_tokens(F.col("text")))).alias("term"))
    return index_of(spark, d).search_best(asked, 5).select("query_id", F.col("key").alias("doc_id"), F.round("score", 5).alias("score"))


def rerank_from_index(spark, d):
    """Every question's best twenty documents by words, scored again by places."""
    index = forms_index(spark, d)
    pool = index.search_many(_asked(spark, d), 20).select("query_id", "key")
    return rerank.rerank_from_index(index, _questions(spark, d), pool).select("query_id", F.col("key").alias("doc_id"), "score")


QUERIES = {f.__name__: f for f in (stem_forms, bm25_forms, bm25_forms_best, bm25_batch_best, rerank_from_index)}

TEXT = f"CASE WHEN doc_id % 3 = 0 THEN '{AFFIXED} ' || text ELSE text END"


def _without_prefix(x: str) -> str:
    """SQL for the list of roots of ``x``."""
    rest = lambda n: f"substr({x}, {n + 1})"
    fits = lambda p: f"starts_with({x}, '{p}') AND length({x}) >= {len(p) + stem.SHORTEST}"
    plain = "".join(
        f"WHEN {fits(p)} THEN " + (f"CASE WHEN regexp_matches({rest(len(p))}, '^[aeiou]') THEN [{rest(len(p))}, 'r' || {rest(len(p))}] ELSE [{rest(len(p))}] END " if p in ("ber", "ter") else f"[{rest(len(p))}] ")
        for p in stem.PLAIN_PREFIXES
    )

    def nasal(p: str) -> str:
        r, cases = rest(len(p)), ""
        for n, lost in stem.NASALS.items():
            tail = rest(len(p) + len(n))
            vowel = "[" + ", ".join(f"'{c}' || {tail}" for c in lost) + "]"
            cases += f"WHEN starts_with({r}, '{n}') AND length({r}) > {len(n)} THEN CASE WHEN regexp_matches({tail}, '^[aeiou]') THEN {vowel} ELSE [{tail if n != 'ny' else rest(len(p) + 1)}] END "
        return f"WHEN {fits(p)} THEN list_filter(CASE {cases} WHEN regexp_matches({r}, '^[lrwy]') THEN [{r}] ELSE [] END, lambda z: length(z) >= {stem.SHORTEST}) "

    return f"CASE {plain}{''.join(map(nasal, stem.NASAL_PREFIXES))} ELSE []::VARCHAR[] END"


def _forms_sql(vocabulary: str) -> str:
    """CTEs up to ``forms`` (word, form), the word itself among them, for the words of a query that selects them."""
    cut = lambda x, ends, least: f"CASE WHEN regexp_full_match({x}, '.*({'|'.join(ends)})') AND length({x}) >= {len(ends[0]) + least} THEN left({x}, length({x}) - {len(ends[0])}) END"
    return f"""v0 AS ({vocabulary}),
v1 AS (SELECT word, {cut('word', stem.PARTICLES, 4)} AS w1 FROM v0 WHERE length(word) >= 5 AND regexp_full_match(word, '\\p{{L}}+')),
v2 AS (SELECT *, coalesce({cut('coalesce(w1, word)', ['nya'], 4)}, {cut('coalesce(w1, word)', ['ku', 'mu'], 4)}) AS w2 FROM v1),
v3 AS (SELECT *, coalesce(w2, w1, word) AS q FROM v2),
b AS (SELECT word, unnest([word, w1, w2, {cut('q', ['kan'], 4)}, {cut('q', ['an'], 4)}, CASE WHEN regexp_full_match(q, '.*[^aeiou]i') AND length(q) >= 5 THEN left(q, length(q) - 1) END]) AS base FROM v3),
r1 AS (SELECT word, base, unnest({_without_prefix('base')}) AS root FROM b WHERE length(base) >= {stem.SHORTEST}),
r2 AS (SELECT word, unnest({_without_prefix('root')}) AS root FROM r1 WHERE regexp_matches(root, '^({'|'.join(stem.SECOND_PREFIXES)})')),
forms AS (SELECT word, word AS form FROM v0 UNION SELECT word, form FROM (SELECT word, base AS form FROM b WHERE length(base) >= {stem.SHORTEST} UNION SELECT word, root FROM r1 UNION SELECT word, root FROM r2) x WHERE NOT list_contains({STOP}, form))
"""


_DOC_WORDS = _surface_sql(TEXT) + f", k AS (SELECT doc_id, form AS word, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS place FROM w WHERE {KEEP})"
_ITEM_WORDS = (
    _surface_sql("'ajukan perbaikan ' || text").replace("doc_id", "query_id").replace("FROM documents", "FROM (SELECT item_id AS query_id, text FROM benchmark)").replace("WITH m AS", ", qm AS").replace("FROM m)", "FROM qm)")
    .replace("\nt AS", "\nqt AS").replace("FROM t WHERE", "FROM qt WHERE").replace("\np AS", "\nqp AS").replace("FROM p)", "FROM qp)").replace("\nf AS", "\nqf AS").replace("FROM f)", "FROM qf)").replace("\nu AS", "\nqu AS").replace("FROM u GROUP", "FROM qu GROUP").replace("\nw AS", "\nqw AS")
    + f", qk AS (SELECT query_id, form AS word, min(place) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY i, j) - 1 AS place FROM qw WHERE {KEEP}) GROUP BY ALL), qa AS (SELECT query_id, word, row_number() OVER (PARTITION BY query_id ORDER BY place) - 1 AS nr FROM qk)"
)
_INDEX = _DOC_WORDS + _ITEM_WORDS + ", " + _forms_sql("SELECT DISTINCT word FROM k UNION SELECT DISTINCT word FROM qa") + """,
ps AS (SELECT doc_id, form AS term, count(*) AS tf, list(place ORDER BY place) AS places FROM k JOIN forms USING (word) GROUP BY ALL),
dl AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS dl FROM documents d LEFT JOIN ps USING (doc_id) GROUP BY ALL),
st AS (SELECT count(*) AS n, sum(dl) AS total FROM dl),
fr AS (SELECT term, count(*) AS df FROM ps GROUP BY term),
qf2 AS (SELECT query_id, nr, form AS term, form = word AS exact FROM qa JOIN forms USING (word)),
sc AS (SELECT q.query_id, ps.doc_id, sum(ln(1 + (st.n - fr.df + 0.5) / (fr.df + 0.5)) * (ps.tf * 2.2) / (ps.tf + 1.2 * (0.25 + 0.75 * dl.dl / (st.total / st.n)))) AS score
       FROM (SELECT DISTINCT query_id, term FROM qf2) q JOIN ps USING (term) JOIN fr USING (term) JOIN dl USING (doc_id), st GROUP BY ALL)
"""
_FORMS = _INDEX + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc WHERE doc_id % 5 <> 4)
SELECT query_id, doc_id, round(score, 5) AS score FROM r WHERE rank <= 5"""
ORACLE_SQL: dict[str, str] = {
    "stem_forms": _DOC_WORDS + ", " + _forms_sql("SELECT DISTINCT word FROM k") + "SELECT word, string_agg(form, ',' ORDER BY form) AS forms FROM forms GROUP BY word",
    "bm25_forms": _FORMS,
    "bm25_forms_best": _FORMS,
    "bm25_batch_best": BM25_BATCH + "SELECT query_id, doc_id, round(score, 5) AS score FROM r WHERE rank <= 5",
    "rerank_from_index": _INDEX
    + """, pool AS (SELECT query_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc) WHERE rank <= 20),
wt AS (SELECT query_id, nr, greatest(0.05::DOUBLE, min(ln(1 + (st.n - coalesce(fr.df, 0) + 0.5) / (coalesce(fr.df, 0) + 0.5)))) AS weight FROM qf2 LEFT JOIN fr USING (term), st GROUP BY ALL),
tt AS (SELECT query_id, sum(weight) AS total, count(*) AS asked FROM wt GROUP BY ALL),
h0 AS (SELECT pool.query_id, pool.doc_id, qf2.nr, qf2.exact, unnest(ps.places) AS place FROM pool JOIN qf2 USING (query_id) JOIN ps ON ps.doc_id = pool.doc_id AND ps.term = qf2.term),
h1 AS (SELECT query_id, doc_id, nr, place, has FROM (SELECT DISTINCT query_id, doc_id, nr, exact, place, bool_or(exact) OVER (PARTITION BY query_id, doc_id, nr) AS has FROM h0) WHERE exact = has),
h2 AS (SELECT query_id, doc_id, nr, any_value(CASE WHEN has THEN 1.0::DOUBLE ELSE 0.85::DOUBLE END) AS strength, list(DISTINCT place) AS places FROM h1 GROUP BY ALL),
own AS (SELECT query_id, doc_id, count(*) AS n FROM h2 GROUP BY ALL),
span AS (SELECT query_id, doc_id, end_, count(*) AS n, min(last) AS first FROM (
  SELECT e.query_id, e.doc_id, e.place AS end_, x.nr, max(x.place) AS last FROM (SELECT DISTINCT query_id, doc_id, place FROM h1) e JOIN h1 x ON x.query_id = e.query_id AND x.doc_id = e.doc_id AND x.place <= e.place GROUP BY ALL) GROUP BY ALL),
win AS (SELECT query_id, doc_id, min(end_ - first + 1) AS width FROM span JOIN own USING (query_id, doc_id) WHERE span.n = own.n GROUP BY ALL),
ph AS (SELECT query_id, doc_id, count(DISTINCT a.nr) AS close FROM h1 a JOIN h1 b USING (query_id, doc_id) WHERE b.nr = a.nr + 1 AND b.place IN (a.place + 1, a.place + 2) GROUP BY ALL),
ln AS (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id),
parts AS (SELECT h2.query_id, h2.doc_id, sum(weight * strength) / any_value(total) AS coverage, sum(len(places)) AS seen, count(*) AS n, any_value(asked) AS asked FROM h2 JOIN wt USING (query_id, nr) JOIN tt USING (query_id) GROUP BY ALL)
SELECT pool.query_id, pool.doc_id, coalesce(round(least(1.0::DOUBLE, 0.6::DOUBLE * coverage
  + 0.15::DOUBLE * CASE WHEN asked = 1 THEN 1 WHEN p.n > 1 THEN least(1.0::DOUBLE, p.n / greatest(1, width)) ELSE 0 END
  + 0.15::DOUBLE * CASE WHEN asked = 1 THEN 1 ELSE coalesce(close, 0) / (asked - 1) END
  + 0.1::DOUBLE * least(1.0::DOUBLE, seen / ln.n * 8)), 6), 0.0) AS score
FROM pool LEFT JOIN parts p USING (query_id, doc_id) LEFT JOIN win USING (query_id, doc_id) LEFT JOIN ph USING (query_id, doc_id) LEFT JOIN ln USING (doc_id)""",
}
