"""Lexical, dense and hybrid search as DataFrame plans.

Rankings run on narrow columns (key and score); texts are joined to the few
rows that are left.  Every order ends in the key, so results are stable.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarn.functions.embed import dot
from tarn.functions.text import fingerprint, garbage_reason
from tarn.session import materialize, small_batches

K1, B = 1.2, 0.75
RRF_K = 60
HASH_DENSE_WEIGHT = 0.25
POOL, POOL_SHARE = 120, 3
MAX_PER_DOCUMENT = 8
FOCUS_RATIO, FOCUS_DOCUMENTS = 0.8, 3
#: For questions that compare documents: of the usual share, and documents at least.
COMPARED_SHARE, COMPARED_DOCUMENTS = 0.6, 6
RELATIVE_THRESHOLD = 0.35
MIN_RELEVANCE = 0.28
SEMANTIC_FLOOR, SEMANTIC_SPAN, SEMANTIC_WEIGHT = 0.25, 0.55, 0.6


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def bm25_term(tf: Column, dl: Column, avgdl: Column, idf_: Column) -> Column:
    return idf_ * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avgdl))


def place_of(score: Column) -> Column:
    """What scores are ranked by: equal texts must tie, whatever the order in which their terms were added up."""
    return F.round(score, 9)


def _equals(word: str):
    return lambda token: token == F.lit(word)


def bm25_scan(docs: DataFrame, key: str, tokens: str, terms: list[str], top_k: int | None = None, within: Column | None = None, hidden: Column | None = None) -> DataFrame:
    """(key, score): BM25 of a few terms straight from token arrays.

    Texts are counted in one pass that writes a few numbers a document; what
    gathers the statistics, as a single row, and what scores reads those.
    Nothing is shuffled but partial sums and the top rows of each task.
    ``within`` narrows what is scored, ``hidden`` rows are never scored; both
    still count in the statistics.
    """
    terms = list(dict.fromkeys(terms))
    tf = [F.size(F.filter(F.col(tokens), _equals(w))).alias(f"tf{i}") for i, w in enumerate(terms)]
    keep = (within if within is not None else F.lit(True)) & (~F.coalesce(hidden, F.lit(False)) if hidden is not None else F.lit(True))
    rows = docs.select(F.col(key), F.size(tokens).alias("dl"), keep.alias("keep"), *tf)
    rows = materialize(rows, "term-counts")
    counts = [F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))]
    stats = rows.agg(F.count("*").alias("n"), F.sum("dl").alias("total"), *counts)  # one row
    any_hit = reduce(lambda a, b: a | b, [F.col(f"tf{i}") > 0 for i in range(len(terms))], F.lit(False))
    joined = rows.where(F.col("keep") & any_hit).crossJoin(F.broadcast(stats))
    parts = [
        F.when(F.col(f"tf{i}") > 0, bm25_term(F.col(f"tf{i}"), F.col("dl"), F.col("total") / F.col("n"), idf(F.col("n"), F.col(f"df{i}")))).otherwise(0.0)
        for i in range(len(terms))
    ]
    scored = joined.select(key, reduce(lambda a, b: a + b, parts, F.lit(0.0)).alias("score"))
    return scored.orderBy(place_of(F.col("score")).desc(), key).limit(top_k) if top_k else scored


def normalised(scores: DataFrame, score: str = "score") -> DataFrame:
    """Scores over the best one."""
    best = scores.agg(F.max(score).alias("best"))
    return scores.crossJoin(F.broadcast(best)).withColumn(score, F.col(score) / F.when(F.col("best") != 0, F.col("best")).otherwise(1.0)).drop("best")


def dense_search(vectors: DataFrame, key: str, vector: str, query: DataFrame, top_k: int) -> DataFrame:
    """(key, score): exact nearest rows by dot product; ``query`` is one row with ``query_vector``."""
    return vectors.crossJoin(F.broadcast(query)).select(key, dot(F.col(vector), F.col("query_vector")).alias("score")).orderBy(F.desc("score"), key).limit(top_k)


def dense_many(vectors: DataFrame, key: str, vector: str, asked: DataFrame, top_k: int, block: int = 1024) -> DataFrame:
    """(query_id, key, score, rank): exact nearest rows, other than itself, of each of ``asked`` (query_id, query_vector).

    The asking side goes in blocks of about ``block`` vectors, which every task
    gets; a task keeps the best rows so far, and sends those only.
    """
    blocks = max(1, math.ceil(asked.count() / block))
    kinds = asked.schema["query_id"].dataType.simpleString(), vectors.schema[key].dataType.simpleString()
    found = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).collect()  # about ``block`` rows
        held = vectors.sparkSession.sparkContext.broadcast(([r.query_id for r in rows], np.array([r.query_vector for r in rows], dtype=np.float64)))

        def best(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            ids, sought = held.value
            asking, least, kept = np.array(ids), np.full(len(ids), -np.inf), []
            for pdf in batches:
                if not len(pdf) or not ids:
                    continue
                scores = np.stack(pdf["vector"].to_numpy()).astype(np.float64) @ sought.T
                keys = pdf["key"].to_numpy()
                scores[keys[:, None] == asking[None, :]] = -np.inf
                own = np.partition(scores, -min(top_k, len(pdf)), axis=0)[-min(top_k, len(pdf))]
                at, of = np.nonzero((scores >= np.maximum(own, least)[None, :]) & (scores > -np.inf))
                kept.append(pd.DataFrame({"of": of, "key": keys[at], "score": scores[at, of]}))
                if sum(map(len, kept)) > 4 * top_k * len(ids):
                    kept = [_first_of_each(pd.concat(kept), top_k)]
                    full = kept[0].groupby("of")["score"].agg(["size", "min"])
                    full = full[full["size"] == top_k]
                    least[full.index] = full["min"]
            if kept:
                out = _first_of_each(pd.concat(kept), top_k)
                yield pd.DataFrame({"query_id": asking[out["of"]], "key": out["key"].to_numpy(), "score": out["score"].to_numpy()})

        found.append(vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")).mapInPandas(best, f"query_id {kinds[0]}, key {kinds[1]}, score double"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    small_batches(vectors.sparkSession)
    met = reduce(DataFrame.union, found).withColumn("rank", rank).where(F.col("rank") <= top_k)
    return met.select("query_id", F.col("key").alias(key), "score", "rank")


def _first_of_each(rows: pd.DataFrame, top_k: int) -> pd.DataFrame:
    """The best rows (of, key, score) of each asking vector; ties by key."""
    rows = rows.sort_values(["of", "score", "key"], ascending=[True, False, True])
    return rows[rows.groupby("of").cumcount() < top_k]


def ranked(hits: DataFrame, key: str, score: str = "score", rank: str = "rank") -> DataFrame:
    """Ranks from 0. For lists that a limit has cut already."""
    return hits.withColumn(rank, F.row_number().over(Window.orderBy(place_of(F.col(score)).desc(), key)) - 1)


def rrf(dense: DataFrame, sparse: DataFrame, key: str, k: int = RRF_K, dense_weight: float = 1.0) -> DataFrame:
    """(key, score): reciprocal rank fusion of two ranked lists, over the best."""
    d = dense.select(key, F.col("rank").alias("dense_rank"))
    s = sparse.select(key, F.col("rank").alias("sparse_rank"))
    both = d.join(s, key, "full_outer")
    score = F.coalesce(F.lit(dense_weight) * (F.lit(1.0) / (F.lit(k) + F.col("dense_rank") + 1)), F.lit(0.0)) + F.coalesce(
        F.lit(1.0) / (F.lit(k) + F.col("sparse_rank") + 1), F.lit(0.0)
    )
    return normalised(both.select(key, "dense_rank", "sparse_rank", score.alias("score")))


def blended(lexical: Column, semantic: Column, floor: float = SEMANTIC_FLOOR, span: float = SEMANTIC_SPAN, weight: float = SEMANTIC_WEIGHT) -> Column:
    """Meaning, calibrated to 0..1, and words, weighted; words alone where no meaning is known."""
    meaning = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (semantic - floor) / span))
    return F.when(semantic.isNull(), lexical).otherwise(F.round(F.lit(weight) * meaning + F.lit(1 - weight) * lexical, 6))


def dedupe_content(rows: DataFrame, content: str, *order: Column) -> DataFrame:
    """The first row of each fingerprint, told by its digest of 256 bits: texts themselves are not shuffled by."""
    first = F.row_number().over(Window.partitionBy(F.sha2(fingerprint(F.col(content)), 256)).orderBy(*order))
    return rows.withColumn("__first", first).where("__first = 1").drop("__first")


def cap_per_document(rows: DataFrame, document: str, *order: Column, most: int = MAX_PER_DOCUMENT) -> DataFrame:
    """The first ``most`` rows of each document."""
    place = F.row_number().over(Window.partitionBy(document).orderBy(*order))
    return rows.withColumn("__place", place).where(F.col("__place") <= most).drop("__place")


def focus_documents(rows: DataFrame, document: str, score: str, ratio: float = FOCUS_RATIO, most: int = FOCUS_DOCUMENTS) -> DataFrame:
    """Rows of the documents whose best score is near the top one, ``most`` documents at most."""
    best = rows.groupBy(document).agg(F.max(score).alias("best")).orderBy(F.desc("best"), document).limit(max(1, most))
    top = best.agg(F.max("best").alias("top"))
    kept = best.crossJoin(F.broadcast(top)).where(F.col("best") >= F.col("top") * ratio).select(document)
    return rows.join(F.broadcast(kept), document, "left_semi")  # ``most`` rows at most


def focus_many(rows: DataFrame, document: str, score: str, comparison: Column, ratio: float = FOCUS_RATIO, most: int = FOCUS_DOCUMENTS) -> DataFrame:
    """``focus_documents`` for each ``query_id`` of ``rows``; a question that compares is answered from more documents, and from weaker ones.

    Candidates are few for each question; questions are dealt over all tasks.
    """
    best = rows.groupBy("query_id", document).agg(F.max(score).alias("__best"), F.bool_or(comparison).alias("__wide"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(place_of(F.col("__best")).desc(), document))
    top = F.max("__best").over(Window.partitionBy("query_id"))
    least = F.when(F.col("__wide"), F.lit(ratio * COMPARED_SHARE)).otherwise(F.lit(ratio))
    room = F.when(F.col("__wide"), F.lit(max(most, COMPARED_DOCUMENTS))).otherwise(F.lit(max(1, most)))
    kept = best.withColumns({"__place": place, "__top": top}).where((F.col("__place") <= room) & (F.col("__best") >= F.col("__top") * least))
    return rows.join(kept.select("query_id", document), ["query_id", document], "left_semi")


def pool_size(k: int) -> int:
    """Candidates that are gathered for ``k`` answers."""
    return max(POOL, POOL_SHARE * k)


def relative_threshold(rows: DataFrame, score: str, share: float = RELATIVE_THRESHOLD) -> DataFrame:
    """Rows that reach a share of the best score; none if the best is not above 0."""
    best = rows.agg(F.max(score).alias("__best"))
    return rows.crossJoin(F.broadcast(best)).where((F.col("__best") > 0) & (F.col(score) >= F.col("__best") * share)).drop("__best")


def readable(rows: DataFrame, content: str) -> DataFrame:
    """Candidates whose text does not read like a binary file."""
    return rows.where(garbage_reason(F.col(content)).isNull())


def relevance_gate(rows: DataFrame, score: str, reranked: bool = True, minimum: float = MIN_RELEVANCE, semantic: bool = False) -> DataFrame:
    """One row: best_score, relevant, gate."""
    stats = rows.agg(F.count("*").alias("n"), F.coalesce(F.max(score), F.lit(0.0)).alias("best_score"))
    gate = (
        F.when(F.col("n") == 0, "no_candidates")
        .when(F.lit(not reranked), "reranker_off")
        .when(F.lit(minimum <= 0), "gate_off")
        .when(F.col("best_score") >= minimum, "semantic" if semantic else "lexical")
        .otherwise("below_min_relevance")
    )
    return stats.select("best_score", gate.isin("reranker_off", "gate_off", "lexical", "semantic").alias("relevant"), gate.alias("gate"))
