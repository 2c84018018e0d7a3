"""Context assembly: neighbours, order, coverage, packing, grouping."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.providers import completed

#: How many documents of a query are completed, and how far summaries go.
EXPANDED_DOCUMENTS = 4
SUMMARY_PARTS, SUMMARY_STAGES = 400, 12
#: Budgets in tokens.
SUMMARY_LEAST, SUMMARY_SHARE, SUMMARY_MOST = 400, 0.25, 4000
FULL_DOCUMENT_TOKENS = 3000
HIT_OVERHEAD = 60


def neighbours(hits: DataFrame, chunks: DataFrame, n: int, document: str = "document_id", index: str = "chunk_index") -> DataFrame:
    """Chunks within ``n`` places of a hit in the same document, with ``distance`` to the nearest.

    A range join written as an equi-join: each hit names the places around it.
    """
    around = hits.select(F.col(document), F.explode(F.sequence(F.col(index) - n, F.col(index) + n)).alias("at"), F.col(index).alias("hit"))
    near = around.groupBy(document, F.col("at").alias(index)).agg(F.min(F.abs(F.col("at") - F.col("hit"))).alias("distance"))
    return chunks.join(near, [document, index])


def ordered(rows: DataFrame, rank: str = "rank", document: str = "document_id", place: str = "document_order", summary: str = "is_summary", query: str | None = None) -> DataFrame:
    """Adds ``position``: summaries first, then documents by their best rank, each in its own order; within each ``query``, if one is named."""
    flag = F.coalesce(F.col(summary), F.lit(False))
    per = [query] if query else []
    first = F.min(F.when(~flag, F.col(rank))).over(Window.partitionBy(*per, document))
    keyed = rows.withColumn("__first", F.when(flag, F.col(rank)).otherwise(first)).withColumn("__flag", flag)
    order = Window.partitionBy(*per).orderBy(F.desc("__flag"), "__first", F.when(F.col("__flag"), F.lit(0)).otherwise(F.col(place)), rank)
    return keyed.withColumn("position", F.row_number().over(order)).drop("__first", "__flag")


def merged(hits: DataFrame, extras: DataFrame, keys: list[str]) -> DataFrame:
    """Hits, then what is new among the extras."""
    return hits.withColumn("expanded", F.lit(False)).unionByName(extras.join(hits.select(*keys), keys, "left_anti").withColumn("expanded", F.lit(True)), allowMissingColumns=True)


def coverage(included: DataFrame, chunks: DataFrame, document: str = "document_id") -> DataFrame:
    """How much of each document is included; summaries count on neither side, documents known by their summary alone say so."""
    flag = F.coalesce(F.col("is_summary"), F.lit(False))
    have = included.groupBy(document).agg(F.sum((~flag).cast("long")).alias("included"), F.max(flag).alias("summarised"))
    there = chunks.where(~flag).groupBy(document).agg(F.count("*").alias("there"))
    met = have.join(there, document, "left")
    via = (F.col("included") == 0) & F.col("summarised")
    total = F.when(via, F.lit(1)).when(F.coalesce("there", F.lit(0)) > 0, F.col("there")).otherwise(F.col("included"))
    inc = F.when(via, F.lit(1)).otherwise(F.col("included"))
    return met.select(document, inc.alias("included"), total.alias("total"), (inc >= total).alias("complete"), via.alias("via_summary"))


def pack(items: Iterable[tuple[str, int, bool]], budget: int, most: int = 8) -> list[str]:
    """Keys of what is admitted, in order, of (key, tokens, is_summary).

    Content goes first: an item that does not fit is skipped and smaller ones
    may follow; the first is admitted whatever its size.  Summaries then share
    a part of the budget of their own.
    """
    items = list(items)
    taken, spent = set(), 0
    for key, tokens, summary in items:
        if not summary and len(taken) < most and (not taken or spent + tokens <= budget):
            taken.add(key)
            spent += tokens
    share = max(SUMMARY_LEAST, min(int(budget * SUMMARY_SHARE), SUMMARY_MOST))
    for key, tokens, summary in items:
        if summary and tokens <= share and (not taken or spent + tokens <= budget):
            taken.add(key)
            spent, share = spent + tokens, share - tokens
    return [key for key, _, _ in items if key in taken]


def pack_contexts(rows: DataFrame, budget: int, most: int = 8) -> DataFrame:
    """(query_id, key, number): per query, its candidates by ``position`` (key, tokens, is_summary), packed and numbered from 1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("position")
        kept = pack(zip(pdf["key"], pdf["tokens"], pdf["is_summary"].fillna(False), strict=True), budget, most)
        return pd.DataFrame({"query_id": pdf["query_id"].iloc[0], "key": kept, "number": range(1, len(kept) + 1)})

    return rows.groupBy("query_id").applyInPandas(run, "query_id long, key string, number int")


def expanded(hits: DataFrame, chunks: DataFrame, budget: int, n: int, whole: str | None = None, most_documents: int = EXPANDED_DOCUMENTS) -> DataFrame:
    """What a query's documents add to its hits: chunks with ``upto``, the tokens spent once each is added.

    ``hits`` and ``chunks`` (query_id, document_id, chunk_index, rank, tokens,
    content).  A query's first documents by best hit take their turns: small
    ones, or those for which column ``whole`` of ``hits`` asks it, are added
    whole up to the first chunk that does not fit; others get the chunks within
    ``n`` places of a hit, nearest first, and one that does not fit is skipped.
    Neighbours are found by an equi-join; only chunks that are wanted, of
    ``most_documents`` documents a query, meet in a query's group.
    """
    asks = F.coalesce(F.max(F.col(whole).cast("boolean")), F.lit(False)) if whole else F.lit(False)
    best = hits.groupBy("query_id", "document_id").agg(F.min("rank").alias("best"), asks.alias("asked"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("best", "document_id"))
    first = best.withColumn("place", place).where(F.col("place") <= most_documents)
    size = chunks.groupBy("query_id", "document_id").agg(F.sum("tokens").alias("size"))
    turn = first.join(size, ["query_id", "document_id"]).select("query_id", "document_id", "place", (F.col("asked") | (F.col("size") <= FULL_DOCUMENT_TOKENS)).alias("whole"))
    key = ["query_id", "document_id", "chunk_index"]
    around = hits.select("query_id", "document_id", F.col("chunk_index").alias("hit"), F.explode(F.sequence(F.col("chunk_index") - n, F.col("chunk_index") + n)).alias("chunk_index"))
    near = around.groupBy(*key).agg(F.min(F.abs(F.col("chunk_index") - F.col("hit"))).alias("gap"))
    open_ = chunks.where(F.trim(F.regexp_replace("content", r"\s", "")) != "").join(hits.select(*key), key, "left_anti").select(*key, "tokens")
    wanted = open_.join(turn, ["query_id", "document_id"]).join(near, key, "left").where(F.col("whole") | F.col("gap").isNotNull())
    spent = hits.groupBy("query_id").agg(F.sum(F.col("tokens") + HIT_OVERHEAD).alias("spent"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total, stopped, out = int(pdf["spent"].iloc[0]), None, []
        pdf = pdf.assign(gap=pdf["gap"].where(~pdf["whole"], 0)).sort_values(["place", "gap", "chunk_index"])
        for r in pdf.itertuples(index=False):
            if r.place == stopped:
                continue
            if total + r.tokens > budget:
                stopped = r.place if r.whole else stopped
                continue
            total += int(r.tokens)
            out.append((r.query_id, r.document_id, r.chunk_index, total))
        return pd.DataFrame(out, columns=[*key, "upto"])

    kinds = {f.name: f.dataType.simpleString() for f in wanted.schema}
    return wanted.join(spent, "query_id").groupBy("query_id").applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in key) + ", upto long")


def overview(chunks: DataFrame, picked: DataFrame, budget: int, document: str = "document_id", index: str = "chunk_index", tokens: str = "tokens", query: str | None = None) -> DataFrame:
    """Leading chunks of each picked document within its share of the budget (of its ``query``, if one is named)."""
    per = [query] if query else []
    share = F.greatest(F.lit(400), F.floor(F.lit(budget) / F.greatest(F.count("*"), F.lit(1)))).alias("share")
    shares = picked.groupBy(*per).agg(share) if per else picked.agg(share)
    run = F.sum(tokens).over(Window.partitionBy(*per, document).orderBy(index))
    rows = chunks.join(picked, [*per, document], "left_semi").withColumn("upto", run)
    met = rows.join(shares, per) if per else rows.crossJoin(F.broadcast(shares))
    return met.where(F.col("upto") <= F.col("share")).drop("share")


def grouped(chunks: DataFrame, window: int, most_parts: int = SUMMARY_PARTS, most_stages: int = SUMMARY_STAGES, document: str = "document_id", index: str = "chunk_index") -> DataFrame:
    """``chunks`` (with ``tokens``) with ``stage``, the group that each is summarised in, and ``covered``.

    A document's chunks fill one group after another, each as far as the window
    goes.  Summaries stop at ``most_parts`` chunks and ``most_stages`` groups;
    what lies beyond is flagged, not dropped, so raising the limits covers it.
    """
    rows = chunks.select(document, index, "tokens")
    kinds = T.StructType([*rows.schema, T.StructField("stage", T.IntegerType()), T.StructField("covered", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents follow each other, so their state is carried from batch to batch."""
        last, place, stage, room = object(), 0, 0, window
        for batch in batches:
            stages, covered = [], []
            for of, tokens in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if of != last:
                    last, place, stage, room = of, 0, 0, window
                elif tokens > room:
                    stage, room = stage + 1, window
                stages.append(stage)
                covered.append(stage < most_stages and place < most_parts)
                place, room = place + 1, room - tokens
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(stages, pa.int32()), pa.array(covered, pa.bool_())], names=kinds.names)

    return rows.repartition(document).sortWithinPartitions(document, F.col(index).asc_nulls_last()).mapInArrow(run, kinds)


def summarised(parts: DataFrame, model, document: str = "document_id", index: str = "chunk_index", content: str = "content") -> DataFrame:
    """(document, summary, partial) of covered, grouped chunks: each stage is summarised by the model, then the stages' summaries together."""
    texts = lambda key: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, "piece"))), lambda x: x["piece"]), "\n")
    partial = parts.groupBy(document).agg(F.max(~F.col("covered")).alias("partial"), F.max(F.when(F.col("covered"), F.col("stage"))).alias("last"))
    stages = parts.where("covered").withColumn("piece", F.col(content)).groupBy(document, "stage").agg(texts(index).alias("prompt"))
    pieces = completed(stages, "prompt", model, "piece")
    joined = pieces.groupBy(document).agg(texts("stage").alias("prompt")).join(partial, document)
    single = joined.where("last = 0").withColumn("summary", F.col("prompt"))
    return single.unionByName(completed(joined.where("last > 0"), "prompt", model, "summary")).select(document, "summary", "partial")


def attach_summaries(hits: DataFrame, summaries: DataFrame, most: int = 3, document: str = "document_id", rank: str = "rank", query: str | None = None) -> DataFrame:
    """Summaries of the first ``most`` documents among the hits (of each ``query``, if one is named)."""
    if query is None:
        first = hits.groupBy(document).agg(F.min(rank).alias("first")).orderBy("first", document).limit(most)
        return summaries.join(F.broadcast(first), document)  # ``most`` rows
    first = hits.groupBy(query, document).agg(F.min(rank).alias("first"))
    place = F.row_number().over(Window.partitionBy(query).orderBy("first", document))
    return summaries.join(first.withColumn("place", place).where(F.col("place") <= most).drop("place"), document)
