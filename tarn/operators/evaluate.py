"""Retrieval metrics over ranked results (query_id, document_id, rank from 1) and expectations (query_id, document_id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def holding(docs: DataFrame, key: str, items: DataFrame, item_key: str, text: str = "text", window: int = 8) -> DataFrame:
    """(item_key, key): documents that hold all words of an item in a row.

    Items are found by an equi-join on their first ``window`` words (fewer, if
    they have fewer), then compared whole; no item meets every document.
    """
    words = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\s+"), lambda w: w != "")
    asked = items.select(item_key, words.alias("sought")).where(F.size("sought") > 0)
    asked = asked.withColumn("n", F.least(F.size("sought"), F.lit(window))).withColumn("at", F.xxhash64("n", F.slice("sought", 1, F.col("n"))))
    lengths = asked.select("n").distinct()  # ``window`` rows at most
    have = docs.select(key, words.alias("words")).join(F.broadcast(lengths), F.size("words") >= F.col("n"))
    places = F.transform(F.sequence(F.lit(1), F.size("words") - F.col("n") + 1), lambda i: F.xxhash64("n", F.slice("words", i, F.col("n"))))
    line = lambda c: F.concat(F.lit(" "), F.array_join(c, " "), F.lit(" "))
    met = have.select(key, "n", F.explode(F.array_distinct(places)).alias("at")).join(asked.select(item_key, "n", "at"), ["n", "at"]).select(key, item_key)
    whole = met.join(docs.select(key, line(words).alias("line")), key).join(asked.select(item_key, line("sought").alias("piece")), item_key)
    return whole.where(F.contains("line", F.col("piece"))).select(item_key, key).distinct()


def per_query(results: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """recall, precision (by distinct documents) and reciprocal rank of each query.

    A query that expects nothing has recall 1.
    """
    top = results.where(F.col("rank") <= k).groupBy("query_id", "document_id").agg(F.min("rank").alias("rank"))
    want = expected.distinct().withColumn("good", F.lit(1))
    judged = top.join(want, ["query_id", "document_id"], "left")
    have = judged.groupBy("query_id").agg(F.count("*").alias("shown"), F.coalesce(F.sum("good"), F.lit(0)).alias("hits"))
    first = results.join(want, ["query_id", "document_id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    asked = results.select("query_id").union(expected.select("query_id")).distinct()
    wanted = want.groupBy("query_id").agg(F.count("*").alias("wanted"))
    met = asked.join(have, "query_id", "left").join(first, "query_id", "left").join(wanted, "query_id", "left").fillna(0, ["shown", "hits", "wanted"])
    return met.select(
        "query_id",
        F.when(F.col("wanted") == 0, 1.0).otherwise(F.col("hits") / F.col("wanted")).alias("recall"),
        F.when(F.col("shown") == 0, 0.0).otherwise(F.col("hits") / F.when(F.col("shown") > 0, F.col("shown")).otherwise(1)).alias("precision"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"),
    )


def summary(scores: DataFrame) -> DataFrame:
    return scores.agg(
        F.round(F.avg("recall"), 4).alias("recall"),
        F.round(F.avg("precision"), 4).alias("precision"),
        F.round(F.avg("reciprocal_rank"), 4).alias("mrr"),
        F.round(F.avg((F.col("recall") > 0).cast("double")), 4).alias("hit_rate"),
        F.count("*").alias("queries"),
    )


def rates(answers: DataFrame) -> DataFrame:
    """Of (answerable, answered, grounded, cited): how often unanswerable questions are refused, and answers are grounded and cited."""
    rate = lambda value, where: F.round(F.coalesce(F.avg(F.when(where, value.cast("double"))), F.lit(0.0)), 4)
    return answers.agg(
        rate(~F.col("answered"), ~F.col("answerable")).alias("refusal_rate"),
        rate(F.col("grounded"), F.col("answered")).alias("grounded_rate"),
        rate(F.col("cited"), F.col("answered")).alias("citation_rate"),
    )
