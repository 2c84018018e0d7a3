"""The corpus pipeline: language ID, exact and near dedup, mixing, tokenising.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows that the stage
before it kept.  All but the last return the columns of ``documents``.  Between
stages rows are written as Parquet and read again, so each stage starts from a
table: a lost executor never costs more than the stage it was lost in, and rows
are told by their file and place in it.

The mix may take a document up to three times; such rows repeat from there on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.llm import bpe, exact_dedup, language, mixing, near_dedup
from tarn.session import materialize

RANKS = "byte_bpe_50k.tiktoken"


#: The least score of a language that a document is kept with.
LEAST_LANGUAGE_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told."""
    return language.keep_known(docs, least=LEAST_LANGUAGE_SCORE)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.drop_copies(docs, scanned=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.drop_near_copies(docs, scanned=True)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them."""
    return mixing.mix_sources(docs, scanned=True)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts, and digests of token ids and of the bytes that they decode to."""
    import public_tokenizers

    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    coded = bpe.round_trip(docs.select("doc_id", "source", "text"), ranks, pattern)
    return coded.select(
        "doc_id",
        "source",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mix_sources", mix),
    ("byte_bpe", tokenize),
]

#: SQL expresses neither the language model nor the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
