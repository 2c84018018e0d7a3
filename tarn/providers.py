"""What models plug into: each provider works on batches, so it runs inside Arrow partitions.

Neural embedders, rerankers and language models are not part of the engine; the
stand-ins here are deterministic.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType

from tarn.functions.embed import hash_vector
from tarn.operators.answers import REFUSALS
from tarn.operators.catalog import KEY, missing
from tarn.operators.rerank import lexical_scores


class Embedder(Protocol):
    name: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


class Reranker(Protocol):
    def score(self, query: str, texts: list[str]) -> list[float]: ...


class LanguageModel(Protocol):
    def complete(self, prompt: str) -> str: ...


class HashEmbedder:
    name = "hash"

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [hash_vector(t).tolist() for t in texts]


class LexicalReranker:
    def score(self, query: str, texts: list[str]) -> list[float]:
        return lexical_scores(query, texts)


class EchoModel:
    """Answers with the first sentence of the first block of evidence, cited."""

    def complete(self, prompt: str) -> str:
        found = re.search(r"(?s)\[CONTENT\]\n(.*?)\n</retrieved_document>", prompt)
        return f"{re.split(r'(?<=[.!?])\s', found.group(1).strip())[0]} [1]" if found else REFUSALS[0]


def embedded(rows: DataFrame, text: str, provider: Embedder) -> DataFrame:
    """``rows`` with ``embedding``."""
    schema = StructType([*rows.schema.fields, StructField("embedding", ArrayType(FloatType()))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(embedding=provider.embed(pdf[text].fillna("").tolist()))

    return rows.mapInPandas(run, schema)


def migrate(source: DataFrame, target: DataFrame, text: str, provider: Embedder) -> DataFrame:
    """The target collection after what it lacks was embedded anew and what the source lost was dropped. May be run again at any time."""
    alive = target.join(source.select(*KEY), KEY, "left_semi")
    fresh = embedded(missing(source, target).drop("embedding"), text, provider)
    return alive.unionByName(fresh, allowMissingColumns=True)


def completed(prompts: DataFrame, prompt: str, model: LanguageModel, out: str = "answer") -> DataFrame:
    schema = StructType([*prompts.schema.fields, StructField(out, StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(**{out: [model.complete(p) for p in pdf[prompt].fillna("")]})

    return prompts.mapInPandas(run, schema)


def payload_size(base64: str = "base64", text: str = "text"):
    """Bytes that a request's payload will have, told from the lengths alone."""
    packed = F.trim(F.col(base64))
    padding = F.length(packed) - F.length(F.regexp_replace(packed, "=+$", ""))
    return F.when(F.coalesce(F.length(packed), F.lit(0)) > 0, F.greatest(F.lit(0), F.floor(F.length(packed) * 3 / 4) - padding)).otherwise(F.coalesce(F.octet_length(text), F.lit(0)))
