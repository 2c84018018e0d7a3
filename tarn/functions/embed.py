"""A deterministic embedder: hashed word counts on the unit sphere. The provider to use where no neural one is at hand."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, FloatType

from tarn.session import small_batches

DIM = 384
_WORD = re.compile(r"[\w\-]+")


def hash_vector(text: str | None, dim: int = DIM) -> np.ndarray:
    """Each word adds or takes 1 at a place that its hash names; the sum is scaled to length 1, zero stays zero."""
    out = np.zeros(dim, dtype=np.float64)
    for word in _WORD.findall((text or "").lower()):
        h = hashlib.blake2b(word.encode("utf-8"), digest_size=8).digest()
        out[int.from_bytes(h[:4], "little") % dim] += 1.0 if h[4] % 2 == 0 else -1.0
    size = float(np.sqrt((out * out).sum()))
    return (out / size if size else out).astype(np.float32)


def hash_embedding(df: DataFrame, text: str, out: str = "embedding", dim: int = DIM) -> DataFrame:
    @pandas_udf(ArrayType(FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([hash_vector(t, dim) for t in texts], dtype=object)

    small_batches(df.sparkSession)
    return df.withColumn(out, run(F.col(text)))


def dot(a: Column, b: Column) -> Column:
    """The dot product of two arrays of equal length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
