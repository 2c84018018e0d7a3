"""Quality classification by importance resampling.

A document's weight is the ratio of two hashed n-gram models that generate its
text: one of the target (trusted rows), one of the raw corpus.  Documents are
sampled without replacement in proportion to their weights by Gumbel top-k: the
``k`` largest sums of log weight and Gumbel noise.  The k-th is found exactly by
counting between probes, as for shards, never by sorting everything.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm import _ngrams
from tarn.llm._common import hash60, small_batches
from tarn.llm.sharding import K1, K2, SIZE, find_splitters
from tarn.session import materialize

SEED = 41
#: Keys are told apart within this of 0.
_FAR = 1 << 33


def _weigh(ratios: np.ndarray):
    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sums, n = _ngrams.text_scores(pdf["text"].tolist(), ratios)
            yield pd.DataFrame({"rid": pdf["rid"], "id": pdf["id"], "n_ngrams": n, "log_weight": sums})

    return weigh


def _place(key: Column, tie: Column) -> dict[str, Column]:
    """``key`` as two numbers of 60 bits, ascending where it descends: its whole part and 26 binary places, then 26 more and a hash of ``tie``."""
    whole = F.floor(-key)
    places = (-key - whole) * F.lit(float(1 << 26))
    held = F.greatest(F.lit(-_FAR), F.least(F.lit(_FAR - 1), whole))
    return {
        K1: (held + F.lit(_FAR)) * F.lit(1 << 26) + F.floor(places),
        K2: F.floor((places - F.floor(places)) * F.lit(float(1 << 26))) * F.lit(1 << 34) + F.shiftrightunsigned(hash60(tie), 26),
    }


def good_share(labels: DataFrame) -> float:
    """How large a part of the labelled rows is of good quality; 1 without labels."""
    found = labels.where("quality IS NOT NULL").agg(F.avg((F.col("quality") == 1).cast("double"))).first()[0]
    return 1.0 if found is None else found


def resample(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    k: int | None = None,
    share: float | None = None,
    seed: int = SEED,
    target_docs: int = _ngrams.TARGET_DOCS,
) -> DataFrame:
    """One row per row of ``df``: position ``__tarn_rid``, ``id_col``, ``n_ngrams``, ``log_weight``, ``gumbel_key``, ``kept``.

    ``labels`` (id, quality, toxic) names trusted rows, of which about
    ``target_docs`` are learnt from.  A log weight is the sum of the log ratios of
    all n-grams of a text.  ``k`` rows are kept, or that ``share`` of all rows, by
    default the share that good rows have among those with a label of quality
    (null labels say nothing, repeated ones count as often as they stand), and
    all rows where no row has one.  Noise depends on seed and identifier, so
    reruns agree; equal keys are told apart by their place in the one scan that
    weighs them.  A text without n-grams (null, empty) has log weight 0.  Without
    trusted rows all log weights are 0.  An empty table gives none.
    """
    spark = df.sparkSession
    small_batches(spark)
    raw, target = _ngrams.count_ngrams(df, _ngrams.pick_target(labels, id_col, target_docs), id_col, text)
    ratios = _ngrams.log_ratios(raw, target)
    rows = df.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(ratios)  # 2 * BUCKETS numbers, whatever the input

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _weigh(shared.value)(batches)

    uniform = (hash60(F.lit(seed), F.col("id"), F.col("rid") * F.col("id").isNull().cast("long")) + 0.5) / F.lit(float(1 << 60))
    weighed = rows.mapInPandas(weigh, f"rid long, id {kind}, n_ngrams long, log_weight double")
    weighed = materialize(weighed.withColumn("gumbel_key", F.col("log_weight") - F.log(-F.log(uniform))), "weights")
    n = weighed.count()
    if k is None:
        k = round((good_share(labels) if share is None else share) * n)
    # ascending, so that the k first keys are the k largest sums
    keyed = weighed.withColumns({**_place(F.col("gumbel_key"), F.col("rid")), SIZE: F.lit(1)})
    cut = find_splitters(keyed.select(K1, K2, SIZE), [k / n]) if 0 < k < n else []
    if cut:
        (k1, k2), = cut
        kept = (F.col(K1) < F.lit(k1)) | ((F.col(K1) == F.lit(k1)) & (F.col(K2) < F.lit(k2)))
    else:
        kept = F.lit(bool(n and k >= n))
    return keyed.select(F.col("rid").alias("__tarn_rid"), F.col("id").alias(id_col), "n_ngrams", "log_weight", "gumbel_key", kept.alias("kept"))
