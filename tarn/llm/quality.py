"""Quality rules: exact counts about a text, then a model's verdict.

The verdict compares a document under two multinomials over hashed n-grams,
one of trusted rows, one of the raw corpus: the mean log-likelihood ratio of its
n-grams.  Every document is held against the same threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import _ngrams, _words
from tarn.llm._common import small_batches

SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
LEAST_MEAN_RATIO = -0.03
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(hashes: np.ndarray) -> int:
    """Words that lie in a window of 3 words found at least twice."""
    wide = _words.windows(hashes, 3)
    if not len(wide):
        return 0
    _, where, counts = np.unique(wide, return_inverse=True, return_counts=True)
    again = counts[where] > 1
    if not again.any():
        return 0
    inside = np.zeros(len(hashes), dtype=bool)
    for i in range(3):
        inside[i : i + len(wide)] |= again
    return int(inside.sum())


def dup_lines(text: str) -> int:
    """Lines with a word that are equal to an earlier line."""
    seen, n = set(), 0
    for line in text.split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            n += line in seen
            seen.add(line)
    return n


def text_counts(texts: list[str | None]) -> pd.DataFrame:
    """The counts of each text, ``COUNTS``; a null text has no words."""
    out = []
    for start, part in _words.pieces(texts):
        hashes, per_text, _ = _words.word_hashes(part)
        at = 0
        for i, n in enumerate(per_text.tolist()):
            text = texts[start + i] or ""
            spaces = sum(map(text.count, " \t\n\x0b\x0c\r"))
            out.append((n, len(text) - spaces, sum(map(text.count, SYMBOLS)), dup_lines(text), repeat_words(hashes[at : at + n])))
            at += n
    return pd.DataFrame(out, columns=COUNTS)


def judge(
    df: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text: str = "text",
    least: float = LEAST_MEAN_RATIO,
    target_docs: int = _ngrams.TARGET_DOCS,
) -> DataFrame:
    """One row per row of ``df``: ``id_col``, the counts, ``base_failed``, ``mean_ratio`` and ``kept``.

    ``labels`` (id, quality, toxic) names trusted rows, of which about
    ``target_docs`` are learnt from; the raw model counts every row.  A text
    without n-grams has ratio 0 (and fails the base, as it has no words).
    Without trusted rows all ratios are 0 and the base alone decides.  Repeated
    rows get the same verdict and count as often as they stand, null and empty
    texts have no words, texts of any length are read whole, an empty table gives
    no rows.  Other columns are not passed on, so none can clash.
    """
    spark = df.sparkSession
    small_batches(spark)
    raw, target = _ngrams.count_ngrams(df, _ngrams.pick_target(labels, id_col, target_docs), id_col, text)
    shared = spark.sparkContext.broadcast(_ngrams.log_ratios(raw, target))  # 2 * BUCKETS numbers, whatever the input
    rows = df.select(F.col(id_col).alias("id"), F.col(text).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = [None if t is None else str(t) for t in pdf["text"]]
            sums, n = _ngrams.text_scores(texts, shared.value)
            yield text_counts(texts).assign(id=pdf["id"].to_numpy(), mean_ratio=sums / np.maximum(1, n))[["id", *COUNTS, "mean_ratio"]]

    found = rows.mapInPandas(measure, f"id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, mean_ratio double")
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return found.select(
        F.col("id").alias(id_col),
        *COUNTS,
        failed.alias("base_failed"),
        "mean_ratio",
        (~failed & (F.col("mean_ratio") >= F.lit(least))).alias("kept"),
    )
