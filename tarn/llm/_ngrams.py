"""Hashed n-gram models of a target and of the raw corpus.

Tokens are runs of letters and digits, and runs of any one other character that
is no white space; the n-grams are single tokens and pairs.  Counts have a
fixed size, ``2 * BUCKETS`` numbers for each side: a task adds up its own and
sends those that are not zero.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm import _words

BUCKETS = 1 << 17
TARGET_DOCS = 40_000
#: Added to both counts of a bucket, as if each side had met it so often: what is rare says little.
SMOOTHING = 32.0
_SIDE = np.zeros(256, dtype=np.uint8)  # 0 white space, 1 word, otherwise the character itself
_SIDE[:] = np.arange(256)
_SIDE[[0x20, *range(0x09, 0x0E)]] = 0
_SIDE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 0x20


def ngram_buckets(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(buckets of the n-grams of some texts, one text after another; how many each text has)."""
    for _, part in _words.pieces(texts):
        raw = np.frombuffer(b"\n".join([*part, b""]), dtype=np.uint8)
        side = _SIDE[raw]
        # a token begins where the side changes; longer runs of one sign count as one token
        starts = np.flatnonzero((side != 0) & (np.diff(side, prepend=np.uint8(0)) != 0))
        ends = np.cumsum([len(x) + 1 for x in part])
        if not len(starts):
            yield np.zeros(0, np.int64), np.zeros(len(part), np.int64)
            continue
        gap = np.flatnonzero((side == 0) | (np.diff(side, prepend=np.uint8(0)) != 0))
        stop = np.append(gap, len(raw))[np.searchsorted(gap, starts, side="right")]
        length = stop - starts
        inside = np.flatnonzero(side != 0)
        first = np.concatenate([[0], np.cumsum(length)[:-1]])
        offset = np.arange(len(inside)) - np.repeat(first, length)
        values = _words._BYTE[_FOLD[raw[inside]]] * _words._powers(int(length.max()) + 1)[offset]
        token = _words.mix(np.add.reduceat(values, first))
        # runs of one sign: length does not matter
        sign = side[starts] != 1
        token[sign] = _words._BYTE[side[starts][sign]]
        per_text = np.diff(np.searchsorted(starts, ends), prepend=0)
        pair = _words.mix(token[:-1] * np.uint64(0x9E3779B97F4A7C15) + token[1:])
        owner = np.repeat(np.arange(len(part)), per_text)
        same = np.flatnonzero(owner[1:] == owner[:-1])
        shift = np.uint64(64 - 17)
        one = (token >> shift).astype(np.int64)
        two = (pair[same] >> shift).astype(np.int64) + BUCKETS
        counts = per_text + np.maximum(per_text - 1, 0)
        order = np.argsort(np.concatenate([owner, owner[same]]), kind="stable")
        yield np.concatenate([one, two])[order], counts


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    raw, target = np.zeros(2 * BUCKETS, np.int64), np.zeros(2 * BUCKETS, np.int64)
    for pdf in batches:
        flags, at = pdf["target"].to_numpy(dtype=bool), 0
        for buckets, counts in ngram_buckets(pdf["text"].tolist()):
            raw += np.bincount(buckets, minlength=2 * BUCKETS)
            mine = np.repeat(flags[at : at + len(counts)], counts)
            target += np.bincount(buckets[mine], minlength=2 * BUCKETS)
            at += len(counts)
    found = np.flatnonzero(raw)
    yield pd.DataFrame({"bucket": found, "raw": raw[found], "target": target[found]})


def pick_target(labels: DataFrame, id_col: str, most: int = TARGET_DOCS) -> DataFrame:
    """Identifiers of about ``most`` trusted rows at most (good quality, not toxic), picked by a hash."""
    trusted = labels.where((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0) & F.col(id_col).isNotNull())
    n = trusted.count()
    place = F.shiftrightunsigned(F.xxhash64(F.lit(11), F.col(id_col)), 11) / F.lit(float(1 << 53))
    return trusted.where(place < F.lit(min(1.0, most / max(1, n)))).select(id_col).distinct()


def count_ngrams(docs: DataFrame, target_ids: DataFrame, id_col: str, text: str) -> tuple[np.ndarray, np.ndarray]:
    """(raw, target) counts of every bucket over all rows of ``docs``; ``target_ids`` is bounded by its picker."""
    flagged = docs.select(id_col, F.col(text).alias("text")).join(F.broadcast(target_ids.withColumn("hit", F.lit(True))), id_col, "left")
    flagged = flagged.select("text", F.coalesce("hit", F.lit(False)).alias("target"))
    found = flagged.mapInPandas(_count, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    pdf = found.toPandas()
    raw, target = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)
    raw[pdf["bucket"]], target[pdf["bucket"]] = pdf["raw"], pdf["target"]
    return raw, target


def log_ratios(raw: np.ndarray, target: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    """log p(bucket | target) - log p(bucket | raw); single tokens and pairs each have their own models.

    The raw counts are first scaled to the target's mass, so that smoothing
    weighs on both alike and a rare bucket says little.
    """
    out = np.zeros(len(raw), dtype=np.float32)
    half = len(raw) // 2
    for part in (slice(0, half), slice(half, None)):
        r, t = raw[part], target[part]
        if t.sum() and r.sum():
            out[part] = np.log((t + smoothing) / (r * (t.sum() / r.sum()) + smoothing))
    return out


def text_scores(texts: list[str | None], ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the log ratios, number of n-grams) of each text."""
    sums, numbers = [], []
    for buckets, counts in ngram_buckets(texts):
        run = np.concatenate([[0.0], np.cumsum(ratios[buckets], dtype=np.float64)])
        ends = np.cumsum(counts)
        sums.append(run[ends] - run[ends - counts])
        numbers.append(counts)
    return (np.concatenate(sums), np.concatenate(numbers)) if sums else (np.zeros(0), np.zeros(0, np.int64))
