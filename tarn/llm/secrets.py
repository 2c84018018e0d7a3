"""Secret scanning: exact patterns, and Markov models for what they miss.

Two character Markov models are fitted, one of random strings, one of ordinary
identifiers.  A long run of identifier characters is a secret where the first
explains it better by a margin.  Both learn from all rows: what the patterns
find, with generated keys, is random; all other words, alone and joined as
identifiers are, are ordinary.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tarn.llm._common import carried, small_batches

#: The patterns of the three kinds and the shortest match of each.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # runs of fewer characters are never kept, and don't touch longer ones
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ["assign", "access", "hex", "markov"]

CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}"
MARGIN = 10.0
GENERATED = 3000
#: The weight of single characters beside a context's own counts.
BACK_OFF = 4.0
_ASSIGN, _ACCESS, _HEX, _CANDIDATE = re.compile(ASSIGN, re.ASCII), re.compile(ACCESS), re.compile(HEX), re.compile(CANDIDATE)
_WORD = re.compile(r"[A-Za-z][A-Za-z0-9+/_=-]{3,}")

_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_SIGNS = len(_ALPHABET) + 1  # and what is none of them
_PLACE = np.full(128, _SIGNS - 1, dtype=np.int64)
_PLACE[[ord(c) for c in _ALPHABET]] = np.arange(len(_ALPHABET))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """What the patterns find, by start, then kind: (kind, start, end) in code points."""
    found = []
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def _steps(word: str) -> np.ndarray:
    """The character pairs of a word of ASCII characters, as numbers."""
    at = _PLACE[np.frombuffer(word.encode("ascii", "replace"), dtype=np.uint8) & 127]
    return at[:-1] * _SIGNS + at[1:]


def generated_keys(n: int = GENERATED, seed: int = 13) -> list[str]:
    """Random strings as keys are made: hexadecimal, letters and digits, base64."""
    draw = random.Random(seed)
    signs = ["0123456789abcdef", _ALPHABET[:62], _ALPHABET[:64], _ALPHABET[:26] + _ALPHABET[52:62]]
    return ["".join(draw.choices(signs[i % len(signs)], k=draw.randint(16, 48))) for i in range(n)]


def _count_pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts = np.zeros((2, _SIGNS * _SIGNS), dtype=np.int64)
    for pdf in batches:
        for text in pdf["text"].dropna():
            spans = base_spans(text)
            for _, a, b in spans:
                for part in re.findall(r"[A-Za-z0-9+/_=-]{12,}", text[a:b]):
                    counts[0] += np.bincount(_steps(part), minlength=_SIGNS * _SIGNS)
            masked, at = [], 0
            for _, a, b in spans:
                masked.append(text[at : max(at, a)])
                at = max(at, b)
            words = _WORD.findall(" ".join([*masked, text[at:]]))
            if words:
                # as they stand, and as identifiers: joined by _ or -, or in camel case
                joined = [*words, "_".join(words), "-".join(words), "".join([w.capitalize() for w in words])]
                counts[1] += np.bincount(_steps("\n".join(joined)), minlength=_SIGNS * _SIGNS)
    # words hold signs of the alphabet only, so what is none of them parted two
    ordinary = counts[1].reshape(_SIGNS, _SIGNS)
    ordinary[-1], ordinary[:, -1] = 0, 0
    side, pair = np.nonzero(counts)
    yield pd.DataFrame({"side": side, "pair": pair, "n": counts[side, pair]})


def train(df: DataFrame, text: str = "text") -> np.ndarray:
    """For each pair of characters, how much likelier the second is after the first in a random string: log-likelihood ratios.

    Learns from all rows; a task sends one count for each pair that it met.
    Null and empty texts add nothing, repeated rows count as often as they
    stand, texts of any length are read whole, and from an empty table only
    generated keys are learnt.
    """
    small_batches(df.sparkSession)
    rows = df.select(F.col(text).alias("text"))
    found = rows.mapInPandas(_count_pairs, "side int, pair int, n long").groupBy("side", "pair").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2, _SIGNS * _SIGNS))
    counts[found["side"], found["pair"]] = found["n"]
    for key in generated_keys():
        counts[0] += np.bincount(_steps(key), minlength=_SIGNS * _SIGNS)
    counts = counts.reshape(2, _SIGNS, _SIGNS)
    single = counts.sum(axis=1) + 0.5
    single /= single.sum(axis=1, keepdims=True)
    # a pair seen seldom is as likely as its second character alone
    pairs = (counts + BACK_OFF * single[:, None, :]) / (counts.sum(axis=2, keepdims=True) + BACK_OFF)
    return (np.log(pairs[0]) - np.log(pairs[1])).ravel()


def all_spans(text: str, ratios: np.ndarray, margin: float = MARGIN) -> list[tuple[str, int, int]]:
    """The patterns' spans, and runs that overlap none of them and look random."""
    base = base_spans(text)
    starts, reach = [x for _, x, _ in base], list(accumulate((y for _, _, y in base), max))
    found = list(base)
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        before = bisect_left(starts, b)  # spans that begin before the run ends; one of them may reach into it
        if before and reach[before - 1] > a:
            continue
        if float(ratios[_steps(m.group())].sum()) > margin:
            found.append(("markov", a, b))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scan(df: DataFrame, ratios: np.ndarray, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """``df`` with ``secrets``: an array of (kind, start, end) in code points, end exclusive, by start and kind.

    A null or empty text has none.  Repeated rows get the same spans, texts of
    any length are scanned whole, an empty table gives no rows.  A column already
    named like the output is replaced.
    """
    small_batches(df.sparkSession)
    kind = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))

    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[{"kind": k, "start": a, "end": b} for k, a, b in all_spans(t or "", ratios, margin)] for t in texts], dtype=object)

    find.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.select(*carried(df, ["secrets"]), pandas_udf(find, kind)(F.col(text)).alias("secrets"))


def spelled(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
