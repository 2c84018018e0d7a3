"""Indonesian word forms without a dictionary.

A word's stems are guesses, kept side by side.  They are worked out once per
distinct word: callers take the vocabulary, stem it and join it back.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions.text import STOPWORDS

_STOP = frozenset(STOPWORDS)
_VOWELS = frozenset("aeiou")
#: Affixes in the order in which they are tried, and the shortest stem.
PARTICLES = ("lah", "kah", "tah", "pun")
POSSESSIVES = ("nya", "ku", "mu")
SUFFIXES = ("kan", "an", "i")
PLAIN_PREFIXES = ("memper", "diper", "ber", "ter", "per", "di", "ke", "se")
NASAL_PREFIXES = ("me", "pe")
SECOND_PREFIXES = ("per", "ber", "pe", "ter")
SHORTEST = 3
#: After me-/pe-: the nasal, and what stood before a vowel in its place.
NASALS = {"ny": ("s",), "ng": ("k", ""), "m": ("p", "m"), "n": ("t", "n")}


def _without_endings(word: str) -> Iterator[str]:
    for endings in (PARTICLES, POSSESSIVES):
        for e in endings:
            if word.endswith(e) and len(word) >= len(e) + 4:
                word = word[: -len(e)]
                yield word
                break
    for e in SUFFIXES:
        root = word[: -len(e)]
        if word.endswith(e) and len(root) >= 4 and not (e == "i" and root[-1] in _VOWELS):
            yield root
            if e != "kan":  # a word in -kan may also end in -an
                return


def _roots_after_nasal(rest: str) -> list[str]:
    for nasal, lost in NASALS.items():
        if rest.startswith(nasal) and len(rest) > len(nasal):
            tail = rest[len(nasal) :]
            if tail[0] in _VOWELS:
                return [x + tail for x in lost]
            if nasal != "ny":
                return [tail]
            return [rest[1:]]
    return [rest] if rest[0] in "lrwy" else []


def _without_prefix(word: str) -> list[str]:
    for p in PLAIN_PREFIXES:
        rest = word[len(p) :]
        if word.startswith(p) and len(rest) >= SHORTEST:
            return [rest, "r" + rest] if p in ("ber", "ter") and rest[0] in _VOWELS else [rest]
    for p in NASAL_PREFIXES:
        rest = word[len(p) :]
        if word.startswith(p) and len(rest) >= SHORTEST:
            return [x for x in dict.fromkeys(_roots_after_nasal(rest)) if len(x) >= SHORTEST]
    return []


@lru_cache(maxsize=1 << 17)
def stem_forms(word: str) -> list[str]:
    """The word, then every stem it may have."""
    if len(word) < 5 or not word.isalpha():
        return [word]
    found: dict[str, None] = {}
    for base in [word, *_without_endings(word)]:
        if len(base) >= SHORTEST:
            found.setdefault(base)
        for root in _without_prefix(base):
            found.setdefault(root)
            if root.startswith(SECOND_PREFIXES):
                found.update(dict.fromkeys(_without_prefix(root)))
    return [word, *(x for x in found if x != word and x not in _STOP)]


def with_stems(vocabulary: DataFrame, word: str = "word") -> DataFrame:
    """``vocabulary`` with ``forms``, for one row per distinct word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({word: pdf[word], "forms": [stem_forms(w) for w in pdf[word]]})

    return vocabulary.select(word).distinct().mapInPandas(run, f"{word} string, forms array<string>")


def explode_forms(tokens: DataFrame, word: str = "word") -> DataFrame:
    """Each token row once per form of its word, as ``form``."""
    stems = with_stems(tokens, word).select(word, F.explode("forms").alias("form"))
    return tokens.join(stems, word)
