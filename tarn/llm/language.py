"""Language identification of mixed-language text.

A text's letters are grouped into words; the script of a word leaves only the
languages that use that script.  Each word gets a score for each language from
hashed character n-grams.  A Viterbi pass with a penalty for switching labels
every word, and runs of one label are spans.

The model is fitted on labelled rows: about ``train_docs`` a language, picked
by a hash of their identifier.  Its size is fixed: languages times buckets.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm._common import carried, small_batches

BUCKETS = 1 << 16
TRAIN_DOCS = 2000
#: Languages that a model tells apart: the most frequent ones of more.
MOST_LANGS = 500
SWITCH_PENALTY = 12.0
WORD_LIMIT = 6.0
UNDETERMINED = "und"
#: First and last code point of the ranges that tell scripts apart; script 0 is any other.
SCRIPT_RANGES = [
    (1, 0x0041, 0x024F),  # Latin
    (2, 0x0370, 0x03FF),  # Greek
    (3, 0x0400, 0x052F),  # Cyrillic
    (4, 0x0530, 0x058F),  # Armenian
    (5, 0x0590, 0x05FF),  # Hebrew
    (6, 0x0600, 0x077F),  # Arabic
    (7, 0x0900, 0x097F),  # Devanagari
    (8, 0x0980, 0x09FF),  # Bengali
    (9, 0x0E00, 0x0E7F),  # Thai
    (10, 0x10A0, 0x10FF),  # Georgian
    (11, 0x1100, 0x11FF),  # Hangul
    (1, 0x1E00, 0x1EFF),  # Latin
    (2, 0x1F00, 0x1FFF),  # Greek
    (12, 0x3040, 0x30FF),  # Kana
    (13, 0x3400, 0x9FFF),  # Han
    (11, 0xAC00, 0xD7AF),  # Hangul
]
SCRIPTS = 14


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point below 0x20000: whether it is a letter, and its script."""
    letter = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(0x20000)])
    script = np.zeros(0x20000, dtype=np.int8)
    for number, first, last in SCRIPT_RANGES:
        script[first : last + 1] = number
    return letter, script


@dataclass
class Words:
    """The words of one batch of texts; ``code`` and ``gram`` run over all letters, ``first`` starts each word."""

    first: np.ndarray
    length: np.ndarray
    start: np.ndarray
    script: np.ndarray
    per_text: np.ndarray
    grams: np.ndarray  # (2, letters): buckets of the two n-grams that end at a letter


def _find_words(texts: list[str]) -> Words:
    letter, script = _tables()
    lower = [t.lower() if len(t.lower()) == len(t) else "".join(c.lower() if len(c.lower()) == 1 else c for c in t) for t in texts]
    code = np.frombuffer("\n".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letter[np.minimum(code, 0x1FFFF)] | ((code > 0x1FFFF) & (code < 0x40000))  # ideographs beyond
    at = np.flatnonzero(is_letter)
    masked = np.where(is_letter, code, np.uint32(0))
    before = np.concatenate([[np.uint32(0)], masked[:-1]])[at]
    after = np.concatenate([masked[1:], [np.uint32(0)]])[at]
    now = masked[at]
    pair = before * np.uint32(0x9E3779B1) + now * np.uint32(0x85EBCA77)
    tri = pair + after * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F)
    fold = lambda x: ((x ^ (x >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(16)
    first = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    ends = np.cumsum([len(t) + 1 for t in lower])
    start = at[first] if len(at) else np.zeros(0, np.int64)
    return Words(
        first,
        np.diff(first, append=len(at)),
        start,
        script[np.minimum(now[first], 0x1FFFF)] if len(at) else np.zeros(0, np.int8),
        np.diff(np.searchsorted(start, ends), prepend=0),
        np.stack([fold(pair), fold(tri)]),
    )


@dataclass
class Model:
    """``table``: log-probability of each bucket in each language, less the mean over languages; ``scripts``: languages by script."""

    langs: list[str]
    table: np.ndarray
    scripts: np.ndarray
    penalty: float = SWITCH_PENALTY

    def word_scores(self, words: Words) -> np.ndarray:
        """(words, languages): at most 0, least ``-WORD_LIMIT``; a language that does not use the word's script gets the least."""
        if not len(words.first):
            return np.zeros((0, len(self.langs)), np.float32)
        letters = self.table[words.grams[0]] + self.table[words.grams[1] + BUCKETS]
        scores = np.add.reduceat(letters, words.first, axis=0)
        allowed = self.scripts[words.script]
        known = allowed.any(axis=1)
        scores = np.where(allowed, scores, -np.inf)
        scores[~known] = 0.0
        return np.maximum(scores - scores.max(axis=1, keepdims=True), -WORD_LIMIT)

    def path(self, scores: np.ndarray) -> np.ndarray:
        """The best language of each word, switches penalised.

        One language throughout is best if no stretch of words gains more by
        leaving it than one switch costs; most texts end there.
        """
        total = scores.sum(axis=0)
        best = int(total.argmax())
        if len(self.langs) == 1:
            return np.zeros(len(scores), np.int64)
        others = np.delete(scores, best, axis=1).max(axis=1) - scores[:, best]
        run = np.concatenate([[0.0], np.cumsum(others)])
        if (run - np.minimum.accumulate(run)).max() <= self.penalty:
            return np.full(len(scores), best)
        return viterbi(scores, self.penalty)


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """The path through ``scores`` of greatest sum, each switch costing ``penalty``; ties stay, else go to the first."""
    value, back, many = list(map(float, scores[0])), [], range(scores.shape[1])
    for row in scores[1:].tolist():
        top = max(value)
        leave, first = top - penalty, value.index(top)
        back.append([k if value[k] >= leave else first for k in many])
        value = [max(value[k], leave) + row[k] for k in many]
    at = value.index(max(value))
    out = [at]
    for step in reversed(back):
        at = step[at]
        out.append(at)
    return np.array(out[::-1])


def _count(langs: list[str]):
    place = {x: i for i, x in enumerate(langs)}

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams = np.zeros((len(langs), 2 * BUCKETS), np.int64)
        scripts = np.zeros((len(langs), SCRIPTS), np.int64)
        for pdf in batches:
            for lang, part in pdf.groupby("lang"):
                words = _find_words(part["text"].fillna("").tolist())
                for k in range(2):
                    grams[place[lang]] += np.bincount(words.grams[k].astype(np.int64) + k * BUCKETS, minlength=2 * BUCKETS)
                scripts[place[lang]] += np.bincount(words.script, weights=words.length, minlength=SCRIPTS).astype(np.int64)
        both = np.concatenate([grams, scripts], axis=1)
        lang, bucket = np.nonzero(both)
        yield pd.DataFrame({"lang": lang, "bucket": bucket, "n": both[lang, bucket]})

    return count


def held_out(id_: Column) -> Column:
    """Rows never learnt from."""
    return F.pmod(F.crc32(id_.cast("string").cast("binary")), F.lit(3)) == 1


def train(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS, most_langs: int = MOST_LANGS) -> Model | None:
    """A model from rows with a language that are not held out; None if there are none.

    Rows without identifier are not learnt from: nobody can tell whether they
    are held out.  Of more than ``most_langs`` languages the most frequent ones
    are learnt (of equally frequent ones the first by name), as a model's size
    grows with their number.  Repeated rows count as often as they stand.
    """
    small_batches(df.sparkSession)
    rows = df.where(F.col(lang).isNotNull() & F.coalesce(~held_out(F.col(id_col)), F.lit(False)))
    counts = {r[0]: r[1] for r in rows.groupBy(lang).count().orderBy(F.desc("count"), lang).limit(most_langs).collect()}  # ``most_langs`` rows
    if not counts:
        return None
    langs = sorted(counts)
    place = F.shiftrightunsigned(F.xxhash64(F.lit(7), F.col(id_col)), 11) / F.lit(float(1 << 53))
    picked = F.lit(False)
    for x in langs:
        picked |= (F.col(lang) == x) & (place < F.lit(min(1.0, train_docs / counts[x])))
    sample = rows.where(picked).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    found = sample.mapInPandas(_count(langs), "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    both = np.zeros((len(langs), 2 * BUCKETS + SCRIPTS))
    both[found["lang"], found["bucket"]] = found["n"]
    grams, scripts = both[:, : 2 * BUCKETS], both[:, 2 * BUCKETS :]
    logs = []
    for k in range(2):
        part = grams[:, k * BUCKETS : (k + 1) * BUCKETS]
        p = (part + 0.5) / (part.sum(axis=1, keepdims=True) + 0.5 * BUCKETS)
        logs.append(np.log(p))
    table = np.concatenate(logs, axis=1)
    table = (table - table.mean(axis=0)).T.astype(np.float32)
    used = scripts > 0.01 * np.maximum(1, scripts.sum(axis=1, keepdims=True))
    return Model(langs, np.ascontiguousarray(table), np.ascontiguousarray(used.T))


def _predict(model: Model | None):
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            out = []
            texts = column.fillna("").tolist()
            step = max(1, len(texts) // max(1, sum(map(len, texts)) >> 19)) if texts else 1
            for i in range(0, len(texts), step):
                out += _label(model, texts[i : i + step])
            yield pd.DataFrame(out, columns=["lang_pred", "score", "spans"])

    return predict


def _label(model: Model | None, texts: list[str]) -> list[tuple]:
    words = _find_words(texts)
    scores = model.word_scores(words) if model else None
    out, at, offset = [], 0, 0
    for text, n in zip(texts, words.per_text.tolist(), strict=True):
        if not n or model is None:
            out.append((UNDETERMINED, 0.0, []))
        else:
            own = scores[at : at + n]
            path = model.path(own)
            length = words.length[at : at + n]
            told = model.scripts[words.script[at : at + n]].any(axis=1)
            mass = np.bincount(path, weights=length * told, minlength=len(model.langs))
            best = int(mass.argmax())
            total = np.sort(own.sum(axis=0))
            sure = 1.0 / (1.0 + np.exp(-min(50.0, float(total[-1] - total[-2])))) if len(total) > 1 else 1.0
            cut = np.flatnonzero(np.diff(path, prepend=-1))
            start = words.start[at : at + n] - offset
            end = start + length
            last = np.append(cut[1:], n) - 1
            spans = [{"start": int(start[a]), "end": int(end[b]), "lang": model.langs[path[a]]} for a, b in zip(cut, last, strict=True)]
            out.append((model.langs[best], float(mass[best] / length.sum() * sure), spans))
        at += n
        offset += len(text) + 1
    return out


def identify(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``df`` with ``lang_pred``, ``score`` (0 to 1) and ``spans`` (start, end, lang; in code points, end exclusive).

    ``lang_pred`` labels most letters; ``score`` is its share of them times the
    probability of the best language against the next.  A null text, or one
    without letters, is ``und`` with score 0, as is every text where nothing
    could be learnt.  Letters in a script that no language uses lower the score.
    Input columns named like an output are replaced.
    """
    from pyspark.sql.functions import pandas_udf
    from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructField, StructType

    small_batches(df.sparkSession)
    span = StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("lang", StringType())])
    kind = StructType([StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("spans", ArrayType(span))])
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return _predict(shared.value)(batches)

    label = pandas_udf(run, kind)
    keep = carried(df, ["lang_pred", "score", "spans"])
    found = df.select(*keep, label(F.col(text)).alias("__tarn_found"))
    return found.select(*keep, "__tarn_found.lang_pred", "__tarn_found.score", "__tarn_found.spans")


def keep_known(df: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", least: float = 0.2) -> DataFrame:
    """``df`` without rows whose language is undetermined or has a score under ``least``; columns unchanged.

    Texts in two or three languages stay: the least score is below the share that
    the main one has in them.  Null texts and texts without letters go, and all
    do where no language could be learnt.  Repeated rows stay or go together;
    columns keep their names, whatever those are; an empty table gives no rows.
    """
    model = train(df, id_col, text, lang)
    tagged = identify(df.select(*[F.col(c).alias(f"in_{i}") for i, c in enumerate(df.columns)], F.col(text).alias("__tarn_text")), model, "__tarn_text")
    kept = tagged.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return kept.select(*[F.col(f"in_{i}").alias(c) for i, c in enumerate(df.columns)])
