"""Byte-level BPE as a tree reduction.

A text is encoded by halves, recursively, down to short leaves.  Two
neighbours are joined by encoding a window around their border again, which
grows until the tokens outside of it are proven to stand.  There are two proofs.

* A space or line feed after a character that is no white space begins a match
  of the split pattern, whatever stands further away, and so does an apostrophe
  after a letter or digit of ASCII: no match holds the one after the other.
  Tokens never cross matches, so a window between two such places is encoded on
  its own.
* Where such places are far, as in base64, Chinese or Thai, the window grows by
  tokens.  A sequence of tokens is the encoding of its bytes if and only if each
  two neighbours are the encoding of theirs: the first merge across any border
  would happen in those two alone as well.  So once the window's outermost tokens
  come back unchanged, each of them still has the neighbour that it had before,
  and all tokens outside stand.  The stretch in which the window grows has no
  white space and no apostrophe: there, matches are runs of one class of
  characters, wherever the text is cut.

Both rest on the form of the split pattern, so other patterns are refused.
Decoding joins the tokens' bytes up the same kind of tree.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import BinaryType, StructField, StructType

from tarn.llm._common import carried, small_batches

LEAF_CHARS = 512
LEAF_IDS = 1024
#: Tokens on either side that a growing window begins with.
FIRST_TOKENS = 8
#: Fixed value: the split pattern for which the proofs hold.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BORDER, _BREAK = re.compile(r"(?<=\S)[ \n]|(?<=[A-Za-z0-9])'"), re.compile(r"[\s']")


def load_ranks(path: str) -> bytes:
    """A rank file, read on the driver."""
    with open(path, "rb") as f:
        return f.read()


class TreeCodec:
    """Encodes and decodes by the ranks of a file and the pattern that splits texts before merges."""

    def __init__(self, ranks: bytes, pattern: str, leaf: int = LEAF_CHARS):
        import tiktoken

        if pattern != PATTERN:
            raise ValueError(f"windows are proven for the split pattern {PATTERN} only")
        table = {base64.b64decode(a): int(b) for a, b in (line.split() for line in ranks.splitlines() if line)}
        self._leaf_encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self._bytes = [b""] * (max(table.values()) + 1)
        for token, rank in table.items():
            self._bytes[rank] = token
        self._size = [len(b) for b in self._bytes]
        self._leaf = leaf

    def encode(self, text: str) -> list[int]:
        return self._encode(text, 0, len(text))

    def _encode(self, text: str, low: int, high: int) -> list[int]:
        if high - low <= self._leaf:
            return self._leaf_encode(text[low:high])
        mid = (low + high) // 2
        return self._join(self._encode(text, low, mid), self._encode(text, mid, high), text, low, mid, high)

    def _join(self, left: list[int], right: list[int], text: str, low: int, mid: int, high: int) -> list[int]:
        start, end = _border_before(text, low, mid), _border_from(text, mid, high)
        if end - start > self._leaf:
            grown = self._grow(left, right, text, start, mid, end)
            if grown is not None:
                return grown
        drop = self._tokens(reversed(left), len(text[start:mid].encode()))
        skip = self._tokens(right, len(text[mid:end].encode()))
        del left[len(left) - drop :]
        left += self._leaf_encode(text[start:end])
        left += right[skip:]
        return left

    def _grow(self, left: list[int], right: list[int], text: str, start: int, mid: int, end: int) -> list[int] | None:
        """The two halves joined inside a stretch without white space and apostrophes; None if that is too short."""
        if _BREAK.search(text, max(start, mid - 3), mid + 1):
            return None
        found = _BREAK.search(text, mid, end)
        stop = found.start() if found else end
        # up to two letters after an apostrophe may belong to it
        since = max((m.end() + 2 for m in _BREAK.finditer(text, start, mid)), default=start)
        i, j = FIRST_TOKENS, FIRST_TOKENS
        while True:
            # outer borders must be borders of characters, too
            while i < len(left) and self._bytes[left[-i]][0] & 0xC0 == 0x80:
                i += 1
            while j < len(right) and self._bytes[right[j]][0] & 0xC0 == 0x80:
                j += 1
            i, j = min(i, len(left)), min(j, len(right))
            a = mid - len(self.decode(left[len(left) - i :]).decode())
            b = mid + len(self.decode(right[:j]).decode())
            if a < since or b > stop:
                return None
            window = self._leaf_encode(text[a:b])
            same_left = i == len(left) or window[0] == left[-i]
            same_right = j == len(right) or window[-1] == right[j - 1]
            if same_left and same_right:
                return left[: len(left) - i] + window + right[j:]
            i, j = i if same_left else 2 * i, j if same_right else 2 * j

    def _tokens(self, ids, n_bytes: int) -> int:
        """How many tokens make up exactly ``n_bytes``."""
        count = 0
        if n_bytes:
            for i in ids:
                n_bytes -= self._size[i]
                count += 1
                if n_bytes <= 0:
                    break
        if n_bytes:
            raise AssertionError("a token crosses a border")
        return count

    def decode(self, ids: list[int]) -> bytes:
        if len(ids) <= LEAF_IDS:
            return b"".join([self._bytes[i] for i in ids])
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


def _border_before(text: str, low: int, mid: int) -> int:
    """The last border in (low, mid), else low."""
    at = mid
    while (at := max(text.rfind(sign, low + 1, at) for sign in " \n'")) > low:
        if _BORDER.match(text, at):
            return at
    return low


def _border_from(text: str, mid: int, high: int) -> int:
    """The first border in [mid, high), else high."""
    found = _BORDER.search(text, mid, high)
    return found.start() if found else high


@lru_cache(maxsize=4)
def _codec(ranks: bytes, pattern: str) -> TreeCodec:
    return TreeCodec(ranks, pattern)


def _shared(spark: SparkSession, ranks_path: str):
    """The rank file (about a megabyte, whatever the input) for all executors."""
    return spark.sparkContext.broadcast(load_ranks(ranks_path))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``df`` with ``ids``: the token ids of the whole text, as little-endian unsigned 32-bit numbers.

    Special tokens are ordinary text.  A null text counts as empty and has no
    ids.  A column already named like the output is replaced.
    """
    small_batches(df.sparkSession)
    ranks = _shared(df.sparkSession, ranks_path)

    @pandas_udf(BinaryType())
    def to_ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(ranks.value, pattern)
        for texts in batches:
            yield pd.Series([np.array(codec.encode(t), dtype="<u4").tobytes() if t else b"" for t in texts], dtype=object)

    return df.select(*carried(df, [ids]), to_ids(F.col(text)).alias(ids))


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``df`` with ``data``: the bytes that ``ids`` stand for. Null ids give no bytes."""
    small_batches(df.sparkSession)
    ranks = _shared(df.sparkSession, ranks_path)

    @pandas_udf(BinaryType())
    def to_bytes(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        codec = _codec(ranks.value, pattern)
        for column in batches:
            yield pd.Series([codec.decode(np.frombuffer(x, dtype="<u4").tolist()) if x else b"" for x in column], dtype=object)

    return df.select(*carried(df, [data]), to_bytes(F.col(ids)).alias(data))


def round_trip(df: DataFrame, ranks_path: str, pattern: str, text: str = "text", ids: str = "ids", data: str = "decoded") -> DataFrame:
    """``df`` with ``ids`` and ``data``: :func:`encode` and :func:`decode` in one visit to a Python worker, which halves the workers that a task needs.

    A null or empty text has empty ids and data.  Repeated rows get the same ids,
    texts of any length are encoded whole, an empty table gives no rows; columns
    already named like the outputs are replaced.
    """
    small_batches(df.sparkSession)
    ranks = _shared(df.sparkSession, ranks_path)

    @pandas_udf(StructType([StructField("ids", BinaryType()), StructField("data", BinaryType())]))
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        codec = _codec(ranks.value, pattern)
        for texts in batches:
            coded = [np.array(codec.encode(t), dtype="<u4").tobytes() if t else b"" for t in texts]
            yield pd.DataFrame({"ids": coded, "data": [codec.decode(np.frombuffer(x, dtype="<u4").tolist()) if x else b"" for x in coded]}, dtype=object)

    found = df.select(*carried(df, [ids, data]), both(F.col(text)).alias("__tarn_both"))
    return found.select(*carried(df, [ids, data]), F.col("__tarn_both.ids").alias(ids), F.col("__tarn_both.data").alias(data))
