"""Vectorised word and n-gram hashing over batches of texts.

Words are runs of anything but ``[\\x20\\x09-\\x0D]``, in UTF-8 bytes.  A whole
batch is hashed in a few array passes, whatever the lengths of its texts.
"""

from __future__ import annotations

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_IS_SPACE = np.zeros(256, dtype=bool)
_IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
#: A batch is cut into pieces of about this many bytes, to bound the arrays: some fifty bytes for each.
PIECE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = x ^ (x >> np.uint64(30))
    x = x * _A
    x ^= x >> np.uint64(27)
    x *= _B
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_POWERS = np.ones(1, dtype=np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 1024)
        _POWERS = np.concatenate([np.ones(1, dtype=np.uint64), np.cumprod(np.full(size - 1, _ODD, dtype=np.uint64))])
    return _POWERS


def pieces(texts: list[str | None], most: int = PIECE_BYTES):
    """(start, UTF-8 texts) of consecutive parts of a batch; a null text counts as empty."""
    part, size, start = [], 0, 0
    for i, text in enumerate(texts):
        part.append(data := (text or "").encode("utf-8", "surrogatepass"))
        size += len(data)
        if size >= most:
            yield start, part
            part, size, start = [], 0, i + 1
    if part:
        yield start, part


def word_hashes(part: list[bytes], lower: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of all words in order, words of each text, byte length of each word)."""
    joined = np.frombuffer(b"\n".join([*part, b""]), dtype=np.uint8)
    if lower:
        joined = _LOWER[joined]
    space = _IS_SPACE[joined]
    inside = np.flatnonzero(~space)
    ends = np.cumsum([len(x) + 1 for x in part])
    if not len(inside):
        return np.zeros(0, np.uint64), np.zeros(len(part), np.int64), np.zeros(0, np.int64)
    first = np.flatnonzero(np.diff(inside, prepend=-2) > 1)
    length = np.diff(first, append=len(inside))
    starts = inside[first]
    offset = np.arange(len(inside)) - np.repeat(first, length)
    values = _BYTE[joined[inside]] * _powers(int(length.max()) + 1)[offset]
    hashes = mix(np.add.reduceat(values, first) + length.astype(np.uint64))
    upto = np.searchsorted(starts, ends)
    return hashes, np.diff(upto, prepend=0), length


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of ``n`` consecutive hashes, across the borders of texts."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = mix(out * _ODD + hashes[i : len(hashes) - n + 1 + i])
    return out
