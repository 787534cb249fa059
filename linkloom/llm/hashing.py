"""Hashes of words and shingles of whole batches of texts at once, without a loop over words.

A running polynomial over the bytes gives every word's hash as a difference of two sums. ASCII letters
are lower-cased. All numbers are unsigned and wrap at 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_P = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 to the 64
_INVERSE = pow(_P, -1, 1 << 64)
_STEP = 1 << 19  # bytes hashed at once; a worker holds numbers of some tens of times this size meanwhile

#: Bytes that stand in words: letters, digits and all beyond ASCII; or all but ASCII white space.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
VISIBLE = np.ones(256, bool)
VISIBLE[[*range(9, 14), 32]] = False


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    size = 1
    while size < n:
        more = min(size, n - size)
        with np.errstate(over="ignore"):
            out[size : size + more] = out[:more] * np.uint64(pow(base, size, 1 << 64))
        size += more
    return out


_TABLES: dict[int, np.ndarray] = {}


def _table(base: int, n: int) -> np.ndarray:
    if base not in _TABLES or len(_TABLES[base]) < n:
        _TABLES[base] = _powers(base, max(n, 1 << 16))
    return _TABLES[base]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


def word_hashes(data: np.ndarray, in_word: np.ndarray = LETTERS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and ends of the words in bytes ``data``."""
    word = np.concatenate(([False], in_word[data], [False]))
    edges = np.flatnonzero(word[1:] != word[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64), ends
    with np.errstate(over="ignore"):
        running = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_LOWER[data].astype(np.uint64) + np.uint64(1)) * _table(_P, len(data))[: len(data)])))
        own = (running[ends] - running[starts]) * _table(_INVERSE, len(data) + 1)[starts]
        return mix(own), ends


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` words; none if there are fewer."""
    if len(words) < width:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        out = words[: len(words) - width + 1].copy()
        for k in range(1, width):
            out = mix(out * np.uint64(_P) + words[k : len(words) - width + 1 + k])
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts of a column and where each begins and ends; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    texts = column.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    return np.frombuffer(data, np.uint8) if data else np.empty(0, np.uint8), np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]


def _portions(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of texts of _STEP bytes or one text."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _STEP, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def _fenced(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The texts with a blank after each, so that no word runs from one into the next."""
    n = len(offsets) - 1
    out = np.full(len(data) + n, 32, np.uint8)
    shift = np.repeat(np.arange(n), np.diff(offsets))
    out[np.arange(len(data)) + shift] = data
    return out


def words_of(column: pa.Array, in_word: np.ndarray = LETTERS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, word hashes, bounds) for runs of texts: text k of a run has the words from bounds[k] to bounds[k + 1]."""
    data, offsets = text_bytes(column)
    for lo, hi in _portions(offsets):
        own = offsets[lo : hi + 1] - offsets[lo]
        words, ends = word_hashes(_fenced(data[offsets[lo] : offsets[hi]], own), in_word)
        bounds = np.searchsorted(ends, own + np.arange(hi - lo + 1), side="right")
        bounds[0] = 0
        yield lo, hi, words, bounds
