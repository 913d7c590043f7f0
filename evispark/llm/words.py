"""Words of Arrow text columns and polynomial hashes over them, vectorised in numpy.

A word is a maximal run of bytes other than space and tab to carriage return. Every function works
on the raw UTF-8 bytes of many documents at once; nothing here loops over words in Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True
_BYTE_BASE = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD1342543DE82EF95)
#: Bytes of text that are hashed at a time; bounds the working memory, not the text.
CHUNK_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64))
_BYTE_VALUE[IS_SPACE] = 0


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null is an empty text."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("").cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes each; a longer row is a range of its own."""
    first = 0
    while first < len(offsets) - 1:
        last = int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1
        last = max(last, first + 1)
        yield first, last
        first = last


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _chunk_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    lengths = np.diff(np.append(starts, len(data)))
    inside = np.arange(starts[0], len(data)) - np.repeat(starts, lengths)
    values = _BYTE_VALUE[data[starts[0] :]] * _powers(_BYTE_BASE, int(lengths.max()))[inside]
    return np.add.reduceat(values, starts - starts[0])


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per word, in order, and the index of each row's first word (one more at the end).

    The hash is a polynomial over the bytes modulo 2**64, scrambled afterwards.
    """
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    space = IS_SPACE[data]
    begins = ~space
    begins[1:] &= space[:-1]
    firsts = offsets[:-1][offsets[:-1] < len(data)]
    begins[firsts] = ~space[firsts]
    starts = np.flatnonzero(begins)
    counts = np.searchsorted(starts, offsets)
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        end = int(np.searchsorted(starts, starts[at] + CHUNK_BYTES))
        end = max(end, at + 1)
        stop = starts[end] if end < len(starts) else len(data)
        hashes[at:end] = _chunk_hashes(data[starts[at] : stop], starts[at:end] - starts[at])
        at = end
    return mix(hashes), counts


def window_hashes(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Rabin-Karp hashes of every ``size`` consecutive words of a row.

    Returns the hashes and the index of the word each window starts with. Rows with fewer words have none.
    """
    n = len(hashes) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = hashes[:n].copy()
    for j in range(1, size):
        value *= _WORD_BASE
        value += hashes[j : j + n]
    ends = np.repeat(counts[1:], np.diff(counts))
    at = np.flatnonzero(np.arange(n) + size <= ends[:n])
    return mix(value[at]), at


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of ``size`` words as hashes, and the row of each.

    A row with some words but fewer than ``size`` has one shingle of all its words.
    """
    value, at = window_hashes(hashes, counts, size)
    row = np.searchsorted(counts, at, "right") - 1
    n = np.diff(counts)
    short = np.flatnonzero((n > 0) & (n < size))
    if len(short):
        extra = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = n[short] > j
            extra[has] = extra[has] * _WORD_BASE + hashes[counts[short[has]] + j]
        extra = mix(extra ^ n[short].astype(np.uint64))
        value, row = np.concatenate([value, extra]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        value, row = value[order], row[order]
    return value, row
