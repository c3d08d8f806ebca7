"""Vectorised word hashing over Arrow string buffers.

A word is a maximal run of ASCII letters, digits, underscores and non-ASCII characters of the lower-cased text. In
SQL: regexp_extract_all(lower(text), '[0-9a-z_\\x{80}-\\x{10FFFF}]+').
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; bounds a worker's memory whatever the batch holds.
SLICE_BYTES = 1 << 21
_BASE = 0x9E3779B97F4A7C15 | 1


@lru_cache(1)
def _word_bytes() -> np.ndarray:
    t = np.zeros(256, bool)
    t[128:] = True
    for a, b in (("0", "9"), ("a", "z"), ("_", "_")):
        t[ord(a) : ord(b) + 1] = True
    return t


_powers: dict[str, np.ndarray] = {}


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2**64, for n positions."""
    if "p" not in _powers or len(_powers["p"]) < n:
        m = max(n, SLICE_BYTES + 1024)
        for k, base in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            a = np.full(m, base, np.uint64)
            a[0] = 1
            _powers[k] = np.cumprod(a, dtype=np.uint64)
    return _powers["p"], _powers["i"]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x + np.uint64((seed * 0xD1342543DE82EF95 + 0x9E3779B97F4A7C15) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def strings(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A plain string array; nulls become empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def buffers(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a large_string array and the n + 1 offsets into them."""
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def sliced(arr: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most so many bytes each, or of one longer row."""
    if not len(arr):
        return
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    a = 0
    while a < len(arr):
        b = max(a + 1, int(np.searchsorted(off, off[a] + most, "right")) - 1)
        yield a, b
        a = b


def word_hashes(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For the texts of a large_string array: the hashes of all words in order, and len(arr) + 1 offsets into them."""
    data, off = buffers(pc.utf8_lower(arr))
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    is_word = _word_bytes()[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0], before[1:] = False, is_word[:-1]
    start = np.flatnonzero(is_word & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, is_word[1:]
    end = np.flatnonzero(is_word & (~after | edge[1:]))
    p, inv = _pow(n)
    total = np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[:n], dtype=np.uint64)
    low = np.where(start > 0, total[start - 1], np.uint64(0))
    return mix((total[end] - low) * inv[start]), np.searchsorted(start, off)
