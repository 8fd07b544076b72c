"""Word tables over Arrow string columns, computed with whole-batch numpy operations.

A slice of rows is seen as one byte buffer with row offsets. Words are runs of the
bytes that a 256-entry table allows, never crossing a row. Every word gets a 64-bit
hash; windows of words get hashes by polynomial combination. Nothing here loops over
words or rows in Python, and slices are bounded in bytes (one longer row stands alone).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20

_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.uint64(0x9E3779B97F4A7C15)
_Q = np.uint64(0xD6E8FEB86659FD93)

#: words are runs of anything but ASCII white space: [^\x20\x09-\x0D]+
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: words are runs of a-z, 0-9 and non-ASCII: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()) if not pa.types.is_large_string(column.type) else column
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes, or one row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


@dataclass
class Words:
    data: np.ndarray  # bytes, lower-cased if asked for
    rows: np.ndarray  # byte offsets of rows, n + 1
    starts: np.ndarray  # byte offset of each word
    ends: np.ndarray
    at: np.ndarray  # word offsets of rows, n + 1
    hashes: np.ndarray  # of each word

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.at)

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.at) - 1), self.counts)

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the k words from each word on, and whether the window lies within its row."""
        n = len(self.hashes)
        whole = np.zeros(n, bool)
        if n >= k:
            last = np.repeat(self.at[1:], self.counts)
            whole = np.arange(n) + k <= last
        out = np.zeros(n, np.uint64)
        if n >= k:
            h = self.hashes[: n - k + 1].copy()
            for j in range(1, k):
                h *= _Q
                h += self.hashes[j : n - k + 1 + j]
            out[: n - k + 1] = mix(h)
        return out, whole

    def per_row(self, flags: np.ndarray) -> np.ndarray:
        """Sum over each row's words."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.at[1:]] - total[self.at[:-1]]

    def covered(self, first: np.ndarray, k: int) -> np.ndarray:
        """Words inside the k-word windows that start at ``first``."""
        edge = np.zeros(len(self.hashes) + 1, np.int32)
        np.add.at(edge, first, 1)
        np.add.at(edge, np.minimum(first + k, len(self.hashes)), -1)
        return np.cumsum(edge[:-1]) > 0


def words(data: np.ndarray, rows: np.ndarray, kind: np.ndarray = SPACED, lower: bool = False, hashed: bool = True) -> Words:
    if lower:
        data = _LOWER[data]
    n = len(data)
    inside = kind[data]
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    edges = rows[:-1][rows[:-1] < n]
    before[edges] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    hashes = np.zeros(len(starts), np.uint64)
    if hashed and len(starts):
        a = starts[0]
        spans = np.diff(np.append(starts, n))
        place = np.arange(a, n) - np.repeat(starts, spans)
        power = np.ones(int(spans.max()), np.uint64)
        power[1:] = _P
        power = np.cumprod(power, dtype=np.uint64)
        value = np.where(kind, _BYTE, np.uint64(0))[data[a:]]
        value *= power[place]
        hashes = mix(np.add.reduceat(value, starts - a))
    return Words(data, rows, starts, ends, np.searchsorted(starts, rows), hashes)


def word_slices(column: pa.Array, kind: np.ndarray = SPACED, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(first row, last row, words) for bounded slices of a column."""
    data, offsets = utf8(column)
    for a, b in slices(offsets):
        yield a, b, words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], kind, lower)


def shingles(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row, row by row: (hashes, row offsets).

    A row of fewer words has its whole sequence as one shingle; a row without words has none."""
    h, _ = w.windows(k)
    sets = []
    for a, c in zip(w.at[:-1].tolist(), w.counts.tolist(), strict=True):
        v = np.sort(h[a : a + max(c - k + 1, 0)])
        if len(v) > 1:
            v = v[np.concatenate([[True], v[1:] != v[:-1]])]
        sets.append(v)
    short = np.flatnonzero((w.counts > 0) & (w.counts < k))
    for size in np.unique(w.counts[short]):
        part = short[w.counts[short] == size]
        whole, _ = w.windows(int(size))
        for i, v in zip(part.tolist(), mix(whole[w.at[part]] + np.uint64(size)), strict=True):
            sets[i] = np.array([v], np.uint64)
    at = np.concatenate([[0], np.cumsum([len(v) for v in sets], dtype=np.int64)])
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), at
