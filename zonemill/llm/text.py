"""Vectorised text statistics on Arrow string buffers: word borders, word hashes, shingle sets.

A batch is taken in slices of about ``SLICE`` bytes (one document at least), so the working memory does not follow
the batch size. Words and hashes are those of the bytes, with A-Z lowered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS = {"up": powers(BASE, 2), "down": powers(INVERSE, 2)}


def _table(kind: str, n: int) -> np.ndarray:
    if len(_POWERS[kind]) < n:
        _POWERS[kind] = powers(BASE if kind == "up" else INVERSE, max(n, SLICE + (1 << 16)))
    return _POWERS[kind][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on unsigned 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null row is empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), at


def slices(offsets: np.ndarray, size: int = SLICE) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes, one row at least."""
    low, rows = 0, len(offsets) - 1
    while low < rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        yield low, min(high, rows)
        low = min(high, rows)


class Slice:
    """Words of rows ``low`` to ``high``: ``start``, ``end`` (bytes), ``row`` and ``counts`` per row."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, low: int, high: int):
        first = offsets[low]
        self.raw = data[first:offsets[high]]
        self.bytes = LOWER[self.raw]
        self.offsets = offsets[low:high + 1] - first
        self.rows = high - low
        n = len(self.bytes)
        solid = ~SPACE[self.bytes]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before = np.empty(n, bool)
        after = np.empty(n, bool)
        if n:
            before[0], after[-1] = False, False
            before[1:], after[:-1] = solid[:-1], solid[1:]
        self.start = np.flatnonzero(solid & (~before | edge[:n]))
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.row = np.searchsorted(self.offsets, self.start, "right") - 1
        self.counts = np.bincount(self.row, minlength=self.rows)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word, by differences of one running polynomial sum."""
        n = len(self.bytes)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.bytes.astype(np.uint64) + np.uint64(1)) * _table("up", n), out=total[1:])
        length = (self.end - self.start).astype(np.uint64)
        return mix((total[self.end] - total[self.start]) * _table("down", n)[self.start] + length * np.uint64(0xD6E8FEB86659FD93))

    def shingles(self, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Distinct ``width``-word shingle hashes, ascending within a row, and row borders.

        A row with fewer words has one shingle, its whole sequence; a row without words has none.
        """
        words = self.hashes()
        first = np.concatenate([[0], np.cumsum(self.counts)])
        number = np.where(self.counts >= width, self.counts - width + 1, np.minimum(self.counts, 1))
        out_first = np.concatenate([[0], np.cumsum(number)])
        row = np.repeat(np.arange(self.rows), number)
        at = first[row] + np.arange(out_first[-1]) - out_first[row]
        have = np.minimum(self.counts, width)[row]
        value = have.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        for k in range(width):
            factor = np.uint64((0xE7037ED1A0B428DB * (2 * k + 1) ** 3 | 1) % (1 << 64))
            if len(words):
                value = value + np.where(have > k, words[np.minimum(at + k, len(words) - 1)], np.uint64(0)) * factor
        value = mix(value)
        order = np.lexsort((value, row))
        value, row = value[order], row[order]
        keep = np.ones(len(value), bool)
        if len(value):
            keep[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
        value, row = value[keep], row[keep]
        return value, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=self.rows))])


def gathered(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ``data`` one after the other, and where each begins (one border more than pieces)."""
    place = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=place[1:])
    return data[np.repeat(start - place[:-1], length) + np.arange(place[-1])], place
