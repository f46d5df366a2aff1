"""Vectorised kernels over a batch of texts held as one byte buffer.

Texts arrive as Arrow batches and stay one contiguous UTF-8 buffer with row
offsets.  Word finding, hashing, n-grams and window minima are numpy passes over
that buffer, in blocks of about a megabyte, so memory is bounded by the block or
by the longest single text.

Hashes are 64-bit polynomial sums (odd base, modulo 2**64) passed through a
finaliser.  A null text is an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
BLOCK_BYTES = 1 << 20
MOST_TEXTS = (1 << 16) - 1
_BASE = 0x9E3779B97F4A7C15
_BASE_INV = pow(_BASE, -1, 1 << 64)


def _byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    t = np.zeros(256, dtype=bool)
    for lo, hi in ranges:
        t[lo : hi + 1] = True
    return t


#: Bytes of words written ``[^\x20\x09-\x0D]+``.
SPACED = ~_byte_table((0x20, 0x20), (0x09, 0x0D))
#: Bytes of words written ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` (after A-Z became a-z).
ALNUM = ~_byte_table((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


class _Powers:
    """Powers of the base and of its inverse, kept up to a few million entries."""

    kept = (np.ones(1, U64), np.ones(1, U64))

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.kept[0]) >= n:
            return cls.kept
        size = max(n, BLOCK_BYTES + 1)
        made = []
        for base in (_BASE, _BASE_INV):
            p = np.full(size, base, U64)
            p[0] = 1
            made.append(np.cumprod(p, dtype=U64))
        made = tuple(made)
        if size <= 4 * BLOCK_BYTES:
            cls.kept = made
        return made


class Rolling:
    """Hashes of any ranges [start, end) of a symbol sequence after one pass."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.power, self.inverse = _Powers.upto(n + 1)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum((values.astype(U64) + U64(1)) * self.power[:n], dtype=U64, out=self.sums[1:])

    def raw(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]

    def ranges(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.raw(start, end) ^ ((end - start).astype(U64) * U64(0xD6E8FEB86659FD93)))

    def grams(self, k: int) -> np.ndarray:
        """Hash of every run of k symbols, by its first position."""
        n = len(self.sums) - 1
        if n < k:
            return np.zeros(0, U64)
        return mix((self.sums[k:] - self.sums[: n - k + 1]) * self.inverse[: n - k + 1])


class Block:
    """Some consecutive texts: their bytes, and where each begins and ends."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first
        self.n = len(offsets) - 1

    def words(self, table: np.ndarray, data: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the words, and the index of each text's first word."""
        data = self.data if data is None else data
        inside = table[data]
        n = len(inside)
        flags = np.empty(n + 1, bool)
        flags[0] = False
        flags[1:] = inside
        before = flags[:-1].copy()
        after = np.append(inside[1:], False) if n else inside
        cuts = self.offsets[1:-1]
        before[cuts[cuts < n]] = False
        after[cuts[cuts > 0] - 1] = False
        starts = np.flatnonzero(inside & ~before)
        ends = np.flatnonzero(inside & ~after) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)


def texts(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(column: pa.Array | pa.ChunkedArray, size: int = BLOCK_BYTES) -> Iterator[Block]:
    """The column in runs of whole texts of about ``size`` bytes."""
    data, offsets = texts(column)
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1)
        j = min(j, i + MOST_TEXTS)
        yield Block(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], i)
        i = j


def owner(first: np.ndarray) -> np.ndarray:
    """For word counts by text given as first indexes: the text of each word."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    if have < width:
        out = np.minimum(out[: len(values) - width + 1], out[width - have :])
    return out


_POS_BITS = 24
_SEGMENT = (1 << _POS_BITS) - (1 << 12)


def chosen(grams: np.ndarray, width: int) -> np.ndarray:
    """For every run of ``width`` grams, the position of the smallest, the last one among equals.

    The choice depends on the grams of the run alone, so equal passages choose
    equal positions wherever they stand.
    """
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    out = np.empty(n, np.int64)
    low = U64((1 << _POS_BITS) - 1)
    for a in range(0, n, _SEGMENT):
        b = min(n, a + _SEGMENT)
        part = grams[a : b + width - 1]
        packed = (part & ~low) | (low - np.arange(len(part), dtype=U64))
        out[a:b] = (low - (sliding_min(packed, width) & low)).astype(np.int64) + a
    return out


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of equal values."""
    if not len(values):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    cut = np.flatnonzero(values[1:] != values[:-1]) + 1
    return np.concatenate(([0], cut)), np.concatenate((cut, [len(values)]))


def union(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions any of the ranges covers."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, ends, -1)
    return np.cumsum(delta[:-1]) > 0


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()
