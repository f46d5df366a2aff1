"""Substring dedup by suffix sorting with a difference cover.

Blockwise construction: the suffixes of a text are sorted one bucket (those that
begin with the same two bytes) at a time, first by their first ``PERIOD`` bytes.
Ties that go deeper are decided by the rank of a *cover sample*: suffixes whose
position modulo the period lies in a difference cover are ranked beforehand, and
for any two positions some offset below the period takes both into the sample.
The memory is the text, the sample's ranks and one bucket.

``remove_repeats`` removes from documents every byte covered by a window of
``length`` bytes that also starts in a document with a smaller id.  The candidate
search of ``repeats`` collapses copies of a passage and gathers the contested
passages of a bucket; here the windows of these passages are suffixes, sorted as
above, and equal windows are neighbours.  Passages are laid out with their
anchors on multiples of the period: equal windows then stand at equal positions
modulo the period, and one cover rank each decides a tie.

Edge cases: a null or empty text has 0 bytes; texts shorter than a window lose
nothing; documents of equal id, and those with a null id (which come last), do not
remove each other's bytes; an empty table gives an empty result.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plumbline.llm import repeats
from plumbline.llm import text as tx

LENGTH, GRAM = 50, 20
#: A difference cover of its period (every residue is a difference of two members).
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)

_IN = np.zeros(PERIOD, bool)
_IN[list(COVER)] = True
#: The least offset from each residue into the cover, and from each pair of residues.
NEXT = np.array([next(d for d in range(PERIOD) if _IN[(r + d) % PERIOD]) for r in range(PERIOD)])
BOTH = np.array([[next(d for d in range(PERIOD) if _IN[(a + d) % PERIOD] and _IN[(b + d) % PERIOD]) for b in range(PERIOD)] for a in range(PERIOD)])


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every position, as a number that orders like them; zeros follow the end."""
    n = len(data)
    padded = np.zeros(-(-n // 8) * 8 + 64, np.uint8)
    padded[:n] = data
    out = np.zeros(n + 48, np.uint64)
    for r in range(8):
        part = padded[r : r + (len(padded) - r) // 8 * 8].view(">u8")
        spot = out[r::8]
        m = min(len(spot), len(part))
        spot[:m] = part[:m]
    return out


class Sorter:
    """Sorts suffixes of one text; what follows its end is below all bytes.

    With ``depth``, suffixes that agree for so many bytes need no order.
    """

    def __init__(self, data: np.ndarray, depth: int | None = None):
        self.n = len(data)
        self.depth = depth or self.n
        self.words = _eights(data)
        self.rank = np.zeros(self.n + PERIOD + 1, np.int64)  # 0: beyond the end
        at = np.flatnonzero(_IN[np.arange(self.n) % PERIOD])
        if len(at):
            self._rank_sample(at)

    def keys(self, at: np.ndarray) -> list[np.ndarray]:
        """The first PERIOD bytes of suffixes, most significant first."""
        w = self.words
        return [w[at], w[np.minimum(at + 8, len(w) - 1)], w[np.minimum(at + 16, len(w) - 1)], w[np.minimum(at + 24, len(w) - 1)] >> np.uint64(8)]

    @staticmethod
    def _new(keys: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(keys[0]), bool)
        out[:1] = True
        for k in keys:
            out[1:] |= k[1:] != k[:-1]
        return out

    def _rank_sample(self, at: np.ndarray) -> None:
        """Ranks by the first PERIOD bytes, then twice as many each round, until none are equal or the depth is reached."""
        keys = self.keys(at)
        order = np.lexsort(keys[::-1])
        name = np.cumsum(self._new([k[order] for k in keys]))
        self.rank[at[order]] = name
        step = PERIOD
        while name[-1] < len(at) and step < self.depth:
            after = np.where(at + step < self.n, self.rank[np.minimum(at + step, self.n)], 0)
            own = self.rank[at]
            order = np.lexsort((after, own))
            name = np.cumsum(self._new([own[order], after[order]]))
            self.rank[at[order]] = name
            step *= 2

    def sort(self, at: np.ndarray, aligned: bool = False) -> np.ndarray:
        """The given positions in the order of their suffixes.

        With ``aligned``, suffixes equal for PERIOD bytes are ordered by residue
        before rank, so that only those of one residue are in suffix order.
        """
        if not len(at):
            return at
        head = (self.words[at] >> np.uint64(48)).astype(np.int64)
        first = np.argsort(head, kind="stable")
        bounds = np.concatenate(([0], np.flatnonzero(np.diff(head[first])) + 1, [len(at)]))
        return np.concatenate([self._bucket(at[first[a:b]], aligned) for a, b in zip(bounds[:-1], bounds[1:], strict=True)])

    def _bucket(self, at: np.ndarray, aligned: bool) -> np.ndarray:
        keys = self.keys(at)
        residue = at % PERIOD
        deep = self.rank[np.minimum(at + NEXT[residue], self.n)]
        order = np.lexsort((deep, residue, *keys[::-1]))
        if aligned:
            return at[order]
        new = self._new([k[order] for k in keys])
        a = np.flatnonzero(new)
        b = np.append(a[1:], len(at))
        out, residue = at[order], residue[order]
        for i in np.flatnonzero((b - a > 1) & (np.maximum.reduceat(residue, a) != np.minimum.reduceat(residue, a))):
            out[a[i] : b[i]] = sorted(out[a[i] : b[i]], key=functools.cmp_to_key(self._compare))
        return out

    def _compare(self, i: int, j: int) -> int:
        d = BOTH[i % PERIOD][j % PERIOD]
        return int(self.rank[min(i + d, self.n)]) - int(self.rank[min(j + d, self.n)])

    def same(self, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
        """Whether suffixes agree for ``length`` bytes."""
        out = np.ones(len(a), bool)
        for o in range(0, length - 7, 8):
            out &= self.words[a + o] == self.words[b + o]
        if length % 8:
            o = max(0, length - 8)
            out &= self.words[a + o] == self.words[b + o] if length >= 8 else (self.words[a] ^ self.words[b]) >> np.uint64(64 - 8 * length) == 0
        return out


def resolve(c: repeats.Contested) -> np.ndarray:
    """For each window of contested passages: whether a smaller document has it."""
    size = c.windows.astype(np.int64) + c.length - 1
    slot = -(-(size + PERIOD) // PERIOD) * PERIOD
    base = np.cumsum(slot) - slot
    begin = base + (-c.offset) % PERIOD
    data = np.zeros(int(slot.sum()) + c.length, np.uint8)
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    data[np.repeat(begin, size) + within] = c.symbols[np.repeat(c.at, size) + within]
    which = np.repeat(np.arange(len(size)), c.windows)
    step = np.arange(len(which)) - np.repeat(np.cumsum(c.windows) - c.windows, c.windows)
    at = begin[which] + step
    sorter = Sorter(data, c.length)
    order = sorter.sort(at, aligned=True)
    number = np.zeros(len(data), np.int64)
    number[at] = np.arange(len(at))
    new = np.append(True, ~sorter.same(order[1:], order[:-1], c.length))
    doc = c.doc[which[number[order]]]
    least = np.minimum.reduceat(doc, np.flatnonzero(new))[np.cumsum(new) - 1]
    out = np.zeros(len(at), bool)
    out[number[order]] = doc > least
    return out


def remove_repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM, digests: bool = False) -> DataFrame:
    """One row a document: id, ``n_bytes``, ``n_removed``, ``n_spans`` and the bytes kept (or their sha256)."""
    kind = repeats.Kind(repeats.of_bytes, length, gram, np.uint8, False)
    spans, n = repeats.find(docs, kind, resolve, doc_id=doc_id, text=text)

    def finish(column, of):
        size, removed, runs, kept = [], [], [], []
        for block in tx.blocks(column):
            for i in range(block.n):
                data = block.data[block.offsets[i] : block.offsets[i + 1]]
                begin, end = of(block.first + i)
                gone = tx.union(begin, end, len(data)) if len(begin) else np.zeros(len(data), bool)
                size.append(len(data))
                removed.append(int(gone.sum()))
                runs.append(int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()))
                left = data[~gone].tobytes()
                kept.append(tx.sha256(left) if digests else left)
        return [pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string() if digests else pa.binary())]

    return repeats.gather(docs, spans, n, kind, finish, f"n_bytes long, n_removed long, n_spans long, {'kept_sha256 string' if digests else 'kept binary'}", doc_id=doc_id, text=text)
