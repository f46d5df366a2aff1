"""Pairs of reviewers with products in common, without a row for every pair.

A product of n reviewers makes n * (n - 1) / 2 pairs, and most are never seen again.
They are dealt packed by the first of the pair, of eight bytes each, a few buckets of
first reviewers at a time; a bucket sorts its pairs and gives only those that occur
often enough.  Nothing is left out: passes and buckets part the pairs, and every pair
is in one of them.

Products and reviewers stand for themselves by 62 and 64 bits of their hashes; within
one first reviewer, pairs are told apart by what a bucket's number of reviewers leaves
of 64 bits (over 45 in buckets of ``AT_ONCE`` pairs).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.cluster import Scratch, partitions

#: Pairs in a bucket; passes, where there are more than ``FEW`` pairs; a reviewer of more products has its pairs dealt over all buckets of a pass.
AT_ONCE, PASSES, FEW, BUSY = 1 << 20, 8, 1 << 24, 1 << 14
_TARGET, _EDGE, _FLAGS = np.uint64(1), np.uint64(2), np.uint64(3)
_MIX = np.uint64(0x9E3779B97F4A7C15)
_EMITTED = 1 << 20


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _MIX
    return x ^ (x >> np.uint64(29))


def _followers(n: np.ndarray) -> np.ndarray:
    """Of lists of lengths ``n`` laid end to end: how many entries follow each in its list."""
    return np.repeat(np.cumsum(n), n) - np.arange(int(n.sum())) - 1


def _seconds(at: np.ndarray, k: np.ndarray) -> np.ndarray:
    """The ``k`` places from ``at`` on, for each, laid end to end."""
    return np.repeat(at - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))


def _dealt(own: np.ndarray, buckets: int) -> np.ndarray:
    return (_mixed(own) % np.uint64(buckets)).astype(np.int64)


def _emitted(asin: np.ndarray, n: np.ndarray, who: np.ndarray, busy: np.ndarray, low: int, high: int, buckets: int) -> pa.RecordBatch | None:
    """The pairs of some products whose bucket is at least ``low`` and less than ``high``, a row for each bucket."""
    after, of, own = _followers(n), np.repeat(asin, n), who & ~_FLAGS
    b = _dealt(own, buckets)
    many = np.isin(own, busy) if len(busy) else np.zeros(len(own), bool)
    first = np.flatnonzero((after > 0) & ~many & (b >= low) & (b < high))
    k, b, at = after[first], b[first], first + 1
    if many.any():  # each pair of these for itself
        some = np.flatnonzero(many)
        one, other = np.repeat(some, after[some]), _seconds(some + 1, after[some])
        to = _dealt(own[one] ^ _mixed(own[other]), buckets)
        here = (to >= low) & (to < high)
        first, at, b = np.concatenate((first, one[here])), np.concatenate((at, other[here])), np.concatenate((b, to[here]))
        k = np.concatenate((k, np.ones(int(here.sum()), k.dtype)))
    if not len(b):
        return None
    order = np.argsort(b, kind="stable")
    first, at, k, b = first[order], at[order], k[order], b[order]
    other = who[_seconds(at, k)]
    cut = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1], [True])))
    ends = np.concatenate(([0], np.cumsum(k)))
    parts = list(zip(cut[:-1], cut[1:]))
    column = lambda x, spans: pa.array([x[i:j].tobytes() for i, j in spans], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(b[cut[:-1]], pa.int32()), column(of[first], parts), column(who[first], parts), column(k.astype(np.uint32), parts), column(other, [(ends[i], ends[j]) for i, j in parts])], names=["bucket", "a", "r", "k", "other"])


def _counted(table: pa.Table, least: int) -> pa.Table:
    """The target pairs of one bucket whose reviewers have ``least`` *other* products or more in common."""
    read = lambda c, kind: np.frombuffer(b"".join(table[c].to_pylist()), kind)
    a, r, k, other = read("a", np.uint64), read("r", np.uint64), read("k", np.uint32), read("other", np.uint64)
    at = np.repeat(np.arange(len(a), dtype=np.uint32), k)
    firsts, of = np.unique(r & ~_FLAGS, return_inverse=True)
    bits = np.uint64(max(1, int(len(firsts) - 1).bit_length()))
    key = (of.astype(np.uint64) << (np.uint64(64) - bits))[at] | ((other & ~_FLAGS) >> bits)
    both = r[at] & other
    held, asked = both & _EDGE > 0, both & _TARGET > 0
    edges = np.flatnonzero(held)
    order = edges[np.argsort(key[edges])]
    ranked = key[order]
    begin = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(ranked) else np.zeros(0, np.int64)
    n = np.diff(np.concatenate((begin, [len(ranked)])))
    shared = np.repeat(n, n) - 1  # without the product itself
    good = (shared >= least) & asked[order]
    found, count = order[good], shared[good]
    strange = np.flatnonzero(asked & ~held)  # pairs of a target that the corpus does not have
    if len(strange) and len(begin):
        keys = ranked[begin]
        place = np.minimum(np.searchsorted(keys, key[strange]), len(keys) - 1)
        good = (keys[place] == key[strange]) & (n[place] >= least)
        found, count = np.concatenate((found, strange[good])), np.concatenate((count, n[place][good]))
    long = lambda x: pa.array((x & ~_FLAGS).view(np.int64))
    return pa.table({"a": pa.array(a[at[found]].view(np.int64)), "r1": long(r[at[found]]), "r2": long(other[found]), "shared": pa.array(count.astype(np.int64))})


def product_id(asin: str = "asin"):
    return F.xxhash64(asin)


def reviewer_id(reviewer: str = "reviewer"):
    """62 bits of the reviewer's hash; the two lowest are free."""
    return F.xxhash64(reviewer).bitwiseAND(F.lit(-4))


def linked(held: DataFrame, pairs: int, scratch: Scratch, least: int = 2) -> DataFrame:
    """(a, r1, r2, shared): the pairs of a target's reviewers with ``least`` other products or more in common.

    ``held`` is a written table of distinct (a, r, target, edge): ids and flags of a product's
    reviewers; ``pairs`` bounds the pairs that its products make.
    """
    spark = held.sparkSession
    buckets, passes = max(1, -(-pairs // AT_ONCE)), PASSES if pairs > FEW else 1
    busy = held.groupBy("r").count().where(F.col("count") > BUSY).select("r").toArrow()["r"].to_numpy().view(np.uint64)
    coded = F.col("r").bitwiseOR(F.col("target").cast("long")).bitwiseOR(F.col("edge").cast("long") * 2)
    lists = scratch.cut(held.repartition(partitions(spark), "a").groupBy("a").agg(F.sort_array(F.collect_list(coded)).alias("who")).where(F.size("who") > 1))
    scratch.release()
    out = None
    for p in range(passes):
        low, high = buckets * p // passes, buckets * (p + 1) // passes

        def emit(batches: Iterator[pa.RecordBatch], low=low, high=high):
            for batch in batches:
                n = batch.column(1).value_lengths().to_numpy().astype(np.int64)
                made, begin = np.cumsum(n * (n - 1) // 2), 0
                while begin < batch.num_rows:
                    end = max(begin + 1, int(np.searchsorted(made, (made[begin - 1] if begin else 0) + _EMITTED, side="right")))
                    some = batch.slice(begin, end - begin)
                    found = _emitted(some.column(0).to_numpy().view(np.uint64), n[begin:end], some.column(1).flatten().to_numpy().view(np.uint64), busy, low, high, buckets)
                    if found is not None:
                        yield found
                    begin = end

        dealt = lists.mapInArrow(emit, "bucket int, a binary, r binary, k binary, other binary")
        found = scratch.cut(dealt.groupBy("bucket").applyInArrow(lambda table: _counted(table, least), "a long, r1 long, r2 long, shared long"))
        scratch.release()
        out = found if out is None else out.unionByName(found)
    scratch.drop(lists)
    return out
