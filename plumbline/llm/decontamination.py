"""Benchmark decontamination by winnowing.

A *window* is ``window`` consecutive words of a benchmark item; an item with
fewer words (but not none) is one window.  Winnowing keeps, of every window, the
smallest hash of its ``gram``-word runs, the last among equals.  Equal windows
keep equal hashes, so a text that holds a benchmark window always shares its
fingerprint: every shared span of ``window`` words or more is found.  Where a
fingerprint of a text meets one of the benchmark, the hit is extended: the text's
windows that chose that fingerprint are compared by the hash of all their words.
Items shorter than a window have a fingerprint of their own, the hash of all
their words, for each length that occurs.

The benchmark's index is broadcast.  Its size is checked: a benchmark of more
than ``block_bytes`` of text is dealt into blocks of about that size, and the
texts pass by each block in turn, which gives out its hits alone; the rows are the same.

Edge cases: a null or empty text has no words and no hits; an item with null id
or text is left out; equal items each count; equal ids count once; an empty
benchmark hits nothing.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import text as tx
from plumbline.llm.cluster import Scratch, fresh, map_texts, others

WINDOW, GRAM, BLOCK = 13, 5, 32 << 20
RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _hashed(block: tx.Block) -> tuple[np.ndarray, np.ndarray]:
    lower = tx.LOWER[block.data]
    starts, ends, first = block.words(tx.ALNUM, lower)
    return tx.Rolling(lower).ranges(starts, ends), first


class Index:
    """Fingerprints and windows of a part of the benchmark."""

    def __init__(self, ids: list[str], texts: list[str], window: int, gram: int):
        self.window, self.gram = window, gram
        found: dict[int, list[np.ndarray]] = {}
        prints = []
        for block in tx.blocks(pa.array(texts, pa.string())):
            hashes, first = _hashed(block)
            for i in range(block.n):
                words = hashes[first[i] : first[i + 1]]
                size = min(window, len(words))
                if not size:
                    continue
                whole = tx.Rolling(words).grams(size)
                found.setdefault(size, []).append(np.stack([whole, np.full(len(whole), block.first + i, np.uint64)]))
                if size == window:
                    g = tx.Rolling(words).grams(gram)
                    prints.append(g[tx.chosen(g, window - gram + 1)])
        self.ids = ids
        self.prints = np.unique(np.concatenate(prints)) if prints else np.zeros(0, np.uint64)
        self.windows = {}
        for size, parts in found.items():
            both = np.unique(np.concatenate(parts, axis=1), axis=1)
            keys, at = np.unique(both[0], return_index=True)
            self.windows[size] = (keys, np.append(at, both.shape[1]), both[1].astype(np.int64))

    def hits(self, hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words, lengths and numbers in ``windows[length]`` of the windows that occur."""
        n, limit = len(hashes), np.repeat(first[1:], np.diff(first))
        rolling = tx.Rolling(hashes)
        out = []
        for size, (keys, _, _) in self.windows.items():
            if n < size:
                continue
            if size == self.window:
                g = rolling.grams(self.gram)
                anchor = tx.chosen(g, size - self.gram + 1)
                at = np.flatnonzero(_in(g, self.prints)[anchor])
            else:
                at = np.arange(n - size + 1)
            at = at[at + size <= limit[at]]
            full = rolling.raw(at, at + size)
            full = tx.mix(full)
            pos = np.searchsorted(keys, full)
            pos[pos == len(keys)] = 0
            yes = keys[pos] == full
            out.append((at[yes], np.full(yes.sum(), size), pos[yes]))
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def items(self, size: int, number: int) -> np.ndarray:
        _, at, items = self.windows[size]
        return items[at[number] : at[number + 1]]


def _in(values: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(values), bool)
    pos = np.searchsorted(keys, values)
    pos[pos == len(keys)] = 0
    return keys[pos] == values


def _look(broadcast):
    def make():
        index: Index = broadcast.value

        def work(column, batch):
            counts, spans, items = [], [], []
            for block in tx.blocks(column):
                hashes, first = _hashed(block)
                counts.append(np.diff(first))
                at, size, number = index.hits(hashes, first)
                order = np.argsort(at, kind="stable")
                at, size, number = at[order], size[order], number[order]
                cut = np.searchsorted(at, first)
                for i in range(block.n):
                    a, b = cut[i], cut[i + 1]
                    if a == b:
                        spans.append([])
                        items.append([])
                        continue
                    hit = tx.union(at[a:b] - first[i], at[a:b] + size[a:b] - first[i], first[i + 1] - first[i])
                    s, e = tx.runs(hit)
                    spans.append([{"start": int(x), "end": int(y)} for x, y in zip(s, e, strict=True) if hit[x]])
                    pairs = np.unique(np.stack([size[a:b], number[a:b]]), axis=1)
                    items.append(sorted({index.ids[j] for x, y in pairs.T for j in index.items(int(x), int(y))}))
            types = [pa.int64(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.string())]
            return [pa.array(np.concatenate(counts), types[0]), pa.array(spans, types[1]), pa.array(items, types[2])]

        return work

    return make


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", into: str = "contamination", window: int = WINDOW, gram: int = GRAM, block_bytes: int = BLOCK, keep: list[str] | None = None) -> DataFrame:
    """Add a struct of ``n_words``, hit word ``spans`` [start, end) and the ``items`` hit, sorted as strings."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{item_text}`").alias("text")).dropna()
    size = items.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    n = max(1, -(-size // block_bytes))
    names = docs.columns if keep is None else keep
    made = fresh(docs, "n_words", "spans", "items")
    n_words, spans, hit = (F.col(m) for m in made)
    fields = [T.StructField(m, f.dataType) for m, f in zip(made, RESULT, strict=True)]

    def looked(table: DataFrame, k: int, kept: list[str]) -> DataFrame:
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k)
        rows = part.orderBy("id", "text").collect()  # at most about block_bytes
        index = spark.sparkContext.broadcast(Index([r["id"] for r in rows], [r["text"] for r in rows], window, gram))
        return map_texts(table, text, _look(index), fields, kept)

    if n == 1:
        found = looked(docs, 0, names)
    else:  # only the hits of the further blocks are written, by the number of their row
        scratch, (row, more_spans, more_items) = Scratch(spark), fresh(docs, "row", "more_spans", "more_items")
        table = scratch.cut(docs.withColumn(row, F.monotonically_increasing_id()))
        hits = [scratch.cut(looked(table, k, [row]).where(F.size(spans) > 0)) for k in range(1, n)]
        more = functools.reduce(DataFrame.unionByName, hits).groupBy(row).agg(F.flatten(F.collect_list(spans)).alias(more_spans), F.flatten(F.collect_list(hit)).alias(more_items))
        found = looked(table, 0, [*names, row]).join(more, row, "left")
        spans, hit = F.when(F.col(more_spans).isNull(), spans).otherwise(_merged(F.array_sort(F.concat(spans, more_spans)))), F.when(F.col(more_items).isNull(), hit).otherwise(F.array_sort(F.array_distinct(F.concat(hit, more_items))))
    return found.select(*others(names, into), F.struct(n_words.alias("n_words"), spans.alias("spans"), hit.alias("items")).alias(into))


def _merged(spans):
    """Sorted spans without overlaps."""
    kind = RESULT["spans"].dataType.simpleString()
    return F.aggregate(
        spans,
        F.expr(f"cast(array() as {kind})"),
        lambda acc, x: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["end"] >= x["start"]), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(F.element_at(acc, -1)["start"].alias("start"), F.greatest(F.element_at(acc, -1)["end"], x["end"]).alias("end"))))).otherwise(F.concat(acc, F.array(x))),
    )


def hit_words(found) -> F.Column:
    return F.aggregate(found["spans"], F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def is_contaminated(found, least_share: int = 20) -> F.Column:
    """A word in ``least_share`` or more was hit."""
    return (hit_words(found) > 0) & (least_share * hit_words(found) >= found["n_words"])
