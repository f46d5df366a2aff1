"""Finding what repeats: the candidate search that both substring operators share.

A document is a sequence of symbols (bytes or words), a *window* ``length``
consecutive ones.  Each window picks, by the smallest hash, one ``gram``-symbol
run in it: its *anchor*.  Equal windows pick equal anchors at equal offsets, so
all occurrences of a window meet under one anchor.  Consecutive windows with one
anchor make a *passage* (the symbols from the first window's start to the last
one's end); a document is cut into about ``2 / (length - gram + 2)`` passages a
symbol, and only one record a passage is shuffled.

1. ``fingerprints``: a record (anchor, passage hash, document) for every distinct
   passage of a batch, dealt by anchor.  Copies within the batch are answered at
   once, so a passage in a third of all documents sends one record a batch.
2. ``answers``: under each anchor, a passage that a smaller document also holds is
   a whole copy; where one anchor has several different passages, these are
   *contested*: they may share some windows.  Both go back, dealt by document.
3. ``passages``: documents look up their passages.  Whole copies become spans;
   contested passages are sent with their symbols, again dealt by anchor.  Under
   an anchor with over ``HOT`` passages each window is sent for itself, dealt by
   its own hash, so no anchor gathers in one task.
4. The operator compares the contested passages of a bucket by its own method
   and returns the spans of windows that start earlier.
5. ``gather``: documents meet the spans of steps 3 and 4.

Records travel as byte strings, one a bucket and batch, so rows are few and the
work on them is vectorised.  Buckets follow the session's shuffle partitions, and the
size of the table where that asks for more.

A row is known by its id and a hash of its symbols: rows that share an id are told
apart, and do not remove anything from each other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import text as tx
from plumbline.llm.cluster import Scratch, parts

U64 = np.uint64
HOT = 4096
LAST = (1 << 63) - 1  # a null id comes after all others
ROW = "part int, kind int, blob binary"
DOCS, COPY, CONTEST, CROWD, PASSAGES, SPANS = range(6)


@dataclass(frozen=True)
class Kind:
    """What the symbols are, and how long windows and anchors are."""

    symbols: Callable[[tx.Block], tuple[np.ndarray, np.ndarray]]
    length: int
    gram: int
    dtype: type
    within: bool  # whether an earlier start in the same document counts


def of_bytes(block: tx.Block) -> tuple[np.ndarray, np.ndarray]:
    return block.data, block.offsets


def of_words(block: tx.Block) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = block.words(tx.SPACED)
    return tx.Rolling(block.data).ranges(starts, ends), first


@dataclass
class Prints:
    """The passages of a block: text, first and last window, anchor position; hashes of anchor, passage and whole text."""

    text: np.ndarray
    begin: np.ndarray
    end: np.ndarray
    at: np.ndarray
    anchor: np.ndarray
    passage: np.ndarray
    row: np.ndarray


def row_hashes(rolling: tx.Rolling, first: np.ndarray) -> np.ndarray:
    """A hash of the symbols of each text."""
    return rolling.ranges(first[:-1], first[1:])


def prints(values: np.ndarray, first: np.ndarray, kind: Kind) -> Prints:
    rolling = tx.Rolling(values)
    grams = rolling.grams(kind.gram)
    pick = tx.chosen(grams, kind.length - kind.gram + 1)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(pick)]
    start = np.flatnonzero(np.arange(len(pick)) + kind.length <= first[1:][text])
    picked = pick[start]
    a, b = tx.runs(picked)
    begin, end, at = start[a], start[b - 1] if len(b) else a, picked[a]
    whole = rolling.raw(begin, end + kind.length)
    passage = tx.mix(tx.mix(whole) ^ ((end - begin).astype(U64) << U64(32)) ^ (at - begin).astype(U64))
    return Prints(text[begin], begin, end, at, grams[at], passage, row_hashes(rolling, first)[text[begin]])


def mixed_id(ids: np.ndarray) -> np.ndarray:
    u = ids.astype(np.int64).view(U64)
    return (u ^ (u >> U64(7)) ^ (u >> U64(15)) ^ (u >> U64(31))) & U64(LAST)


def part_of_id(ids: np.ndarray, n: int) -> np.ndarray:
    return (mixed_id(ids) % U64(n)).astype(np.int32)


def part_column(column, n: int):
    """``part_of_id`` as a column."""
    c = F.coalesce(column.cast("long"), F.lit(LAST))
    h = c.bitwiseXOR(F.shiftrightunsigned(c, 7)).bitwiseXOR(F.shiftrightunsigned(c, 15)).bitwiseXOR(F.shiftrightunsigned(c, 31))
    return F.pmod(h.bitwiseAND(F.lit(LAST)), F.lit(n)).cast("int")


def ids_of(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(LAST).to_numpy(zero_copy_only=False)


def joint(anchor: np.ndarray, passage: np.ndarray) -> np.ndarray:
    return tx.mix(anchor ^ (passage * U64(0x9FB21C651E98DF25)))


def key_of(pair: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """One number for a document's passage."""
    return tx.mix(pair + ids.view(U64) * U64(0xD6E8FEB86659FD93))


def short(values: np.ndarray) -> bytes:
    """The upper 48 bits of each number."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def unshort(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


CUT48 = U64(0xFFFFFFFFFFFF0000)


def deal(part: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """An order by part, and where each part begins in it."""
    order = np.argsort(part, kind="stable")
    return order, np.searchsorted(part[order], np.arange(n + 1))


def rows(out: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    if out:
        part, kind, blob = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(blob, pa.binary())], names=["part", "kind", "blob"])


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Arrays behind their lengths."""
    data = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    return np.array([len(data), *map(len, data)], np.int64).tobytes() + b"".join(data)


def unpack(blob: bytes) -> list[bytes]:
    n = int(np.frombuffer(blob, np.int64, 1)[0])
    out, at = [], 8 * (n + 1)
    for size in np.frombuffer(blob, np.int64, n, 8):
        out.append(blob[at : at + size])
        at += size
    return out


def _send_keys(out: list, n: int, kind: int, keys: np.ndarray, ids: np.ndarray) -> None:
    order, cut = deal(part_of_id(ids, n), n)
    keys = keys[order]
    for p in range(n):
        if cut[p] < cut[p + 1]:
            out.append((p, kind, keys[cut[p] : cut[p + 1]].tobytes()))


def fingerprints(kind: Kind, n: int):
    """Step 1: rows for the anchors' buckets; the answers known at once take the bucket of their document."""

    def run(batches):
        for batch in batches:
            ids = ids_of(batch.column(0))
            found = []
            for block in tx.blocks(batch.column(1)):
                p = prints(*kind.symbols(block), kind)
                found.append((p.anchor, p.passage & CUT48, p.text + block.first))
            anchor, passage, text = (np.concatenate(x) for x in zip(*found, strict=True))
            bucket = (anchor % U64(n)).astype(np.int32)
            anchor &= CUT48
            pair, doc = joint(anchor, passage), ids[text]
            order = np.argsort(pair, kind="stable")
            a, b = tx.runs(pair[order])
            out: list = []
            if len(a):
                least = np.minimum.reduceat(doc[order], a)
                copy = order[doc[order] > np.repeat(least, b - a)]
                keys, at = np.unique(key_of(pair[copy], doc[copy]), return_index=True)
                _send_keys(out, n, COPY, keys, doc[copy][at])
                lead = order[a]
                order, cut = deal(bucket[lead], n)
                lead, least = lead[order], least[order]
                for k in range(n):
                    own = slice(cut[k], cut[k + 1])
                    if cut[k] < cut[k + 1]:
                        docs, of = np.unique(least[own], return_inverse=True)
                        of = of.astype(np.uint16 if len(docs) <= 1 << 16 else np.uint32)
                        out.append((k, DOCS, pack(short(anchor[lead[own]]), short(passage[lead[own]]), docs, of)))
            yield from rows(out)

    return run


def answers(n: int):
    """Step 2: the whole copies and the contested passages of a bucket, for the parts of their documents."""

    def run(batches):
        anchor, passage, doc = [], [], []
        for batch in batches:
            for part, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind != DOCS:
                    yield from rows([(part, kind, blob)])
                    continue
                a, p, docs, of = unpack(blob)
                docs = np.frombuffer(docs, np.int64)
                size = len(a) // 6
                anchor.append(unshort(a))
                passage.append(unshort(p))
                doc.append(docs[np.frombuffer(of, np.uint16 if len(of) == 2 * size else np.uint32)])
        if not anchor:
            return
        anchor, passage, doc = np.concatenate(anchor), np.concatenate(passage), np.concatenate(doc)
        order = np.lexsort((passage, anchor))
        anchor, passage, doc = anchor[order], passage[order], doc[order]
        new_anchor = np.append(True, anchor[1:] != anchor[:-1])
        new = new_anchor | np.append(True, passage[1:] != passage[:-1])
        group = np.cumsum(new) - 1
        least = np.minimum.reduceat(doc, np.flatnonzero(new))[group]
        of_anchor = np.cumsum(new_anchor) - 1
        crowd = np.bincount(of_anchor, new)[of_anchor]
        keys = key_of(joint(anchor, passage), doc)
        copy = doc > least
        contested = ~copy & (crowd > 1)
        out: list = []
        _send_keys(out, n, COPY, keys[copy], doc[copy])
        for kind, which in ((CONTEST, contested & (crowd <= HOT)), (CROWD, contested & (crowd > HOT))):
            _send_keys(out, n, kind, keys[which], doc[which])
        yield from rows(out)

    return run


def _is_in(keys: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(keys), bool)
    at = np.searchsorted(sorted_keys, keys)
    at[at == len(sorted_keys)] = 0
    return sorted_keys[at] == keys


def _span_row(part: int, ids: np.ndarray, row: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[int, int, bytes]:
    return part, SPANS, pack(ids.astype(np.int64), row.astype(U64), begin.astype(np.int64), end.astype(np.int64))


def passages(kind: Kind, n: int):
    """Step 3: spans of whole copies, and contested passages with their symbols."""

    def run(batches):
        docs, known = [], {COPY: [], CONTEST: [], CROWD: []}
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            for i in np.flatnonzero(kinds != DOCS):
                known[int(kinds[i])].append(np.frombuffer(batch.column(2)[int(i)].as_py(), U64))
            if (kinds == DOCS).any():
                docs.append(batch.filter(pa.array(kinds == DOCS)).select([0, 3, 4]))
        known = {k: np.unique(np.concatenate(v)) if v else np.zeros(0, U64) for k, v in known.items()}
        for batch in docs:
            ids, part = ids_of(batch.column(1)), batch.column(0).to_numpy()
            out: list = []
            sent: dict[int, list] = {}
            for block in tx.blocks(batch.column(2)):
                values, first = kind.symbols(block)
                p = prints(values, first, kind)
                doc = ids[p.text + block.first]
                key = key_of(joint(p.anchor & CUT48, p.passage & CUT48), doc)
                copy = _is_in(key, known[COPY])
                if kind.within:  # a passage's later places in its own text
                    order = np.lexsort((p.begin, key, p.text))
                    again = (key[order][1:] == key[order][:-1]) & (p.text[order][1:] == p.text[order][:-1])
                    copy[order[1:][again]] = True
                base = first[p.text]
                if copy.any():
                    out.append(_span_row(int(part[block.first]), doc[copy], p.row[copy], (p.begin - base)[copy], (p.end - base)[copy] + kind.length))
                for which, alone in ((CONTEST, False), (CROWD, True)):
                    some = np.flatnonzero(_is_in(key, known[which]) & ~copy)
                    if not len(some):
                        continue
                    if alone:
                        times = (p.end - p.begin + 1)[some]
                        some = np.repeat(some, times)
                        begin = p.begin[some] + np.arange(len(some)) - np.repeat(np.cumsum(times) - times, times)
                        end = begin
                        anchor = tx.Rolling(values).ranges(begin, begin + kind.length)
                    else:
                        begin, end, anchor = p.begin[some], p.end[some], p.anchor[some]
                    size = end - begin + kind.length
                    symbols = values[np.repeat(begin - np.cumsum(size) + size, size) + np.arange(size.sum())].astype(kind.dtype)
                    order, cut = deal((anchor % U64(n)).astype(np.int32), n)
                    at = np.concatenate(([0], np.cumsum(size)))
                    for b in np.flatnonzero(np.diff(cut)):
                        own = order[cut[b] : cut[b + 1]]
                        take = np.repeat(at[own] - np.cumsum(size[own]) + size[own], size[own]) + np.arange(size[own].sum())
                        sent.setdefault(int(b), []).append((anchor[own], doc[some[own]], p.row[some[own]], (begin - base[some])[own], (end - begin + 1)[own].astype(np.int32), (p.at[some] - begin)[own].astype(np.int32), symbols[take]))
            for b, parts in sent.items():
                out.append((b, PASSAGES, pack(*(np.concatenate(x) for x in zip(*parts, strict=True)))))
            yield from rows(out)

    return run


@dataclass
class Contested:
    """Passages of a bucket, by anchor, document, row and position: number of windows, offset of the anchor, and where the symbols begin."""

    anchor: np.ndarray
    doc: np.ndarray
    row: np.ndarray
    begin: np.ndarray
    windows: np.ndarray
    offset: np.ndarray
    at: np.ndarray
    symbols: np.ndarray
    length: int

    def part(self, a: int, b: int) -> Contested:
        return Contested(*(x[a:b] for x in (self.anchor, self.doc, self.row, self.begin, self.windows, self.offset, self.at)), self.symbols, self.length)


def contests(kind: Kind, n: int, resolve: Callable[[Contested], np.ndarray]):
    """Step 4: ``resolve`` says for each window, in order, whether it starts earlier."""

    def run(batches):
        parts = []
        for batch in batches:
            for part, what, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if what == SPANS:
                    yield from rows([(part, what, blob)])
                else:
                    parts.append(unpack(blob))
        if not parts:
            return
        anchor, doc, row, begin, windows, offset, symbols = (np.concatenate([np.frombuffer(p[i], t) for p in parts]) for i, t in enumerate((U64, np.int64, U64, np.int64, np.int32, np.int32, kind.dtype)))
        parts.clear()
        size = windows.astype(np.int64) + kind.length - 1
        at = np.cumsum(size) - size
        order = np.lexsort((begin, row, doc, anchor))
        c = Contested(anchor[order], doc[order], row[order], begin[order], windows[order], offset[order], at[order], symbols, kind.length)
        group = np.concatenate(([0], np.flatnonzero(c.anchor[1:] != c.anchor[:-1]) + 1, [len(c.anchor)]))
        i = 0
        while i < len(group) - 1:  # whole anchors, about a block of symbols at a time
            j = i + 1
            load = np.cumsum(c.windows[group[i] : group[-1]] + kind.length) if i == 0 else load
            base = load[group[i] - 1] if i else 0
            j = max(j, int(np.searchsorted(load[group[i + 1 :] - 1], base + tx.BLOCK_BYTES, side="right")) + i)
            own = c.part(group[i], group[j])
            hit = resolve(own)
            which = np.repeat(np.arange(len(own.doc)), own.windows)
            start = own.begin[which] + np.arange(len(which)) - np.repeat(np.cumsum(own.windows) - own.windows, own.windows)
            joined = hit[1:] & hit[:-1] & (which[1:] == which[:-1])  # consecutive windows of a passage make one span
            first, last = np.flatnonzero(hit & ~np.append(False, joined)), np.flatnonzero(hit & ~np.append(joined, False))
            ids, row, start, end = own.doc[which[first]], own.row[which[first]], start[first], start[last] + kind.length
            order, cut = deal(part_of_id(ids, n), n)
            spans = [x[order] for x in (ids, row, start, end)]
            yield from rows([_span_row(int(p), *(x[cut[p] : cut[p + 1]] for x in spans)) for p in np.flatnonzero(np.diff(cut))])
            i = j

    return run


def find(docs: DataFrame, kind: Kind, resolve: Callable[[Contested], np.ndarray], *, doc_id: str, text: str) -> tuple[DataFrame, int]:
    """Rows of spans [start, end) of symbols by part of their documents, and the number of parts."""
    scratch, n = Scratch(docs.sparkSession), parts(docs, text)
    read = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    part = F.col("part")
    told = scratch.cut(read.mapInArrow(fingerprints(kind, n), ROW).repartitionById(n, part).mapInArrow(answers(n), ROW))
    both = dealt(read, n).unionByName(told, allowMissingColumns=True).repartitionById(n, part)
    sent = scratch.cut(both.mapInArrow(passages(kind, n), ROW).repartitionById(n, part).mapInArrow(contests(kind, n, resolve), ROW))
    scratch.drop(told)
    scratch.release()
    return sent, n


def dealt(docs: DataFrame, n: int) -> DataFrame:
    """Documents as rows that the blobs of their part can join."""
    return docs.select(part_column(F.col("id"), n).alias("part"), F.lit(DOCS).alias("kind"), F.lit(None).cast("binary").alias("blob"), "id", "text")


def gather(docs: DataFrame, spans: DataFrame, n: int, kind: Kind, finish, schema: str, *, doc_id: str, text: str) -> DataFrame:
    """Step 5: ``finish(ids, column, spans)`` makes result arrays; ``spans(i)`` are the begins and ends of text i."""
    read = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        kept, found = [], []
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            found += [unpack(batch.column(2)[int(i)].as_py()) for i in np.flatnonzero(kinds == SPANS)]
            if (kinds == DOCS).any():
                kept.append(batch.filter(pa.array(kinds == DOCS)).select([3, 4]))
        ids, row, begin, end = (np.concatenate([np.frombuffer(f[k], t) for f in found]) if found else np.zeros(0, t) for k, t in enumerate((np.int64, U64, np.int64, np.int64)))
        order = np.argsort(ids, kind="stable")
        ids, row, begin, end = ids[order], row[order], begin[order], end[order]
        held, times = np.unique(np.concatenate([ids_of(batch.column(0)) for batch in kept]) if kept else ids, return_counts=True)
        shared = held[times > 1]
        for batch in kept:
            own = ids_of(batch.column(0))
            a, b = np.searchsorted(ids, own), np.searchsorted(ids, own, side="right")
            unlike = {}  # rows that share their id take the spans of their own text
            for i in np.flatnonzero(_is_in(own, shared) & (b > a)).tolist():
                values, first = kind.symbols(next(tx.blocks(batch.column(1).slice(i, 1))))
                unlike[i] = np.flatnonzero(row[a[i] : b[i]] == row_hashes(tx.Rolling(values), first)[0]) + a[i]
            of = lambda i: (begin[unlike[i]], end[unlike[i]]) if i in unlike else (begin[a[i] : b[i]], end[a[i] : b[i]])  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([batch.column(0), *finish(batch.column(1), of)], names=names)

    names = ["id", *[f.split()[0] for f in schema.split(", ")]]
    both = dealt(read, n).unionByName(spans, allowMissingColumns=True).repartitionById(n, F.col("part"))
    return both.mapInArrow(run, f"id long, {schema}").withColumnRenamed("id", doc_id)
