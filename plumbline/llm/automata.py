"""Substring dedup by suffix automata.

A suffix automaton of a reference reads any text word by word and knows, after
each word, the length of the longest run ending there that the reference holds:
the *matching statistics*.  Where the length reaches ``length`` words, the last
``length`` words occur in the reference; the union of such windows are the
maximal spans to remove.

``remove_reference`` broadcasts the automata of a given reference, cut into shards
of at most ``shard_words`` words, and streams the documents by each shard.

``remove_repeats`` removes words of documents that repeat earlier documents (or an
earlier place of the same one).  Here the reference is the corpus itself, and its
shards have no bound to broadcast: so they are dealt instead.  The candidate search
of ``repeats`` sends the contested passages of one anchor to one place; they are the
anchor's shard.  In the order of their place in the corpus, each is streamed through
the automaton of the ones before it, and then extends the automaton if it holds
anything new.

Edge cases: a null or empty text has no words; texts shorter than a window lose
nothing; rows of equal id, and those with a null id (which come last), remove nothing
from each other, only from later ids and from later places in themselves; an empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import repeats
from plumbline.llm import text as tx
from plumbline.llm.cluster import fresh, map_texts

LENGTH, GRAM, SHARD_WORDS = 20, 8, 200_000


class SuffixAutomaton:
    """Accepts every run of symbols of the sequences added."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.size = [-1], [0]

    def add(self, symbols) -> None:
        nxt, link, size = self.next, self.link, self.size
        last = 0
        for c in symbols:
            to = nxt[last].get(c)
            if to is not None and size[to] == size[last] + 1:
                last = to
                continue
            if to is None:
                cur = len(nxt)
                nxt.append({})
                link.append(0)
                size.append(size[last] + 1)
                p = last
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = cur
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[cur] = q if size[q] == size[p] + 1 else self._split(p, c, q)
                last = cur
            else:
                last = self._split(last, c, to)

    def _split(self, p: int, c, q: int) -> int:
        nxt, link, size = self.next, self.link, self.size
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = clone
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        return clone

    def matching(self, symbols) -> list[int]:
        """For each symbol, the length of the longest known run that ends with it."""
        nxt, link, size = self.next, self.link, self.size
        state = have = 0
        out = []
        for c in symbols:
            while state and c not in nxt[state]:
                state = link[state]
                have = size[state]
            to = nxt[state].get(c)
            if to is None:
                have = 0
            else:
                state = to
                have += 1
            out.append(have)
        return out


def resolve(c: repeats.Contested) -> np.ndarray:
    """For each window of contested passages: whether it starts earlier in the corpus."""
    out, need = np.zeros(int(c.windows.sum()), bool), c.length
    spot = (np.cumsum(c.windows) - c.windows).tolist()
    anchor, doc, row, begin, at, windows = (x.tolist() for x in (c.anchor, c.doc, c.row, c.begin, c.at, c.windows))
    starts = lambda *keys: [i for i in range(len(anchor)) if not i or any(k[i] != k[i - 1] for k in keys)]
    several = np.zeros(len(anchor), bool)  # passages of ids with several rows under the anchor
    groups = [*starts(anchor, doc), len(anchor)]
    for a, b in zip(groups[:-1], groups[1:], strict=True):
        several[a:b] = row[a] != row[b - 1]
    shard = known = own = None
    waiting: list[list[int]] = []
    for i in range(len(anchor)):
        words = c.symbols[at[i] : at[i] + windows[i] + need - 1].tolist()
        if anchor[i] != shard:
            shard, known, own, waiting = anchor[i], SuffixAutomaton(), None, []
        elif doc[i] != doc[i - 1]:
            for held in waiting:
                known.add(held)
            own, waiting = None, []
        elif (row[i], begin[i]) == (row[i - 1], begin[i - 1]):  # the same row again
            out[spot[i] : spot[i] + windows[i]] = out[spot[i - 1] : spot[i - 1] + windows[i]]
            continue
        elif row[i] != row[i - 1]:
            own = None
        hits = [n >= need for n in known.matching(words)[need - 1 :]]
        if own:
            hits = [a or n >= need for a, n in zip(hits, own.matching(words)[need - 1 :], strict=True)]
        out[spot[i] : spot[i] + windows[i]] = hits
        if all(hits):
            continue
        if several[i]:
            own = own or SuffixAutomaton()
            own.add(words)
            waiting.append(words)
        else:
            known.add(words)
    return out


def _kept(block: tx.Block, starts: np.ndarray, ends: np.ndarray, first: np.ndarray, gone: np.ndarray) -> list[bytes]:
    """The words of each text that stay, joined by one space.

    A word that is not its text's last is followed by white space; that byte becomes
    the space.
    """
    text = tx.owner(first)[~gone]
    a, b = starts[~gone], ends[~gone].copy()
    last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
    data = block.data.copy()
    data[b[~last]] = 32
    b[~last] += 1
    delta = np.zeros(len(data) + 1, np.int8)
    delta[a] += 1
    delta[b] -= 1
    stay = np.cumsum(delta[:-1], dtype=np.int8) > 0
    left = data[stay].tobytes()
    cut = np.concatenate(([0], np.cumsum(stay)))[block.offsets]
    return [left[x:y] for x, y in zip(cut[:-1], cut[1:], strict=True)]


def _results(block: tx.Block, gone: np.ndarray, words, digests: bool):
    starts, ends, first = words
    removed = np.diff(np.concatenate(([0], np.cumsum(gone)))[first])
    kept = _kept(block, starts, ends, first, gone)
    return np.diff(first), removed, [tx.sha256(k) if digests else k.decode() for k in kept]


def remove_repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM, digests: bool = False) -> DataFrame:
    """One row a document: id, ``n_words``, ``n_removed`` and the words kept, joined by a space (or their sha256)."""
    kind = repeats.Kind(repeats.of_words, length, gram, np.uint64, True)
    spans, n = repeats.find(docs, kind, resolve, doc_id=doc_id, text=text)

    def finish(column, of):
        size, removed, kept = [], [], []
        for block in tx.blocks(column):
            words = block.words(tx.SPACED)
            first = words[2]
            found = [of(block.first + i) for i in range(block.n)]
            begin = np.concatenate([b + first[i] for i, (b, _) in enumerate(found)])
            end = np.concatenate([e + first[i] for i, (_, e) in enumerate(found)])
            x, y, z = _results(block, tx.union(begin, end, len(words[0])), words, digests)
            size.append(x)
            removed.append(y)
            kept += z
        return [pa.array(np.concatenate(size), pa.int64()), pa.array(np.concatenate(removed), pa.int64()), pa.array(kept, pa.string())]

    return repeats.gather(docs, spans, n, kind, finish, f"n_words long, n_removed long, {'kept_sha256' if digests else 'kept'} string", doc_id=doc_id, text=text)


def shards(reference: DataFrame, text: str, shard_words: int):
    """Automata of the reference, one shard at a time; a text longer than a shard is cut with an overlap of a window by the caller's choice of shard."""
    known, n = SuffixAutomaton(), 0
    for row in reference.select(F.col(f"`{text}`").alias("text")).dropna().toLocalIterator():
        block = next(tx.blocks(pa.array([row["text"]], pa.string())))
        starts, ends, _ = block.words(tx.SPACED)
        words = tx.Rolling(block.data).ranges(starts, ends).tolist()
        known.add(words)
        n += len(words)
        if n >= shard_words:
            yield known
            known, n = SuffixAutomaton(), 0
    if n:
        yield known


def remove_reference(docs: DataFrame, reference: DataFrame, *, text: str = "text", reference_text: str = "text", length: int = LENGTH, shard_words: int = SHARD_WORDS, keep: list[str] | None = None, into: str = "kept") -> DataFrame:
    """Add the text without the spans of ``length`` words or more that the reference holds.

    One automaton is broadcast at a time: a shard ends with the text that takes it to
    ``shard_words`` words, so its size is bounded by that and the longest text.
    """
    spark, out = docs.sparkSession, docs
    names = docs.columns if keep is None else keep
    marks = fresh(docs, "hits")[0]
    out = docs.withColumn(marks, F.expr("cast(array() as array<int>)"))
    for shard in shards(reference, reference_text, shard_words):
        held = spark.sparkContext.broadcast((shard.next, shard.link, shard.size))

        def make(held=held):
            known = SuffixAutomaton()
            known.next, known.link, known.size = held.value

            def work(column, batch):
                found = []
                for block in tx.blocks(column):
                    starts, ends, first = block.words(tx.SPACED)
                    h = tx.Rolling(block.data).ranges(starts, ends).tolist()
                    found += [[j for j, n in enumerate(known.matching(h[first[i] : first[i + 1]])) if n >= length] for i in range(block.n)]
                return [pa.array(found, pa.list_(pa.int32()))]

            return work

        more = fresh(out, "more")[0]
        out = map_texts(out, text, make, [T.StructField(more, T.ArrayType(T.IntegerType()))]).withColumn(marks, F.array_union(marks, F.col(more))).drop(more)

    def cut():
        def work(column, batch):
            hits = batch.column(batch.schema.get_field_index(marks))
            kept = []
            for block in tx.blocks(column):
                words = block.words(tx.SPACED)
                end = [np.array(hits[block.first + i].as_py(), np.int64) + words[2][i] + 1 for i in range(block.n)]
                end = np.concatenate(end)
                kept += _results(block, tx.union(end - length, end, len(words[0])), words, False)[2]
            return [pa.array(kept, pa.string())]

        return work

    made = fresh(out, "kept")[0]
    return map_texts(out, text, cut, [T.StructField(made, T.StringType())]).select(*[F.col(f"`{c}`") for c in names], F.col(made).alias(into))
