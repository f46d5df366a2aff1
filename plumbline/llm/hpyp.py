"""Language-model scoring by a hierarchical Pitman-Yor model of word pairs.

Every context (the word before) has a restaurant whose dishes are the words that
follow it; all share one parent, the restaurant of single words, whose base is
uniform over the vocabulary and one unknown word.  A dish's customers at a context
are its occurrences there; each table of a context is one customer of the parent.
In one sample of the seating the predictive probability of word w after u is

    (c_uw - d t_uw + (theta + d T_u) P(w)) / (theta + c_u)

and P(w) the same at the parent.  A text's score takes for each word the mean of these
probabilities over the kept samples.

Seating is sampled by Gibbs sweeps, contexts and parent in turn.  A dish is unseated and
its customers come back one by one: each sits at an old table with weight n - d t or
opens one with weight (theta + d T_u) P(w), the dish's own tables being taken out of T_u
and of the parent meanwhile.  The number seated before the next new table is drawn by
inverting its distribution, a ratio of gamma functions, so a dish costs its tables and
not its customers; a dish with one customer has one table and needs no draw.  Where the
next quarter of a dish's customers should open ``CROWD`` tables or more, their number is
drawn at once, from the normal distribution with its mean and variance.  The dishes of a
context are reseated in ``STEPS`` steps by rank, each of which sees the tables of the
steps before, so contexts of up to ``STEPS`` dishes are sampled one dish after the other;
those of over ``WIDE`` dishes, where one dish counts for little, in one step.  After every sweep of the contexts all their tables are added up at the one shared
parent, whose dishes are reseated before the next sweep: within a sweep contexts see the
parent of the sweep before, and the parent's dishes its total.  That is the usual
approximation of distributed Gibbs samplers.

A draw is a hash of context, word, sweep and step.  Counts are whole numbers.  So the
sample, and the scores, are the same for every number of partitions.

Distribution.  Nothing of the corpus is held in one place, and everything that is
gathered grows with it:

1. word counts, added up within each batch, are dealt by word;
2. each batch sends its distinct training pairs with their counts, dealt by context; a
   context with more tokens than ``HOT`` and a 65,536th of the corpus is dealt by pair,
   and its total of tables comes from the parent's buckets with the sweep before.  There
   are fewer than 65,536 such contexts, which bounds their broadcast;
3. a bucket keeps its dishes of two customers or more; in each sweep the parent's buckets
   send it the guests and tables of its words, and it sends back its tables;
4. parts of the documents, dealt by id, send their distinct pairs and words; the buckets
   answer each part, pair by pair, in its order;
5. the parts meet the answers, and texts are scored.

Parts of documents follow from their ids alone, so step 5 can be repeated anywhere.

Edge cases: a null or empty text is its end alone; a null id is not learnt from and
counts as held out; repeated rows are learnt from as often as they stand; without
training rows every word has the uniform probability.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import text as tx
from plumbline.llm.cluster import Scratch, parts
from plumbline.llm.repeats import DOCS, LAST, ROW, deal, dealt, ids_of, pack, rows, short, unpack, unshort

U64 = np.uint64
DISCOUNT, STRENGTH, TOP_DISCOUNT, TOP_STRENGTH = 0.75, 5.0, 0.6, 10.0
SWEEPS, BURN, STEPS = 3, 1, 8
KEPT = SWEEPS - BURN
HOT = 1 << 20
FEW, CROWD, WIDE = 8, 12, 64
COUNTS, PAIRS, WORDS, TABLES, VALUES, FACTS, TOTALS, SEATS, PARENT, WANT, CONTEXTS = range(10, 21)
M48 = U64((1 << 48) - 1)
#: Symbols that no word hashes to by rule: the end of a text and what stands before its first word.
END, START = U64(0x1), U64(0x2)


@dataclass
class Part:
    """Some texts as tokens (words and ends) with the tokens before them; the distinct of both and of their pairs."""

    text: np.ndarray
    trained: np.ndarray
    words: np.ndarray
    word: np.ndarray
    pairs: np.ndarray
    pair: np.ndarray


def is_training(ids: np.ndarray, modulus: int, remainder: int) -> np.ndarray:
    """Whether crc32 of the decimal id leaves another remainder; a null id is not learnt from."""
    return np.array([i != LAST and zlib.crc32(b"%d" % i) % modulus != remainder for i in ids.tolist()], bool)


def tokens(block: tx.Block) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of a block's texts, each closed by an end, and the text of each."""
    lower = tx.LOWER[block.data]
    starts, ends, first = block.words(tx.SPACED, lower)
    h = tx.Rolling(lower).ranges(starts, ends)
    at = first[1:]
    return np.insert(h, at, END), np.insert(tx.owner(first), at, np.arange(block.n))


def read_part(columns: list, train: np.ndarray) -> Part:
    found, n = [], 0
    for column in columns:
        for block in tx.blocks(column):
            h, text = tokens(block)
            found.append((h, text + n + block.first))
        n += len(column)
    h = np.concatenate([f[0] for f in found]) if found else np.zeros(0, U64)
    text = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    words, word = np.unique(np.append(h, START), return_inverse=True)
    start, word = word[-1], word[:-1]
    before = np.empty(len(word), np.int64)
    before[1:] = word[:-1]
    before[np.append(True, text[1:] != text[:-1])[: len(text)]] = start
    pairs, pair = np.unique(before << 32 | word, return_inverse=True)
    return Part(text, train[text] if len(text) else np.zeros(0, bool), words, word, pairs, pair)


def bucket_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys & M48) % U64(n)).astype(np.int32)


def pair_order(part: Part, hot: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pairs by bucket, then context: an order, where each bucket begins, and the context and word of each pair."""
    a, b = part.words[part.pairs >> 32], part.words[part.pairs & 0xFFFFFFFF]
    bucket = bucket_of(a, n)
    split = np.isin(a, hot)
    bucket[split] = bucket_of(tx.mix(a[split] + b[split] * U64(3)), n)
    return *deal(bucket, n), a, b


def word_order(part: Part, n: int) -> tuple[np.ndarray, np.ndarray]:
    return deal(bucket_of(part.words, n), n)


def count_words(n: int, modulus: int, remainder: int):
    """Step 1: training counts of a batch's words, for their buckets."""

    def run(batches):
        for batch in batches:
            train = is_training(ids_of(batch.column(0)), modulus, remainder)
            found = []
            for block in tx.blocks(batch.column(1)):
                h, text = tokens(block)
                found.append(np.unique(h[train[block.first + text]], return_counts=True))
            words, at = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            count = np.bincount(at, np.concatenate([f[1] for f in found]), len(words)).astype(np.int64)
            order, cut = deal(bucket_of(words, n), n)
            yield from rows([(p, COUNTS, pack(words[order[cut[p] : cut[p + 1]]], count[order[cut[p] : cut[p + 1]]])) for p in np.flatnonzero(np.diff(cut)).tolist()])

    return run


def _sum(blobs: list[list[bytes]], *kinds: type) -> list[np.ndarray]:
    """Keys and summed values of several messages of keys and values."""
    keys = np.concatenate([np.frombuffer(b[0], U64) for b in blobs]) if blobs else np.zeros(0, U64)
    own, at = np.unique(keys, return_inverse=True)
    out = [own]
    for k, t in enumerate(kinds, 1):
        total = np.zeros(len(own), np.int64)
        if blobs:
            np.add.at(total, at, np.concatenate([np.frombuffer(b[k], t) for b in blobs]).astype(np.int64))
        out.append(total)
    return out


def add_counts(batches):
    """One row of words and counts a bucket."""
    blobs, part = [], 0
    for batch in batches:
        part = batch.column(0)[0].as_py() if batch.num_rows else part
        blobs += [unpack(b.as_py()) for b in batch.column(2)]
    if blobs:
        yield from rows([(part, COUNTS, pack(*_sum(blobs, np.int64)))])


def _narrow(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts in one byte, and those that do not fit."""
    return np.minimum(counts, 255).astype(np.uint8), counts[counts >= 255].astype(np.int64)


def _wide(narrow: bytes, rest: bytes) -> np.ndarray:
    out = np.frombuffer(narrow, np.uint8).astype(np.int64)
    out[out == 255] = np.frombuffer(rest, np.int64)
    return out


def _pair_rows(p: Part, n: int, hot: np.ndarray, some: np.ndarray, told):
    """Rows of pairs for their buckets: contexts in runs, words, and what is ``told`` of each."""
    order, cut, a, b = pair_order(p, hot, n)
    for k in range(n):
        own = order[cut[k] : cut[k + 1]]
        own = own[some[own]]
        if len(own):
            x, y = tx.runs(a[own])
            yield from rows([(k, PAIRS, pack(short(a[own][x] << U64(16)), *_narrow(y - x), short(b[own] << U64(16)), *told(own)))])


def count_pairs(n: int, hot, modulus: int, remainder: int):
    """Step 2: training counts of a batch's pairs, for the buckets of their contexts."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                p = read_part([batch.column(1)], is_training(ids_of(batch.column(0)), modulus, remainder))
                count = np.bincount(p.pair[p.trained], minlength=len(p.pairs))
                yield from _pair_rows(p, n, hot.value, count > 0, lambda own, c=count: _narrow(c[own]))

    return run


def _read_pairs(sent: list[list[bytes]]) -> tuple[np.ndarray, ...]:
    """Of messages of pairs: the distinct contexts and words, the distinct pairs of their numbers, and the pair of each entry."""
    contexts, context = np.unique(np.concatenate([unshort(s[0]) for s in sent]), return_inverse=True)
    context = np.repeat(context, np.concatenate([_wide(s[1], s[2]) for s in sent]))
    words, word = np.unique(np.concatenate([unshort(s[3]) for s in sent]), return_inverse=True)
    keys, at = np.unique(context << 32 | word, return_inverse=True)
    return contexts >> U64(16), words >> U64(16), keys, at


@dataclass
class Seats:
    """A bucket's dishes of two customers or more, by context and word.

    ``words`` are ordered by bucket, so that what a bucket of the parent sends of them is
    one run; so are ``hot``, the contexts that share their dishes with other buckets.
    ``alone`` are the tables of a context's other dishes, ``history`` all its tables here
    in the kept sweeps, ``kept`` the sum of a dish's tables in these.
    """

    contexts: np.ndarray
    alone: np.ndarray
    words: np.ndarray
    hot: np.ndarray
    hot_at: np.ndarray
    context: np.ndarray
    word: np.ndarray
    customers: np.ndarray
    tables: np.ndarray
    kept: np.ndarray
    history: np.ndarray

    KINDS = (U64, np.int64, U64, U64, np.int64, np.uint32, np.uint32, np.int64, np.int64, np.int64, np.int64)

    def row(self, bucket: int) -> tuple[int, int, bytes]:
        return bucket, SEATS, pack(*(getattr(self, f.name).astype(t) for f, t in zip(fields(self), self.KINDS, strict=True)))

    @classmethod
    def read(cls, blob: bytes) -> Seats:
        return cls(*(np.frombuffer(b, t) for b, t in zip(unpack(blob), cls.KINDS, strict=True)))

    def opened(self) -> np.ndarray:
        """Tables of each context in this bucket."""
        out = self.alone.copy()
        np.add.at(out, self.context, self.tables)
        return out


def _by_bucket(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((keys, bucket_of(keys, n)))
    return order, np.searchsorted(bucket_of(keys, n)[order], np.arange(n + 1))


def seat(n: int, hot):
    """The first seating, one table a dish, and what the bucket needs of the parent's buckets in every sweep."""

    def run(batches):
        sent, bucket = [], 0
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                bucket = part
                sent.append(unpack(blob))
        if not sent:
            return
        contexts, words, keys, at = _read_pairs(sent)
        customers = np.zeros(len(keys), np.int64)
        np.add.at(customers, at, np.concatenate([_wide(s[4], s[5]) for s in sent]))
        context, word = keys >> 32, keys & 0xFFFFFFFF
        many = customers > 1
        alone, base = np.bincount(context[~many], minlength=len(contexts)), np.bincount(word[~many], minlength=len(words))
        tables = np.bincount(word[many], minlength=len(words))
        used, hot_here = np.flatnonzero(tables), np.flatnonzero(np.isin(contexts, hot.value & M48))
        order, cut = _by_bucket(words[used], n)
        used = used[order]
        hot_order, hot_cut = _by_bucket(contexts[hot_here], n)
        hot_here = hot_here[hot_order]
        number = np.zeros(len(words), np.int64)
        number[used] = np.arange(len(used))
        s = Seats(contexts, alone, words[used], contexts[hot_here], hot_here, context[many], number[word[many]], customers[many], np.ones(int(many.sum())), np.zeros(int(many.sum())), np.zeros(0))
        opened = s.opened().astype(np.int64)
        yield from rows([s.row(bucket)])
        order, base_cut = _by_bucket(words, n)
        words, base = words[order], base[order]
        order, fixed_cut = _by_bucket(contexts, n)
        contexts, alone = contexts[order], alone[order]
        for k in range(n):
            own, mine, b, c = slice(cut[k], cut[k + 1]), slice(hot_cut[k], hot_cut[k + 1]), slice(base_cut[k], base_cut[k + 1]), slice(fixed_cut[k], fixed_cut[k + 1])
            if any(x.start < x.stop for x in (own, mine, b, c)):
                yield from rows([(k, WANT, pack(np.array([bucket]), s.words[own], tables[used][own].astype(np.int64), s.hot[mine], opened[hot_here][mine], words[b], base[b].astype(np.int64), contexts[c]))])

    return run


@dataclass
class Parent:
    """A bucket of the parent: its words (and contexts), their counts, guests and tables.

    ``base`` are guests that never change, ``opened`` all tables of hot contexts, ``top``
    the guests less the tables' discounts in the kept sweeps; ``who`` wants the words
    ``own`` and the contexts ``heat``, ``cut`` and ``heat_cut`` long.
    """

    words: np.ndarray
    count: np.ndarray
    base: np.ndarray
    guests: np.ndarray
    tables: np.ndarray
    opened: np.ndarray
    top: np.ndarray
    who: np.ndarray
    own: np.ndarray
    cut: np.ndarray
    heat: np.ndarray
    heat_cut: np.ndarray

    KINDS = (U64, np.int64, np.int64, np.int64, np.int64, np.int64, np.float32, np.int64, np.uint32, np.int64, np.uint32, np.int64)

    def row(self, bucket: int) -> tuple[int, int, bytes]:
        return bucket, PARENT, pack(*(getattr(self, f.name).astype(t) for f, t in zip(fields(self), self.KINDS, strict=True)))

    @classmethod
    def read(cls, blob: bytes) -> Parent:
        return cls(*(np.frombuffer(b, t) for b, t in zip(unpack(blob), cls.KINDS, strict=True)))

    def totals(self) -> tuple[int, int, bytes]:
        return 0, TOTALS, pack(np.array([self.guests.sum(), self.tables.sum()], np.int64))


def set_up(batches):
    """The parent's buckets before the first sweep, from word counts and what the buckets of contexts want."""
    counts, wants, bucket = [], [], 0
    for batch in batches:
        for part, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            bucket = part
            (counts if kind == COUNTS else wants).append(unpack(blob))
    if not counts and not wants:
        return
    wants.sort(key=lambda w: np.frombuffer(w[0], np.int64)[0])
    counted, count = _sum(counts, np.int64)
    words = np.unique(np.concatenate([counted & M48, *(np.frombuffer(w[7], U64) for w in wants)]))
    size = len(words)
    at = lambda b: np.searchsorted(words, np.frombuffer(b, U64))
    total = np.zeros((4, size), np.int64)
    np.add.at(total[0], np.searchsorted(words, counted & M48), count)
    own, heat = [at(w[1]) for w in wants], [at(w[3]) for w in wants]
    for w, a, h in zip(wants, own, heat, strict=True):
        np.add.at(total[1], a, np.frombuffer(w[2], np.int64))
        np.add.at(total[2], at(w[5]), np.frombuffer(w[6], np.int64))
        np.add.at(total[3], h, np.frombuffer(w[4], np.int64))
    guests = total[1] + total[2]
    none = [np.zeros(0, np.int64)]
    p = Parent(words, total[0], total[2], guests, np.minimum(guests, 1), total[3], np.zeros(0), np.array([np.frombuffer(w[0], np.int64)[0] for w in wants]), np.concatenate(own or none), np.array([len(x) for x in own]), np.concatenate(heat or none), np.array([len(x) for x in heat]))
    yield from rows([p.row(bucket), p.totals()])


def tell(batches):
    """What the parent's buckets send to the buckets of contexts: guests and tables of words, tables of hot contexts."""
    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            p = Parent.read(blob)
            own, heat = np.split(p.own, np.cumsum(p.cut)[:-1]), np.split(p.heat, np.cumsum(p.heat_cut)[:-1])
            for who, a, h in zip(p.who.tolist(), own, heat, strict=False):
                if len(a) or len(h):
                    yield from rows([(who, FACTS, pack(np.array([bucket]), p.guests[a], p.tables[a], p.opened[h]))])


def _unit(h: np.ndarray) -> np.ndarray:
    """Numbers between 0 and 1, neither included."""
    return (h >> U64(11)).astype(np.float64) * 2.0**-53 + 2.0**-54


def _rise(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    """log gamma(a + w) - log gamma(a), by Stirling's series from a + 10 on."""
    product = np.ones(len(a))
    for k in range(10):
        product *= 1 + w / (a + k)
    a = a + 10
    return (a - 0.5) * np.log1p(w / a) + w * (np.log(a + w) - 1) + (1 / (a + w) - 1 / a) / 12 - np.log(product)


def reseat(customers: np.ndarray, weight, discount: float, key: np.ndarray) -> np.ndarray:
    """Tables of dishes whose customers come back one by one; ``weight(rows, tables)`` is that of a new table, ``key`` makes the draws."""
    tables = np.minimum(customers, 1)
    active = np.flatnonzero(customers > 1)
    n, step = np.ones(len(active)), 0
    while len(active):
        step += 1
        draw = tx.mix(key[active] + U64(step * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        held, left = tables[active], customers[active] - n
        w, a = np.maximum(weight(active, held), 1e-300), n - discount * held
        many = np.minimum(np.floor(n / 4), left)
        opened = w * np.log1p(many / (w + a))
        slope = 1 - discount * opened / np.maximum(many, 1)  # new tables lower the weight of the old ones meanwhile
        opened = w / slope * np.log1p(slope * many / (w + a))
        crowd = np.flatnonzero(opened >= CROWD)
        out = np.full(len(active), np.nan)
        few = np.setdiff1d(np.arange(len(active)), crowd, assume_unique=True) if len(crowd) else slice(None)
        seated = _seated(a[few], w[few], left[few], _unit(draw[few]))
        out[few] = np.where(seated >= 0, n[few] + seated + 1, np.inf)
        tables[active[few]] += seated >= 0
        if len(crowd):
            wide, mean, upto = w[crowd], opened[crowd], w[crowd] + a[crowd]
            spread = np.sqrt(np.maximum(mean - wide * wide * (1 / upto - 1 / (upto + many[crowd])), 0))
            normal = np.sqrt(-2 * np.log(_unit(draw[crowd]))) * np.cos(2 * np.pi * _unit(tx.mix(~draw[crowd])))
            tables[active[crowd]] += np.clip(np.rint(mean + spread * normal), 0, many[crowd]).astype(np.int64)
            out[crowd] = n[crowd] + many[crowd]
        stay = out < customers[active]
        active, n = active[stay], out[stay]
    return tables


def _seated(a: np.ndarray, w: np.ndarray, left: np.ndarray, u: np.ndarray) -> np.ndarray:
    """How many customers sit at old tables (weight ``a``, one more each) before one opens a new one (weight ``w``); -1 if none of those left does.

    The first ``FEW`` customers are followed one by one, the others by the logarithm of
    the chance that none opens, a ratio of gamma functions, searched by halves.
    """
    out, go, chance = np.full(len(a), -1.0), np.arange(len(a)), np.ones(len(a))
    for k in range(FEW):
        chance = chance[: len(go)] * (a[go] + k) / (a[go] + k + w[go])
        now = chance <= u[go]
        out[go[now]] = k
        stay = ~now & (left[go] > k + 1)
        go, chance = go[stay], chance[stay]
        if not len(go):
            return out
    a, w, left, u = a[go], w[go], left[go], np.log(u[go])
    first = _rise(a, w)
    opens = np.flatnonzero(first - _rise(a + left, w) <= u)
    low, high = np.full(len(opens), float(FEW)), left[opens] - 1
    search = np.flatnonzero(low < high)
    while len(search):
        own = opens[search]
        middle = np.floor((low[search] + high[search]) / 2)
        yes = first[own] - _rise(a[own] + middle + 1, w[own]) <= u[own]
        high[search[yes]], low[search[~yes]] = middle[yes], middle[~yes] + 1
        search = search[low[search] < high[search]]
    out[go[opens]] = low
    return out


def steps_of(context: np.ndarray) -> np.ndarray:
    """The step of each dish, given the contexts of dishes in order."""
    begin, end = tx.runs(context)
    size = np.repeat(end - begin, end - begin)
    return np.where(size > WIDE, 0, (np.arange(len(context)) - np.repeat(begin, end - begin)) * STEPS // np.maximum(size, 1))


def seat_again(s: Seats, facts: list[list[bytes]], sweep: int, served: int, top_tables: int, vocabulary: int) -> Seats:
    """One sweep of the contexts of a bucket."""
    facts = sorted(facts, key=lambda f: np.frombuffer(f[0], np.int64)[0])
    guests, parent, heat = (np.concatenate([np.zeros(0, np.int64), *(np.frombuffer(f[k], np.int64) for f in facts)]) for k in (1, 2, 3))
    guests, parent, opened, tables = guests[s.word], parent[s.word], s.opened(), s.tables.copy()
    opened[s.hot_at] = heat
    split = np.zeros(len(s.contexts), bool)
    split[s.hot_at] = True
    base = (TOP_STRENGTH + TOP_DISCOUNT * top_tables) / (vocabulary + 1)
    key = tx.mix(s.contexts[s.context] * U64(0x9FB21C651E98DF25) + tx.mix(s.words[s.word] + U64(sweep)))
    step = steps_of(s.context)
    for k in range(STEPS):
        own = np.flatnonzero(step == k)
        held = tables[own]
        others, left = opened[s.context[own]] - held, guests[own] - held
        chance = (left - TOP_DISCOUNT * np.minimum(parent[own], left) + base) / (TOP_STRENGTH + served - held)
        tables[own] = reseat(s.customers[own], lambda r, t, o=others, c=chance: (STRENGTH + DISCOUNT * (o[r] + t)) * c[r], DISCOUNT, key[own])
        change = np.where(split[s.context[own]], 0, tables[own] - held)
        np.add.at(opened, s.context[own], change)
    out = Seats(s.contexts, s.alone, s.words, s.hot, s.hot_at, s.context, s.word, s.customers, tables, s.kept, s.history)
    if sweep >= BURN:
        out.kept, out.history = s.kept + tables, np.concatenate([s.history, out.opened()])
    return out


def sweep_contexts(n: int, sweep: int, served: int, top_tables: int, vocabulary: int):
    """Step 3: a bucket's dishes are reseated; their tables go to the parent's buckets."""

    def run(batches):
        held, facts = None, []
        for batch in batches:
            for part, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == SEATS:
                    held = part, Seats.read(blob)
                else:
                    facts.append(unpack(blob))
        if held is None:
            return
        bucket, s = held
        s = seat_again(s, facts, sweep, served, top_tables, vocabulary)
        tables, opened = np.zeros(len(s.words), np.int64), s.opened()[s.hot_at]
        np.add.at(tables, s.word, s.tables)
        cut, hot_cut = (np.searchsorted(bucket_of(x, n), np.arange(n + 1)) for x in (s.words, s.hot))
        yield from rows([s.row(bucket)])
        yield from rows([(k, TABLES, pack(np.array([bucket]), tables[cut[k] : cut[k + 1]], opened[hot_cut[k] : hot_cut[k + 1]])) for k in np.flatnonzero(np.diff(cut) + np.diff(hot_cut)).tolist()])

    return run


def sweep_parent(sweep: int, top_tables: int, vocabulary: int):
    """The parent's dishes of a bucket are reseated."""

    def run(batches):
        held, sent = None, []
        for batch in batches:
            for part, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == PARENT:
                    held = part, Parent.read(blob)
                else:
                    sent.append(unpack(blob))
        if held is None:
            return
        bucket, p = held
        sent.sort(key=lambda w: np.frombuffer(w[0], np.int64)[0])
        guests, opened = p.base.copy(), np.zeros(len(p.words), np.int64)
        if sent:
            np.add.at(guests, p.own, np.concatenate([np.frombuffer(w[1], np.int64) for w in sent]))
            np.add.at(opened, p.heat, np.concatenate([np.frombuffer(w[2], np.int64) for w in sent]))
        weight = lambda r, t: (TOP_STRENGTH + TOP_DISCOUNT * (top_tables - p.tables[r] + t)) / (vocabulary + 1)
        tables = reseat(guests, weight, TOP_DISCOUNT, tx.mix(p.words + U64(sweep * 0xD6E8FEB86659FD93 & (1 << 64) - 1)))
        top = np.concatenate([p.top, (guests - TOP_DISCOUNT * tables).astype(np.float32)]) if sweep >= BURN else p.top
        p = Parent(p.words, p.count, p.base, guests, tables, opened, top, p.who, p.own, p.cut, p.heat, p.heat_cut)
        yield from rows([p.row(bucket), p.totals()])

    return run


def send_contexts(n: int):
    """The tables of contexts in the kept sweeps, for the buckets that answer for them."""

    def run(batches):
        for batch in batches:
            for blob in batch.column(2).to_pylist():
                s = Seats.read(blob)
                order, cut = _by_bucket(s.contexts, n)
                history = s.history.reshape(KEPT, -1)[:, order]
                yield from rows([(k, CONTEXTS, pack(s.contexts[order[cut[k] : cut[k + 1]]], *history[:, cut[k] : cut[k + 1]])) for k in np.flatnonzero(np.diff(cut)).tolist()])

    return run


def ask(n: int, hot, modulus: int, remainder: int):
    """Step 4: a part's distinct pairs, with whether it trains on them once or more often, and its words."""

    def run(batches):
        part, columns, train = None, [], []
        for batch in batches:
            if batch.num_rows:
                part = batch.column(0)[0].as_py()
                columns.append(batch.column(4))
                train.append(is_training(ids_of(batch.column(3)), modulus, remainder))
        if part is None:
            return
        p = read_part(columns, np.concatenate(train))
        count = np.minimum(np.bincount(p.pair[p.trained], minlength=len(p.pairs)), 2).astype(np.uint8)
        yield from _pair_rows(p, n, hot.value, np.ones(len(p.pairs), bool), lambda own: [count[own], np.array([part])])
        order, cut = word_order(p, n)
        yield from rows([(k, WORDS, pack(np.array([part]), p.words[order[cut[k] : cut[k + 1]]])) for k in np.flatnonzero(np.diff(cut)).tolist()])

    return run


def answer(batches):
    """For the parts: the discounted customers of their pairs; counts, parent's guests and contexts' tables of their words."""
    asked, wanted, contexts, bucket, s, p = [], [], [], 0, None, None
    for batch in batches:
        for part, kind, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            bucket = part
            if kind == SEATS:
                s = Seats.read(blob)
            elif kind == PARENT:
                p = Parent.read(blob)
            else:
                {PAIRS: asked, WORDS: wanted, CONTEXTS: contexts}[kind].append(unpack(blob))
    if asked:
        own, words, keys, at = _read_pairs(asked)
        times = np.zeros(len(keys), np.int64)
        np.add.at(times, at, np.concatenate([np.frombuffer(a[4], np.uint8) for a in asked]))
        value = np.zeros(len(keys), np.float32)
        if s is not None and len(s.context):
            # Where the bucket's contexts and words stand in those asked for.
            context, word = _spots(own, s.contexts)[s.context], _spots(words, s.words)[s.word]
            some = np.flatnonzero((context >= 0) & (word >= 0))
            value[np.searchsorted(keys, context[some] << 32 | word[some])] = s.customers[some] - DISCOUNT * s.kept[some] / KEPT
        few, spot = np.minimum(times, 2).astype(np.uint8), 0
        for a in asked:
            size = len(a[3]) // 6
            yield from rows([(int(np.frombuffer(a[5], np.int64)[0]), VALUES, pack(np.array([bucket]), few[own := at[spot : spot + size]], value[own[few[own] == 2]]))])
            spot += size
    keys, *opened = _sum(contexts, *[np.int64] * KEPT)
    top = p.top.reshape(KEPT, -1) if p is not None else np.zeros((KEPT, 0))
    known, count = (p.words, p.count) if p is not None else (np.zeros(0, U64), np.zeros(0, np.int64))
    for part, own in wanted:
        own = np.frombuffer(own, U64) & M48
        yield from rows([(int(np.frombuffer(part, np.int64)[0]), FACTS, pack(np.array([bucket]), _of(known, count, own).astype(np.int64), *(_of(known, t, own).astype(np.float32) for t in top), *(_of(keys, t, own).astype(np.int64) for t in opened)))])


def _spots(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted key stands; -1 for others."""
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return np.where(keys[at] == wanted, at, -1)


def _of(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values by key; 0 for others."""
    if not len(keys):
        return np.zeros(len(wanted))
    at = _spots(keys, wanted)
    return np.where(at >= 0, values[at], 0)


@dataclass(frozen=True)
class Totals:
    """Training tokens, distinct ones and texts; guests and tables of the parent in the kept sweeps."""

    tokens: int
    vocabulary: int
    texts: int
    served: tuple[int, ...]
    tables: tuple[int, ...]

    def single(self, top: np.ndarray) -> np.ndarray:
        """P(w) in each kept sweep, from the guests less discounts of words."""
        served, tables = (np.array(x, np.float64)[:, None] for x in (self.served, self.tables))
        return (top + (TOP_STRENGTH + TOP_DISCOUNT * tables) / (self.vocabulary + 1)) / (TOP_STRENGTH + served)


def score_part(n: int, hot, modulus: int, remainder: int, totals: Totals):
    """Step 5."""

    def run(batches):
        values, facts, docs = {}, {}, []
        for batch in batches:
            kinds = batch.column(1).to_numpy()
            for i in np.flatnonzero(kinds != DOCS).tolist():
                got = unpack(batch.column(2)[i].as_py())
                (values if kinds[i] == VALUES else facts)[int(np.frombuffer(got[0], np.int64)[0])] = got[1:]
            if (kinds == DOCS).any():
                docs.append(batch.filter(pa.array(kinds == DOCS)).select([3, 4]))
        if not docs:
            return
        train = [is_training(ids_of(d.column(0)), modulus, remainder) for d in docs]
        p = read_part([d.column(1) for d in docs], np.concatenate(train))
        order, cut, _, _ = pair_order(p, hot.value, n)
        value = np.zeros(len(p.pairs))
        for k, v in values.items():
            few = np.frombuffer(v[0], np.uint8)
            own = (1 - DISCOUNT) * few
            own[few == 2] = np.frombuffer(v[1], np.float32)
            value[order[cut[k] : cut[k + 1]]] = own
        order, cut = word_order(p, n)
        count, top, opened = np.zeros(len(p.words), np.int64), np.zeros((KEPT, len(p.words)), np.float32), np.zeros((KEPT, len(p.words)), np.int64)
        for k, v in facts.items():
            own = order[cut[k] : cut[k + 1]]
            count[own] = np.frombuffer(v[0], np.int64)
            for j in range(KEPT):
                top[j, own], opened[j, own] = np.frombuffer(v[1 + j], np.float32), np.frombuffer(v[1 + KEPT + j], np.int64)
        single = totals.single(top)
        context, word = p.pairs >> 32, p.pairs & 0xFFFFFFFF
        shared = np.zeros(len(p.pairs))
        for j in range(KEPT):
            shared += (STRENGTH + DISCOUNT * opened[j, context]) * single[j, word] / KEPT
        seen = np.where(p.words == START, totals.texts, count)
        probability = (value + shared) / (STRENGTH + seen[context])
        size = sum(len(t) for t in train)
        base = np.log10((count + 0.1) / (totals.tokens + 0.1 * (totals.vocabulary + 1)))
        sums = [np.bincount(p.text, minlength=size), np.bincount(p.text, count[p.word] > 0, size).astype(np.int64), np.bincount(p.text, base[p.word], size), np.bincount(p.text, np.log10(probability)[p.pair], size)]
        at = 0
        for d, t in zip(docs, train, strict=True):
            own = slice(at, at + len(t))
            at += len(t)
            yield pa.RecordBatch.from_arrays([d.column(0), pa.array(~t), *(pa.array(x[own]) for x in sums[:2]), pa.array(np.full(len(t), totals.tokens)), *(pa.array(x[own]) for x in sums[2:])], names=["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", modulus: int = 10, remainder: int = 0) -> DataFrame:
    """Each row's id with token counts, the base model's and this model's log10 probability; texts with crc32(id) mod ``modulus`` = ``remainder`` are held out."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    n, part, kind = parts(docs, text), F.col("part"), F.col("kind")
    read = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    dealt_by = lambda messages, work: scratch.cut(messages.repartitionById(n, part).mapInArrow(work, ROW))
    counted = dealt_by(read.mapInArrow(count_words(n, modulus, remainder), ROW), add_counts)
    tokens_, vocabulary, texts, hot = _totals(counted)
    held = spark.sparkContext.broadcast(hot)
    seated = dealt_by(read.mapInArrow(count_pairs(n, held, modulus, remainder), ROW), seat(n, held))
    parent = dealt_by(seated.where(kind == WANT).unionByName(counted), set_up)
    scratch.drop(counted)
    served, tables = [], []
    now = _parent_totals(parent)
    for sweep in range(SWEEPS):
        told = parent.where(kind == PARENT).mapInArrow(tell, ROW)
        again = dealt_by(seated.where(kind == SEATS).unionByName(told), sweep_contexts(n, sweep, *now, vocabulary))
        scratch.drop(seated)
        after = dealt_by(again.where(kind == TABLES).unionByName(parent.where(kind == PARENT)), sweep_parent(sweep, now[1], vocabulary))
        scratch.drop(parent)
        seated, parent = again, after
        now = _parent_totals(parent)
        if sweep >= BURN:
            served.append(now[0])
            tables.append(now[1])
    seats = seated.where(kind == SEATS)
    asked = dealt(read, n).repartitionById(n, part).mapInArrow(ask(n, held, modulus, remainder), ROW)
    told = dealt_by(asked.unionByName(seats).unionByName(seats.mapInArrow(send_contexts(n), ROW)).unionByName(parent.where(kind == PARENT)), answer)
    scratch.drop(seated)
    scratch.drop(parent)
    scratch.release()
    both = dealt(read, n).unionByName(told, allowMissingColumns=True).repartitionById(n, part)
    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    totals = Totals(tokens_, vocabulary, texts, tuple(served), tuple(tables))
    return both.mapInArrow(score_part(n, held, modulus, remainder, totals), schema).withColumnRenamed("id", doc_id)


def _parent_totals(parent: DataFrame) -> tuple[int, int]:
    """Guests and tables of the parent, from one row a bucket."""
    sums = [np.frombuffer(unpack(bytes(r["blob"]))[0], np.int64) for r in parent.where(F.col("kind") == TOTALS).select("blob").collect()]
    return tuple(np.array(sums, np.int64).reshape(-1, 2).sum(0).tolist())


def _totals(counted: DataFrame) -> tuple[int, int, int, np.ndarray]:
    """Training tokens, distinct ones, texts, and the hot contexts."""

    def measure(batches):
        for batch in batches:
            for blob in batch.column(2):
                words, count = (np.frombuffer(b, t) for b, t in zip(unpack(blob.as_py()), (U64, np.int64), strict=True))
                hot = count > HOT
                yield pa.RecordBatch.from_arrays([pa.array([int(count.sum())]), pa.array([len(words)]), pa.array([int(_of(words, count, np.array([END]))[0])]), pa.array([words[hot].view(np.int64).tolist()], pa.list_(pa.int64())), pa.array([count[hot].tolist()], pa.list_(pa.int64()))], names=["total", "words", "texts", "hot", "n"])

    seen = counted.mapInArrow(measure, "total long, words long, texts long, hot array<long>, n array<long>")
    sums = seen.agg(F.sum("total").alias("total"), F.sum("words").alias("words"), F.sum("texts").alias("texts")).first()
    total, words, texts = (int(x or 0) for x in sums)
    rows_ = seen.select(F.explode(F.arrays_zip("hot", "n")).alias("w")).where(F.col("w.n") * 65_536 > total).select("w.hot").collect() if total else []
    return total, words, texts, np.sort(np.array([r[0] for r in rows_] + ([START.view(np.int64)] if texts > HOT and texts * 65_536 > total else []), np.int64).view(U64))
