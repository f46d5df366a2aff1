"""BPE encoding and decoding by a tokenization automaton.

Construction.  The automaton starts with one state and an arc for every byte.
Each merge ``(u, v) -> w``, in order of rank, is a gadget: the state that ``u``
reaches is copied without its arc ``v``, and an arc ``w`` joins every state that
has an arc ``u`` to the state that ``v`` reached.  Arcs into ``w`` are thus those
into ``u`` after the gadget, arcs out of ``w`` are those out of ``v`` before it,
and the only arc a gadget removes is ``v`` after ``u``.  ``Automaton.allows``
reads a state's arcs off these three facts, so the tables keep the gadgets and
not the square of the vocabulary.

Encoding.  A sequence of arcs is the BPE of its bytes exactly if each arc is
allowed after the one before.  Every prefix of a word then has one last arc, so
reading bytes is deterministic: ``Encoder.step`` maps (state, byte) to a state,
filled as words ask for it, and a state holds its last arc and the state before
it.  Words are pre-split by the public pattern; words already read are looked up.
Decoding emits the labels (bytes) of the arcs.

Memory: a task's tables stop growing at ``MAX_STATES`` states and are read on; the
table of words is emptied at ``MAX_WORDS``; words over ``LONG_WORD`` bytes keep no
states.  Every word is read in full.  Ids leave as an Arrow array of 32-bit numbers,
some rows at a time, and a text decoded to compare it is not kept.

Edge cases: a null or empty text has no tokens and decodes to an empty text; the
strings of special tokens in a text become their ids, as the library does.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import text as tx
from plumbline.llm.cluster import fresh, map_texts, others

#: Fixed value: the public pattern that splits a text into words before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
MAX_STATES, MAX_WORDS, LONG_WORD = 200_000, 200_000, 64


def _byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, the rest follow from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """The gadgets of a byte-level BPE vocabulary."""

    def __init__(self, labels: list[bytes], merges: list[tuple[int, int, int]], special: dict[str, int]):
        self.labels, self.special = labels, special
        self.rank = [-1] * len(labels)
        self.parts: list[tuple[int, int] | None] = [None] * len(labels)
        self.removed: dict[tuple[int, int], int] = {}
        for r, (u, v, w) in enumerate(merges):
            self.removed.setdefault((u, v), r)
            if self.parts[w] is None and len(labels[w]) > 1:
                self.parts[w], self.rank[w] = (u, v), r
        self.ids = {label: i for i, label in enumerate(labels) if len(label) == 1 or self.parts[i]}
        self.begun = {label[:n] for label in self.ids for n in range(1, len(label) + 1)}
        self.known: dict[int, bool] = {}

    @classmethod
    def load(cls, path: str) -> Automaton:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = _byte_letters()
        vocab, added = spec["model"]["vocab"], {x["content"]: x["id"] for x in spec["added_tokens"]}
        labels = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            labels[i] = bytes(letters[c] for c in token)
        for token, i in added.items():
            labels[i] = token.encode()
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        return cls(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs], added)

    def allows(self, a: int, b: int) -> bool:
        """Whether the state that arc ``a`` reaches has an arc ``b``."""
        out = self._has(a, b, len(self.removed))
        if len(self.known) < MAX_STATES:
            self.known[a << 32 | b] = out
        return out

    def _has(self, a: int, b: int, when: int) -> bool:
        """The same after the gadgets of rank below ``when``."""
        while True:
            if self.removed.get((a, b), when) < when:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                a, when = self.parts[a][1], ra
            else:
                b, when = self.parts[b][0], rb + 1

    def decode(self, ids) -> str:
        """The labels of the arcs, as text."""
        return b"".join([self.labels[i] for i in ids]).decode("utf-8", "replace")


class Encoder(dict):
    """Words by their ids, written as decimals with commas; filled by reading unknown words."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.a = automaton
        self.split = regex.compile(PATTERN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(automaton.special, key=len, reverse=True))) + ")").split if automaton.special else None
        self.step: dict[int, int] = {}
        self.last, self.back, self.low = [-1], [-1], [0]

    def __missing__(self, word: str) -> str:
        out = self[word] = ",".join(map(str, self.read(word.encode())))
        return out

    def read(self, data: bytes) -> list[int]:
        """The arcs that read a word, by the table where it is filled; a full table is read and not extended."""
        step, lasts, backs, lows = self.step, self.last, self.back, self.low
        fill = len(data) <= LONG_WORD and len(lasts) < MAX_STATES
        state, low, path, last, starts = 0, 0, [0], [-1], [0]
        for end, byte in enumerate(data, 1):
            to = step.get(state << 8 | byte) if state >= 0 else None
            if to is not None:
                low = lows[to]
                last.append(lasts[to])
                starts.append(backs[to])
                path.append(to)
                state = to
                continue
            arc, start, low = self._arc(data, end, last, low)
            last.append(arc)
            starts.append(start)
            if fill and state >= 0:
                to = step[state << 8 | byte] = len(lasts)
                lasts.append(arc)
                backs.append(start)
                lows.append(low)
                state = to
            else:
                state = -1
        out, end = [], len(data)
        while end:
            out.append(last[end])
            end = starts[end]
        return out[::-1]

    def _arc(self, data: bytes, end: int, last: list[int], low: int) -> tuple[int, int, int]:
        """The one arc that ends the first ``end`` bytes, where it begins, and where the longest beginning of a label begins."""
        a = self.a
        ids, known, begun = a.ids, a.known, a.begun
        while data[low:end] not in begun:
            low += 1
        for start in range(low, end):
            arc = ids.get(data[start:end])
            if arc is not None:
                if not start:
                    return arc, start, low
                key = last[start] << 32 | arc
                ok = known.get(key)
                if a.allows(last[start], arc) if ok is None else ok:
                    return arc, start, low
        raise ValueError("the vocabulary lacks a byte")

    def encode(self, text: str) -> str:
        """Ids of a whole text, as decimals with commas."""
        if len(self) > MAX_WORDS:
            self.clear()
        if self.cut is None or not any(s in text for s in self.a.special):
            return ",".join(map(self.__getitem__, self.split(text)))
        parts = []
        for piece in self.cut(text):
            if piece in self.a.special:
                parts.append(str(self.a.special[piece]))
            elif piece:
                parts.append(",".join(map(self.__getitem__, self.split(piece))))
        return ",".join(parts)


class Decoder(dict):
    """Runs of ids by the bytes of their labels."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.labels = automaton.labels

    def __missing__(self, ids: str) -> bytes:
        if len(self) > MAX_STATES:
            self.clear()
        out = self[ids] = self.labels[int(ids)]
        return out

    def decode(self, ids: str) -> str:
        return b"".join(map(self.__getitem__, ids.split(","))).decode("utf-8", "replace") if ids else ""


#: What ``tokenize`` can tell of the decoded text beside the ids.
DECODED = {"decoded": T.StringType(), "exact": T.BooleanType()}


def _id_lists(runs: list[str], n: list[int]) -> pa.Array:
    """Lists of ids written as decimals with commas."""
    values = np.fromstring(",".join([r for r in runs if r]), np.int32, sep=",") if any(n) else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(values))


def tokenize(docs: DataFrame, path: str, *, text: str = "text", into: str = "bpe", keep: list[str] | None = None, digests: bool = False, told: str = "decoded") -> DataFrame:
    """Add a struct of ``n_tokens``, ``ids`` and what is ``told`` of the decoding: the ``decoded`` text, or whether it is ``exact``.

    With ``digests`` the struct has the sha256 of ids and decoded text instead.
    ``path`` is the vocabulary file, read on the driver; its size bounds the broadcast.
    """
    held = docs.sparkSession.sparkContext.broadcast(Automaton.load(path))

    def make():
        automaton = held.value
        encoder, decoder = Encoder(automaton), Decoder(automaton)

        def work(column, batch):
            n, ids, decoded = [], [], []
            for value in column:
                t = value.as_py() or ""
                run = encoder.encode(t)
                back = decoder.decode(run)
                n.append(run.count(",") + 1 if run else 0)
                ids.append(tx.sha256(run.encode()) if digests else run)
                decoded.append(tx.sha256(back.encode()) if digests else back if told == "decoded" else back == t)
            return [pa.array(n, pa.int64()), pa.array(ids, pa.string()) if digests else _id_lists(ids, n), pa.array(decoded, pa.bool_() if told == "exact" and not digests else pa.string())]

        return work

    kinds = [("n_tokens", T.LongType()), *((("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())) if digests else (("ids", T.ArrayType(T.IntegerType())), (told, DECODED[told])))]
    names = docs.columns if keep is None else keep
    made = fresh(docs, *[k for k, _ in kinds])
    found = map_texts(docs, text, make, [T.StructField(m, t) for m, (_, t) in zip(made, kinds, strict=True)], names)
    return found.select(*others(names, into), F.struct(*[F.col(m).alias(k) for m, (k, _) in zip(made, kinds, strict=True)]).alias(into))
