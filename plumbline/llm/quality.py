"""Quality rules: hashed n-gram log-likelihood ratio between a trusted and the raw corpus.

Features of a text are its words and word pairs, hashed into ``2**bits`` bins.
The raw multinomial is counted over every text; the trusted one over texts with
label 1.  A text's score is the mean over its features of the log ratio of the
two smoothed multinomials, so length does not matter.  The threshold is the cut
that does least harm on labelled texts kept out of the trusted counts, where
losing a good text weighs ``good_weight`` times keeping a bad one; every text is
then judged by it alone.

Half of the labelled rows, by a hash of the id, count towards the trusted multinomial,
all of them that are good; the whole other half sets the threshold, by sorted ranges of
scores of which each sends a few numbers to the driver.
Raw and trusted counts and the verdicts cover all texts.  The roles of labelled rows
are broadcast where they are at most ``MAX_HELD``, and joined by a shuffle beyond.

Edge cases: a null or empty text has no features and score 0; ids labelled both
ways and null labels or ids are no labels; without labels of both kinds the
threshold is minus infinity and only the fixed rules reject; repeated rows are
judged alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import text as tx
from plumbline.llm.cluster import HELD, Scratch, fresh, map_texts, others, partitions

BITS, MAX_HELD, GOOD_WEIGHT, SMOOTHING = 16, 1_000_000, 20, 0.5
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = np.zeros(256, bool)
SYMBOLS[np.frombuffer(b"#*$%&|<>", np.uint8)] = True
TRUSTED, JUDGED_GOOD, JUDGED_BAD = 1, 2, 3
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def features(block: tx.Block, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins of the words and word pairs, and the text of each."""
    starts, ends, first = block.words(tx.SPACED)
    words = tx.Rolling(block.data).ranges(starts, ends)
    text = tx.owner(first)
    pairs = tx.Rolling(words).grams(2)
    inside = text[: len(pairs)] == text[1:]
    shift = np.uint64(64 - bits)
    return np.concatenate([words, pairs[inside]]) >> shift, np.concatenate([text, text[: len(pairs)][inside]])


def counts(block: tx.Block) -> dict[str, np.ndarray]:
    """The base measures of each text of a block."""
    data, offsets = block.data, block.offsets
    starts, ends, first = block.words(tx.SPACED)
    text = tx.owner(first)
    total = lambda flags: np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])
    out = {"n_words": np.diff(first), "word_chars": total(tx.SPACED[data] & ((data & 0xC0) != 0x80)), "n_symbols": total(SYMBOLS[data])}
    rolling = tx.Rolling(data)
    cut = np.unique(np.concatenate([np.flatnonzero(data == 10) + 1, offsets]))
    cut = cut[cut <= len(data)]
    a = cut[:-1]
    b = np.where(np.isin(cut[1:], offsets) & (data[cut[1:] - 1] != 10), cut[1:], cut[1:] - 1) if len(cut) > 1 else cut[1:]
    filled = np.searchsorted(starts, a) < np.searchsorted(starts, b)
    a, b = a[filled], b[filled]
    lines, of = rolling.ranges(a, b), np.searchsorted(offsets, a, side="right") - 1
    order = np.lexsort((lines, of))
    again = (lines[order][1:] == lines[order][:-1]) & (of[order][1:] == of[order][:-1])
    out["n_dup_lines"] = np.bincount(of[order][1:][again], minlength=block.n)
    threes = tx.Rolling(rolling.ranges(starts, ends)).grams(3)
    at = np.flatnonzero(text[: len(threes)] == text[2:]) if len(threes) else np.zeros(0, np.int64)
    order = at[np.lexsort((threes[at], text[at]))]
    same = (threes[order][1:] == threes[order][:-1]) & (text[order][1:] == text[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    hit = tx.union(order[twice], order[twice] + 3, len(starts))
    out["n_repeat_words"] = np.bincount(text[hit], minlength=block.n)
    return out


def _roles(labels: DataFrame, doc_id: str, quality: str) -> DataFrame:
    """Ids of the labelled rows, and what each is used for."""
    seen = labels.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{quality}`").cast("int").alias("q")).dropna()
    own = seen.groupBy("id").agg(F.min("q").alias("q"), F.max("q").alias("most")).where("q = most and q in (0, 1)")
    fits = F.xxhash64(F.lit(7), "id") % 2 == 0
    trusted = own.where(fits & (F.col("q") == 1)).select("id", F.lit(TRUSTED).alias("role"))
    judged = own.where(~fits)
    return trusted.unionByName(judged.select("id", F.when(F.col("q") == 1, JUDGED_GOOD).otherwise(JUDGED_BAD).alias("role")))


def _read(docs: DataFrame, roles: DataFrame, text: str, doc_id: str, max_held: int) -> DataFrame:
    """(role, text) of every row; the role is 0 without a label."""
    few = roles.limit(max_held + 1).count() <= max_held
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    return rows.join(F.broadcast(roles) if few else roles, "id", "left").select(F.coalesce("role", F.lit(0)).alias("role"), "text")


def count_corpus(read: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature counts over all texts and over the trusted ones; each task sends its bins once."""

    def run(batches):
        raw, trusted = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for batch in batches:
            role = batch.column(0).to_numpy()
            for block in tx.blocks(batch.column(1)):
                bins, of = features(block, bits)
                bins = bins.astype(np.int64)
                raw += np.bincount(bins, minlength=1 << bits)
                trusted += np.bincount(bins[role[block.first : block.first + block.n][of] == TRUSTED], minlength=1 << bits)
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(raw[some]), pa.array(trusted[some])], names=["bin", "raw", "trusted"])

    rows = read.mapInArrow(run, "bin int, raw long, trusted long").groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("trusted").alias("trusted")).toArrow()
    out = np.zeros((2, 1 << bits))
    for k, name in enumerate(("raw", "trusted")):
        out[k, rows["bin"].to_numpy()] = rows[name].to_numpy()
    return out[0], out[1]


def ratio(raw: np.ndarray, trusted: np.ndarray, smoothing: float = SMOOTHING) -> np.ndarray:
    if not trusted.sum():
        return np.zeros(len(raw))
    raw, trusted = raw + smoothing, trusted + smoothing
    return np.log(trusted / trusted.sum()) - np.log(raw / raw.sum())


def scores(block: tx.Block, table: np.ndarray, bits: int) -> np.ndarray:
    bins, of = features(block, bits)
    n = np.bincount(of, minlength=block.n)
    return np.bincount(of, table[bins.astype(np.int64)], block.n) / np.maximum(n, 1)


def least_harm(good: np.ndarray, bad: np.ndarray, good_weight: float) -> float:
    """The cut (score below it: rejected) with the least weighted errors; of equal ones the middle one."""
    if not len(good) or not len(bad):
        return -np.inf
    at = np.unique(np.concatenate([good, bad]))
    cuts = np.concatenate([[at[0] - 1e-9], (at[1:] + at[:-1]) / 2, [at[-1] + 1e-9]])
    harm = good_weight * np.searchsorted(np.sort(good), cuts) + len(bad) - np.searchsorted(np.sort(bad), cuts)
    best = np.flatnonzero(harm == harm.min())
    return float(cuts[best[len(best) // 2]])


def least_harm_of(seen: DataFrame, good_weight: float) -> float:
    """``least_harm`` of all rows (role, score), without bringing them to one place.

    Distinct scores are sorted in ranges.  Of each range the driver gets its ends, what
    it adds to the harm, and its least harm (with the number of cuts that have
    it) counted from the range's beginning.  Cut k of a range lies below its score k.
    Then the range that holds the middle one of the best cuts is read once more.
    """
    n = lambda role: F.sum((F.col("role") == role).cast("long"))
    scratch = Scratch(seen.sparkSession)
    at = scratch.cut(seen.groupBy((F.col("score") + 0.0).alias("score")).agg(n(JUDGED_GOOD).alias("good"), n(JUDGED_BAD).alias("bad")))  # -0.0 + 0.0 is 0.0
    total = at.agg(F.sum("good"), F.sum("bad"), F.count("*")).first()
    if not total[0] or not total[1]:
        return -np.inf

    def harms(rows: pa.Table) -> np.ndarray:
        """Harm of the cut below each score, less that of the first."""
        step = good_weight * rows["good"].to_numpy() - rows["bad"].to_numpy()
        return np.concatenate(([0], np.cumsum(step)[:-1]))

    def run(batches):
        held = list(batches)
        if not sum(b.num_rows for b in held):
            return
        rows = pa.Table.from_batches(held)
        score, harm = rows["score"].to_numpy(), harms(rows)
        step = good_weight * rows["good"].to_numpy()[-1] - rows["bad"].to_numpy()[-1]
        made = {"first": score[:1], "last": score[-1:], "whole": [float(harm[-1] + step)], "least": [float(harm.min())], "cuts": [int((harm == harm.min()).sum())]}
        yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in made.items()})

    ranges = at.repartitionByRange(max(partitions(seen.sparkSession), -(-total[2] // HELD)), "score").sortWithinPartitions("score")
    found = ranges.mapInArrow(run, "first double, last double, whole double, least double, cuts long").toArrow().sort_by("first").to_pydict()
    before = np.concatenate(([0], np.cumsum(found["whole"])))
    least = before[:-1] + np.array(found["least"])
    best = min(least.min(), before[-1])  # the last cut lies above all scores
    cuts = np.where(least == best, found["cuts"], 0)
    middle = int(cuts.sum() + (before[-1] == best)) // 2
    if middle == cuts.sum():
        return float(found["last"][-1] + 1e-9)
    part = int(np.searchsorted(np.cumsum(cuts), middle, side="right"))
    rows = at.where(F.col("score").between(found["first"][part], found["last"][part])).toArrow().sort_by("score")
    harm, score = harms(rows), rows["score"].to_numpy()
    k = int(np.flatnonzero(harm == harm.min())[middle - int(cuts[:part].sum())])
    below = score[k - 1] if k else found["last"][part - 1] if part else None
    return float(score[k] - 1e-9 if below is None else (score[k] + below) / 2)


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", quality: str = "quality", bits: int = BITS, max_held: int = MAX_HELD, good_weight: float = GOOD_WEIGHT) -> tuple[np.ndarray, float]:
    """The table of log ratios by bin and the threshold."""
    read = _read(docs, _roles(labels, doc_id, quality), text, doc_id, max_held)
    table = ratio(*count_corpus(read, bits))
    held = docs.sparkSession.sparkContext.broadcast(table)

    def run(batches):
        table = held.value
        for batch in batches:
            role = batch.column(0).to_numpy()
            for block in tx.blocks(batch.column(1)):
                own = slice(block.first, block.first + block.n)
                c = counts(block)
                yield pa.RecordBatch.from_arrays([pa.array(role[own], pa.int32()), pa.array(scores(block, table, bits)), pa.array(_failed(c))], names=["role", "score", "failed"])

    seen = read.where(F.col("role") > TRUSTED).mapInArrow(run, "role int, score double, failed boolean").where("not failed")
    return table, least_harm_of(seen, good_weight)


def _failed(c: dict[str, np.ndarray]) -> np.ndarray:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"])


def judge(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", into: str = "quality_rules", keep: list[str] | None = None, bits: int = BITS, **options) -> DataFrame:
    """Add a struct of the base measures, ``score``, ``threshold``, ``base_failed`` and ``kept``."""
    table, threshold = fit(docs, labels, text=text, doc_id=doc_id, bits=bits, **options)
    held = docs.sparkSession.sparkContext.broadcast(table)

    def make():
        table = held.value

        def work(column, batch):
            out: dict[str, list] = {}
            for block in tx.blocks(column):
                c = counts(block)
                score = scores(block, table, bits)
                failed = _failed(c)
                for k, v in (c | {"score": score, "base_failed": failed, "kept": ~failed & (score >= threshold)}).items():
                    out.setdefault(k, []).append(v)
            return [pa.array(np.concatenate(out[k]), t) for k, t in [*((k, pa.int64()) for k in COUNTS), ("score", pa.float64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]]

        return work

    kinds = [*((k, T.LongType()) for k in COUNTS), ("score", T.DoubleType()), ("base_failed", T.BooleanType()), ("kept", T.BooleanType())]
    made = fresh(docs, *[k for k, _ in kinds])
    names = docs.columns if keep is None else keep
    found = map_texts(docs, text, make, [T.StructField(m, t) for m, (_, t) in zip(made, kinds, strict=True)], names)
    return found.select(*others(names, into), F.struct(*[F.col(m).alias(k) for m, (k, _) in zip(made, kinds, strict=True)], F.lit(threshold).alias("threshold")).alias(into))
