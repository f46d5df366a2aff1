"""Toxicity: a convolutional text classifier trained in numpy.

Words (A-Z lowered) are embedded as the sum of rows of one hashed table: two chosen
by independent hashes of the word, so that two words look alike only if both
collide, and one for each beginning of 4 to 8 bytes, so that unseen words of a known
stem look like it.  Filters one, two and
three words wide run over the text; each keeps its largest response (max pooling),
and a logistic layer gives the score.  Language, source, id and labels are no
inputs of a score.

A word that fewer than ``MIN_TEXTS`` training texts hold is blank in training, and a
share ``BLANKED`` of the words is blanked at random, so that single texts teach no
words and each telling word is learnt.

Training covers every labelled text, whole.  The texts are dealt by a hash of the id
into shards of about ``SHARD_BYTES``, and each shard is written once as a file that
every round reads.  In each of ``ROUNDS`` rounds every shard goes on
from the same model for an epoch (up to five where one would pass under
``PASSED`` texts), then the parameters are averaged: a
row of the table by the number of the shard's texts that hold its bin, the others by the
number of texts.  Averages of a range of bins are formed in one task, so the driver gets
one model a round.  The first round starts from a model that the driver trains on at
most ``max_positive`` and ``max_negative`` of the texts, ``max_bytes`` / 2 of either
label; they are those first in the order of a hash of the id and take part in the
rounds like all others.  A threshold for each language is calibrated on all texts of a
fifth of the ids, with scores of a model trained on the others in the same rounds.  A
language with fewer than ``min_calibration`` texts of either label there uses the
default threshold.

Edge cases: a null or empty text has no words and gets the score of the bias;
ids labelled both ways and null labels or ids are no labels; without labels of
both kinds every score is the share of label 1, or 0.
"""

from __future__ import annotations

import copy

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import text as tx
from plumbline.llm.cluster import HELD, Scratch, fresh, if_few, map_texts, others, partitions

BITS, DIM, FILTERS, WIDTHS, PREFIXES = 18, 8, 8, (1, 2, 3), (4, 5, 6, 7, 8)
MAX_POSITIVE, MAX_NEGATIVE, EPOCHS, BATCH, DEFAULT, MIN_CALIBRATION = 3000, 5000, 14, 64, 0.7, 20
MIN_TEXTS, BLANKED, MAX_BYTES = 3, 0.3, 16 << 20
ROUNDS, PASSED, SHARD_BYTES, RANGE = 3, 8000, 16 << 20, 1 << 12
BLANK = 1 << BITS
#: A file's row group is read by one task; this keeps a shard in one.
ROW_GROUP = 1 << 30


def words(block: tx.Block) -> tuple[np.ndarray, np.ndarray]:
    """Bins of each word (two hashes of it, and of each of its beginnings) and the first word of each text."""
    lower = tx.LOWER[block.data]
    starts, ends, first = block.words(tx.ALNUM, lower)
    rolling = tx.Rolling(lower)
    whole = rolling.ranges(starts, ends)
    low = np.uint64(BLANK - 1)
    bins = np.full((len(starts), 2 + len(PREFIXES)), BLANK, np.int32)
    bins[:, 0], bins[:, 1] = whole & low, (whole >> np.uint64(32)) & low
    for k, size in enumerate(PREFIXES, 2):
        long = np.flatnonzero(ends - starts > size)
        h = rolling.ranges(starts[long], starts[long] + size)
        bins[long, k] = tx.mix(h + np.uint64(size)) & low
    return bins, first


class Model:
    """Parameters, forward pass and training."""

    def __init__(self, seed: int = 17):
        rng = np.random.default_rng(seed)
        self.table = np.concatenate([rng.normal(0, 0.01, (BLANK, DIM)), np.zeros((1, DIM))]).astype(np.float32)
        self.filters = [rng.normal(0, 0.5, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        self.shift = [np.zeros(FILTERS, np.float32) for _ in WIDTHS]
        self.out = rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32)
        self.bias = np.zeros(1, np.float32)
        self.constant: float | None = None
        self.thresholds: dict[str, float] = {}
        self.square = np.full(BLANK + 1, 1e-8, np.float32)
        self.moments = [(np.zeros_like(p), np.zeros_like(p)) for p in self.dense]
        self.step = 0

    @property
    def dense(self) -> list[np.ndarray]:
        return [*self.filters, *self.shift, self.out, self.bias]

    @property
    def state(self) -> list[np.ndarray]:
        """All that training changes, but for the table and its squares."""
        return [*self.dense, *[x for pair in self.moments for x in pair]]

    def pooled(self, bins: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest response of each filter in each text, where it stands, and the embedded words.

        A text is followed by blank words (zero vectors), so that every filter fits.
        """
        n, pad = len(first) - 1, max(WIDTHS)
        size = np.diff(first)
        at = np.arange(len(bins)) + pad * np.repeat(np.arange(n), size)
        begin = first[:-1] + pad * np.arange(n)
        x = np.zeros((len(bins) + pad * n, DIM), np.float32)
        rows = self.table[bins[:, 0]]
        for k in range(1, bins.shape[1]):
            rows += self.table[bins[:, k]]
        x[at] = rows
        best = np.empty((n, len(WIDTHS) * FILTERS), np.float32)
        where = np.empty(best.shape, np.int64)
        for k, w in enumerate(WIDTHS):
            z = x @ self.filters[k][0]
            for o in range(1, w):
                z[:-o] += x[o:] @ self.filters[k][o]
            cols = slice(k * FILTERS, (k + 1) * FILTERS)
            if n:
                best[:, cols] = np.maximum.reduceat(z, begin, axis=0)
            if self.training:
                for i in range(n):
                    where[i, cols] = begin[i] + z[begin[i] : begin[i] + size[i] + pad].argmax(0)
            best[:, cols] += self.shift[k]
        return best, where, x

    training = False

    def copy(self) -> Model:
        return copy.deepcopy(self)

    def scores(self, bins: np.ndarray, first: np.ndarray) -> np.ndarray:
        n = len(first) - 1
        if self.constant is not None:
            return np.full(n, self.constant)
        best, _, _ = self.pooled(bins, first)
        return 1 / (1 + np.exp(-(np.maximum(best, 0) @ self.out + self.bias).astype(np.float64)))

    def train(self, texts: list[np.ndarray], labels: np.ndarray, epochs: range, of: int, seed: int) -> None:
        """Some epochs ``of`` all over texts with the bins of rare words blanked."""
        rng, pad = np.random.default_rng(seed), max(WIDTHS)
        dense, moments, square = self.dense, self.moments, self.square
        self.training = True
        for epoch in epochs:
            rate = 1 - 0.9 * epoch / of
            order = rng.permutation(len(texts))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                bins = np.concatenate([texts[i] for i in rows])
                first = np.concatenate(([0], np.cumsum([len(texts[i]) for i in rows])))
                bins[rng.random(len(bins)) < BLANKED] = BLANK
                best, where, x = self.pooled(bins, first)
                hidden = np.maximum(best, 0)
                p = 1 / (1 + np.exp(-(hidden @ self.out + self.bias)))
                d = ((p - labels[rows]) / len(rows)).astype(np.float32)
                back = d[:, None] * self.out * (best > 0)
                grads, dx = [], {}
                position, change = [], []
                for k, w in enumerate(WIDTHS):
                    cols = slice(k * FILTERS, (k + 1) * FILTERS)
                    g = np.zeros_like(self.filters[k])
                    for o in range(w):
                        spot = np.minimum(where[:, cols] + o, len(x) - 1)
                        g[o] = np.einsum("if,ifd->df", back[:, cols], x[spot])
                        position.append(spot.ravel())
                        change.append((back[:, cols, None] * self.filters[k][o].T[None]).reshape(-1, DIM))
                    grads.append(g)
                grads += [back[:, k * FILTERS : (k + 1) * FILTERS].sum(0) for k in range(len(WIDTHS))]
                grads += [hidden.T @ d, d.sum(keepdims=True)]
                self.step += 1
                for p_, g, (m, v) in zip(dense, grads, moments, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    p_ -= 0.01 * rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.999**self.step)) + 1e-8)
                position, change = np.concatenate(position), np.concatenate(change)
                own = np.repeat(np.arange(len(rows)), np.diff(first))
                word = np.full(len(x), -1)
                word[np.arange(len(bins)) + pad * own] = np.arange(len(bins))
                token = word[position]
                change, touched = change[token >= 0], bins[token[token >= 0]]
                touched, change = touched.ravel(), np.repeat(change, touched.shape[1], axis=0)
                change, touched = change[touched != BLANK], touched[touched != BLANK]
                own_bins, inverse = np.unique(touched, return_inverse=True)
                g = np.zeros((len(own_bins), DIM), np.float32)
                np.add.at(g, inverse, change)
                square[own_bins] += (g * g).mean(1)
                self.table[own_bins] -= 0.1 * rate * g / np.sqrt(square[own_bins])[:, None]
        self.training = False


def _sample(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, toxic: str, lang: str | None, may_learn, limits: tuple[int, int], max_bytes: int) -> pa.Table:
    """The bounded labelled sample with its texts, in the order of ids; repeated ids give their first text."""
    seen = labels.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{toxic}`").cast("int").alias("y")).dropna()
    own = seen.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most and y in (0, 1)")
    if may_learn is not None:
        own = own.where(may_learn(F.col("id")))
    picked = [own.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(n) for y, n in ((1, limits[0]), (0, limits[1]))]
    ids = picked[0].unionByName(picked[1]).select("id", "y")
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), (F.col(f"`{lang}`") if lang else F.lit(None)).cast("string").alias("lang"))
    # The bounds of both broadcasts are those of the sample.
    sized = rows.select("id", F.octet_length("text").alias("n")).join(F.broadcast(ids), "id").groupBy("y", "id").agg(F.sum("n").alias("n"))
    chosen, held = [], {0: 0, 1: 0}
    for r in sized.orderBy("y", F.xxhash64("id"), "id").collect():
        if held[r["y"]] + r["n"] <= max_bytes // 2:
            held[r["y"]] += r["n"]
            chosen.append((r["id"], r["y"]))
    table = rows.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "id long, y int")), "id").toArrow()
    return table.sort_by([("id", "ascending"), ("text", "ascending")])


def _held(doc_id) -> F.Column:
    """Whether an id's label is used for the thresholds."""
    return F.pmod(F.xxhash64(F.lit(3), doc_id), F.lit(5)) == 4


def _labelled(docs: DataFrame, labels: DataFrame, text: str, doc_id: str, toxic: str, lang: str | None, may_learn, shard_bytes: int, scratch: Scratch) -> DataFrame:
    """(id, y, held, text, lang, shard) of all rows of the ids whose labels agree, written once, a shard to a file."""
    seen = labels.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{toxic}`").cast("int").alias("y")).dropna()
    own = seen.groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most and y in (0, 1)")
    if may_learn is not None:
        own = own.where(may_learn(F.col("id")))
    own = scratch.cut(own.select("id", "y", _held(F.col("id")).alias("held")))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), F.coalesce((F.col(f"`{lang}`") if lang else F.lit(None)).cast("string"), F.lit("")).alias("lang"))
    found = rows.join(if_few(own), "id").select("id", "y", "held", "text", "lang")
    shards = max(1, -(-(found.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
    dealt = found.withColumn("shard", F.pmod(F.xxhash64(F.lit(5), "id"), F.lit(shards)).cast("int"))
    return scratch.cut(dealt.repartitionById(shards, F.col("shard")), ROW_GROUP)


def _read(rows: pa.Table) -> tuple[list[np.ndarray], pa.Table]:
    """The bins of the texts in the order of ids, and their rows; repeated ids give their first text."""
    rows = rows.sort_by([(c, "ascending") for c in ("id", "text", "lang") if c in rows.column_names])
    ids = rows["id"].to_numpy()
    rows = rows.filter(pa.array(np.append(np.ones(min(len(ids), 1), bool), ids[1:] != ids[:-1])))
    read: list[np.ndarray] = []
    for block in tx.blocks(rows["text"]):
        bins, first = words(block)
        read += [bins[first[i] : first[i + 1]] for i in range(block.n)]
    return read, rows


def _by_shard(labelled: DataFrame, work, schema: str) -> DataFrame:
    """``work(shard, bins, rows)`` on the texts of each shard; a task reads whole files, so the rows of a shard come in a row."""

    def run(batches):
        held, last = [], None
        for batch in batches:
            number = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            for begin, end in zip(*tx.runs(number), strict=True):
                if held and number[begin] != last:
                    yield from work(last, *_read(pa.Table.from_batches(held)))
                    held = []
                last = int(number[begin])
                held.append(batch.slice(begin, end - begin))
        if held:
            yield from work(last, *_read(pa.Table.from_batches(held)))

    return labelled.mapInArrow(run, schema)


def _holding(texts: list[np.ndarray]) -> np.ndarray:
    """How many of the texts hold each bin."""
    n = np.zeros(BLANK + 1, np.int64)
    for bins in texts:
        n[np.unique(bins)] += 1
    return n


def _counts(labelled: DataFrame) -> np.ndarray:
    """How many texts hold each bin, of those not held and of all; then, how many have label 0 and 1."""

    def work(shard, read, rows):
        held, y = rows["held"].to_numpy(zero_copy_only=False), rows["y"].to_numpy()
        n = np.zeros((2, BLANK + 3), np.int64)
        for k, used in enumerate((~held, np.ones(len(held), bool))):
            n[k, : BLANK + 1] = _holding([r for r, u in zip(read, used, strict=True) if u])
            n[k, BLANK + 1 :] = np.bincount(y[used], minlength=2)
        some = np.flatnonzero(n[1])
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[0, some]), pa.array(n[1, some])], names=["bin", "trial", "whole"])

    found = _by_shard(labelled, work, "bin int, trial long, whole long").groupBy("bin").agg(F.sum("trial").alias("trial"), F.sum("whole").alias("whole")).toArrow()
    out = np.zeros((2, BLANK + 3), np.int64)
    for k, name in enumerate(("trial", "whole")):
        out[k, found["bin"].to_numpy()] = found[name].to_numpy()
    return out


def _round(labelled: DataFrame, models: dict[int, Model], rare: np.ndarray, number: int, local: int) -> None:
    """Train the models (0: without the texts held, 1: on all) on every shard and average them."""
    spark = labelled.sparkSession
    sent = spark.sparkContext.broadcast((models, rare))
    epochs = range(number * local, (number + 1) * local)

    def work(shard, read, rows):
        models, rare = sent.value
        held, y = rows["held"].to_numpy(zero_copy_only=False), rows["y"].to_numpy().astype(np.float32)
        for kind, begin in models.items():
            used = np.flatnonzero(~held) if kind == 0 else np.arange(len(held))
            if not len(used):
                continue
            texts, model = [np.where(rare[kind][read[i]], BLANK, read[i]) for i in used], begin.copy()
            model.train(texts, y[used], epochs, ROUNDS * local, 1000003 * number + shard)
            weight = _holding(texts)[:BLANK]
            for at in range(0, BLANK, RANGE):
                some = at + np.flatnonzero(weight[at : at + RANGE])
                if len(some):
                    values = np.concatenate([model.table[some], model.square[some, None]], axis=1)
                    yield _sent(kind, at // RANGE, shard, some.astype(np.int32), weight[some].astype(np.float32), values)
            yield _sent(kind, -1, shard, np.zeros(1, np.int32), np.array([len(used)], np.float32), np.concatenate([x.ravel() for x in model.state] + [[model.step]]))

    def average(rows: pa.Table) -> pa.Table:
        kind, part = (rows[c][0].as_py() for c in ("kind", "part"))
        rows, size = rows.sort_by("shard"), RANGE if part >= 0 else 1
        total, of = None, np.zeros(size)
        for i in range(rows.num_rows):
            at, weight, values = (np.frombuffer(rows[c][i].as_py(), t) for c, t in (("at", np.int32), ("weight", np.float32), ("data", np.float32)))
            at, values = at % RANGE, values.reshape(len(at), -1)
            total = np.zeros((size, values.shape[1])) if total is None else total
            total[at] += weight[:, None] * values
            of[at] += weight
        some = np.flatnonzero(of)
        return pa.Table.from_batches([_sent(kind, part, 0, (some + max(part, 0) * RANGE).astype(np.int32), of[some].astype(np.float32), total[some] / of[some, None])])

    schema = "kind int, part int, shard int, at binary, weight binary, data binary"
    found = _by_shard(labelled, work, schema).groupBy("kind", "part").applyInArrow(average, schema).toArrow()
    for kind, part, at, data in zip(*(found[c].to_pylist() for c in ("kind", "part", "at", "data")), strict=True):
        model, at = models[kind], np.frombuffer(at, np.int32)
        values = np.frombuffer(data, np.float32).reshape(len(at), -1)
        if part >= 0:
            model.table[at], model.square[at] = values[:, :DIM], values[:, DIM]
            continue
        begin = 0
        for x in model.state:
            x[...] = values[0, begin : begin + x.size].reshape(x.shape)
            begin += x.size
        model.step = round(float(values[0, begin]))
    sent.destroy()


def _sent(kind: int, part: int, shard: int, at: np.ndarray, weight: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    numbers = [pa.array([x], pa.int32()) for x in (kind, part, shard)]
    return pa.RecordBatch.from_arrays([*numbers, *[pa.array([x.tobytes()], pa.binary()) for x in (at, weight, values.astype(np.float32))]], names=["kind", "part", "shard", "at", "weight", "data"])


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", toxic: str = "toxic", lang: str | None = "lang", may_learn=None, max_positive: int = MAX_POSITIVE, max_negative: int = MAX_NEGATIVE, max_bytes: int = MAX_BYTES, min_calibration: int = MIN_CALIBRATION, default: float = DEFAULT, shard_bytes: int = SHARD_BYTES) -> Model:
    """Train on all labelled texts; ``may_learn`` maps an id column to whether its label may be used."""
    scratch, model = Scratch(docs.sparkSession), Model()
    labelled = _labelled(docs, labels, text, doc_id, toxic, lang, may_learn, shard_bytes, scratch)
    counts = _counts(labelled)
    rare, kinds = counts[:, : BLANK + 1] < MIN_TEXTS, counts[:, BLANK + 1 :]
    scratch.release(collected=True)
    if not kinds[1].all():
        model.constant = float(kinds[1, 1] > 0)
        return model
    start = labelled.where("not held")
    read, rows = _read(_sample(start, start, "text", "id", "y", "lang", None, (max_positive, max_negative), max_bytes))
    y = rows["y"].to_numpy().astype(np.float32)
    if len(y) and y.min() != y.max():
        model.train([np.where(rare[0][r], BLANK, r) for r in read], y, range(EPOCHS), EPOCHS, 5)
    models = {0: model.copy(), 1: model} if kinds[0].all() else {1: model}
    local = int(np.clip(-(-PASSED // kinds[1].sum()), 1, 5))
    for number in range(ROUNDS):
        _round(labelled, models, rare, number, local)
        scratch.release(collected=True)
    if 0 in models:
        model.thresholds = _thresholds(_trial_scores(labelled.where("held"), models[0]), min_calibration, default, scratch)
    model.training, model.square, model.moments = False, None, []
    return model


def _trial_scores(held: DataFrame, trial: Model) -> DataFrame:
    """(lang, score, y) of the texts held."""
    trial.training, trial.square, trial.moments = False, None, []
    sent = held.sparkSession.sparkContext.broadcast(trial)

    def work(shard, read, rows):
        for at in range(0, len(read), BATCH):
            part = read[at : at + BATCH]
            first = np.concatenate(([0], np.cumsum([len(r) for r in part])))
            own = rows.slice(at, BATCH)
            yield pa.RecordBatch.from_arrays([own["lang"].combine_chunks(), pa.array(sent.value.scores(np.concatenate(part), first)), own["y"].combine_chunks()], names=["lang", "score", "y"])

    return _by_shard(held, work, "lang string, score double, y int")


def _thresholds(seen: DataFrame, min_calibration: int, default: float, scratch: Scratch) -> dict[str, float]:
    """For each language the threshold of the best F1 over all rows (lang, score, y), in the middle of its gap.

    Distinct scores are sorted in ranges; the driver gets what each range adds, and
    then its best cut, counted from all ranges above it.
    """
    at = scratch.cut(seen.groupBy("lang", "score").agg(F.count("*").alias("n"), F.sum("y").alias("hits")))
    ranges = at.repartitionByRange(max(partitions(seen.sparkSession), -(-at.count() // HELD)), "lang", "score").withColumn("part", F.spark_partition_id())
    ranges = scratch.cut(ranges)
    found = ranges.groupBy("lang", "part").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"), F.min("score").alias("least"), F.max("score").alias("most")).orderBy("lang", F.desc("most")).collect()
    out, rows = {}, []
    for name in dict.fromkeys(r["lang"] for r in found):
        own = [r for r in found if r["lang"] == name]
        n, hits = sum(r["n"] for r in own), sum(r["hits"] for r in own)
        out[name] = default
        if min(hits, n - hits) >= min_calibration:
            before = [sum(r[c] for r in own[:k]) for k in range(len(own)) for c in ("n", "hits")]
            rows += [(name, r["part"], before[2 * k], before[2 * k + 1], hits, own[k + 1]["most"] if k + 1 < len(own) else 0.0) for k, r in enumerate(own)]
    if not rows:
        return out

    def best(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("score", "descending")])
        begin = {c: rows[c][0].as_py() for c in ("lang", "n0", "hits0", "all", "below")}
        f1 = 2 * (begin["hits0"] + np.cumsum(rows["hits"].to_numpy())) / (begin["n0"] + np.cumsum(rows["n"].to_numpy()) + begin["all"])
        k, score = int(np.argmax(f1)), np.append(rows["score"].to_numpy(), begin["below"])
        return pa.table({"lang": [begin["lang"]], "f1": [float(f1[k])], "score": [float(score[k])], "below": [float(score[k + 1])]})

    begin = seen.sparkSession.createDataFrame(rows, "lang string, part int, n0 long, hits0 long, all long, below double")
    cuts = ranges.join(F.broadcast(begin), ["lang", "part"]).groupBy("lang", "part").applyInArrow(best, "lang string, f1 double, score double, below double").collect()
    for r in sorted(cuts, key=lambda r: (r["f1"], r["score"])):
        out[r["lang"]] = (r["score"] + r["below"]) / 2
    return out


def classify(docs: DataFrame, model: Model, *, text: str = "text", lang: str | None = "lang", into: str = "toxicity", keep: list[str] | None = None, default: float = DEFAULT) -> DataFrame:
    """Add a struct of ``score``, the ``threshold`` of the row's language and ``flagged``."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = held.value

        def work(column, batch):
            return [pa.array(np.concatenate([model.scores(*words(block)) for block in tx.blocks(column)]), pa.float64())]

        return work

    names = docs.columns if keep is None else keep
    made = fresh(docs, "score", "lang")
    source = docs.withColumn(made[1], (F.col(f"`{lang}`") if lang else F.lit(None)).cast("string"))
    found = map_texts(source, text, make, [T.StructField(made[0], T.DoubleType())], [*names, made[1]])
    threshold = F.lit(default)
    for name, t in model.thresholds.items():
        threshold = F.when(F.coalesce(F.col(made[1]), F.lit("")) == name, F.lit(t)).otherwise(threshold)
    return found.select(*others(names, into), F.struct(F.col(made[0]).alias("score"), threshold.alias("threshold"), (F.col(made[0]) >= threshold).alias("flagged")).alias(into))
