"""MinHash near-dedup: one-permutation hashing, optimal densification, bands, stars.

A document's set holds its distinct ``shingle``-word runs (A-Z lowered); one with
fewer words has its whole sequence as the one member, one without words the empty
set, linked with nothing.  Documents are linked whose sets have Jaccard similarity
of ``percent`` / 100 or more; near-duplicate groups are the components.

1. One pass hashes every set once: the upper bits of a shingle's hash choose one of
   ``BINS`` bins, which keeps its smallest hash.  An empty bin copies the first
   non-empty one of its own sequence of bins (optimal densification), the same
   sequence in every document.  ``BANDS`` bands of ``BINS / BANDS`` bins are hashed
   to band keys.  With 32 bands of four bins a pair at 0.8 is missed by chance with
   probability (1 - 0.8**4)**32, about 5e-8.  In small sets many bins are copies and
   the bands less independent, so sets under ``SMALL`` members are hashed by
   ``PERMUTATIONS`` permutations, with as many times the bands.
2. Documents with equal sets (a 128-bit digest of the set and its size) collapse to
   the least id; a group of copies of any size takes part once.
3. Stars: in each bucket one member, drawn by the bucket's key, is the hub.  Each
   document asks the hub that it meets in the most buckets, so candidate edges are
   fewer than documents.  They are confirmed on full sets, read from the texts; a hub's
   candidates are dealt in chunks, each streamed past the hub's set.  Most copies are
   linked by then.
4. The exact rest: buckets that still hold several components are dealt in blocks of
   ``BLOCK`` members.  In a larger bucket the component of the most members has blocks of
   its own, which meet those of the others and not each other, as its members need no
   comparison among themselves.  First only sizes and band keys travel: a pair counts where it is
   of different components, its sizes allow the similarity and no earlier band has it.
   Then the members of such pairs meet once more with their texts, and the full sets of
   a block are compared inside a task, which gives out a forest of the links.  Members
   are sent and never pairs, no pair that shares a bucket is left out, and there are two
   rounds whatever the data.

Edge cases: a null or empty text has the empty set; rows of equal id are one node,
linked as soon as one of them is; a null id has no component (null); an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import text as tx
from plumbline.llm.cluster import Scratch, if_few, is_empty, partitions
from plumbline.llm.graph import blocks, components, dealt, merged

SHINGLE, PERCENT, BINS, BANDS, CHUNK = 5, 80, 128, 32, 128
SMALL, PERMUTATIONS, BLOCK, COLUMNS = 384, 2, 1024, 4096
U64 = np.uint64


def _sets(block: tx.Block, shingle: int) -> np.ndarray:
    """The distinct shingles of a block's texts, sorted: 16 bits of text above 48 of hash, alike in every block."""
    lower = tx.LOWER[block.data]
    starts, ends, first = block.words(tx.SPACED, lower)
    hashes = tx.Rolling(lower).ranges(starts, ends)
    text = tx.owner(first)
    rolling = tx.Rolling(hashes)
    grams = rolling.grams(shingle)
    at = np.flatnonzero(text[: len(grams)] == text[shingle - 1 :]) if len(grams) else np.zeros(0, np.int64)
    n = np.diff(first)
    few = np.flatnonzero((n > 0) & (n < shingle))
    own = np.concatenate([text[at], few])
    values = np.concatenate([grams[at], rolling.ranges(first[few], first[few + 1])])
    packed = np.sort((own.astype(U64) << U64(48)) | (values >> U64(16)))
    return np.append(packed[:1], packed[1:][packed[1:] != packed[:-1]])


def _alternatives(bins: int, rounds: int) -> np.ndarray:
    """For each bin its sequence of other bins to copy from."""
    seed = np.arange(bins * rounds, dtype=U64).reshape(rounds, bins)
    return (tx.mix(seed + U64(0xA0761D6478BD642F)) >> U64(40)).astype(np.int64) % bins


def densify(signature: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """Fill empty bins of the rows that have any filled one."""
    n, bins = signature.shape
    out, values, full = signature.ravel().copy(), signature.ravel(), filled.ravel()
    left = np.flatnonzero(~full & np.repeat(filled.any(1), bins))
    for source in _alternatives(bins, 64 * bins):
        if not len(left):
            break
        take = left - left % bins + source[left % bins]
        have = full[take]
        out[left[have]] = values[take[have]]
        left = left[~have]
    return out.reshape(n, bins)


def sketch(packed: np.ndarray, n: int, bins: int, bands: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the sets of n texts: sizes, two digests of each, and band keys (rows of texts with an empty set are void)."""
    own = (packed >> U64(48)).astype(np.int64)
    value = packed << U64(16)
    size = np.bincount(own, minlength=n)
    digest = np.zeros((2, n), U64)
    some = np.flatnonzero(size)
    if len(some):
        begin = (np.cumsum(size) - size)[some]
        for k in range(2):
            digest[k, some] = np.add.reduceat(tx.mix(value + U64(k + 1)), begin)
    keys = [_band_keys(own, value, n, bins, bands, 0)]
    small = size[own] < SMALL
    for k in range(1, PERMUTATIONS):
        again = tx.mix(value[small] + U64(k))
        again = np.sort((own[small].astype(U64) << U64(48)) | (again >> U64(16)))
        keys.append(_band_keys((again >> U64(48)).astype(np.int64), again << U64(16), n, bins, bands, k))
    return size, digest, np.concatenate(keys, axis=1)


def _band_keys(own: np.ndarray, value: np.ndarray, n: int, bins: int, bands: int, permutation: int) -> np.ndarray:
    """Band keys of n texts from their members' hashes, sorted by text and hash."""
    log = U64(bins.bit_length() - 1)
    cell = own * bins + (value >> (U64(64) - log)).astype(np.int64)
    lead = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else np.zeros(0, np.int64)
    signature = np.zeros(n * bins, U64)
    filled = np.zeros(n * bins, bool)
    signature[cell[lead]] = ((value << log) >> U64(24))[lead]
    filled[cell[lead]] = True
    full = densify(signature.reshape(-1, bins), filled.reshape(-1, bins)).reshape(n, bands, bins // bands)
    key = np.broadcast_to(np.arange(bands, dtype=U64) + U64(permutation * bands), full.shape[:2])
    for k in range(full.shape[2]):
        key = tx.mix(key * U64(0x9E3779B97F4A7C15) + full[:, :, k])
    return key


def _sketches(docs: DataFrame, shingle: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            ids = batch.column(0).cast(pa.int64())
            for block in tx.blocks(batch.column(1)):
                packed = _sets(block, shingle)
                size, digest, keys = sketch(packed, block.n, BINS, BANDS)
                bands = np.where(size > 0, np.where(size < SMALL, PERMUTATIONS * BANDS, BANDS), 0)
                offsets = np.concatenate(([0], np.cumsum(bands))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[np.arange(keys.shape[1]) < bands[:, None]].view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(block.first, block.n), pa.array(size, pa.int64()), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), lists], names=["id", "n", "d1", "d2", "bands"])

    return docs.mapInArrow(run, "id long, n long, d1 long, d2 long, bands array<long>")


def _only(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of some ids, which are a table of their own and distinct."""
    return texts.join(if_few(wanted), "id", "left_semi")


def confirm(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (``a`` the hub, ``b``) whose sets are similar, by their texts."""
    n = partitions(pairs.sparkSession)
    of_hub = scratch.cut(pairs.groupBy("a").agg((1 + F.count("*") / CHUNK).cast("long").alias("chunks")))
    texts = _only(texts, scratch.cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
    chunked = pairs.join(of_hub, "a").withColumn("chunk", F.pmod(F.xxhash64("b"), "chunks")).select("a", "chunk", "b")
    members = chunked.join(texts.select(F.col("id").alias("b"), "text"), "b").select("a", "chunk", F.lit(1).alias("side"), "b", "text")
    hubs = chunked.select("a", "chunk").distinct().join(texts.select(F.col("id").alias("a"), "text"), "a").select("a", "chunk", F.lit(0).alias("side"), F.col("a").alias("b"), "text")

    def run(batches):
        hub, held = None, None
        for batch in batches:
            a, chunk, side, b = (batch.column(i).to_numpy() for i in range(4))
            out: list[tuple[int, int]] = []
            for block in tx.blocks(batch.column(4)):
                packed = _sets(block, shingle)
                cut = np.searchsorted(packed >> U64(48), np.arange(block.n + 1, dtype=U64))
                for i in range(block.n):
                    values = packed[cut[i] : cut[i + 1]] & U64((1 << 48) - 1)
                    row = block.first + i
                    if side[row] == 0:
                        hub, held = (a[row], chunk[row]), values
                    elif hub == (a[row], chunk[row]):
                        both = len(np.intersect1d(held, values, assume_unique=True))
                        either = len(held) + len(values) - both
                        if 100 * both >= percent * either:
                            out.append((a[row], b[row]))
            if out:
                x, y = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    return members.unionByName(hubs).repartition(n, "a", "chunk").sortWithinPartitions("a", "chunk", "side").mapInArrow(run, "a long, b long")


def _stars(members: DataFrame, scratch: Scratch) -> DataFrame:
    """Candidate edges (``hub``, ``id``) of buckets (``key``, ``id``): each member with the hub it meets most often.

    The hub of a bucket is the member whose id differs least from the key in its upper bits.
    """
    drawn = F.min(F.col("id").bitwiseXOR(F.col("key")))
    hubs = scratch.cut(members.groupBy("key").agg(drawn.alias("least"), F.count("*").alias("n")).where("n > 1").select("key", F.col("least").bitwiseXOR(F.col("key")).alias("hub")))
    met = members.join(if_few(hubs), "key").where("id <> hub").groupBy("id", "hub").agg(F.count("*").alias("n"))
    return met.groupBy("id").agg(F.max(F.struct("n", "hub")).alias("most")).select("most.hub", "id")


def _of_size(pairs: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """The candidates (``hub``, ``id``) whose set sizes allow the similarity."""
    of = lambda n: sizes.select(F.col("id").alias(n), F.col("least").alias(f"{n}_least"), F.col("most").alias(f"{n}_most"))
    fits = (F.col("hub_most") * 100 >= F.col("id_least") * percent) & (F.col("id_most") * 100 >= F.col("hub_least") * percent)
    return pairs.join(of("hub"), "hub").join(of("id"), "id").where(fits).select("hub", "id")


def groups(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Each row's id, ``n_shingles`` and ``component_id``, the least id of its near-duplicate group."""
    scratch = Scratch(docs.sparkSession)
    read = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    sketches = scratch.cut(_sketches(read, shingle))
    filled = sketches.where("n > 0 and id is not null")
    sets = ["n", "d1", "d2"]
    leads = scratch.cut(filled.groupBy(*sets).agg(F.min("id").alias("lead")))
    member = scratch.cut(sketches.select("id", *sets).join(leads, sets, "left").select("id", "n", F.coalesce("lead", "id").alias("lead")))
    alone = scratch.cut(_only(filled, leads.select(F.col("lead").alias("id"))).select("id", "n", "bands"))
    scratch.drop(sketches)
    sizes = scratch.cut(alone.groupBy("id").agg(F.min("n").alias("least"), F.max("n").alias("most")))
    stars = _of_size(_stars(alone.select("id", F.explode("bands").alias("key")), scratch), sizes, percent)
    asked = scratch.cut(stars.select(F.col("hub").alias("a"), F.col("id").alias("b")))
    known = components(scratch.cut(confirm(asked, read, shingle, percent, scratch)), scratch)
    links = scratch.cut(_rest(alone, known, read, shingle, percent, scratch))
    if not is_empty(links):
        known = merged(known, links, scratch)
    scratch.release()
    found = member.join(known.withColumnRenamed("id", "lead"), "lead", "left")
    return found.select(F.col("id").alias(doc_id), F.col("n").alias("n_shingles"), F.coalesce("component", "lead").alias("component_id"))


def _named(members: DataFrame, known: DataFrame) -> DataFrame:
    """Members (``id``) with their component so far (``g``)."""
    return members.join(known.withColumnRenamed("component", "g"), "id", "left").withColumn("g", F.coalesce("g", "id"))


def _rest(alone: DataFrame, known: DataFrame, texts: DataFrame, shingle: int, percent: int, scratch: Scratch) -> DataFrame:
    """A forest (``a``, ``b``) of the links between components that share a bucket."""
    n, block = partitions(alone.sparkSession), ["key", "first", "second"]
    within = _named(alone.select("id", "bands"), known).select("id", "g", F.explode("bands").alias("key"))
    mixed = blocks(within, "key", BLOCK, scratch)
    blocked = dealt(within.join(if_few(mixed), "key"), "key", "id")
    told = blocked.select("key", F.least("own", "other").alias("first"), F.greatest("own", "other").alias("second"), "own", "id", "g").join(alone, "id").select(*block, "own", "id", "g", "n", "bands")
    kind = "key long, first int, second int, own int, id long, g long"
    met = scratch.cut(told.repartition(n, *block).sortWithinPartitions(*block).mapInArrow(_by_block(lambda rows: _meeting(rows, percent)), kind))
    read = _only(texts, scratch.cut(met.select("id").distinct()))
    return met.join(read, "id").select(*block, "own", "id", "g", "text").repartition(n, *block).sortWithinPartitions(*block).mapInArrow(_by_block(lambda rows: _linked(rows, shingle, percent)), "a long, b long")


def _by_block(work):
    """``work`` on the rows of each block, which the first three columns name; the rows come sorted by them."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(i).to_numpy() for i in range(3)])
            cut = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1
            if held and (key[:, 0] != [held[-1].column(i)[-1].as_py() for i in range(3)]).any():
                yield from work(pa.Table.from_batches(held))
                held = []
            begin = 0
            for end in cut.tolist():
                yield from work(pa.Table.from_batches([*held, batch.slice(begin, end - begin)]))
                held, begin = [], end
            held.append(batch.slice(begin))
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def _asked(rows: pa.Table, n: np.ndarray, percent: int) -> np.ndarray:
    """Which two rows are of different components, of sizes that allow the similarity, and of the two blocks."""
    first, second, own, group = (rows[c].to_numpy() for c in ("first", "second", "own", "g"))
    fits = (group[:, None] != group) & (np.minimum(n[:, None], n) * 100 >= np.maximum(n[:, None], n) * percent)
    return fits & (own[:, None] != own) if first[0] != second[0] else fits


def _meeting(rows: pa.Table, percent: int):
    """The members of pairs that meet here and in no earlier band."""
    fits = _asked(rows, rows["n"].to_numpy(), percent)
    some = np.flatnonzero(fits.any(0))
    if not len(some):
        return
    rows, fits = rows.take(pa.array(some)), fits[np.ix_(some, some)]
    bands = rows["bands"].combine_chunks()
    flat, at = bands.flatten().to_numpy(), np.concatenate(([0], np.cumsum(bands.value_lengths().to_numpy())))
    here = int(np.flatnonzero(flat[: at[1]] == rows["key"][0].as_py())[0])
    for q in range(here):
        key = flat[at[:-1] + q]
        fits &= key[:, None] != key
    yield from rows.filter(pa.array(fits.any(0))).select(["key", "first", "second", "own", "id", "g"]).to_batches()


def _linked(rows: pa.Table, shingle: int, percent: int):
    """A forest of the links within two blocks of a bucket, by their full sets."""
    sets: list[np.ndarray] = []
    for block in tx.blocks(rows["text"]):
        packed = _sets(block, shingle)
        cut = np.searchsorted(packed >> U64(48), np.arange(block.n + 1, dtype=U64))
        sets += [packed[cut[i] : cut[i + 1]] & U64((1 << 48) - 1) for i in range(block.n)]
    n, ids, group = np.array([len(x) for x in sets]), rows["id"].to_numpy(), rows["g"].to_numpy()
    x, y = np.nonzero(np.triu(_asked(rows, n, percent)))
    if not len(x):
        return
    both = _shared(sets)[x, y].astype(np.int64)
    root = {g: g for g in group.tolist()}

    def find(g):
        while root[g] != g:
            root[g] = g = root[root[g]]
        return g

    out = []
    for i in np.flatnonzero(100 * both >= percent * (n[x] + n[y] - both)).tolist():
        a, b = find(int(group[x[i]])), find(int(group[y[i]]))
        if a != b:
            root[a] = b
            out.append((int(ids[x[i]]), int(ids[y[i]])))
    if out:
        a, b = zip(*out, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """How many members each two of the sets share; members are told apart ``COLUMNS`` at a time."""
    values, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, at, times = np.unique(values, return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    often = times[at] > 1
    at, owner = number[at[often]], owner[often]
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for begin in range(0, int(at[-1]) + 1 if len(at) else 0, COLUMNS):
        own = slice(*np.searchsorted(at, (begin, begin + COLUMNS)))
        table = np.zeros((len(sets), min(COLUMNS, int(at[-1]) + 1 - begin)), np.float32)
        table[owner[own], at[own] - begin] = 1
        out += table @ table.T
    return out
