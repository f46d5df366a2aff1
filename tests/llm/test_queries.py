"""The opN_ queries and the pipeline on a small folder of tables, against SQL or brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from plumbline.llm import hpyp, queries, sql

WORDS = "amber birch cedar delta ember fjord grove haven inlet jetty kelp lagoon marsh north ocean pine quay reef shore tide".split()
SPACED, ALNUM = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def prose(seed, n, kinds=50):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(rng.integers(0, 20, n), rng.integers(0, kinds, n), strict=True))


def crc(i):
    return zlib.crc32(str(i).encode())


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Copies, near copies, shared passages and lines, benchmark passages, licenses, empty, null and long texts."""
    shared, line = prose(900, 70), "One line that many of the texts have in common, with a number"
    texts = [prose(i, 60 + i) for i in range(30)]
    texts += [texts[0], texts[1].replace("amber", "umber", 1), texts[2] + " end", f"{prose(91, 30)} {shared} {prose(92, 30)}", f"{prose(93, 25)} {shared}", f"{shared} {shared}"]
    texts += [f"{prose(200 + i, 55)}\n{line} {i % 3}\n{prose(300 + i, 12)}" for i in range(12)]
    texts += [f"{prose(400 + i, 90)} {prose(950, 14)} {prose(500 + i, 20)}" for i in range(3)]
    texts += ["", None, "a b c", "  \n\t\n ", "é\x00ß 😀 日本 " * 30, prose(77, 40_000, 5000), "x" * 3000, "spam *** " * 60]
    texts += [f"{prose(600 + i, 60)} vile filth {prose(700 + i, 5)}" for i in range(40)] + [f"{prose(800 + i, 60)}\nReleased under the MIT License." for i in range(4)]
    texts += ["Licensed under CC BY-NC 4.0.", prose(1, 80).upper(), texts[40]]
    ids = list(range(0, 3 * len(texts), 3))
    root = tmp_path_factory.mktemp("tables")
    langs = [("en", "fr", None)[i % 3] for i in ids]
    docs = pa.table({"doc_id": ids, "text": pa.array(texts, pa.string()), "lang": pa.array(langs, pa.string()), "source": [f"s{i % 4}" for i in ids], "n_chars": [len(t or "") for t in texts], "score": [1.0] * len(ids), "kept": ["x"] * len(ids), "bpe": [1] * len(ids)})
    quality = [0 if t and "***" in t else 1 for t in texts]
    toxic = [int(bool(t) and "vile filth" in t) for t in texts]
    labels = pa.table({"doc_id": pa.array([*ids, None], pa.int64()), "quality": pa.array([*quality, 1], pa.int32()), "toxic": pa.array([*toxic, 1], pa.int32())})
    bench = pa.table({"item_id": ["b1", "b2", "b3", "b4"], "text": [prose(950, 14), "zig zag zig", None, ""]})
    for name, t in (("documents", docs), ("labels", labels), ("benchmark", bench)):
        pq.write_table(t, root / f"{name}.parquet")
    return str(root), dict(zip(ids, texts, strict=True))


def rows(df):
    return {r["doc_id"]: r for r in df.collect()}


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_equals_sql(spark, folder, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.sql(f"create view {table} as select * from '{folder[0]}/{table}.parquet'")
    want = con.sql(sql.ORACLES[name])
    got = queries.QUERIES[name](spark, folder[0])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    at = [want.columns.index(c) for c in order]
    assert sorted(map(repr, (tuple(r[c] for c in order) for r in got.collect()))) == sorted(map(repr, (tuple(r[i] for i in at) for r in want.fetchall())))


def test_quality_rules(spark, folder):
    path, texts = folder
    got = rows(queries.op2_quality_rules(spark, path))
    assert set(got) == set(texts)
    for i, t in texts.items():
        t = t or ""
        words = SPACED.findall(t)
        seen, dup = set(), 0
        for x in t.split("\n"):
            if SPACED.search(x):
                dup += x in seen
                seen.add(x)
        threes = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
        hit = {j for k in range(len(words) - 2) if threes[tuple(words[k : k + 3])] > 1 for j in range(k, k + 3)}
        failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(words), sum(map(len, words)), sum(t.count(c) for c in "#*$%&|<>"), dup, len(hit), failed), i
        assert not (failed and r.kept)


def test_bpe(spark, folder):
    tokenizers = pytest.importorskip("tokenizers")
    path, texts = folder
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    got = rows(queries.op5_bpe(spark, path))
    for i, t in texts.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        assert tuple(got[i][c] for c in ("n_tokens", "ids_sha256", "decoded_sha256")) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))), i


def test_toxicity(spark, folder):
    path, texts = folder
    got = rows(queries.op10_toxicity(spark, path))
    assert set(got) == set(texts) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) and r.held_out == (crc(i) % 3 == 1) for i, r in got.items())
    held = [(r.score, bool(texts[i]) and "vile filth" in texts[i]) for i, r in got.items() if r.held_out]
    ranked = [a > b for a, x in held if x for b, y in held if not y]
    assert sum(ranked) >= 0.9 * len(ranked)


def brute_scores(texts):
    """Every text's base and model score, context by context and dish by dish, with the operator's draws; and the model itself."""
    tokens = {}
    for i, t in texts.items():
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
        tokens[i] = [*SPACED.findall(low), None]
    hashed = {None: int(hpyp.END), "": int(hpyp.START)}
    for w in {w for ws in tokens.values() for w in ws if w}:
        hashed[w] = int(hpyp.tx.Rolling(np.frombuffer(w.encode(), np.uint8)).ranges(np.array([0]), np.array([len(w.encode())]))[0])
    key = {w: h & ((1 << 48) - 1) for w, h in hashed.items()}
    train = [tokens[i] for i in texts if crc(i) % 10 != 0]
    counts, pairs = Counter(w for ws in train for w in ws), Counter()
    for ws in train:
        pairs.update(zip(["", *ws[:-1]], ws, strict=True))
    total, size = sum(counts.values()), len(counts)
    dishes = defaultdict(list)
    for u, w in sorted(pairs, key=lambda p: (key[p[0]], key[p[1]])):
        dishes[u].append(w)
    t = dict.fromkeys(pairs, 1)
    guests = Counter(w for _, w in pairs)
    top = dict.fromkeys(guests, 1)
    one = lambda x, kind: np.array([x], kind)
    kept = []
    for sweep in range(hpyp.SWEEPS):
        served, tables = sum(guests.values()), sum(top.values())
        base = (hpyp.TOP_STRENGTH + hpyp.TOP_DISCOUNT * tables) / (size + 1)
        for u, own in dishes.items():
            many = [w for w in own if pairs[u, w] > 1]
            opened = sum(t[u, w] for w in own)
            for step in range(hpyp.STEPS):
                now, change = [w for k, w in enumerate(many) if (k * hpyp.STEPS // len(many) if len(many) <= hpyp.WIDE else 0) == step], 0
                for w in now:
                    held = t[u, w]
                    left = guests[w] - held
                    chance = (left - hpyp.TOP_DISCOUNT * min(top[w], left) + base) / (hpyp.TOP_STRENGTH + served - held)
                    draw = hpyp.tx.mix(one(key[u], np.uint64) * np.uint64(0x9FB21C651E98DF25) + hpyp.tx.mix(one(key[w], np.uint64) + np.uint64(sweep)))
                    others = opened - held
                    t[u, w] = int(hpyp.reseat(one(pairs[u, w], np.int64), lambda r, n, o=others, c=chance: (hpyp.STRENGTH + hpyp.DISCOUNT * (o + n)) * c, hpyp.DISCOUNT, draw)[0])
                    change += t[u, w] - held
                opened += change
        guests = Counter()
        for (_, w), n in t.items():
            guests[w] += n
        top = {w: int(hpyp.reseat(one(n, np.int64), lambda r, k, m=top[w]: (hpyp.TOP_STRENGTH + hpyp.TOP_DISCOUNT * (tables - m + k)) / (size + 1), hpyp.TOP_DISCOUNT, hpyp.tx.mix(one(key[w], np.uint64) + np.uint64(sweep) * np.uint64(0xD6E8FEB86659FD93)))[0]) for w, n in guests.items()}
        if sweep >= hpyp.BURN:
            kept.append((dict(t), dict(guests), dict(top)))

    opened = [Counter() for _ in kept]
    for o, (seats, _, _) in zip(opened, kept, strict=True):
        for (u, _), n in seats.items():
            o[u] += n

    def probability(w, u):
        out = 0
        for (seats, g, m), o in zip(kept, opened, strict=True):
            p = (g.get(w, 0) - hpyp.TOP_DISCOUNT * m.get(w, 0) + (hpyp.TOP_STRENGTH + hpyp.TOP_DISCOUNT * sum(m.values())) / (size + 1)) / (hpyp.TOP_STRENGTH + sum(g.values()))
            seen = len(train) if u == "" else counts[u]
            out += (pairs[u, w] - hpyp.DISCOUNT * seats.get((u, w), 0) + (hpyp.STRENGTH + hpyp.DISCOUNT * o[u]) * p) / (hpyp.STRENGTH + seen)
        return out / len(kept)

    found = {i: (len(ws), sum(counts[w] > 0 for w in ws), total, sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (size + 1))) for w in ws), sum(math.log10(probability(w, u)) for u, w in zip(["", *ws[:-1]], ws, strict=True))) for i, ws in tokens.items()}
    return found, probability, counts


def test_language_model(spark, folder, tmp_path):
    path, texts = folder
    texts = {i: t for i, t in texts.items() if len(t or "") < 5000} | {500 + i: f"{prose(i, 40, 3)} the end" for i in range(30)}
    pq.write_table(pa.table({"doc_id": list(texts), "text": pa.array(list(texts.values()), pa.string())}), tmp_path / "documents.parquet")
    want, probability, counts = brute_scores(texts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("3", "7"):  # the sample does not depend on them
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = rows(queries.op1_lm_scoring(spark, str(tmp_path)))
            assert set(got) == set(texts)
            for i, w in want.items():
                r = got[i]
                assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (*w[:3], crc(i) % 10 == 0)
                assert r.base_score == pytest.approx(w[3], rel=1e-9) and r.score == pytest.approx(w[4], rel=1e-4), i
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for context in ("", "amber0", "never seen"):
        assert sum(probability(w, context) for w in [*counts, "unknown"]) == pytest.approx(1)
    held = [i for i in texts if crc(i) % 10 == 0]
    assert sum(got[i].score for i in held) > sum(got[i].base_score for i in held)


def test_hot_contexts_change_nothing(spark, folder, monkeypatch):
    """Contexts dealt by pair give nearly the scores of contexts in one place: only their steps differ."""
    path, _ = folder
    docs = queries.table(spark, path, "documents", "doc_id", "text")
    whole = rows(hpyp.score(docs))
    monkeypatch.setattr(hpyp, "HOT", 20)
    split = rows(hpyp.score(docs))
    assert all(split[i].score == pytest.approx(whole[i].score, rel=0.02) for i in whole)


@pytest.mark.parametrize(("n", "weight"), [(40, 3.0), (400, 60.0)])
def test_new_tables_are_opened_as_often_as_customer_by_customer(n, weight):
    discount, chance = 0.75, {1: 1.0}  # the chance of each number of tables, after the first customer
    for c in range(1, n):
        nxt = Counter()
        for t, p in chance.items():
            opens = weight / (weight + c - discount * t)
            nxt[t + 1] += p * opens
            nxt[t] += p * (1 - opens)
        chance = nxt
    mean = sum(t * p for t, p in chance.items())
    spread = math.sqrt(sum((t - mean) ** 2 * p for t, p in chance.items()))
    key = hpyp.tx.mix(np.arange(20_000, dtype=np.uint64))
    got = hpyp.reseat(np.full(20_000, n), lambda r, t: np.full(len(r), weight), discount, key)
    assert got.mean() == pytest.approx(mean, rel=0.02) and got.std() == pytest.approx(spread, rel=0.1)
    assert hpyp.reseat(np.array([1, 0]), None, discount, key[:2]).tolist() == [1, 0]


def alike(texts, grams, share=80):
    """The least index of each text's component of similar sets."""
    sets, first = [grams(t) for t in texts], list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if first[a] != first[b] and both and both * 100 >= share * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((first[a], first[b]))
                first = [low if x == high else x for x in first]
    return first


def test_pipeline(spark, folder, monkeypatch):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}

    def watched(name, stage):
        def run(session, given, sf_dir):
            out = stage(session, given, sf_dir)
            seen[name] = out.columns, {r.doc_id: r for r in out.collect()}
            return out

        return name, run

    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(*s) for s in corpus_pipeline.STAGES])
    result = {r.doc_id: (r.n_tokens, r.ids, r.exact) for r in corpus_pipeline.run(spark, path).collect()}
    assert list(seen) == ["quality_rules", "line_dedup", "near_dedup", "decontaminate", "bpe_tokens"]
    assert all(seen[name][0] == docs.columns for name in list(seen)[:-1])

    kept = {i for i, r in rows(queries.op2_quality_rules(spark, path)).items() if r.kept}
    left = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    assert {i: r.text for i, r in seen["quality_rules"][1].items()} == left

    lines = [(i, k, x) for i in sorted(left) for k, x in enumerate(left[i].split("\n"))]
    worded = [p for p in lines if SPACED.search(p[2])]
    names = sorted({p[2] for p in worded})
    group = dict(zip(names, alike(names, lambda x: {x[k : k + 5] for k in range(max(len(x) - 4, 1))}), strict=True))
    first, gone = set(), set()
    for i, k, x in worded:
        if group[x] in first:
            gone.add((i, k))
        first.add(group[x])
    left = {i: "\n".join(x for j, k, x in lines if j == i and (j, k) not in gone) for i in left}
    assert {i: (r.text, r.n_chars) for i, r in seen["line_dedup"][1].items()} == {i: (t, len(t)) for i, t in left.items()}

    def shingles(text):
        w = SPACED.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        return {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()

    order = sorted(left)
    group = alike([left[i] for i in order], shingles)
    left = {i: left[i] for k, i in enumerate(order) if group[k] == k}
    assert set(seen["near_dedup"][1]) == set(left)

    left = {i: t for i, t in left.items() if not hits(t)}
    assert set(seen["decontaminate"][1]) == set(left) < set(seen["near_dedup"][1])

    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_path())
    want = {i: library.encode(t, add_special_tokens=False).ids for i, t in left.items()}
    assert result == {i: (len(x), x, True) for i, x in want.items()}


def hits(text):
    """Whether a twentieth of a text's words stand in windows of the fixture's benchmark."""
    low = lambda t: ALNUM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t))
    words, hit = low(text), set()
    for item in (low(prose(950, 14)), low("zig zag zig")):
        size = min(13, len(item))
        windows = {tuple(item[k : k + size]) for k in range(len(item) - size + 1)}
        hit |= {j for k in range(len(words) - size + 1) if tuple(words[k : k + size]) in windows for j in range(k, k + size)}
    return bool(hit) and 20 * len(hit) >= len(words)
