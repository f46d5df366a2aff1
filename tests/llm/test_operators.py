"""Corpus operators against brute force on small fixtures, with nulls, empty texts and repeated rows."""

import re

import numpy as np
import pytest

from plumbline.llm import automata, bpe, cluster, decontamination, graph, hpyp, licenses, lines, neardup, quality, suffixes, toxicity
from plumbline.llm.cluster import Scratch

SCHEMA = "doc_id long, text string"
WORDS = "amber birch cedar delta ember fjord grove haven inlet jetty kelp lagoon marsh north ocean pine quay reef shore tide".split()


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"{WORDS[i]}{j}" for i, j in zip(rng.integers(0, 20, n), rng.integers(0, 50, n), strict=True))


@pytest.fixture(scope="module")
def docs(spark):
    shared = prose(99, 60)
    rows = [(i, prose(i, 80)) for i in range(6)]
    rows += [(6, f"{prose(60, 20)} {shared} {prose(61, 20)}"), (7, f"{prose(70, 30)} {shared}"), (8, shared), (9, shared), (10, rows[0][1]), (11, rows[1][1].replace("amber", "umber", 1)), (12, ""), (13, None), (None, prose(5, 30)), (14, "é\x00ß 😀 " + shared[:40])]
    return spark.createDataFrame(rows, SCHEMA), rows


def got(df, *columns):
    return {r.doc_id: tuple(r[c] for c in columns) for r in df.collect()}


def test_suffix_array(docs):
    df, rows = docs
    order = lambda i: (i is None, i or 0)
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for s in range(len(b) - 49):
            w = b[s : s + 50]
            first[w] = min(first.get(w, (True, 1)), order(i))
    found = got(suffixes.remove_repeats(df), "n_bytes", "n_removed", "kept")
    for i, t in rows:
        b = (t or "").encode()
        gone = set()
        for s in range(len(b) - 49):
            if first[b[s : s + 50]] < order(i):
                gone |= set(range(s, s + 50))
        assert found[i] == (len(b), len(gone), bytes(x for k, x in enumerate(b) if k not in gone))


def test_sorter_is_a_suffix_array():
    rng = np.random.default_rng(3)
    data = rng.integers(97, 99, 700).astype(np.uint8)
    data[300:420] = data[20:140]
    raw = data.tobytes()
    assert suffixes.Sorter(data).sort(np.arange(700)).tolist() == sorted(range(700), key=lambda i: raw[i:])
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))


def test_automata(docs):
    df, rows = docs
    words = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for i, w in sorted(words, key=lambda x: (x[0] is None, x[0] or 0)):
        for s in range(len(w) - 19):
            first.setdefault(tuple(w[s : s + 20]), (i, s))
    found = got(automata.remove_repeats(df), "n_words", "n_removed", "kept")
    for i, w in words:
        gone = {k for s in range(len(w) - 19) if first[tuple(w[s : s + 20])] != (i, s) for k in range(s, s + 20)}
        assert found[i] == (len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone))


def test_matching_statistics(spark):
    a = automata.SuffixAutomaton()
    a.add("abcbc")
    a.add("bcd")
    assert a.matching("xbcbcdab") == [0, 1, 2, 3, 4, 3, 1, 2]
    df = spark.createDataFrame([(1, f"x {prose(1, 25)} y"), (2, None)], SCHEMA)
    ref = spark.createDataFrame([(prose(1, 25),)], "text string")
    assert got(automata.remove_reference(df, ref), "kept") == {1: ("x y",), 2: ("",)}


def test_near_duplicates(docs):
    df, _ = docs
    found = got(neardup.groups(df, shingle=4), "component_id")
    assert found[10] == (0,) and found[11] == (1,) and found[9] == (8,) and found[12] == (12,) and found[None] == (None,)


def test_near_duplicates_of_a_template(spark, monkeypatch):
    """Pairs at 0.83 in a family at 0.75 are found in blocks too."""
    monkeypatch.setattr(neardup, "BLOCK", 16)
    template, texts = prose(600, 147), []
    for i in range(60):
        head = prose(700 + i, 8)
        texts += [f"{template} {head} {prose(800 + 2 * i + k, 16)}" for k in range(2)]
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in (t.split() for t in texts)]
    alike = {(a, b) for b in range(120) for a in range(b) if len(sets[a] & sets[b]) * 100 >= 80 * len(sets[a] | sets[b])}
    assert alike == {(i, i + 1) for i in range(0, 120, 2)}
    words = prose(7, 200).split()
    chain = [(500 + i, " ".join([*words[:150], *(f"v{i // 2}x{k}" for k in range(10)), *words[160:]])) for i in range(40)]
    chain += [(503, chain[3][1]), (503, "another text of the same id with some words")]
    found = {}
    for r in neardup.groups(spark.createDataFrame([*enumerate(texts), *chain], SCHEMA), shingle=4).collect():
        found.setdefault(r.doc_id, set()).add(r.component_id)
    assert [found[i] for i in range(120)] == [{i - i % 2} for i in range(120)]
    assert all(min(found[500 + i]) == 500 for i in range(40))  # copies in one bucket, equal ids and rows included


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 101), (100, 102), (5, 5)]
    found = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark)).collect()}
    assert found == {**dict.fromkeys(range(21), 0), **dict.fromkeys((100, 101, 102), 100)}


def test_lines(spark):
    line = "The quick brown fox jumps over the lazy dog by the river bank today"
    rows = [(1, f"{line}\n\nown one"), (2, f"{line}.\nown two\n"), (3, line), (4, None), (5, ""), (None, line)]
    found = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found == {1: f"{line}\n\nown one", 2: "own two\n", 3: "", 4: None, 5: "", None: ""}


def alike_lines(texts):
    """Brute force: the place of the first line of each text's component of alike lines."""
    sets = [{t[i : i + 5] for i in range(max(len(t) - 4, 1))} for t in texts]
    first = list(range(len(texts)))
    for b in range(len(texts)):
        for a in range(b):
            both = len(sets[a] & sets[b])
            if first[a] != first[b] and both * 100 >= 80 * (len(sets[a]) + len(sets[b]) - both):
                low, high = sorted((first[a], first[b]))
                first = [low if x == high else x for x in first]
    return first


def kept_lines(spark, texts):
    found = {r.doc_id: r.text for r in lines.dedup(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    return [i for i in range(len(texts)) if found[i]]


def test_lines_of_a_template_and_without_white_space(spark):
    template = prose(500, 12)
    texts = [x for i in range(20) for x in (prose(i, 12).replace(" ", "/"), "x" + prose(i, 12).replace(" ", "/")[1:])]
    for i in range(100):
        own = prose(1000 + i, 6)
        texts += [f"{template} {own}", f"{template} {own.rsplit(' ', 1)[0]} {prose(3000 + i, 1)}"]
    first = alike_lines(texts)
    assert first[:40] == [i - i % 2 for i in range(40)] and len(set(first)) > 40
    assert kept_lines(spark, texts) == [i for i in range(len(texts)) if first[i] == i]


def test_decontamination(spark):
    bench = spark.createDataFrame([("a", "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), ("b", "zig zag"), ("c", None)], "item_id string, text string")
    df = spark.createDataFrame([(1, "x TWO three, four five six seven eight nine ten eleven twelve thirteen fourteen y"), (2, "zig-zag"), (3, "two three four five six seven eight nine ten eleven twelve thirteen"), (4, None)], SCHEMA)
    for size in (1 << 20, 20):
        found = {r.doc_id: (r.c.n_words, [(s.start, s.end) for s in r.c.spans], r.c["items"]) for r in decontamination.find_contamination(df, bench, into="c", block_bytes=size).collect()}
        assert found == {1: (15, [(1, 14)], ["a"]), 2: (2, [(0, 2)], ["b"]), 3: (12, [], []), 4: (0, [], [])}


def test_quality(spark):
    good = [(i, prose(i, 100)) for i in range(40)]
    bad = [(100 + i, " ".join(f"{w}***" for w in prose(i, 100).split())) for i in range(20)]
    df = spark.createDataFrame([*good, *bad, (200, "a b c\na b c\n" * 30), (201, None)], SCHEMA)
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1)], "doc_id long, quality int")
    found = {r.doc_id: r.q for r in quality.judge(df, labels, into="q").collect()}
    assert all(found[i].kept for i, _ in good) and not any(found[i].kept for i, _ in bad)
    assert (found[200].n_words, found[200].n_dup_lines, found[200].n_repeat_words, found[200].base_failed) == (180, 59, 180, True)
    assert found[201].n_words == 0 and found[201].base_failed


def test_bpe(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    texts = [prose(1, 50), "", None, "aaaa aaaaaaa", "<|endoftext|>a<|endoftext|>", "日本 😀 don't  \n\t x", "9" * 200]
    found = got(bpe.tokenize(spark.createDataFrame(list(enumerate(texts)), SCHEMA), path).select("doc_id", "bpe.*"), "ids", "decoded")
    library = tokenizers.Tokenizer.from_file(path)
    for i, t in enumerate(texts):
        assert found[i] == (library.encode(t or "", add_special_tokens=False).ids, t or "")


def test_licenses(spark):
    rows = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.txt", "nothing"), ("c/x.txt", "x\nLicensed under the Apache License, Version 2.0."), ("d/x.txt", None), (None, "y")]
    found = {r.path: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert found == {"a/LICENSE": ("MIT", "header"), "a/b/x.txt": ("MIT", "directory"), "c/x.txt": ("Apache-2.0", "header"), "d/x.txt": (None, "none"), None: (None, "none")}


def test_toxicity(spark):
    rows = [(i, prose(i, 30) + (" vile words" if i % 3 == 0 else "")) for i in range(120)]
    df = spark.createDataFrame([*rows, (500, None)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(80)], "doc_id long, toxic int")
    model = toxicity.fit(df, labels, lang=None)
    found = {r.doc_id: r.toxicity.score for r in toxicity.classify(df, model, lang=None).collect()}
    assert sum((found[i] >= 0.5) == (i % 3 == 0) for i in range(80, 120)) >= 38 and 0 <= found[500] <= 1


def test_language_model(docs):
    df, rows = docs
    found = {r.doc_id: r for r in hpyp.score(df).collect()}
    assert found[12].n_tokens == found[13].n_tokens == 1 and found[None].held_out
    assert found[9].n_tokens == 61 and found[9].score > found[9].base_score
    assert hpyp.score(df.limit(0)).count() == 0


def test_equal_rows_are_not_wiped_out(spark):
    """Rows that share an id lose nothing to each other, whatever batch they come in; later ids and places do."""
    text, other = prose(1, 60), prose(2, 60)
    rows = [(1, text), (1, text), (1, f"{other} {prose(3, 25)}"), (2, f"{text} {text}"), (None, text), (None, other)]
    for parts in (1, 6):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        words = sorted((r.doc_id or 9, r.n_words, r.n_removed) for r in automata.remove_repeats(df).collect())
        assert words == [(1, 60, 0), (1, 60, 0), (1, 85, 0), (2, 120, 120), (9, 60, 60), (9, 60, 60)]
        first = sorted((r.doc_id or 9, r.n_removed) for r in suffixes.remove_repeats(df).collect())
        assert [n for i, n in first if i == 1] == [0, 0, 0] and all(n for i, n in first if i > 1)
    within = spark.createDataFrame([(1, f"{text} {text}"), (1, f"{other} {other}")], SCHEMA)
    assert sorted(r.n_removed for r in automata.remove_repeats(within).collect()) == [60, 60]


def test_equal_ids_keep_their_own_spans(spark):
    text, own = prose(1, 40), prose(5, 40)
    rows = [(1, text), (2, f"{text} {own}"), (2, own)]
    found = sorted((r.n_words, r.n_removed, r.kept) for r in automata.remove_repeats(spark.createDataFrame(rows, SCHEMA)).collect())
    assert found == sorted([(40, 0, own), (40, 0, text), (80, 40, own)])


def test_license_units(spark):
    wrapped = "# This program is free software: you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation, either version 3 of the License, or\n# (at your option) any later version.\n#\nimport os\n" + "x = 1\n" * 50
    title = "                    GNU GENERAL PUBLIC LICENSE\n                       Version 3, 29 June 2007\n\n Copyright (C) 2007 Free Software Foundation\n"
    long, short = (" ".join(["w" * n] * 15) + " Released under the MIT License." for n in (300, 3))
    rows = [("a/x.py", wrapped), ("b/COPYING", title), ("b/c/y", "z"), ("d/x", "Licensed under CC BY-NC 4.0."), ("d/y", "z"), ("e/x", long), ("e/y", "z"), ("f/x", short), ("f/y", "z"), ("g/x", None), ("h/x", "")]
    found = {r.path: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert found["a/x.py"] == ("GPL-3.0", "header") and found["b/COPYING"] == ("GPL-3.0", "header") and found["b/c/y"] == ("GPL-3.0", "directory")
    assert found["d/x"] == ("CC-BY-NC-4.0", "header") and found["d/y"] == ("CC-BY-NC-4.0", "directory")
    assert found["e/y"] == found["f/y"] == (None, "none")  # the length of the words does not matter
    import re as regex

    assert all(regex.search(licenses.CUE, t) for _, t in licenses.TEMPLATES)


def test_license_columns_that_clash(spark):
    df = spark.createDataFrame([("a/LICENSE", "Released under the MIT License.", "mine", 1)], "path string, text string, license string, Cosine int")
    out = licenses.scan(df, keep=["path", "license", "Cosine"])
    assert out.columns == ["path", "license", "cosine", "origin"] and out.first().license == "MIT"
    assert licenses.scan(df, keep=["license"]).columns == ["license", "cosine", "origin"]


def test_toxicity_without_labels_of_both_kinds(spark):
    df = spark.createDataFrame([(1, "a b"), (2, None)], SCHEMA)
    for rows, want in (([], 0.0), ([(1, 1)], 1.0), ([(1, 0), (2, 0)], 0.0), ([(1, 1), (1, 0)], 0.0), ([(None, 1), (2, None)], 0.0)):
        model = toxicity.fit(df, spark.createDataFrame(rows, "doc_id long, toxic int"), lang=None)
        assert {r.toxicity.score for r in toxicity.classify(df, model, lang=None).collect()} == {want}


def test_toxicity_sample_is_bounded_in_bytes(spark):
    df = spark.createDataFrame([(i, "word " * (1000 if i == 3 else 10)) for i in range(12)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    table = toxicity._sample(df, labels, "text", "doc_id", "toxic", None, None, (100, 100), 400)
    assert sum(map(len, table["text"].to_pylist())) <= 400 and 3 not in table["id"].to_pylist() and table.num_rows == 8


def test_toxicity_learns_from_all_labels(spark):
    """Whatever the driver's first sample holds, and however many shards there are."""
    rows = [(i, prose(i, 30) + (" vile words" if i % 3 == 0 else "")) for i in range(360)]
    df = spark.createDataFrame([*rows, (0, None)], SCHEMA)
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    for size in (1 << 20, 20_000):
        model = toxicity.fit(df, labels, lang=None, max_positive=2, max_negative=2, shard_bytes=size)
        found = {r.doc_id: r.toxicity.score for r in toxicity.classify(df, model, lang=None).collect() if r.doc_id}
        assert sum((found[i] >= 0.5) == (i % 3 == 0) for i in range(300, 360)) >= 57


def test_toxicity_thresholds_of_all_rows(spark):
    rng = np.random.default_rng(4)
    seen = [(lang, float(s) / 50, int(rng.random() < s / 60)) for lang, n in (("a", 400), ("b", 90), ("", 8)) for s in rng.integers(0, 50, n)]
    found = toxicity._thresholds(spark.createDataFrame(seen, "lang string, score double, y int"), 20, 0.7, Scratch(spark))
    want = {"": 0.7}
    for lang in ("a", "b"):
        own = [(s, y) for x, s, y in seen if x == lang]
        at = sorted({s for s, _ in own}, reverse=True)
        f1 = [2 * sum(y for s, y in own if s >= t) / (sum(s >= t for s, _ in own) + sum(y for _, y in own)) for t in at]
        k = int(np.argmax(f1))
        want[lang] = (at[k] + [*at, 0.0][k + 1]) / 2
    assert found == want


def test_quality_joins_when_labels_are_many(spark):
    texts = [(i, prose(i, 100) if i % 3 else " ".join(f"{w}***" for w in prose(i, 100).split())) for i in range(60)]
    df, labels = spark.createDataFrame(texts, SCHEMA), spark.createDataFrame([(i, int(i % 3 > 0)) for i, _ in texts], "doc_id long, quality int")
    few, many = ({r.doc_id: (r.q.score, r.q.kept) for r in quality.judge(df, labels, into="q", max_held=n).collect()} for n in (1000, 0))
    assert few == many and all(few[i][1] == bool(i % 3) for i in few)


def test_columns_that_clash(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    df = spark.createDataFrame([(1, prose(1, 60), "mine", 7)], "doc_id long, text string, found string, Score int")
    labels, bench = spark.createDataFrame([(1, 1)], "doc_id long, quality int"), spark.createDataFrame([("a", "b c")], "item_id string, text string")
    made = [quality.judge(df, labels, into="found"), bpe.tokenize(df, path, into="FOUND"), decontamination.find_contamination(df, bench, into="found"), toxicity.classify(df, toxicity.Model(), lang=None, into="score"), lines.dedup(df, report=("found", "score"))]
    for out in made:
        names = [c.lower() for c in out.columns]
        assert len(set(names)) == len(names) and out.count() == 1


def test_empty_tables(spark):
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    df = spark.createDataFrame([], SCHEMA)
    labels, bench = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id string, text string")
    made = [hpyp.score(df), quality.judge(df, labels), lines.dedup(df), suffixes.remove_repeats(df), bpe.tokenize(df, path), decontamination.find_contamination(df, bench), neardup.groups(df), automata.remove_repeats(df), automata.remove_reference(df, df), licenses.scan(df.withColumnRenamed("doc_id", "path").selectExpr("cast(path as string) path", "text")), toxicity.classify(df, toxicity.fit(df, labels, lang=None), lang=None)]
    assert [out.count() for out in made] == [0] * len(made)


def test_empty_benchmark_hits_nothing(spark):
    df = spark.createDataFrame([(1, prose(1, 30)), (1, prose(1, 30)), (None, None)], SCHEMA)
    out = decontamination.find_contamination(df, spark.createDataFrame([], "item_id string, text string"), into="c").collect()
    assert sorted((r.doc_id or 0, r.c.n_words, r.c.spans, r.c["items"]) for r in out) == [(0, 0, [], []), (1, 30, [], []), (1, 30, [], [])]


def test_ties_in_the_quality_threshold():
    assert quality.least_harm(np.array([3.0, 4.0]), np.array([1.0, 2.0]), 20) == 2.5
    assert quality.least_harm(np.array([]), np.array([1.0]), 20) == -np.inf
    same = np.array([1.0, 1.0])
    assert quality.least_harm(same, same, 20) <= 1.0


def test_quality_threshold_of_all_labelled_rows(spark):
    """The cut of sorted ranges is that of all rows in one place, ties, single ranges and one-sided tables included."""
    rng = np.random.default_rng(8)
    tables = [(rng.normal(0.5, 1, 300), rng.normal(-0.5, 1, 400)), (rng.integers(0, 9, 200) / 4, rng.integers(-6, 5, 900) / 4), (np.array([1.0, 1.0]), np.array([1.0, -0.0])), (np.array([3.0]), np.array([1.0])), (np.array([1.0]), np.array([3.0] * 50)), (np.array([]), np.array([1.0]))]
    tables.append((np.repeat(np.arange(0, 40, 2.0), 1), np.repeat(np.arange(-1, 39, 2.0), 20)))  # every second cut is a best one
    for good, bad in tables:
        rows = [(quality.JUDGED_GOOD, float(x)) for x in good] + [(quality.JUDGED_BAD, float(x)) for x in bad]
        seen = spark.createDataFrame(rows, "role int, score double").repartition(3)
        assert quality.least_harm_of(seen, 20) == quality.least_harm(good, bad, 20)
    assert not hasattr(quality, "MAX_LABELLED")


def test_shared_members():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 20_000, n).astype(np.uint64)) for n in (0, 1, 5000, 9000, 9000)]
    got = neardup._shared(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(5) for j in range(5) if i != j)


def test_line_signatures_agree(spark):
    """The share of agreeing slots follows the similarity, so that no alike pair is left unasked."""
    base = prose(5, 60)
    texts = [base, base.replace(base[100:110], "qqqqqqqqqq"), prose(6, 60), "short line", "short lime"]
    once = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "h1 long, line string")
    signed = lines.signatures(once)
    assert {r.h1: len(r.bands) for r in signed.collect()}[0] == lines.BANDS
    edges = spark.createDataFrame([(0, 1), (0, 2), (3, 4)], "a long, b long")
    asked = {tuple(r) for r in lines._asked(edges, signed, Scratch(spark)).collect()}
    assert (0, 1) in asked and (0, 2) not in asked


def test_line_edge_cases(spark):
    rows = [(1, "same line of some length here\nsame line of some length here"), (1, "same line of some length here"), (2, "x"), (3, "x"), (4, "\n\n"), (5, "é😀日本" * 30 + "\n" + "é😀日本" * 30 + "!"), (6, "a" * 5000), (7, "a" * 5001)]
    got = sorted((r.doc_id, r.text) for r in lines.dedup(spark.createDataFrame(rows, SCHEMA)).collect())
    kept = [t for i, t in got if i == 1]
    assert sorted(map(len, kept)) == [0, 29] and dict(got)[3] == "" and dict(got)[4] == "\n\n" and dict(got)[5] == "é😀日本" * 30 and dict(got)[7] == ""


def test_line_dedup_leaves_one_table(spark, monkeypatch):
    """What the next stages do not read is gone before they begin."""
    made = []
    monkeypatch.setattr(lines, "Scratch", lambda session: made.append(Scratch(session)) or made[0])
    docs = spark.createDataFrame([(1, "one line of some length\nother words altogether here"), (2, "one line of some length\na third line that is new")], "doc_id long, text string")
    got = lines.dedup(docs)
    path, files = made[0]._file(made[0].root)
    assert len(files.listStatus(path)) == 1
    assert {r.doc_id: r.text for r in got.collect()} == {1: "one line of some length\nother words altogether here", 2: "a third line that is new"}


def test_line_dedup_keeps_no_band_keys(spark, monkeypatch):
    """Once buckets are formed, the keys of all lines are gone, and written tables are not counted again."""
    seen, verified = [], lines.verified

    def watched(pairs, texts, scratch):
        path, files = scratch._file(scratch.root)
        seen.extend(spark.read.parquet(f.getPath().toString()).columns for f in files.listStatus(path))
        return verified(pairs, texts, scratch)

    monkeypatch.setattr(lines, "verified", watched)
    base = prose(5, 60)
    docs = spark.createDataFrame([(i, base.replace(base[100:103], f"q{i}")) for i in range(6)] + [(9, prose(8, 60))], SCHEMA)
    assert {r.doc_id: len(r.text) > 0 for r in lines.dedup(docs).collect()} == {0: True, 1: False, 2: False, 3: False, 4: False, 5: False, 9: True}
    assert seen and not any("bands" in columns for columns in seen)


def test_written_tables_know_their_rows(spark, monkeypatch):
    scratch = Scratch(spark)
    tables = [scratch.cut(df) for df in (spark.range(7), spark.range(7).where("id > 9"), spark.range(9).repartition(3).groupBy("id").count())]
    whole = scratch.together(tables[:2])
    monkeypatch.setattr(type(whole), "limit", None)
    monkeypatch.setattr(type(whole), "isEmpty", None)
    assert [cluster.if_few(t) is not t for t in (*tables, whole)] == [True] * 4
    assert [cluster.is_empty(t) for t in (*tables, whole)] == [False, True, False, False]
    monkeypatch.undo()
    assert sorted(r.id for r in whole.collect()) == list(range(7))


def test_large_component_is_not_dealt_to_its_own_blocks(spark):
    """Every pair of two components meets, at a row or a few for each member and not one for each block."""
    group = {i: 0 if i < 300 else i for i in range(304)} | {i: i % 5 for i in range(400, 480)}
    bucket = lambda i: 1 if i < 400 else 2
    members = spark.createDataFrame([(bucket(i), i, g) for i, g in group.items()], "key long, id long, g long")
    found = graph.dealt(members.join(graph.blocks(members, "key", 16, Scratch(spark)), "key"), "key", "id").collect()
    assert sum(r.key == 1 for r in found) <= 300 + 4 * 20
    at = {}
    for r in found:
        at.setdefault((r.key, min(r.own, r.other), max(r.own, r.other)), []).append((r.id, r.own))
    met = [(a, b) for (_, low, high), rows in at.items() for a, x in rows for b, y in rows if a < b and group[a] != group[b] and (low == high or x != y)]
    want = {(a, b) for a in group for b in group if a < b and group[a] != group[b] and bucket(a) == bucket(b)}
    assert len(met) == len(set(met)) and set(met) == want


def test_toxicity_shards_are_files(spark):
    """The texts are dealt once; every later pass reads the shards as they were written."""
    df = spark.createDataFrame([(i, prose(i, 30)) for i in range(200)] + [(3, None)], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(190)], "doc_id long, toxic int")
    scratch = Scratch(spark)
    labelled = toxicity._labelled(df, labels, "text", "doc_id", "toxic", None, None, 5000, scratch)

    def work(shard, read, rows):
        yield rows.select(["id", "shard"]).combine_chunks().to_batches()[0]

    passed = toxicity._by_shard(labelled, work, "id long, shard int")
    assert "Exchange" not in passed._jdf.queryExecution().executedPlan().toString()
    rows = [(r.id, r.shard) for r in passed.collect()]
    assert sorted(i for i, _ in rows) == list(range(190)) and len({s for _, s in rows}) > 4
    assert all(len({s for j, s in rows if j == i}) == 1 for i in range(190))
