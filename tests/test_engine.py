"""The engine's queries against their SQL, and the formulas against worked numbers."""

import datetime as dt
import glob
import hashlib
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from plumbline import catalog
from plumbline.functions import text as tx
from plumbline.operators import corpus, frequent, overlaps, scoring, signals, validation
from plumbline.sources import pages, store
from plumbline.sources.adapters import view

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def flat(rows, columns):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda x: "null" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x)[:40]
    return sorted(tuple(cell(r[i]) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert flat([tuple(r) for r in got.collect()], got.columns) == flat(want.fetchall(), want.columns)


def one(spark, column, *values):
    return spark.createDataFrame([values], ", ".join(f"v{i} {'string' if isinstance(v, str) else 'double'}" for i, v in enumerate(values))).select(column).first()[0]


def test_text_edges(spark):
    v = F.col("v0")
    assert one(spark, tx.trigrams(v), "ab") == []
    assert one(spark, tx.trigrams(v), "  AbA  bA") == ["aba", "ba ", "a b", " ba"]
    assert one(spark, tx.shingle_hashes(v), "five words are too few") == []
    assert one(spark, tx.sentence_variation(v), "One. Two.") == 1.0
    assert one(spark, tx.specifics(v), "5 kg, 20%, $19.99, XK-200") == 4
    assert one(spark, tx.parse_count(v), "1,234 ratings") == 1234
    assert one(spark, tx.parse_votes(v), "One person found this helpful") == 1
    assert one(spark, tx.parse_review_date(v), "Reviewed in Spain on June 3, 2026") == dt.date(2026, 6, 3)
    assert one(spark, tx.asin_of_url(v), "https://x.example/dp/b00abcdef1?x=1") == "B00ABCDEF1"
    assert one(spark, tx.clamp(F.lit(None).cast("double")), "x") is None


def test_sentences_keep_their_ends(spark):
    """The third sentence lost what its number is made of, and edges of spaces stayed."""
    said = "One here.   Two here.  Item number 2.  1 of 31."
    assert one(spark, tx.sentences(F.col("v0")), said) == ["One here", "Two here", "Item number 2", "1 of 31"]
    assert one(spark, tx.sentence_variation(F.col("v0")), "a a a. b b b. c c 2.") == 0.0


def test_upsert_of_copies_does_not_depend_on_their_order(spark):
    """Two rows of a batch with one key and day: the first by place counts, however the rows are dealt."""
    kind = "seq long, asin string, review_key string, rating long, helpful_votes long, first_seen date, last_seen date"
    day = dt.date(2026, 1, 1)
    rows = [(i, "a", "k", i, v, day, day) for i, v in ((2, 9), (1, 4), (3, 0))]
    for n in range(3):
        batch = spark.createDataFrame(rows[n:] + rows[:n], kind).repartition(3)
        empty = batch.drop("seq").limit(0)
        got = corpus.upsert_reviews(empty, batch, "seq").first()
        assert (got.rating, got.helpful_votes, got.first_seen) == (1, 4, day)
        assert corpus.upsert_reviews(empty, batch.drop("seq")).first().helpful_votes == 0
        again = corpus.upsert_reviews(corpus.upsert_reviews(empty, batch, "seq"), batch.withColumn("last_seen", F.lit(dt.date(2026, 2, 1))).withColumn("helpful_votes", F.col("seq") + 10), "seq").first()
        assert (again.rating, again.helpful_votes, again.last_seen) == (1, 11, dt.date(2026, 2, 1))


def test_shared_keys_are_found_without_dealing_rows(spark, monkeypatch):
    """Rows of shared keys, in ranges of few keys, are those of a plain count."""
    monkeypatch.setattr(frequent, "PACKED", 50)
    monkeypatch.setattr(frequent, "BROADCAST", 40)
    rows = spark.createDataFrame([(f"k{i % 97 if i % 3 else i}", i) for i in range(900)] + [(None, 1)], "k string, i long").repartition(5)
    plain = {r.k for r in rows.groupBy("k").count().where("count >= 3 and k is not null").collect()}
    tables = [t.collect() for t in frequent.of_shared_keys(rows, F.when(F.col("k").isNotNull(), F.xxhash64("k")), 3)]
    got = [tuple(r) for t in tables for r in t]
    assert len(tables) > 1 and sorted(got) == sorted(tuple(r) for r in rows.collect() if r.k in plain)
    assert list(frequent.of_shared_keys(rows.limit(0), F.xxhash64("k"), 3))[0].count() == 0


def test_phrases_by_product_need_one_shuffle(spark):
    reviews = spark.read.parquet(f"{SF}/documents.parquet").select("text", F.concat(F.lit("a"), F.col("doc_id") % 7).alias("asin"))
    counted = corpus.count_sightings(corpus.shingle_rows(corpus.by_product(reviews), F.lit("2026-01-01").cast("date")))
    assert counted._jdf.queryExecution().sparkPlan().toString().count("Exchange") == 1
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_templates_meet_by_product_in_ranges_of_phrases(spark, monkeypatch):
    """A phrase on four products counts three others for a product seen with it and four for one that was not."""
    monkeypatch.setattr(frequent, "BROADCAST", 4)
    text = "one two three four five six seven eight nine ten"
    seen = spark.createDataFrame([(f"p{i}", text, dt.date(2026, 1, 1 + i)) for i in range(4)], "asin string, text string, day date")
    new = spark.createDataFrame([("p0", "a", text), ("q", "b", text), ("q", "c", "nothing of this was ever seen before by anyone"), ("q", "d", None)], "asin string, review_id string, text string")
    rows = corpus.shingle_sightings(seen, F.col("day"))
    got = {r.review_id: (r.reused, r.total, r.peak) for r in corpus.template_findings(new, rows).collect()}
    assert got == {"a": (5, 5, 3), "b": (5, 5, 4)}
    assert len(list(frequent.with_values(rows.select(F.xxhash64("shingle_hash").alias("k")), F.col("k"), rows.groupBy(F.xxhash64("shingle_hash").alias("key")).agg(F.count("*").alias("value")), "n"))) > 1


def test_golden_numbers(spark):
    for n, want in ((1, 0.212746), (8, 0.674389), (25, 1.0)):
        assert one(spark, scoring.sample_confidence(F.col("v0")), float(n)) == pytest.approx(want, abs=1e-6)
    for d, m, c, want in ((4.6, 0.0, 1.0, 4.6), (4.6, 0.3, 1.0, 4.4), (4.6, 0.3, 0.4, 4.5), (4.6, 0.95, 1.0, None)):
        assert one(spark, scoring.adjusted(F.col("v0"), F.col("v1"), F.col("v2")), d, m, c) == want
    for g, d, n, c, want in (("A", 1, 13, 9, "A"), ("A", 2, 13, 9, "B"), ("A", 3, 8, 9, "C"), ("A", 5, 8, 9, "D"), ("F", 5, 8, 9, "F"), ("D", 2, 13, 9, "D"), ("A", 0, 0, 9, "A"), ("A", 5, 8, 1, "C")):
        assert one(spark, scoring.capped(F.col("v0"), F.lit(d), F.lit(n), F.lit(c)), g) == want
    rows = [("n", 8400, 62.0, 18.0, 8.0, 4.0, 8.0), ("i", 9000, 96.0, 3.0, 1.0, 0.0, 0.0), ("none", 10, None, None, None, None, None)]
    got = {r.asin: r for r in signals.distribution(spark.createDataFrame(rows, "asin string, total_ratings long, h5 double, h4 double, h3 double, h2 double, h1 double")).collect()}
    assert got["n"].status == "pass" and got["i"].suspicion == pytest.approx(0.725) and got["none"].status == "insufficient-data"


def test_burst(spark):
    days = ["2026-01-05", "2026-02-11", "2026-06-01", "2026-06-01", "2026-06-02", "2026-06-03"]
    df = spark.createDataFrame([("a", i, f"r{i}", dt.date.fromisoformat(d)) for i, d in enumerate(days)], "asin string, seq long, review_id string, review_date date")
    got = signals.burst(df).orderBy("seq").collect()
    assert [r.seq for r in got] == [2, 3, 4, 5] and got[0].delta == pytest.approx(0.263927, abs=1e-6)
    assert signals.burst(df.limit(0)).count() == 0


def test_observations_and_salt(spark):
    rows = [(1, 4.0), (2, 4.0), (3, 4.5), (4, 4.0), (5, 4.0)]
    df = spark.createDataFrame([(i, "a", dt.datetime(2026, 1, i), r, 10, "t") for i, r in rows], "obs_id long, asin string, observed_at timestamp, displayed_rating double, total_ratings long, title_hash string")
    assert [r.obs_id for r in corpus.dedupe_observations(df).orderBy("obs_id").collect()] == [1, 3, 4]
    assert corpus.rating_shifts(corpus.dedupe_observations(df)).first().status == "fail"
    hashed = spark.createDataFrame([("x",), (None,)], "reviewer_hash string")
    assert corpus.check_salt(None, "a", hashed) == ("a", None) and corpus.check_salt("a", "b", hashed)[1]["orphaned_reviewers"] == 1


PAGE = """<html><span id="productTitle"> A  lamp </span><span data-hook="rating-out-of-text">4,6 out of 5</span><span id="acrCustomerReviewText">1,234 ratings</span>
<ul id="histogramTable"><li><a aria-label="5 stars represent 62% of rating"></a></li><li><a aria-label="4 stars represent 18% of rating"></a></li><li><a aria-label="3 stars represent 8% of rating"></a></li><li><a aria-label="1 stars represent 12% of rating"></a></li></ul>
<div data-hook="review" id="R1"><a class="a-profile" href="/gp/profile/abc/x"></a><i data-hook="review-star-rating"><span class="a-icon-alt">5.0 out of 5 stars</span></i><h5>Bright</h5><span data-hook="review-date">Reviewed on June 3, 2026</span><span data-hook="avp-badge">Verified</span><div data-hook="review-body"><span>Works for 3 weeks. Read more</span></div><span data-hook="helpful-vote-statement">One person found this helpful</span></div>
<div data-hook="review"><p>No rating here</p></div></html>"""


def test_pages(spark):
    df = spark.createDataFrame([(1, "https://x.example/dp/B00ABCDEF1", PAGE), (2, "https://x.example/dp/B00ABCDEF2", "enter the characters you see below"), (3, None, None)], "page_id long, url string, html string")
    found = pages.snapshots(df)
    s = found.first()
    assert (s.asin, s.title, s.displayed_rating, s.total_ratings, s.h5, s.h2) == ("B00ABCDEF1", "A lamp", 4.6, 1234, 62.0, None)
    r = pages.reviews(found).collect()
    assert len(r) == 1 and (r[0].review_id, r[0].rating, r[0].verified, r[0].text, r[0].helpful_votes, r[0].reviewer_id) == ("R1", 5, True, "Works for 3 weeks.", 1, "abc")


def snapshot_of(spark, **fields):
    own = {"asin": "a", "displayed_rating": 4.0, "total_ratings": 500, "h1": 3.0, "h2": 0.0, "h3": 1.0, "h4": 0.0, "h5": 96.0} | fields
    return spark.createDataFrame([tuple(own.values())], "asin string, displayed_rating double, total_ratings long, h1 double, h2 double, h3 double, h4 double, h5 double")


def reviews_of(spark, *rows):
    """Reviews of one listing from (rating, date, verified, text, votes, reviewer)."""
    made = [("a", i, f"r{i}", rating, dt.date.fromisoformat(day) if day else None, verified, text, votes, who) for i, (rating, day, verified, text, votes, who) in enumerate(rows)]
    return spark.createDataFrame(made, "asin string, seq long, review_id string, rating long, review_date date, verified boolean, text string, helpful_votes long, reviewer_id string")


LONG = "The lamp arrived in one piece and the cable is long enough to reach the desk from the far wall without trouble"
#: For each signal reviews of which the first is flagged, and what is said of it.
LIVE = {
    "verified": ([(5, None, False, LONG, 1, "u")], "Unverified purchase giving a 5-star rating"),
    "phrasing": ([(4, None, True, f"{LONG}. I received this product for free in exchange for my honest review.", 1, "u")], "Discloses a free or discounted product in exchange for the review"),
    "duplication": ([(4, None, True, LONG, 1, "u"), (4, None, True, f"{LONG}!", 1, "v")], "Text closely matches another review on this product"),
    "burst": ([(4, d, True, LONG[i:], 1, "u") for i, d in enumerate(["2026-06-01", "2026-06-01", "2026-06-02", "2026-06-03", "2026-01-05", "2026-02-11"])], "Posted in a cluster of 4 reviews within 3 days (around 2026-06-01), against a sample spanning 149 days"),
    "depth": ([(5, None, True, "Nice", 1, "u")], "5-star rating with only 1 word and no specifics"),
    "helpfulness": ([(5, "2025-09-01", True, LONG, 0, "u")], "Featured on the product page for 122 days without a single helpful vote"),
}


def test_every_signal_can_fire(spark):
    assert [s.name for s in signals.REGISTRY] == list(LIVE)
    snap = snapshot_of(spark)
    for name, (rows, said) in LIVE.items():
        one = scoring.assess(reviews_of(spark, *rows), snap, "2026-01-01" if name != "burst" else "2026-06-05").orderBy("seq").first()
        assert one[f"d_{name}"] > 0 and one[f"r_{name}"] == said and said in one["reasons"], name
    quiet = scoring.assess(reviews_of(spark, (4, None, True, LONG, 1, "u")), snap, "2026-01-01").first()
    assert quiet["suspicion"] == 0 and quiet["reasons"] == []


def test_registry_is_pluggable(spark):
    loud = signals.ReviewSignal("loud", "Loudness", "Nobody shouts.", columns=lambda as_of: (F.when(F.col("text").contains("!"), F.lit(0.5)), F.lit("Shouts")))
    reviews, snap = reviews_of(spark, (5, None, False, "Nice!", 1, "u"), (5, None, False, "Nice", 1, "u")), snapshot_of(spark)
    found = scoring.assess(reviews, snap, "2026-01-01", registry=[loud])
    assert [(r.suspicion, r.reasons) for r in found.orderBy("seq").collect()] == [(0.5, ["Shouts"]), (0.0, [])]
    details = {r.signal: (r.detail, r.evidence) for r in scoring.signal_details(found, snap, [loud]).collect()}
    assert details["loud"] == ("1 of 2 visible reviews flagged.", ["Shouts"]) and set(details) == {"loud", "distribution"}


def test_details_without_reviews_or_text(spark):
    none = reviews_of(spark).limit(0)
    said = {r.signal: (r.status, r.detail) for r in scoring.signal_details(scoring.assess(none, snapshot_of(spark), "2026-01-01"), snapshot_of(spark)).collect()}
    assert said["depth"] == ("insufficient-data", "No reviews were readable on this page.") and said["distribution"][0] == "warn"
    blank = reviews_of(spark, *[(5, None, True, x, 1, "u") for x in ("", " ", None)])
    found = scoring.assess(blank, snapshot_of(spark), "2026-01-01")
    said = {r.signal: r.status for r in scoring.signal_details(found, snapshot_of(spark, h1=None, h2=None, h3=None, h4=None, h5=None)).collect()}
    assert said == {"verified": "pass", "phrasing": "insufficient-data", "duplication": "insufficient-data", "burst": "pass", "depth": "insufficient-data", "helpfulness": "pass", "distribution": "insufficient-data"}
    a = scoring.analyse(blank, snapshot_of(spark, h1=None, h2=None, h3=None, h4=None, h5=None), "2026-01-01")
    assert scoring.verdict(a).first().basis == "Based on the 3 reviews visible on this page. This is an estimate, not proof. Note: This tool couldn't read the review text on this page, so the language checks were skipped and this grade rests on less evidence than usual, and the rating breakdown wasn't readable either."


def test_rating_that_is_no_number(spark):
    a = scoring.analyse(reviews_of(spark, (5, None, False, LONG, 1, "u")), snapshot_of(spark, displayed_rating=float("nan")), "2026-01-01").first()
    assert a.adjusted_rating is None


def test_heavy_products_count_alike(spark, monkeypatch):
    edges = [(f"u{u}", f"p{p}") for u in range(12) for p in range(9) if (u * 7 + p * 5) % 4]
    df = spark.createDataFrame(edges, "reviewer string, asin string")
    pairs = lambda: {tuple(r) for r in corpus.reviewer_links(df, df).collect()}
    want = pairs()
    own = {u: {p for v, p in edges if v == u} for u, _ in edges}
    assert want == {(p, a, b, len(own[a] & own[b]) - 1) for a in own for b in own for p in own[a] & own[b] if a < b and len(own[a] & own[b]) >= 3}
    monkeypatch.setattr(corpus, "HEAVY", 6)
    assert pairs() == want


def test_pairs_are_counted_without_a_row_each(spark, monkeypatch):
    """In passes, in many buckets and with busy reviewers; targets that the corpus does not have count whole."""
    edges = {(f"u{u}", f"p{p}") for u in range(12) for p in range(9) if (u * 7 + p * 5) % 4}
    targets = {(u, p) for u, p in edges if p < "p5"} | {(f"u{u}", "new") for u in range(5)}
    tables = [spark.createDataFrame(sorted(t), "reviewer string, asin string") for t in (targets, edges)]
    own = {u: {p for v, p in edges if v == u} for u, _ in edges}
    met = [(p, a, b, len((own[a] & own[b]) - {p})) for a, p in targets for b, q in targets if p == q and a < b]
    want = {x for x in met if x[3] >= 2}
    monkeypatch.setattr(corpus, "_crowded_links", None)
    for name, value in (("AT_ONCE", 20), ("FEW", 0), ("PASSES", 3), ("BUSY", 4)):
        assert {tuple(r) for r in corpus.reviewer_links(*tables).collect()} == want
        monkeypatch.setattr(overlaps, name, value)
    assert {tuple(r) for r in corpus.reviewer_links(*tables).collect()} == want


def test_sweep_is_counted_as_it_sweeps(spark):
    """Phrases alone, twice in a listing, on other days and in swept listings."""
    day = lambda k: dt.date(2026, 1, k)
    seen = [("aa", "p1", day(1)), ("aa", "p1", day(1)), ("aa", "p1", day(2)), ("aa", "p2", day(3)), ("bb", "p2", day(1)), ("cc", "p2", day(1)), ("cc", "p3", day(1)), ("dd", "p3", day(4))]
    sightings = spark.createDataFrame(seen, "shingle_hash string, asin string, day date")
    reviews = spark.createDataFrame([("p1", day(1)), ("p2", dt.date(2020, 1, 1)), ("p3", day(1)), ("p3", day(2))], "asin string, last_seen date").withColumn("first_seen", F.col("last_seen"))
    observations = spark.createDataFrame([(dt.datetime(2026, 1, 1),), (dt.datetime(2020, 1, 1),)], "observed_at timestamp")
    tables = {"reviews": reviews, "observations": observations, "cache": observations.select(F.col("observed_at").alias("computed_at"))}
    now = F.lit("2026-07-01").cast("timestamp")
    swept = corpus.sweep(tables | {"shingles": sightings.select("shingle_hash", "asin").distinct(), "shingle_days": sightings.select("shingle_hash", "day").distinct()}, now)
    assert {tuple(r) for r in corpus.sweep_counts(tables, sightings, now).collect()} == {(n, t.count()) for n, t in swept.items()}


def test_reviews_are_dealt_into_listings_once(spark):
    """What reads reviews, listings and history at a time shuffles no text for each."""
    reads = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    made = {"v_reviews": spark.createDataFrame(view(spark, SF, "v_reviews").limit(20).collect())}
    for name in ("v_history", "v_listings"):
        assert "Window" in reads(view(spark, SF, name)) and "Window" not in reads(view(spark, SF, name, made))


def test_empty_reviewers_are_nobody(spark):
    rows = [("a", f"r{i}", w) for i, w in enumerate(["", "", None, "x", "y"])]
    targets = spark.createDataFrame(rows, "asin string, review_id string, reviewer string")
    assert corpus.network_status(targets, targets.select("reviewer", "asin")).first().identifiable == 2


def test_deep_analysis(spark):
    now = F.expr("timestamp '2026-07-01 12:00:00'")
    reviews = spark.createDataFrame([(a, 0, f"{a}-r", 5, None, True, LONG, 1, "u") for a in "abc"], "asin string, seq long, review_id string, rating long, review_date date, verified boolean, text string, helpful_votes long, reviewer_id string")
    seen = spark.createDataFrame([(i, a, dt.datetime(2026, 6, 1), 4.0, 100, "t") for i, a in enumerate("ab")], "obs_id long, asin string, observed_at timestamp, displayed_rating double, total_ratings long, title_hash string")
    asked = spark.createDataFrame([(10 + i, a, dt.datetime(2026, 7, 1), 4.0, n, "t") for i, (a, n) in enumerate([("a", 100), ("b", 900), ("c", 5)])], seen.schema)
    cache = spark.createDataFrame([("a", "{}"), ("b", "{}")], "asin string, payload string").withColumn("computed_at", F.expr("timestamp '2026-07-01 11:00:00'"))
    known = {"sightings": corpus.shingle_sightings(reviews, F.expr("date '2026-06-01'")), "edges": reviews.select(F.col("reviewer_id").alias("reviewer"), "asin").limit(0), "observations": seen, "cache": cache}
    answers, after = corpus.deep_analysis(reviews, asked, known, now)
    got = {r.asin: r for r in answers.collect()}
    assert {a: r.cached for a, r in got.items()} == {"a": True, "b": False, "c": False}
    body = json.loads(got["b"].payload)
    assert [f["id"] for f in body["productFindings"]] == ["ai-text", "reviewer-network", "review-hijack", "rating-history"] and body["corpusObservations"] == 2 and body["reviewFindings"] == []
    assert [f["status"] for f in json.loads(got["c"].payload)["productFindings"]] == ["pass", "insufficient-data", "insufficient-data"]
    assert sorted(r.obs_id for r in after["observations"].collect()) == [0, 1, 11, 12]
    assert sorted(r.asin for r in after["edges"].collect()) == ["b", "c"] and sorted(r.asin for r in after["cache"].collect()) == ["a", "b", "c"]


def test_wire_form(spark):
    snap = snapshot_of(spark, h2=None).withColumn("title", F.lit(" A Lamp ")).withColumn("reviews", F.expr("array(named_struct('review_id', 'r', 'rating', 5, 'review_date', date '2026-06-03', 'verified', true, 'text', 'x', 'helpful_votes', 1, 'reviewer_id', 'u', 'title', 'never'))"))
    body = json.loads(validation.build_request(snap).first().body)
    assert body == {"contractVersion": 1, "asin": "a", "displayedRating": 4.0, "totalRatings": 500, "histogram": {"1": 3.0, "3": 1.0, "4": 0.0, "5": 96.0}, "titleHash": hashlib.sha256(b"a lamp").hexdigest()[:32], "reviews": [{"id": "r", "rating": 5, "date": "2026-06-03", "verified": True, "text": "x", "helpfulVotes": 1, "reviewerId": "u"}]}


def test_oversized_bodies(spark):
    df = spark.createDataFrame([("x" * (512 * 1024 + 1),), ("{}",)], "body string")
    assert [r.reject_reason for r in validation.validate(df).collect()] == ["body too large", "contractVersion"]


def test_page_strategies():
    page = lambda inner: pages.read_page(f"<html><body>{inner}</body></html>")
    label = lambda k, n: f'<a aria-label="{k} stars represent {n}% of rating"></a>'
    found = page("".join(label(k, n) for k, n in ((5, 10), (5, 60), (4, 20), (3, 10), (1, 10))))
    assert [found[f"h{k}"] for k in (5, 4, 3, 2, 1)] == [60, 20, 10, None, 10]  # the last label of a star wins
    assert page("<p>5 stars 60%</p>" + label(4, 5))["h4"] is None  # not plausible
    block = '<div data-hook="review"><i data-hook="review-star-rating" aria-label="3.0 out of 5 stars"></i><div data-hook="review-body"><span class="c">no</span><span>yes</span></div><a data-hook="review-title"><span class="c">no</span><span class="d">last</span></a></div>'
    one = page(block)["reviews"][0]
    assert (one["stars"], one["body"], one["title"]) == ("3.0 out of 5 stars", "yes", "last")
    assert page("<script>enter the characters you see below</script>")["interstitial"] is False
    assert page('<form action="/errors/validateCaptcha"></form>')["interstitial"] and page("<p>Enter the characters you see below</p>")["interstitial"]
    assert page('<input id="ASIN" value="b00abcdef1">')["dom_asin"] == "B00ABCDEF1" and page('<input id="ASIN" value="short"><i data-asin="B00ABCDEF2"></i>')["dom_asin"] is None


def test_a_broken_review_costs_no_other(monkeypatch):
    read = pages.read_review
    monkeypatch.setattr(pages, "read_review", lambda block, place: read(block, place) if place else int("x"))
    block = '<div data-hook="review" id="{}"></div>'
    assert [r["id"] for r in pages.read_page(block.format("a") + block.format("b"))["reviews"]] == ["b"]


def test_store(spark, tmp_path):
    held = store.Store(spark, str(tmp_path / "corpus"))
    held.create()
    assert [held.read(name).count() for name in store.TABLES] == [0] * len(store.TABLES)
    seen = spark.createDataFrame([(2, "b", dt.datetime(2026, 1, 2), 4.0, 10, "t"), (1, "a", dt.datetime(2026, 1, 1), 4.0, 10, "t")], "obs_id long, asin string, observed_at timestamp, displayed_rating double, total_ratings long, title_hash string")
    held.append("observations", seen)
    held.append("observations", seen.where("asin = 'a'").withColumn("histogram", corpus.histogram_json(F.create_map(F.lit("5"), F.lit(80.0)))))
    assert {(r.asin, r.histogram) for r in held.scan("observations", "a").collect()} == {("a", None), ("a", '{"5":80.0}')}
    assert held.scan("observations", "a").count() == 2 and held.read("observations").count() == 3
    assert "In(asin" in held.scan("observations", "a", "b")._jdf.queryExecution().executedPlan().toString()
    held.create()
    held.prune("observations", keep=1)
    assert held.read("observations").count() == 3
    cache = spark.createDataFrame([("a", "{}")], "asin string, payload string").withColumn("computed_at", F.expr("timestamp '2026-01-01'"))
    held.replace("cache", corpus.write_cache(held.read("cache"), cache))
    held.replace("cache", corpus.write_cache(held.read("cache"), cache.withColumn("payload", F.lit("{1}"))))
    assert [r.payload for r in held.read("cache").collect()] == ["{1}"]


def test_salts():
    assert corpus.salt_fingerprint("a") == corpus.salt_fingerprint("a") != corpus.salt_fingerprint("b") and len(corpus.salt_fingerprint("a")) == 32
