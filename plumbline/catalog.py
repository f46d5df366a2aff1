"""The engine's queries over the driver's tables, and the same in SQL written apart from them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import oracles
from plumbline.cluster import Scratch
from plumbline.functions import text as tx
from plumbline.operators import corpus, scoring, signals, validation
from plumbline.sources import pages
from plumbline.sources.adapters import view

AS_OF = "2026-01-01"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(*tables: str, written: bool = False):
    """Register a function of DataFrames under its name; ``written``: reviews are dealt into listings once, and written, for all that reads them."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            zone = spark.conf.get("spark.sql.session.timeZone")
            spark.conf.set("spark.sql.session.timeZone", "UTC")  # a plan takes the zone when it is made
            try:
                made = {}
                if written:
                    scratch = Scratch(spark)
                    made["v_reviews"] = scratch.cut(view(spark, sf_dir, "v_reviews"))
                    scratch.release()
                return f(*[view(spark, sf_dir, t, made) for t in tables])
            finally:
                spark.conf.set("spark.sql.session.timeZone", zone)

        QUERIES[f.__name__] = run
        return f

    return add


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1e6 + 0.5) / 1e6


def T() -> Column:
    return F.col("text")


@query("v_reviews")
def text_tokens(r):
    return r.select("review_id", F.explode(tx.tokens(T())).alias("token")).groupBy("token").agg(F.count("*").alias("n"))


@query("v_reviews")
def text_word_count(r):
    return r.select("review_id", tx.word_count(T()).alias("words"), tx.spaced_words(T()).alias("spaced"))


@query("v_reviews")
def text_diversity(r):
    return r.select("review_id", r6(tx.diversity(T())).alias("diversity"))


@query("v_reviews")
def text_sentence_variation(r):
    return r.select("review_id", r6(tx.sentence_variation(T())).alias("variation"), r6(tx.burstiness(T())).alias("burstiness"))


@query("v_reviews")
def text_specificity(r):
    return r.select("review_id", tx.specifics(T()).alias("specifics"), tx.specifics_short(T()).alias("specifics_short"), r6(tx.contraction_rate(T())).alias("contractions"))


@query("v_reviews")
def phrase_hits(r):
    return r.select("review_id", tx.phrase_hits(T(), tx.INCENTIVE_PHRASES).alias("incentives"), tx.phrase_hits(T(), tx.TEMPLATE_PHRASES).alias("templates"))


@query("v_reviews")
def phrase_lists(r):
    return r.select("review_id", F.array_join(tx.matched_phrases(T(), tx.INCENTIVE_PHRASES + tx.TEMPLATE_PHRASES), " | ").alias("phrases"))


@query("v_reviews")
def trigram_jaccard_pairs(r):
    a = r.select("asin", F.col("review_id").alias("a"), F.col("seq").alias("a_seq"), tx.trigrams(T()).alias("ga"))
    b = r.select("asin", F.col("review_id").alias("b"), F.col("seq").alias("b_seq"), tx.trigrams(T()).alias("gb"))
    return a.join(b, "asin").where("a_seq < b_seq").select("a", "b", r6(tx.jaccard(F.col("ga"), F.col("gb"))).alias("sim")).where("sim >= 0.55D")


@query("v_reviews")
def shingle_hashes(r):
    return r.select(F.explode(tx.shingle_hashes(T())).alias("hash")).groupBy("hash").agg(F.count("*").alias("n"))


@query("v_reviews")
def review_key(r):
    return r.select("review_id", tx.review_key(F.col("rating"), F.col("review_date"), T()).alias("review_key"))


@query("part")
def title_hash(p):
    return p.select("p_partkey", tx.title_hash(F.col("p_name")).alias("title_hash"))


@query("v_reviews")
def reviewer_hash(r):
    return r.select("reviewer_id").distinct().select("reviewer_id", tx.keyed_hash(F.col("reviewer_id"), "pepper").alias("reviewer_hash"))


@query("v_snapshots")
def sig_distribution(s):
    return signals.distribution(s).select("asin", "status", r6("score").alias("score"), r6("confidence").alias("confidence"))


@query("v_reviews")
def sig_verified(r):
    return r.select("review_id", r6(signals.verified_delta()).alias("delta")).where("delta is not null")


@query("v_reviews")
def sig_phrasing(r):
    return r.select("review_id", r6(signals.phrasing_delta()).alias("delta")).where("delta is not null")


@query("v_reviews")
def sig_duplication(r):
    return signals.duplication(r).select("review_id", "matches", r6("peak").alias("peak"), r6("delta").alias("delta"))


@query("v_reviews")
def sig_burst(r):
    return signals.burst(r).select("review_id", r6("share").alias("share"), r6("delta").alias("delta"))


@query("v_reviews")
def sig_depth(r):
    return r.select("review_id", r6(signals.depth_delta()).alias("delta")).where("delta is not null")


@query("v_reviews", "v_listings")
def sig_helpfulness(r, s):
    return r.join(s.select("asin", "total_ratings"), "asin").select("review_id", signals.helpfulness_delta(AS_OF).alias("delta")).where("delta is not null")


@query("v_reviews")
def text_coverage(r):
    return signals.text_failed(r).select("asin", "n", r6("coverage").alias("coverage"), "text_failed")


@query("v_reviews", "v_listings")
def review_suspicion(r, s):
    return scoring.assess(r, s, AS_OF).select("asin", "review_id", r6("suspicion").alias("suspicion"))


@query("v_reviews", "v_listings")
def signal_summary(r, s):
    return scoring.summaries(scoring.assess(r, s, AS_OF)).select("asin", "signal", "flagged", "n", "status", r6("score").alias("score"), r6("confidence").alias("confidence"))


def _analysis(r, s):
    return scoring.analyse(r, s, AS_OF)


@query("v_reviews", "v_listings")
def analysis(r, s):
    a = _analysis(r, s)
    return a.select("asin", "sample_size", "trust_score", "grade", r6("displayed_rating").alias("displayed_rating"), r6("adjusted_rating").alias("adjusted_rating"), "discounted_count", "concerning_signals", "confidence", "insufficient_data", r6("mean_suspicion").alias("mean_suspicion"))


@query("v_reviews", "v_listings")
def trust_score(r, s):
    return _analysis(r, s).select("asin", "trust_score", "insufficient_data")


@query("v_reviews", "v_listings")
def adjusted_rating(r, s):
    return _analysis(r, s).select("asin", r6("displayed_rating").alias("displayed_rating"), r6("adjusted_rating").alias("adjusted_rating"))


@query("v_reviews", "v_listings")
def grade_distribution(r, s):
    return _analysis(r, s).groupBy("grade").agg(F.count("*").alias("listings"))


@query("v_reviews", "v_listings")
def grade_cap(r, s):
    return _analysis(r, s).select("asin", "grade", scoring.grade_of(F.col("trust_score")).alias("uncapped"), "discounted_count", "concerning_signals")


@query("v_reviews", "v_listings")
def confidence_level(r, s):
    return _analysis(r, s).select("asin", "confidence")


@query("v_reviews", "v_listings")
def verdict_tone(r, s):
    return scoring.verdict(_analysis(r, s)).groupBy("tone", "shows_old_rating").agg(F.count("*").alias("listings"))


@query("v_reviews", "v_listings")
def headline(r, s):
    return scoring.verdict(_analysis(r, s)).select("asin", "title", "sub")


@query("v_reviews", "v_listings")
def verdict_texts(r, s):
    return scoring.verdict(_analysis(r, s)).select("asin", "headline", "advice", "basis", "popup", "confidence_label", "grade_meaning")


@query("v_reviews", "v_listings")
def review_reasons(r, s):
    return scoring.assess(r, s, AS_OF).select("asin", "review_id", F.array_join("reasons", " | ").alias("reasons"))


@query("v_reviews", "v_listings")
def signal_details(r, s):
    found = scoring.signal_details(scoring.assess(r, s, AS_OF), s)
    return found.select("asin", "signal", "label", "status", scoring.label("status", F.col("status")).alias("status_label"), r6("score").alias("score"), "weight", r6("confidence").alias("confidence"), "detail", F.array_join("evidence", " | ").alias("evidence"))


@query("v_snapshots")
def distribution_details(s):
    return signals.distribution(s).select("asin", "status", "detail", F.array_join("evidence", " | ").alias("evidence"))


def _sightings(r):
    return corpus.shingle_rows(r, F.expr("date '2026-07-01' + cast(doc_id % 3 as int)"))


@query("v_reviews")
def shingle_spread(r):
    return corpus.shingle_spread(_sightings(r))


@query("v_reviews")
def template_findings(r):
    return corpus.template_findings(r, _sightings(r)).select("review_id", "reused", F.col("total").cast("long").alias("total"), F.col("peak").cast("long").alias("peak"), r6("delta").alias("delta"))


@query("v_reviews")
def machine_likelihood(r):
    return r.select("review_id", r6(corpus.machine_likelihood(T())).alias("likelihood"))


@query("v_reviews")
def text_findings(r):
    return corpus.text_finding(r, corpus.template_findings(r, _sightings(r)), corpus.machine_findings(r)).select("asin", "k", "status")


@query("v_edges")
def reviewer_links(e):
    e = Scratch(e.sparkSession).cut(e)
    return corpus.reviewer_links(e, e)


@query("v_edges")
def network_findings(e):
    e = Scratch(e.sparkSession).cut(e)
    t = e.withColumn("review_id", F.concat_ws("-", "asin", "reviewer"))
    return corpus.network_findings(t, e).select("review_id", "identifiable", "links", "peak", r6("delta").alias("delta"))


@query("v_edges")
def network_status(e):
    e = Scratch(e.sparkSession).cut(e)
    return corpus.network_status(e.withColumn("review_id", F.concat_ws("-", "asin", "reviewer")), e)


@query("v_observations")
def obs_dedupe(o):
    return corpus.dedupe_observations(o).select("obs_id", "asin", "displayed_rating", "total_ratings", "title_hash")


@query("v_observations")
def listing_hijack(o):
    return corpus.listing_hijack(corpus.history(corpus.dedupe_observations(o)))


@query("v_observations")
def rating_shifts(o):
    return corpus.rating_shifts(corpus.history(corpus.dedupe_observations(o)))


@query("v_observations")
def material_change(o):
    return corpus.material_changes(o)


def _stored(r, day, *more):
    return r.select(*more, "asin", tx.review_key(F.col("rating"), F.col("review_date"), T()).alias("review_key"), "rating", "verified", "helpful_votes", F.col("reviewer_id").alias("reviewer_hash"), tx.spaced_words(T()).alias("word_count"), F.col("review_date").alias("first_seen"), (F.col("review_date") + F.lit(day)).alias("last_seen"))


@query("v_reviews")
def upsert_reviews(r):
    old = corpus.upsert_reviews(_stored(r.limit(0), 0), _stored(r.where("doc_id % 2 = 0"), 0, "seq"), "seq")
    new = _stored(r, 30, "seq").withColumn("first_seen", F.col("first_seen") + F.lit(30)).withColumn("helpful_votes", F.col("helpful_votes") + 1)
    return corpus.upsert_reviews(old, new, "seq").groupBy("asin").agg(F.count("*").alias("n"), F.sum("helpful_votes").alias("votes"), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


@query("v_reviews")
def shingle_sightings(r):
    return corpus.count_sightings(_sightings(corpus.by_product(r)))


def _tables(r, o):
    s = _sightings(r)
    return {"reviews": _stored(r, 30), "observations": o, "cache": o.select("asin", F.col("observed_at").alias("computed_at")), "shingles": s.select("shingle_hash", "asin").distinct(), "shingle_days": s.select("shingle_hash", "day").distinct()}


@query("v_reviews", "v_observations", written=True)
def retention_sweep(r, o):
    live = _tables(r, o)
    phrases = _sightings(corpus.by_product(r))
    return corpus.sweep_counts({n: live[n] for n in ("reviews", "observations", "cache")}, phrases, F.lit("2026-07-01").cast("timestamp"))


@query("v_reviews", "v_observations")
def orphan_shingles(r, o):
    t = _tables(r, o)
    gone = t["reviews"].where("last_seen < date '2024-07-01'").select("asin").distinct()
    live = t["reviews"].where("last_seen >= date '2024-07-01'").select("asin").distinct()
    return t["shingles"].join(gone.join(live, "asin", "left_anti"), "asin", "left_semi").groupBy("asin").agg(F.count("*").alias("orphans"))


@query("v_observations")
def cache_lookup(o):
    cache = o.select("asin", F.col("obs_id").alias("payload"), F.col("observed_at").alias("computed_at"))
    return corpus.read_cache(cache, F.lit("2024-01-30 23:00:00").cast("timestamp")).select("asin", "payload")


@query("v_requests")
def request_validation(q):
    return validation.validate(q).select("event_id", F.coalesce("reject_reason", F.lit("accepted")).alias("outcome"))


@query("v_requests")
def reject_reasons(q):
    return validation.validate(q).groupBy(F.coalesce("reject_reason", F.lit("accepted")).alias("outcome")).agg(F.count("*").alias("requests"))


@query("v_requests")
def accepted_reviews(q):
    return validation.accepted_reviews(validation.validate(q), keep=["event_id"]).select("event_id", "asin", F.col("rating").cast("long").alias("rating"), "review_date", "verified", "helpful_votes")


@query("pages")
def url_asin(p):
    return p.select("page_id", tx.asin_of_url(F.col("url")).alias("asin"), pages.is_product_page(F.col("url")).alias("product"))


@query("pages")
def interstitial_pages(p):
    return p.groupBy(pages.is_interstitial(F.col("html")).alias("interstitial")).agg(F.count("*").alias("pages"))


@query("v_pages")
def page_snapshots(p):
    return pages.snapshots(p).select("page_id", "asin", "title", "displayed_rating", "total_ratings", *[f"h{k}" for k in range(1, 6)])


@query("v_pages")
def page_coverage(p):
    return pages.coverage(pages.snapshots(p))


@query("v_pages")
def page_reviews(p):
    found = pages.reviews(pages.snapshots(p))
    return found.select("page_id", "asin", "review_id", "title", F.col("rating").cast("long").alias("rating"), "review_date", "verified", "helpful_votes", "reviewer_id", "reviewer_name", F.md5("text").alias("text_md5"))


@query("v_snapshots")
def histogram_plausible(s):
    bars = F.array(*[F.col(f"h{i}") for i in range(1, 6)])
    total = F.aggregate(F.filter(bars, lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)
    return s.select("asin", ((F.size(F.filter(bars, lambda x: x.isNotNull())) >= 4) & total.between(80, 120)).alias("plausible"))


def _edges(r):
    return r.where("reviewer_id <> ''").select(F.col("reviewer_id").alias("reviewer"), "asin").distinct()


def _findings(r):
    return corpus.review_findings(r, _sightings(r), _edges(r))


def _past(o):
    return corpus.history(corpus.dedupe_observations(o))


@query("v_reviews", written=True)
def review_findings(r):
    found = _findings(r).where("d_template is not null or d_machine is not null or d_network is not null")
    return found.select("asin", "review_id", *[r6(f"d_{f}").alias(f) for f in scoring.DEEP_FINDINGS], F.concat_ws(" | ", *[f"r_{f}" for f in scoring.DEEP_FINDINGS]).alias("reasons"))


@query("v_reviews", "v_history", written=True)
def product_findings(r, o):
    return corpus.product_findings(_findings(r), _past(o)).select("asin", "signal", "label", "status", "detail", F.array_join("evidence", " | ").alias("evidence"))


@query("v_reviews", "v_history", written=True)
def deep_augmentation(r, o):
    return corpus.augmentation(corpus.product_findings(_findings(r), _past(o))).select("asin", "signal", "label", "status", "score", "weight", "confidence")


@query("v_reviews", "v_listings", "v_history", written=True)
def deep_reanalysis(r, s, o):
    deep = _findings(r)
    return scoring.analyse(r, s, AS_OF, deep, corpus.history_status(_past(o))).select("asin", "trust_score", "grade", "discounted_count", "concerning_signals", r6("mean_suspicion").alias("mean_suspicion"))


@query("v_reviews", "v_history", written=True)
def deep_answers(r, o):
    """Every second listing is asked about; a third of the listings have an answer cached an hour ago."""
    now, own = F.lit("2026-07-01 12:00:00").cast("timestamp"), F.substring("asin", 4, 20).cast("long") % 6
    requests = o.where(own % 2 == 0).groupBy("asin").agg(F.max("obs_id").alias("last")).select("asin", (F.col("last") + 1_000_000_000).alias("obs_id"), now.alias("observed_at"), F.lit(4.0).alias("displayed_rating"), F.lit(250).cast("long").alias("total_ratings"), F.lit("t0").alias("title_hash"))
    cache = o.select("asin").distinct().where(own < 2).select("asin", F.lit("{}").alias("payload"), F.expr("timestamp '2026-07-01 11:00:00'").alias("computed_at"))
    known = {"sightings": _sightings(r), "edges": _edges(r), "observations": o, "cache": cache}
    answers, _ = corpus.deep_analysis(r, requests, known, now)
    return answers.select("asin", "cached", F.size(F.from_json("payload", "reviewFindings array<string>, productFindings array<string>, corpusObservations long")["productFindings"]).alias("n")).select("asin", "cached", F.greatest("n", F.lit(0)).cast("long").alias("product_findings"))


@query("conversations")
def conversation_reviews(c):
    g = c.select(F.col("conv_id").cast("string").alias("asin"), F.col("turn").alias("seq"), F.concat_ws("-", "conv_id", "turn").alias("review_id"), "text")
    return signals.text_failed(g).select("asin", "n", r6("coverage").alias("coverage"))


ORACLES = oracles.build()
