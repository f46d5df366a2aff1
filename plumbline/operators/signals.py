"""The review and product signals, and the registry that the analysis runs.

Reviews are rows (asin, seq, review_id, rating, review_date, verified, text,
helpful_votes, reviewer_id); snapshots rows (asin, displayed_rating, total_ratings,
h1..h5).  Signals of single reviews are projections; burst and duplication work within
a listing, dealt by asin.  Each gives a delta and a reason, null where it does not apply.
A listing's reviews are the sample that a page shows, some tens at most.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as tx

DAY = 86_400
#: The sentences that say why a review is doubted.
REASONS = {
    "verified_5": "Unverified purchase giving a 5-star rating",
    "verified": "Unverified purchase",
    "incentive": "Discloses a free or discounted product in exchange for the review",
    "template": "Built largely from generic review boilerplate",
    "machine": "Uniform sentence rhythm, narrow vocabulary and no concrete details — consistent with generated text",
    "duplicate_1": "Text closely matches another review on this product",
    "duplicate_n": "Text closely matches %d other reviews on this product",
    "burst": "Posted in a cluster of %d reviews within 3 days (around %s), against a sample spanning %d days",
    "empty": "%d-star rating with no written review",
    "thin": "%d-star rating with only %d %s and no specifics",
    "unvoted": "Featured on the product page for %d days without a single helpful vote",
}
#: What the rating distribution says.
DISTRIBUTION = {
    "missing": "Couldn't read the rating breakdown on this page.",
    "empty": "The rating breakdown on this page was empty.",
    "tail": "%s of ratings are 5-star but only %s are 1-star — genuine products of this size almost always retain a larger negative tail.",
    "hollow": "Only %s of ratings fall in the 2-4 star range, which is unusually hollow for a product with this much 5-star volume.",
    "polar": "Ratings are split between %s 5-star and %s 1-star with little in between. This can indicate the listing changed products at some point.",
    "clear": "The spread across star ratings looks consistent with organic reviews (%s 5-star, %s 1-star).",
}


@dataclass(frozen=True)
class ReviewSignal:
    """A check of single reviews.

    ``columns(as_of)`` gives delta and reason over a review joined with its snapshot, or
    ``rows(reviews)`` a table (asin, seq, review_id, place, delta, reason), where
    ``place`` orders the evidence.  ``clear`` is said where nothing is found.
    """

    name: str
    label: str
    clear: str
    of_text: bool = False
    columns: Callable[[str], tuple[Column, Column]] | None = None
    rows: Callable[[DataFrame], DataFrame] | None = None


@dataclass(frozen=True)
class ProductSignal:
    """A check of a listing: ``evaluate(snapshots)`` gives (asin, status, score, confidence, detail, evidence)."""

    name: str
    label: str
    weight: float
    evaluate: Callable[[DataFrame], DataFrame]


def verified_delta() -> Column:
    return F.when(~F.col("verified"), F.when(F.col("rating") == 5, F.lit(0.4)).otherwise(F.lit(0.18)))


def verified_reason() -> Column:
    return F.when(~F.col("verified"), F.when(F.col("rating") == 5, REASONS["verified_5"]).otherwise(REASONS["verified"]))


def _phrasing() -> tuple[Column, Column, Column]:
    """The shares of incentive, boilerplate and machine rhythm; 0 where they do not apply."""
    text = F.col("text")
    incentive, template = tx.phrase_hits(text, tx.INCENTIVE_PHRASES), tx.phrase_hits(text, tx.TEMPLATE_PHRASES)
    v, d = tx.sentence_variation(text), tx.diversity(text)
    machine = F.when((tx.word_count(text) >= 40) & (v < 0.35) & (d < 0.55) & (tx.specifics(text) == 0), 0.3 * (tx.clamp((0.35 - v) / 0.35) * tx.clamp((0.55 - d) / 0.55))).otherwise(F.lit(0.0))
    return F.when(incentive > 0, F.lit(0.45)).otherwise(F.lit(0.0)), F.when(template >= 2, 0.12 * F.least(template, F.lit(3))).otherwise(F.lit(0.0)), machine


def phrasing_delta() -> Column:
    incentive, template, machine = _phrasing()
    delta = incentive + template + machine
    return F.when((F.length(F.trim(F.col("text"))) > 0) & (delta > 0), delta)


def phrasing_reason() -> Column:
    said = [F.when(part > 0, REASONS[name]) for part, name in zip(_phrasing(), ("incentive", "template", "machine"), strict=True)]
    return F.when(F.length(F.trim(F.col("text"))) > 0, F.nullif(F.concat_ws("; ", *said), F.lit("")))


def _depth() -> tuple[Column, Column]:
    text = F.coalesce("text", F.lit(""))
    n = tx.word_count(text)
    return n, F.col("rating").isin(1, 5) & (n < 15) & (tx.specifics(text) == 0)


def depth_delta() -> Column:
    n, thin = _depth()
    return F.when(thin, 0.22 * (15 - n) / 15)


def depth_reason() -> Column:
    n, thin = _depth()
    said = F.when(n == 0, F.format_string(REASONS["empty"], F.col("rating").cast("long"))).otherwise(F.format_string(REASONS["thin"], F.col("rating").cast("long"), n, F.when(n == 1, "word").otherwise("words")))
    return F.when(thin, said)


def _age(as_of: str) -> tuple[Column, Column]:
    age = F.datediff(F.to_date(F.lit(as_of)), F.col("review_date"))
    return age, (F.col("total_ratings") >= 200) & (F.col("rating") == 5) & (F.col("helpful_votes") == 0) & (age >= 90)


def helpfulness_delta(as_of: str) -> Column:
    return F.when(_age(as_of)[1], F.lit(0.12))


def helpfulness_reason(as_of: str) -> Column:
    age, unvoted = _age(as_of)
    return F.when(unvoted, F.format_string(REASONS["unvoted"], age))


def _percent(share: Column) -> Column:
    return F.concat(tx.half_up(share * 100).cast("string"), F.lit("%"))


def distribution(snapshots: DataFrame) -> DataFrame:
    """(asin, status, score, confidence, suspicion, detail, evidence) of the rating histogram."""
    total = sum((F.coalesce(F.col(f"h{i}"), F.lit(0.0)) for i in range(2, 6)), F.coalesce(F.col("h1"), F.lit(0.0)))
    s = {i: F.coalesce(F.col(f"h{i}"), F.lit(0.0)) / F.when(total > 0, total) for i in range(1, 6)}
    middle = s[2] + s[3] + s[4]
    has_tail, has_hollow, has_polar = (s[5] > 0.8) & (s[1] < 0.02), (s[5] > 0.75) & (middle < 0.08), (s[5] > 0.5) & (s[1] > 0.2) & (middle < 0.15)
    tail = F.when(has_tail, 0.55 * tx.clamp((0.02 - s[1]) / 0.02) * tx.clamp((s[5] - 0.8) / 0.15)).otherwise(0.0)
    hollow = F.when(has_hollow, 0.35 * tx.clamp((0.08 - middle) / 0.08)).otherwise(0.0)
    polar = F.when(has_polar, F.lit(0.25)).otherwise(0.0)
    five, one = _percent(s[5]), _percent(s[1])
    evidence = F.array_compact(F.array(F.when(has_tail, F.format_string(DISTRIBUTION["tail"], five, one)), F.when(has_hollow, F.format_string(DISTRIBUTION["hollow"], _percent(middle))), F.when(has_polar, F.format_string(DISTRIBUTION["polar"], five, one))))
    missing = F.lit(True)
    for i in range(1, 6):
        missing = missing & F.col(f"h{i}").isNull()
    n = F.col("total_ratings")
    out = snapshots.select("asin", (total > 0).alias("known"), missing.alias("missing"), F.when(F.coalesce(n, F.lit(0)) > 0, tx.clamp(F.log10(n + 1.0) / 3)).otherwise(F.lit(0.3)).alias("c"), tx.clamp(tail + hollow + polar).alias("x"), evidence.alias("evidence"), F.format_string(DISTRIBUTION["clear"], five, one).alias("clear"))
    score = 1 - F.col("x")
    return out.select(
        "asin",
        F.when(~F.col("known"), "insufficient-data").when(F.col("x") >= 0.5, "fail").when(F.col("x") >= 0.2, "warn").otherwise("pass").alias("status"),
        F.when(F.col("known"), score).otherwise(F.lit(0.5)).alias("score"),
        F.when(F.col("known"), F.col("c")).otherwise(F.lit(0.0)).alias("confidence"),
        F.when(F.col("known"), F.col("x")).alias("suspicion"),
        F.when(F.col("missing"), DISTRIBUTION["missing"]).when(~F.col("known"), DISTRIBUTION["empty"]).when(F.size("evidence") > 0, F.get("evidence", F.lit(0))).otherwise(F.col("clear")).alias("detail"),
        F.when(F.col("known"), F.col("evidence")).otherwise(F.array().cast("array<string>")).alias("evidence"),
    )


def duplication(reviews: DataFrame, least: float = 0.55) -> DataFrame:
    """(asin, seq, review_id, place, matches, peak, delta, reason) of reviews whose text is much like another of the listing.

    Only listings with two candidates pair up, and only texts whose set sizes allow the
    similarity.  ``place`` is that of a review's first pair.
    """
    words = reviews.where(tx.word_count(F.col("text")) >= 12).select("asin", "seq", "review_id", tx.trigrams(F.col("text")).alias("grams"))
    mine = words.withColumn("size", F.size("grams"))
    a = mine.select("asin", *[F.col(c).alias(f"a_{c}") for c in ("seq", "review_id", "grams", "size")])
    b = mine.select("asin", *[F.col(c).alias(f"b_{c}") for c in ("seq", "review_id", "grams", "size")])
    near = (F.least("a_size", "b_size") >= least * F.greatest("a_size", "b_size")) & (F.col("a_seq") < F.col("b_seq"))
    pairs = a.join(b, "asin").where(near).withColumn("sim", tx.jaccard(F.col("a_grams"), F.col("b_grams"))).where(F.col("sim") >= least)
    side = lambda s, k: F.struct(F.col(f"{s}_seq").alias("seq"), F.col(f"{s}_review_id").alias("review_id"), F.array(F.col("a_seq"), F.col("b_seq"), F.lit(k).cast("long")).alias("place"))
    sides = pairs.select("asin", "sim", F.explode(F.array(side("a", 0), side("b", 1))).alias("r"))
    found = sides.groupBy("asin", "r.seq", "r.review_id").agg(F.count("*").alias("matches"), F.max("sim").alias("peak"), F.min("r.place").alias("place"))
    reason = F.when(F.col("matches") == 1, REASONS["duplicate_1"]).otherwise(F.format_string(REASONS["duplicate_n"], "matches"))
    return found.withColumns({"delta": tx.clamp(0.35 * F.col("peak") + 0.15 * F.least("matches", F.lit(3))), "reason": reason})


def burst(reviews: DataFrame) -> DataFrame:
    """(asin, seq, review_id, place, share, delta, reason) of the reviews in the densest three days of a listing."""
    own = Window.partitionBy("asin")
    dated = reviews.where("review_date is not null").select("asin", "seq", "review_id", F.unix_date("review_date").alias("t"))
    counted = dated.select("*", F.count("*").over(own).alias("n"), (F.max("t").over(own) - F.min("t").over(own)).alias("span")).where("n >= 5 and span >= 30")
    ahead = Window.partitionBy("asin").orderBy("t").rangeBetween(0, 3)
    inside = counted.withColumn("inside", F.count("*").over(ahead))
    best = inside.withColumn("best", F.first(F.struct("t", "inside")).over(Window.partitionBy("asin").orderBy(F.desc("inside"), "t", "seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    share = F.col("best.inside") / F.col("n")
    expected = tx.clamp(3 / F.col("span"), 0.01, 1.0)
    delta = tx.clamp(0.4 * tx.clamp((share - expected) / (1 - expected)))
    reason = F.format_string(REASONS["burst"], F.col("best.inside"), F.date_from_unix_date("best.t").cast("string"), F.col("span"))
    found = best.where((share >= 0.5) & (F.col("best.inside") >= 3) & F.col("t").between(F.col("best.t"), F.col("best.t") + 3) & (delta >= 0.1))
    return found.select("asin", "seq", "review_id", F.array(F.col("t").cast("long"), F.col("seq").cast("long")).alias("place"), share.alias("share"), delta.alias("delta"), reason.alias("reason"))


def text_failed(reviews: DataFrame) -> DataFrame:
    """(asin, n, coverage, text_failed)."""
    g = reviews.groupBy("asin").agg(F.count("*").alias("n"), F.avg((F.length(F.trim(F.coalesce("text", F.lit("")))) > 0).cast("double")).alias("coverage"))
    return g.withColumn("text_failed", (F.col("n") >= 3) & (F.col("coverage") < 0.35))


#: In this order deltas are added and reasons listed.
REGISTRY = [
    ReviewSignal("verified", "Verified purchases", "Every visible review is from a verified purchase.", columns=lambda as_of: (verified_delta(), verified_reason())),
    ReviewSignal("phrasing", "Review language", "No incentive disclosures, boilerplate or generated-text patterns found.", True, columns=lambda as_of: (phrasing_delta(), phrasing_reason())),
    ReviewSignal("duplication", "Duplicate text", "No reviews share substantially similar text.", True, rows=duplication),
    ReviewSignal("burst", "Review timing", "Review dates are spread out rather than clustered.", rows=burst),
    ReviewSignal("depth", "Review substance", "Extreme ratings come with enough detail to be credible.", True, columns=lambda as_of: (depth_delta(), depth_reason())),
    ReviewSignal("helpfulness", "Community response", "Community voting on these reviews looks normal.", columns=lambda as_of: (helpfulness_delta(as_of), helpfulness_reason(as_of))),
]
PRODUCT_REGISTRY = [ProductSignal("distribution", "Rating distribution", 1.4, distribution)]
