"""From deltas to suspicion, trust, grade, adjusted rating, signal details and verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as tx
from plumbline.operators import signals as sg

DISCOUNT = 0.4
GRADES = ["A", "B", "C", "D", "F"]
REVIEW_WEIGHT, DEEP_WEIGHT = 1.6, 1.2
#: Per-review findings of the corpus, in the order in which their deltas are added.
DEEP_FINDINGS = ["template", "machine", "network"]
#: Product findings of the corpus, in the order in which they are weighed.
DEEP_SIGNALS = ["ai-text", "reviewer-network", "review-hijack", "rating-history"]
#: The sentences of the verdict, the summary and the basis.
SENTENCES = {
    "title_unknown": "Couldn't read this page",
    "title_A": "Reviews look genuine",
    "title_B": "Reviews look mostly genuine",
    "title_C": "Some reviews look questionable",
    "title_D": "Many reviews look manipulated",
    "title_F": "Reviews look heavily manipulated",
    "sub_unknown": "The review section must be visible to say anything useful.",
    "sub_one": "No review was discounted, but 1 check raised a concern.",
    "headline_unknown": "Not enough to judge",
    "advice_unknown": "This tool couldn't read enough of this page to say anything useful. That's a limit of what we could read, not a finding about the product — judge it the way you would with no tool at all.",
    "restated": "The estimate here is closer to %s. ",
    "advice_bad": "Enough of the visible reviews look manipulated that the headline rating is not a safe guide. Read the 1- and 2-star reviews before deciding, and weigh them more heavily than the average.",
    "advice_mixed": "Some of what is visible does not hold up, so treat the rating as an optimistic figure rather than a wrong one. Worth reading the critical reviews before you commit.",
    "noted": ", but not enough to move the overall picture — a normal listing usually has some of this. The rating is worth taking roughly at face value; open the breakdown if you want to see exactly what stood out. ",
    "clear": "Every check came back clear, so the rating is worth taking at face value. ",
    "hand_back": "Whether the product suits you is a separate question, and one this tool does not try to answer — it reads review integrity, not quality.",
    "basis_unknown": "This tool couldn't read enough of this page to judge it. That isn't a verdict about the product.",
    "basis_end": ". This is an estimate, not proof.",
    "caveat_text": "This tool couldn't read the review text on this page, so the language checks were skipped and this grade rests on less evidence than usual",
    "caveat_bars": "the rating breakdown wasn't readable either",
    "popup_unknown": "Not a verdict about the product.",
    "popup_none": "Too little trustworthy data to estimate a rating.",
    "popup": "Adjusted rating %s · trust %d/100",
    "detail_none": "No reviews were readable on this page.",
    "detail_text": "This tool couldn't read the review text on this page, so this check was skipped.",
}

#: How statuses, confidence and grades are called.
LABELS = {
    "status": {"pass": "Clear", "warn": "Caution", "fail": "Flagged", "insufficient-data": "No data"},
    "confidence": {"high": "High confidence", "moderate": "Moderate confidence", "low": "Low confidence", "very-low": "Very low confidence"},
    "tone": {"A": "good", "B": "good", "C": "mixed", "D": "bad", "F": "bad"},
}


def label(kind: str, value: Column) -> Column:
    """What a status, a confidence or a grade's tone is called."""
    return F.create_map(*[F.lit(x) for pair in LABELS[kind].items() for x in pair])[value]


def grade_meaning(grade: Column) -> Column:
    titles = F.create_map(*[F.lit(x) for g in GRADES for x in (g, SENTENCES[f"title_{g}"])])
    return F.concat(F.lit("Grade "), grade, F.lit(" of A to F. "), titles[grade], F.lit("."))


def sample_confidence(n: Column) -> Column:
    return F.when(n > 0, tx.clamp(F.log10(n + 1.0) / F.log10(F.lit(26.0)))).otherwise(F.lit(0.0))


def assess(reviews: DataFrame, snapshots: DataFrame, as_of: str, deep: DataFrame | None = None, registry: list[sg.ReviewSignal] | None = None) -> DataFrame:
    """One row a review: the deltas and reasons of the registry's signals, those of ``deep``, and the suspicion.

    ``deep`` has (asin, review_id) and ``d_`` and ``r_`` columns of DEEP_FINDINGS.
    """
    registry = sg.REGISTRY if registry is None else registry
    keys = ["asin", "seq", "review_id"]
    base = reviews.join(sg.text_failed(reviews).select("asin", "n", "text_failed"), "asin").join(snapshots.select("asin", "total_ratings"), "asin", "left")
    single = {s.name: s.columns(as_of) for s in registry if s.columns}
    out = base.select(*keys, "n", "text_failed", "rating", *[c.alias(f"{k}_{name}") for name, both in single.items() for k, c in zip("dr", both, strict=True)], *[F.array(F.col("seq").cast("long")).alias(f"p_{name}") for name in single])
    for s in registry:
        if s.rows:
            out = out.join(s.rows(reviews).select(*keys, F.col("delta").alias(f"d_{s.name}"), F.col("reason").alias(f"r_{s.name}"), F.col("place").alias(f"p_{s.name}")), keys, "left")
    for s in registry:
        if s.of_text:
            out = out.withColumns({f"{k}_{s.name}": F.when(~F.col("text_failed"), F.col(f"{k}_{s.name}")) for k in "dr"})
    names = [s.name for s in registry]
    if deep is not None:
        names += DEEP_FINDINGS
        out = out.join(deep.select("asin", "review_id", *[f"{k}_{f}" for f in DEEP_FINDINGS for k in "dr"], "identifiable"), ["asin", "review_id"], "left")
    total = F.lit(0.0)
    for name in names:
        total = total + F.coalesce(F.col(f"d_{name}"), F.lit(0.0))
    return out.withColumns({"suspicion": tx.clamp(total), "reasons": F.array_compact(F.array(*[F.when(F.col(f"d_{n}").isNotNull(), F.col(f"r_{n}")) for n in names]))})


def summaries(assessed: DataFrame, registry: list[sg.ReviewSignal] | None = None) -> DataFrame:
    """(asin, signal, flagged, n, status, score, confidence), long."""
    registry = sg.REGISTRY if registry is None else registry
    long = assessed.select("asin", "text_failed", F.explode(F.array(*[F.struct(F.lit(s.name).alias("signal"), F.col(f"d_{s.name}").isNotNull().alias("hit"), F.lit(s.of_text).alias("of_text")) for s in registry])).alias("x"))
    g = long.groupBy("asin", "x.signal", "x.of_text", "text_failed").agg(F.count_if("x.hit").alias("flagged"), F.count("*").alias("n"))
    share, skip = F.col("flagged") / F.col("n"), F.col("of_text") & F.col("text_failed")
    return g.select(
        "asin",
        "signal",
        "flagged",
        "n",
        F.when(skip, "insufficient-data").when(share == 0, "pass").when(share >= 0.4, "fail").otherwise("warn").alias("status"),
        F.when(skip, F.lit(0.5)).otherwise(tx.clamp(1 - share)).alias("score"),
        F.when(skip, F.lit(0.0)).otherwise(sample_confidence(F.col("n"))).alias("confidence"),
    )


def first_reasons(hits: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first ``k`` reasons of (keys, place, reason) rows as an array; only so many are ever gathered."""
    w = Window.partitionBy(*keys).orderBy("place")
    few = hits.withColumn("k", F.row_number().over(w)).where(F.col("k") <= k)
    return few.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("k", "reason"))).alias("found")).select(*keys, F.transform("found", lambda x: x["reason"]).alias("evidence"))


def signal_details(assessed: DataFrame, snapshots: DataFrame, registry: list[sg.ReviewSignal] | None = None) -> DataFrame:
    """(asin, signal, label, status, score, weight, confidence, detail, evidence) of the review and product signals of every listing."""
    registry = sg.REGISTRY if registry is None else registry
    hits = assessed.select("asin", F.explode(F.array(*[F.struct(F.lit(s.name).alias("signal"), F.col(f"p_{s.name}").alias("place"), F.when(F.col(f"d_{s.name}").isNotNull(), F.col(f"r_{s.name}")).alias("reason")) for s in registry])).alias("x")).select("asin", "x.*").where("reason is not null")
    none = F.array().cast("array<string>")
    names = F.explode(F.array(*[F.struct(F.lit(s.name).alias("signal"), F.lit(s.label).alias("label"), F.lit(s.clear).alias("clear")) for s in registry]))
    every = snapshots.select("asin", names.alias("s")).select("asin", "s.*")
    found = every.join(summaries(assessed, registry), ["asin", "signal"], "left").join(first_reasons(hits, ["asin", "signal"], 5), ["asin", "signal"], "left")
    detail = F.when(F.col("n").isNull(), SENTENCES["detail_none"]).when(F.col("status") == "insufficient-data", SENTENCES["detail_text"]).when(F.col("flagged") == 0, F.col("clear")).otherwise(F.format_string("%d of %d visible reviews flagged.", "flagged", "n"))
    of_reviews = found.select("asin", "signal", "label", F.coalesce("status", F.lit("insufficient-data")).alias("status"), F.coalesce("score", F.lit(0.5)).alias("score"), F.lit(1.0).alias("weight"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), detail.alias("detail"), F.coalesce("evidence", none).alias("evidence"))
    out = of_reviews
    for p in sg.PRODUCT_REGISTRY:
        out = out.unionByName(p.evaluate(snapshots).select("asin", F.lit(p.name).alias("signal"), F.lit(p.label).alias("label"), "status", "score", F.lit(p.weight).alias("weight"), "confidence", "detail", "evidence"))
    return out


def adjusted(displayed: Column, m: Column, confidence: Column) -> Column:
    raw = (displayed - 5 * m) / (1 - m)
    unknown = displayed.isNull() | F.isnan(displayed) | (F.abs(displayed) == float("inf"))
    return F.when(unknown | (m >= 0.85), F.lit(None).cast("double")).when(m <= 0.01, tx.round1(displayed)).otherwise(tx.round1(tx.clamp(displayed + (raw - displayed) * confidence, 1.0, 5.0)))


def grade_of(trust: Column) -> Column:
    return F.when(trust >= 85, "A").when(trust >= 70, "B").when(trust >= 55, "C").when(trust >= 40, "D").otherwise("F")


def capped(grade: Column, discounted: Column, n: Column, concerning: Column) -> Column:
    """No better than the share of discounted reviews allows; a single concern caps at C."""
    share = F.when(n > 0, discounted / n).otherwise(F.lit(0.0))
    floor = F.when(share >= 0.5, F.when(concerning < 2, 2).otherwise(3)).when(share >= 0.35, 2).when(share >= 0.15, 1).otherwise(0)
    order = F.array_position(F.array(*map(F.lit, GRADES)), grade).cast("int") - 1
    return F.element_at(F.array(*map(F.lit, GRADES)), F.greatest(order, floor) + 1)


def confidence_level(n: Column, histogram: Column, insufficient: Column) -> Column:
    return F.when(insufficient, "very-low").when((n >= 20) & histogram, "high").when((n >= 8) & histogram, "moderate").when((n >= 8) | histogram, "low").otherwise("very-low")


def mean_in_order(items: Column) -> Column:
    """Mean of ``value`` by ``seq``, added in that order, so that it is the same on every plan."""
    return F.aggregate(F.array_sort(items), F.lit(0.0), lambda a, x: a + x["value"]) / F.size(items)


def deep_status(findings: DataFrame) -> dict[str, Column]:
    """The status of each product finding of the corpus, from counts of a listing's reviews and its history."""
    n, flagged = F.col("n"), F.col("templated") + F.col("machined")
    share = F.col("linked") / F.col("identifiable")
    return {
        "ai-text": F.when(flagged == 0, "pass").when(flagged >= F.greatest(F.lit(2.0), 0.3 * n), "fail").otherwise("warn"),
        "reviewer-network": F.when(F.coalesce("identifiable", F.lit(0)) < 4, "insufficient-data").when(share >= 0.35, "fail").when(share > 0, "warn").otherwise("pass"),
        "review-hijack": F.coalesce("hijack", F.lit("insufficient-data")),
        "rating-history": F.coalesce("shifts", F.lit("insufficient-data")),
    }


def deep_weighed(status: Column) -> tuple[Column, Column]:
    """Weight and score of a product finding."""
    return F.when(status == "insufficient-data", F.lit(0.0)).otherwise(F.lit(DEEP_WEIGHT)), F.when(status == "fail", F.lit(0.15)).when(status == "warn", F.lit(0.55)).otherwise(F.lit(1.0))


def analyse(reviews: DataFrame, snapshots: DataFrame, as_of: str, deep: DataFrame | None = None, history: DataFrame | None = None, registry: list[sg.ReviewSignal] | None = None) -> DataFrame:
    """One row a listing.

    ``deep`` are the corpus's findings of reviews as in ``assess``, computed once: the
    product findings are counted from the same rows.  ``history`` has (asin, hijack,
    shifts), the statuses of a listing's past.
    """
    registry = sg.REGISTRY if registry is None else registry
    assessed = assess(reviews, snapshots, as_of, deep, registry)
    counts = [F.count("d_template").alias("templated"), F.count("d_machine").alias("machined"), F.count("d_network").alias("linked"), F.max("identifiable").alias("identifiable")] if deep is not None else []
    own = assessed.groupBy("asin").agg(
        F.count("*").alias("n"),
        mean_in_order(F.collect_list(F.struct("seq", F.col("suspicion").alias("value")))).alias("m"),
        F.count_if(F.col("suspicion") >= DISCOUNT).alias("discounted_count"),
        F.max("text_failed").alias("text_failed"),
        *[F.count_if(F.col(f"d_{s.name}").isNotNull()).alias(f"flagged_{s.name}") for s in registry],
        *counts,
    )
    concerns = sum((F.coalesce((F.col(f"flagged_{s.name}") > 0).cast("int"), F.lit(0)) for s in registry), F.lit(0))
    dist = sg.distribution(snapshots).select("asin", F.col("status").alias("dist_status"), F.col("score").alias("dist_score"), F.col("confidence").alias("dist_confidence"))
    known = F.coalesce(F.greatest(*[F.col(f"h{i}").isNotNull() for i in range(1, 6)]), F.lit(False))
    out = snapshots.withColumn("has_histogram", known).join(dist, "asin").join(own, "asin", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("concerns", concerns + F.col("dist_status").isin("warn", "fail").cast("int"))
    w1, m = F.when(F.col("n") > 0, REVIEW_WEIGHT * sample_confidence(F.col("n"))).otherwise(F.lit(0.0)), F.coalesce("m", F.lit(0.0))
    w2 = F.when(F.col("dist_status") != "insufficient-data", 1.4 * F.col("dist_confidence")).otherwise(F.lit(0.0))
    weight, weighted = w1 + w2, (1 - m) * w1 + F.col("dist_score") * w2
    if deep is not None:
        out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("templated", "machined", "linked")}).join(history, "asin", "left")
        out = out.withColumns({f"s_{name}": status for name, status in deep_status(out).items()})
        for name in DEEP_SIGNALS:
            w, score = deep_weighed(F.col(f"`s_{name}`"))
            weight, weighted = weight + w, weighted + score * w
        out = out.withColumn("concerns", sum((F.col(f"`s_{name}`").isin("warn", "fail").cast("int") for name in DEEP_SIGNALS), F.col("concerns")))
    out = out.withColumns({"weight": weight, "weighted": weighted})
    out = out.withColumn("insufficient_data", (F.col("weight") < 0.15) | ((F.col("n") < 3) & (F.coalesce("total_ratings", F.lit(0)) < 50)))
    out = out.withColumn("trust_score", F.when(F.col("insufficient_data"), F.lit(50)).otherwise(tx.half_up(tx.clamp(F.col("weighted") / F.col("weight")) * 100)).cast("long"))
    return out.select(
        "asin",
        F.col("n").cast("long").alias("sample_size"),
        "trust_score",
        F.when(F.col("insufficient_data"), "C").otherwise(capped(grade_of(F.col("trust_score")), F.coalesce("discounted_count", F.lit(0)), F.col("n"), F.col("concerns"))).alias("grade"),
        "displayed_rating",
        F.when(~F.col("insufficient_data"), adjusted(F.col("displayed_rating"), m, sample_confidence(F.col("n")))).alias("adjusted_rating"),
        F.coalesce("discounted_count", F.lit(0)).cast("long").alias("discounted_count"),
        F.col("concerns").cast("long").alias("concerning_signals"),
        confidence_level(F.col("n"), F.col("has_histogram"), F.col("insufficient_data")).alias("confidence"),
        "insufficient_data",
        m.alias("mean_suspicion"),
        "total_ratings",
        "has_histogram",
        F.coalesce("text_failed", F.lit(False)).alias("text_failed"),
    )


def _stars(value: Column) -> Column:
    return F.concat(F.format_string("%.1f", value), F.lit("★"))


def basis(n: Column, noun: Column) -> Column:
    """What the analysis rests on, and what could not be read."""
    bars = F.when(F.col("has_histogram"), F.when(F.coalesce("total_ratings", F.lit(0)) > 0, F.concat(F.lit(" and the rating breakdown across all "), F.format_number(F.col("total_ratings"), 0), F.lit(" ratings"))).otherwise(" and the overall rating breakdown")).otherwise("")
    caveats = F.concat_ws(", and ", F.when(F.col("text_failed"), SENTENCES["caveat_text"]), F.when(~F.col("has_histogram"), SENTENCES["caveat_bars"]))
    said = F.concat(F.lit("Based on the "), n, F.lit(" "), noun, F.lit(" visible on this page"), bars, F.lit(SENTENCES["basis_end"]), F.when(caveats != "", F.concat(F.lit(" Note: "), caveats, F.lit("."))).otherwise(""))
    return F.when(F.col("insufficient_data"), SENTENCES["basis_unknown"]).otherwise(said)


def verdict(analysis: DataFrame) -> DataFrame:
    """Headline, advice, tone, the gap shown, the summary lines and the basis of a listing."""
    lit = lambda k: F.lit(SENTENCES[k])
    gap = F.coalesce(F.col("displayed_rating") - F.col("adjusted_rating"), F.lit(0.0))
    material, shown = gap >= 0.3, F.when(F.col("displayed_rating").isNotNull(), _stars(F.col("displayed_rating"))).otherwise("the star rating")
    bad, some = F.col("grade").isin("D", "F"), (F.col("concerning_signals") > 0) | (F.col("discounted_count") > 0)
    headline = F.when(F.col("insufficient_data"), lit("headline_unknown")).when(bad & material, F.concat(F.lit("Don't rely on "), shown)).when(bad, F.concat(F.lit("Treat "), shown, F.lit(" with caution"))).when(F.col("grade") == "C", F.concat(shown, F.lit(" looks softer than it appears"))).when(some, F.concat(shown, F.lit(" is broadly believable"))).when(material, F.concat(shown, F.lit(" is roughly right"))).otherwise(F.concat(shown, F.lit(" looks earned")))
    tone = F.when(F.col("insufficient_data"), "unknown").when(bad, "bad").when(F.col("grade") == "C", "mixed").otherwise("good")
    noun = F.when(F.col("sample_size") == 1, "review").otherwise("reviews")
    d, c, n = (F.col(x).cast("string") for x in ("discounted_count", "concerning_signals", "sample_size"))
    restated = F.when(F.col("adjusted_rating").isNotNull() & material, F.format_string(SENTENCES["restated"], _stars(F.col("adjusted_rating")))).otherwise("")
    noted = F.when(F.col("discounted_count") > 0, F.concat(d, F.lit(" of the "), n, F.lit(" visible reviews were discounted"))).otherwise(F.concat(c, F.when(F.col("concerning_signals") == 1, " check").otherwise(" checks"), F.lit(" flagged something")))
    advice = F.when(F.col("insufficient_data"), lit("advice_unknown")).when(bad, F.concat(restated, lit("advice_bad"))).when(F.col("grade") == "C", F.concat(restated, lit("advice_mixed"))).when(some, F.concat(noted, lit("noted"), lit("hand_back"))).otherwise(F.concat(lit("clear"), lit("hand_back")))
    sub = F.when(F.col("insufficient_data"), lit("sub_unknown")).when(F.col("discounted_count") > 0, F.concat(d, F.lit(" of "), n, F.lit(" visible "), noun, F.lit(" discounted."))).when(F.col("concerning_signals") == 1, lit("sub_one")).when(F.col("concerning_signals") > 1, F.concat(F.lit("No review was discounted, but "), c, F.lit(" checks raised concerns."))).otherwise(F.concat(F.lit("Nothing flagged across "), n, F.lit(" visible "), noun, F.lit(".")))
    title = F.when(F.col("insufficient_data"), lit("title_unknown"))
    for g in GRADES:
        title = title.when(F.col("grade") == g, lit(f"title_{g}"))
    return analysis.select("asin", "grade", headline.alias("headline"), advice.alias("advice"), tone.alias("tone"), title.alias("title"), sub.alias("sub"), basis(n, noun).alias("basis"), (F.abs(gap) >= 0.1).alias("shows_old_rating"), _popup().alias("popup"), label("confidence", F.col("confidence")).alias("confidence_label"), grade_meaning(F.col("grade")).alias("grade_meaning"))


def _popup() -> Column:
    """The second line of a small window."""
    told = F.format_string(SENTENCES["popup"], _stars(F.col("adjusted_rating")), F.col("trust_score"))
    return F.when(F.col("insufficient_data"), SENTENCES["popup_unknown"]).when(F.col("adjusted_rating").isNull(), SENTENCES["popup_none"]).otherwise(told)
