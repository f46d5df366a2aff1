"""Text and hash functions as Column expressions; none runs Python on the executors."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Phrases that disclose an incentive.
INCENTIVE_PHRASES = [
    "in exchange for my honest review",
    "in exchange for an honest review",
    "received this product for free",
    "received this item for free",
    "at a discounted price in exchange",
    "free product in exchange",
    "discounted price for my honest",
    "i received this product at a discount",
    "in return for my unbiased review",
    "for testing and reviewing purposes",
    "sent to me free of charge",
]
#: Boilerplate phrases.
TEMPLATE_PHRASES = [
    "highly recommend this product",
    "exceeded my expectations",
    "exactly as described",
    "great value for the money",
    "works as expected",
    "good quality product",
    "i love this product",
    "five stars",
    "best purchase ever",
    "would buy again",
    "arrived quickly and",
    "great product great price",
]
#: White space as the web's regular expressions know it.
SPACE = "[\\s\\x{00A0}\\x{FEFF}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
_EDGE, _END = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
#: Patterns of concrete detail (a measure, a percentage, a price, a model number).
MEASURE = f"(?i){_EDGE}\\d+(\\.\\d+)?{SPACE}?(inch|inches|cm|mm|ft|lb|lbs|kg|g|oz|ml|l|hours?|days?|weeks?|months?|years?){_END}"
PERCENT = f"{_EDGE}\\d+(\\.\\d+)?%"
PRICE = "\\$\\d+(\\.\\d{2})?"
MODEL = f"{_EDGE}[A-Z]{{2,}}[-\\s]?\\d{{2,}}{_END}"


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, also inside element functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))


def word_count(text: Column) -> Column:
    return F.size(tokens(text)).cast("long")


def spaced_words(text: Column) -> Column:
    """Runs of what is not white space."""
    return F.regexp_count(text, F.lit("\\S+")).cast("long")


def collapsed(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), f"{SPACE}+", " ")


def trigrams(text: Column) -> Column:
    """Distinct three-character runs; none of a text shorter than three."""
    letters = F.regexp_extract_all(F.trim(collapsed(text)), F.lit("(?s)."), F.lit(0))  # so that a run is cut at constant cost
    run = lambda s: lambda i: F.concat(F.get(s, i), F.get(s, i + 1), F.get(s, i + 2))
    return bound(letters, lambda s: F.when(F.size(s) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(0), F.greatest(F.size(s) - 3, F.lit(0))), run(s)))).otherwise(F.array().cast("array<string>")))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def clamp(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Between the limits; null stays null."""
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def diversity(text: Column) -> Column:
    return bound(tokens(text), lambda t: F.when(F.size(t) < 5, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.size(F.array_distinct(t)) / F.sqrt(F.size(t).cast("double")) / 7.0)))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[.!?]+(?:\\s|$)"), lambda s: F.trim(s)), lambda s: F.length(s) > 0)  # F.trim itself would take the place for a set of characters


def _variation(lengths: Column) -> Column:
    """Deviation over mean of the lengths; 1 for fewer than three or a zero mean."""

    def of(n: Column) -> Column:
        total = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        mean = total / F.size(n)
        square = F.aggregate(n, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
        return F.when((F.size(n) < 3) | (total == 0), F.lit(1.0)).otherwise(F.sqrt(square / F.size(n)) / mean)

    return bound(lengths, of)


def sentence_variation(text: Column) -> Column:
    return _variation(F.transform(sentences(text), lambda s: F.size(tokens(s)).cast("double")))


def burstiness(text: Column) -> Column:
    """Like ``sentence_variation``, without sentences that hold no token."""
    return _variation(F.filter(F.transform(sentences(text), lambda s: F.size(tokens(s)).cast("double")), lambda n: n > 0))


def specifics(text: Column) -> Column:
    return sum((F.regexp_count(text, F.lit(p)) for p in (PERCENT, PRICE, MODEL)), F.regexp_count(text, F.lit(MEASURE))).cast("long")


def specifics_short(text: Column) -> Column:
    """Without model numbers."""
    return sum((F.regexp_count(text, F.lit(p)) for p in (PERCENT, "\\$\\d+")), F.regexp_count(text, F.lit(MEASURE))).cast("long")


def contraction_rate(text: Column) -> Column:
    n = F.size(tokens(text))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.regexp_count(text, F.lit(f"(?i){_EDGE}[A-Za-z0-9_]+'(s|t|re|ve|ll|d|m){_END}")) / n)


def phrase_hits(text: Column, phrases: list[str]) -> Column:
    """How many of the phrases a text has."""
    return bound(collapsed(text), lambda n: sum((n.contains(p).cast("long") for p in phrases[1:]), n.contains(phrases[0]).cast("long")))


def matched_phrases(text: Column, phrases: list[str]) -> Column:
    """The phrases that a text has, in their order."""
    return bound(collapsed(text), lambda n: F.filter(F.array(*map(F.lit, phrases)), lambda p: n.contains(p)))


def short_sha(value: Column) -> Column:
    return F.left(F.sha2(value, 256), F.lit(32))


def title_hash(title: Column) -> Column:
    return short_sha(F.lower(F.trim(title)))


def review_key(rating: Column, date: Column, text: Column) -> Column:
    body = F.regexp_replace(F.lower(F.left(text, F.lit(400))), f"{SPACE}+", " ")
    return short_sha(F.concat_ws("|", rating.cast("string"), F.coalesce(date.cast("string"), F.lit("")), body))


def shingles(text: Column, n: int = 6) -> Column:
    """The runs of ``n`` tokens, with repeats; none for fewer tokens."""
    return bound(tokens(text), lambda t: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>")))


def shingle_hashes(text: Column, n: int = 6) -> Column:
    return F.transform(shingles(text, n), short_sha)


def keyed_hash(value: Column, salt: str) -> Column:
    """HMAC-SHA256 in hexadecimal, first half; the key's pads are made on the driver."""
    if not salt:
        raise ValueError("a salt is required")
    key = salt.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(b ^ x for b in key).hex())) for x in (0x36, 0x5C))
    digest = F.unhex(F.sha2(F.concat(inner, F.encode(value, "UTF-8")), 256))
    return F.left(F.sha2(F.concat(outer, digest), 256), F.lit(32))


def half_up(value: Column) -> Column:
    return F.floor(value + 0.5)


def round1(value: Column) -> Column:
    return F.floor(value * 10 + 0.5) / 10


def parse_count(raw: Column) -> Column:
    """The first number, with thousands separators removed."""
    return F.regexp_replace(F.regexp_replace(F.regexp_extract(raw, "\\d[\\d.,\\s]*", 0), "[.,\\s](?=\\d{3})", ""), "[^\\d].*$", "").try_cast("long")


def parse_decimal(raw: Column) -> Column:
    return F.replace(F.regexp_extract(raw, "\\d+([.,]\\d+)?", 0), F.lit(","), F.lit(".")).try_cast("double")


def parse_rating(raw: Column) -> Column:
    r = half_up(parse_decimal(raw)).cast("int")
    return F.when(r.between(1, 5), r)


def parse_votes(raw: Column) -> Column:
    return F.when(raw.rlike("(?i)\\bone\\b") & raw.rlike("(?i)helpful"), F.lit(1)).otherwise(F.coalesce(parse_count(raw), F.lit(0)))


def parse_review_date(raw: Column) -> Column:
    d = F.trim(F.coalesce(F.nullif(F.regexp_extract(raw, "(?i)on\\s+(.+)$", 1), F.lit("")), raw))
    return F.coalesce(*[F.try_to_date(d, form) for form in ("MMMM d, yyyy", "d MMMM yyyy", "yyyy-MM-dd")])


def asin_of_url(url: Column) -> Column:
    found = [F.nullif(F.regexp_extract(url, p, 1), F.lit("")) for p in ("(?i)/dp/([A-Z0-9]{10})(?:[/?]|$)", "(?i)/gp/product/([A-Z0-9]{10})(?:[/?]|$)", "(?i)/product-reviews/([A-Z0-9]{10})(?:[/?]|$)", "(?i)[?&]asin=([A-Z0-9]{10})(?![A-Za-z0-9_])")]
    return F.upper(F.coalesce(*found))
