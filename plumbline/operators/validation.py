"""Validation of submissions: a closed schema, checked without coercion.

``validate`` reads JSON texts as VARIANT, so that a string is never taken for a number,
and gives each row its first failing rule, or null.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as tx

FIELDS = ["contractVersion", "asin", "displayedRating", "totalRatings", "histogram", "titleHash", "reviews"]
REVIEW_FIELDS = ["id", "rating", "date", "verified", "text", "helpfulVotes", "reviewerId"]
MAX_REVIEWS, MAX_TEXT, MAX_BODY, MAX_ID, MAX_VOTES = 60, 6000, 512 * 1024, 128, 1_000_000


def _of(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", kind)


def _type(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.try_variant_get(v, f"$.{path}", "variant"))


def _number(kind: Column) -> Column:
    return kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")


def _optional(v: Column, path: str, good: Column) -> Column:
    """A present field that is not good."""
    return _type(v, path).isNotNull() & ~F.coalesce(good, F.lit(False))


def _review_fault(r: Column) -> Column:
    n, votes = _of(r, "rating", "double"), _of(r, "helpfulVotes", "double")
    rules = [
        (~F.coalesce(F.schema_of_variant(r).startswith("OBJECT"), F.lit(False)), "review: not an object"),
        (F.size(F.array_except(F.json_object_keys(F.to_json(r)), F.array(*map(F.lit, REVIEW_FIELDS)))) > 0, "review: unknown field"),
        (~F.coalesce((_type(r, "id") == "STRING") & F.length(_of(r, "id", "string")).between(1, MAX_ID), F.lit(False)), "review: id"),
        (~F.coalesce(_number(_type(r, "rating")) & (n == F.floor(n)) & n.between(1, 5), F.lit(False)), "review: rating"),
        (~F.coalesce(_type(r, "verified") == "BOOLEAN", F.lit(False)), "review: verified"),
        (~F.coalesce(_type(r, "text") == "STRING", F.lit(False)), "review: text"),
        (~F.coalesce(_number(_type(r, "helpfulVotes")) & (votes >= 0), F.lit(False)), "review: helpfulVotes"),
        (_optional(r, "date", (_type(r, "date") == "STRING") & _of(r, "date", "string").rlike("^\\d{4}-\\d{2}-\\d{2}$")), "review: date"),
        (_optional(r, "reviewerId", (_type(r, "reviewerId") == "STRING") & (F.length(_of(r, "reviewerId", "string")) <= MAX_ID)), "review: reviewerId"),
    ]
    return F.coalesce(*[F.when(bad, F.lit(why)) for bad, why in rules])


def _fault(body: Column, v: Column, reviews: Column) -> Column:
    """The first failing rule of a request, given its text, that parsed, and its reviews."""
    known = F.array(*map(F.lit, FIELDS))
    rating, total = _of(v, "displayedRating", "double"), _of(v, "totalRatings", "double")
    bars = _of(v, "histogram", "map<string,double>")
    bar_types = _of(v, "histogram", "map<string,variant>")
    good_bars = F.forall(F.map_entries(bars), lambda e: e["key"].isin(*"12345") & e["value"].between(0, 100)) & F.forall(F.map_values(bar_types), lambda x: _number(F.schema_of_variant(x)))
    rules = [
        (F.octet_length(body) > MAX_BODY, "body too large"),
        (v.isNull(), "malformed JSON"),
        (~F.schema_of_variant(v).startswith("OBJECT"), "not an object"),
        (F.size(F.array_except(F.json_object_keys(body), known)) > 0, "unknown field"),
        (~F.coalesce(_number(_type(v, "contractVersion")) & (_of(v, "contractVersion", "double") == 1), F.lit(False)), "contractVersion"),
        (~F.coalesce((_type(v, "asin") == "STRING") & _of(v, "asin", "string").rlike("(?i)^[A-Z0-9]{10}$"), F.lit(False)), "asin"),
        (reviews.isNull(), "reviews"),
        (F.size(reviews) > MAX_REVIEWS, "too many reviews"),
        (_optional(v, "displayedRating", _number(_type(v, "displayedRating")) & rating.between(1, 5)), "displayedRating"),
        (_optional(v, "totalRatings", _number(_type(v, "totalRatings")) & (total >= 0)), "totalRatings"),
        (_optional(v, "titleHash", (_type(v, "titleHash") == "STRING") & _of(v, "titleHash", "string").rlike("(?i)^[0-9a-f]{1,64}$")), "titleHash"),
        (_optional(v, "histogram", bars.isNotNull() & good_bars), "histogram"),
    ]
    own = F.coalesce(*[F.when(bad, F.lit(why)) for bad, why in rules])
    first = F.get(F.filter(F.transform(reviews, _review_fault), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(own, first)


def validate(requests: DataFrame, body: str = "body") -> DataFrame:
    """The requests with ``reject_reason``; a text is parsed once, as a column that the rules share."""
    parsed = requests.withColumn("_parsed", F.try_parse_json(F.col(body))).withColumn("_reviews", _of(F.col("_parsed"), "reviews", "array<variant>"))
    return parsed.withColumn("reject_reason", _fault(F.col(body), F.col("_parsed"), F.col("_reviews"))).drop("_parsed", "_reviews")


def accepted_reviews(validated: DataFrame, body: str = "body", keep: list[str] | None = None) -> DataFrame:
    """The reviews of accepted requests: texts cut to the limit, votes capped."""
    v = F.try_parse_json(F.col(body))
    r = F.col("r")
    rows = validated.where("reject_reason is null").select(*(keep or []), F.upper(_of(v, "asin", "string")).alias("asin"), F.posexplode(_of(v, "reviews", "array<variant>")).alias("seq", "r"))
    return rows.select(
        *(keep or []),
        "asin",
        "seq",
        _of(r, "id", "string").alias("review_id"),
        _of(r, "rating", "int").alias("rating"),
        F.try_to_date(_of(r, "date", "string")).alias("review_date"),
        _of(r, "verified", "boolean").alias("verified"),
        F.left(_of(r, "text", "string"), F.lit(MAX_TEXT)).alias("text"),
        F.least(_of(r, "helpfulVotes", "double"), F.lit(float(MAX_VOTES))).cast("long").alias("helpful_votes"),
        _of(r, "reviewerId", "string").alias("reviewer_id"),
    )


def build_request(snapshot: DataFrame) -> DataFrame:
    """(asin, body): the wire form of a snapshot with ``title``, ``h1`` to ``h5`` and a ``reviews`` array.

    The title leaves as its hash, absent fields stay absent, and names and titles of
    reviews never leave.
    """
    review = lambda r: F.struct(r["review_id"].alias("id"), r["rating"].alias("rating"), r["review_date"].cast("string").alias("date"), r["verified"].alias("verified"), r["text"].alias("text"), r["helpful_votes"].alias("helpfulVotes"), r["reviewer_id"].alias("reviewerId"))
    bars = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(str(k)).alias("k"), F.col(f"h{k}").alias("v")) for k in range(1, 6)]), lambda x: x["v"].isNotNull()))
    hashed = F.when(F.col("title") != "", tx.title_hash(F.col("title")))
    return snapshot.select("asin", F.to_json(F.struct(F.lit(1).alias("contractVersion"), "asin", F.col("displayed_rating").alias("displayedRating"), F.col("total_ratings").alias("totalRatings"), F.when(F.size(bars) > 0, bars).alias("histogram"), hashed.alias("titleHash"), F.transform("reviews", review).alias("reviews"))).alias("body"))
