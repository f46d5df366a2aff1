"""Extraction of snapshots and reviews from product pages.

HTML has no built-in function, so pages are parsed in Arrow batches with the standard
library's parser; everything afterwards is columns.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import text as tx

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: What marks an interstitial page, in its forms and in what it shows.
FORMS = ["validateCaptcha", "/errors/"]
SHOWN = "(?i)click the button below to continue shopping|enter the characters you see below|we just need to make sure you'?re not a robot|type the characters you see in this image"
#: Where each field stands, tried in order.
ASIN = ["input#ASIN", 'input[name="ASIN"]', "#averageCustomerReviews[data-asin]", "[data-asin]"]
TITLE = ["#productTitle", "#title span", "h1#title", "h1 span#productTitle"]
RATING = ['[data-hook="rating-out-of-text"]', "#acrPopover .a-icon-alt", "#averageCustomerReviews .a-icon-alt", 'span[data-hook="average-star-rating"] .a-icon-alt', "#acrPopover"]
TOTAL = ["#acrCustomerReviewText", '[data-hook="total-review-count"]', '#reviewsMedley [data-hook="total-review-count"]']
BLOCKS = ['div[data-hook="review"]', 'li[data-hook="review"]', '#cm-cr-dp-review-list div[data-hook="review"]', '[id^="customer_review-"]']
STARS = ['[data-hook="review-star-rating"] .a-icon-alt', '[data-hook="cmps-review-star-rating"] .a-icon-alt', '[data-hook="review-star-rating"]', ".review-rating .a-icon-alt", 'i[class*="a-star-"]']
BODY = ['[data-hook="review-body"] span:not([class])', '[data-hook="review-body"] span', '[data-hook="reviewText"]', '[data-hook="reviewBody"]', '[data-hook="review-collapsed"]', '[data-hook="review-body"]', ".review-text-content span", '[class*="contain-rich-content"]', '[class*="review-text"]']
HEADING = ['[data-hook="review-title"] span:not([class])', '[data-hook="review-title"] span:last-of-type', '[data-hook="review-title"]', '[data-hook="reviewTitle"]', '[class*="single-review-title"]', "h5 a", "h5", ".review-title"]
DATE = ['[data-hook="review-date"]', ".review-date"]
BADGE = ['[data-hook="avp-badge"]', ".a-color-state.a-text-bold"]
VOTES = ['[data-hook="helpful-vote-statement"]', ".cr-vote-text"]
PROFILE = ["a.a-profile", '[data-hook="genome-widget"] a']
REVIEWER = [".a-profile-name"]
BARS = ["#histogramTable", "#cm_cr_dp_d_rating_histogram", '[class*="ratings-histogram"]']
BAR_LABELS = ["#histogramTable a[aria-label]", '[data-hook="cr-histogram-row"] a[aria-label]', "#cm_cr_dp_d_rating_histogram a[aria-label]", 'a[aria-label*="stars represent"]', 'a[title*="stars represent"]']
BAR_ROWS = ["#histogramTable li", "#histogramTable tr", '[data-hook="cr-histogram-row"]', "#cm_cr_dp_d_rating_histogram li", "#cm_cr_dp_d_rating_histogram tr", '[class*="histogram"] li']
#: White space as the web's regular expressions know it.
BLANK = re.compile("[\\t\\n\\x0b\\f\\r \\u00a0\\ufeff\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")


class Node:
    def __init__(self, tag: str, attrs: dict, parent: Node | None):
        self.tag, self.attrs, self.parent, self.children, self.parts = tag, attrs, parent, [], []

    def content(self) -> str:
        return "".join(p if isinstance(p, str) else p.content() for p in self.parts)

    def text(self) -> str:
        return BLANK.sub(" ", self.content()).strip(" ")

    def all(self):
        for c in self.children:
            yield c
            yield from c.all()


class Tree(HTMLParser):
    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        self.at.parts.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.parts.append(data)


_SIMPLE = re.compile(r"^([a-z0-9]+)|#([\w-]+)|\.([\w-]+)|\[([\w-]+)(?:([*^]?=)\"([^\"]*)\")?\]|:(last-of-type)|:not\(\[([\w-]+)\]\)")
_STEP = re.compile(r"(?:\[[^\]]*\]|\([^)]*\)|[^\s\[(])+")


def _matches(node: Node, simple: str) -> bool:
    bare = simple
    for tag, ident, cls, attr, how, value, last, lacks in _SIMPLE.findall(bare):
        own = node.attrs.get(attr)
        if tag and node.tag != tag or ident and node.attrs.get("id") != ident or cls and cls not in node.attrs.get("class", "").split():
            return False
        if attr and (own is None or how == "=" and own != value or how == "*=" and value not in own or how == "^=" and not own.startswith(value)):
            return False
        if lacks and lacks in node.attrs or last and [c for c in node.parent.children if c.tag == node.tag][-1] is not node:
            return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Descendants by a chain of simple selectors."""
    *above, last = _STEP.findall(selector)
    out = []
    for node in root.all():
        if _matches(node, last):
            up, want = node.parent, list(above)
            while up is not None and want:
                if _matches(up, want[-1]):
                    want.pop()
                up = up.parent
            if not want:
                out.append(node)
    return out


def pick(root: Node, selectors: list[str]) -> Node | None:
    return next((found[0] for s in selectors if (found := select(root, s))), None)


def pick_all(root: Node, selectors: list[str]) -> list[Node]:
    """The matches of the first selector that has any."""
    return next((found for s in selectors if (found := select(root, s))), [])


def _text(node: Node | None) -> str:
    return node.text() if node else ""


def plausible(bars: dict[int, float]) -> bool:
    return len(bars) >= 4 and 80 <= sum(bars.values()) <= 120


def _bars(texts) -> dict[int, float]:
    """Shares by star from texts that name both; a later text of a star wins."""
    found = ((re.search(r"([1-5])\s*star", t, re.I), re.search(r"(\d{1,3})\s*%", t)) for t in texts)
    return {int(star[1]): float(share[1]) for star, share in found if star and share}


def histogram(root: Node) -> dict[int, float] | None:
    """Stars and shares paired by position in the table, else read from labels, else from labels and rows; only if plausible."""
    for box in (found[0] for s in BARS if (found := select(root, s))):
        leaves = [n.text() for n in box.all() if not n.children]
        stars = [int(m[1]) for t in leaves if (m := re.fullmatch(r"([1-5])\s*stars?", t, re.I))]
        shares = [float(m[1]) for t in leaves if (m := re.fullmatch(r"(\d{1,3})\s*%", t))]
        if len(stars) >= 4 and len(stars) == len(shares) and plausible(found := dict(zip(stars, shares, strict=True))):
            return found
    bars = _bars(n.attrs.get("aria-label", n.attrs.get("title", "")) for n in pick_all(root, BAR_LABELS))
    if not plausible(bars):
        bars |= _bars(n.text() for n in pick_all(root, BAR_ROWS))
    return bars if plausible(bars) else None


def body_of(node: Node) -> str:
    return _text(pick(node, BODY)) or " ".join(t for n in node.all() if n.tag == "p" and (t := n.text()))


def _said(node: Node | None, *attrs: str) -> str:
    """The text of a node, or else the first of its attributes that is not empty."""
    return next((x for x in (_text(node), *((node.attrs.get(a, "") for a in attrs) if node else ())) if x), "")


def read_review(block: Node, place: int) -> dict:
    link = pick(block, PROFILE)
    return {"seq": place, "id": block.attrs.get("id") or f"review-{place}", "stars": _said(pick(block, STARS), "title", "aria-label"), "body": body_of(block), "title": _text(pick(block, HEADING)), "date": _text(pick(block, DATE)), "verified": pick(block, BADGE) is not None, "votes": _text(pick(block, VOTES)), "profile": link.attrs.get("href", "") if link else "", "name": _text(pick(block, REVIEWER))}


def shown(root: Node) -> str:
    """What a page shows: its text without scripts and styles."""
    return "".join(p if isinstance(p, str) else shown(p) for p in root.parts) if root.tag not in ("script", "style", "head", "template", "noscript") else ""


def read_page(html: str) -> dict:
    """The raw fields of a page; a review that cannot be read costs none of the others."""
    root = Tree(html or "").root
    reviews = []
    for place, block in enumerate(pick_all(root, BLOCKS)):
        try:
            reviews.append(read_review(block, place))
        except (ValueError, IndexError, RecursionError):
            continue
    own = pick(root, ASIN)
    dom = own.attrs.get("value", own.attrs.get("data-asin", "")) if own else ""
    barred = any(f in n.attrs.get("action", "") for n in root.all() if n.tag == "form" for f in FORMS) or re.search(SHOWN, shown(root)) is not None
    bars = histogram(root) or {}
    return {"interstitial": barred, "title": _text(pick(root, TITLE)) or None, "rating": _said(pick(root, RATING), "title"), "total": _text(pick(root, TOTAL)), "dom_asin": dom.upper() if re.fullmatch(r"(?i)[A-Z0-9]{10}", dom) else None, **{f"h{k}": bars.get(k) for k in range(1, 6)}, "reviews": reviews}


SCHEMA = "page_id long, url string, interstitial boolean, title string, rating string, total string, dom_asin string, h1 double, h2 double, h3 double, h4 double, h5 double, reviews array<struct<seq:int,id:string,stars:string,body:string,title:string,date:string,verified:boolean,votes:string,profile:string,name:string>>"


def raw_pages(pages: DataFrame) -> DataFrame:
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(frames):
        for f in frames:
            got = pd.DataFrame([read_page(h) for h in f["html"]], columns=names[2:])
            yield pd.concat([f[["page_id", "url"]].reset_index(drop=True), got], axis=1)

    return pages.select("page_id", "url", "html").mapInPandas(run, SCHEMA)


def is_interstitial(html: Column) -> Column:
    """Whether a page asks for a check in place of its content, by its forms and the text it shows."""
    form = html.rlike("(?i)<form[^>]*action=[\"'][^\"']*(" + "|".join(FORMS) + ")")
    text = F.regexp_replace(html, "(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->", "")
    return F.coalesce(form | F.regexp_replace(text, "<[^>]*>", "").rlike(SHOWN), F.lit(False))


def is_product_page(url: Column) -> Column:
    return url.rlike("(?i)/(dp|gp/product|product-reviews)/")


def stripped(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(text, "(?i)\\s*Read more\\s*Read less\\s*$", ""), "(?i)\\s*Read more\\s*$", "")
    out = F.regexp_replace(F.regexp_replace(out, "(?i)\\s*,?\\s*double tap to read (full|brief) content\\.?", ""), "(?i)\\s*(Full|Brief) content visible\\.?", "")
    return F.trim(F.regexp_replace(out, f"{tx.SPACE}+", " "))


def snapshots(pages: DataFrame) -> DataFrame:
    """Pages that are no interstitial and name a product, as snapshots with raw reviews."""
    r = tx.parse_decimal(F.col("rating"))
    return raw_pages(pages).where("not interstitial").withColumn("asin", F.coalesce(tx.asin_of_url(F.col("url")), "dom_asin")).where("asin is not null").select("page_id", "asin", "title", F.when(r.between(1, 5), r).alias("displayed_rating"), tx.parse_count(F.col("total")).alias("total_ratings"), *[f"h{i}" for i in range(1, 6)], "reviews")


def reviews(found: DataFrame) -> DataFrame:
    """The reviews of snapshots; a block without a rating is dropped."""
    rows = found.select("page_id", "asin", F.explode("reviews").alias("r")).withColumn("rating", tx.parse_rating(F.col("r.stars"))).where("rating is not null")
    title = F.trim(F.regexp_replace("r.title", "(?i)^\\s*\\d(?:\\.\\d)?\\s*out of\\s*5\\s*stars?\\s*", ""))
    return rows.select("page_id", "asin", F.col("r.seq").alias("seq"), F.col("r.id").alias("review_id"), "rating", tx.parse_review_date(F.col("r.date")).alias("review_date"), F.col("r.verified").alias("verified"), stripped(F.col("r.body")).alias("text"), title.alias("title"), tx.parse_votes(F.col("r.votes")).cast("long").alias("helpful_votes"), F.nullif(F.regexp_extract("r.profile", "/profile/([^/?#]+)", 1), F.lit("")).alias("reviewer_id"), F.nullif("r.name", F.lit("")).alias("reviewer_name"))


def coverage(found: DataFrame) -> DataFrame:
    """(field, filled, pages): how often each field was read."""
    fields = ["title", "displayed_rating", "total_ratings", *(f"h{k}" for k in range(1, 6))]
    return found.select(F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).isNotNull().alias("has")) for f in fields])).alias("x")).groupBy("x.field").agg(F.count_if("x.has").alias("filled"), F.count("*").alias("pages"))
