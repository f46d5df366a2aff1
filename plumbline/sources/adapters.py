"""The driver's tables as listings, reviews, observations, edges and requests.

Each adapter is one SQL text that Spark and DuckDB both run.  A whole text is a review; a
null one is a review without text.  Reviews are dealt into listings of ten within shards
of their beginnings, so that copies share a listing.  A shard takes its rows from 4,096
consecutive ids, so however many copies a text has, no window holds more rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

REVIEWS = """
select concat('B', upper(shard), lpad(cast(listing as varchar(20)), cast(greatest(7, length(cast(listing as varchar(20)))) as int), '0')) as asin,
  cast(rn % 10 as bigint) as seq, concat('r', cast(doc_id as varchar(20))) as review_id, doc_id,
  cast(case when doc_id % 7 < 4 then 5 when doc_id % 7 = 4 then 1 else 2 + doc_id % 3 end as bigint) as rating,
  doc_id % 3 <> 0 as verified, cast(n_chars % 3 as bigint) as helpful_votes,
  concat('u', cast(doc_id % 150 as varchar(20))) as reviewer_id,
  date '2024-01-01' + cast(case when listing % 2 = 0 and rn % 10 < 6 then 100 + rn % 3 else (doc_id * 37) % 365 end as int) as review_date,
  concat(text, case when doc_id % 11 = 0 then ' I received this product for free in exchange for my honest review.' when doc_id % 13 = 0 then ' Exceeded my expectations, works as expected. I love this product!' when doc_id % 17 = 0 then ' It''s 5 kg, costs $19.99 and 20% off; model XK-200.' else '' end) as text
from (select *, cast(sub * 512 + floor(rn / 10.0) as bigint) as listing
  from (select *, row_number() over (partition by shard, sub order by left(text, 200), doc_id) - 1 as rn
    from (select doc_id, coalesce(text, '') as text, n_chars, cast(floor(doc_id / 4096.0) as bigint) as sub, substr(md5(left(coalesce(text, ''), 16)), 1, 2) as shard from documents) d) n) l
"""

LISTINGS = """
select asin, cast(floor(avg(rating) * 10 + 0.5) / 10 as double) as displayed_rating, cast(count(*) * 37 + min(doc_id) % 5 * 100 as bigint) as total_ratings,
  cast(case min(doc_id) % 4 when 0 then 96 when 1 then 62 when 3 then 55 end as double) as h5,
  cast(case min(doc_id) % 4 when 0 then 3 when 1 then 18 when 3 then 5 end as double) as h4,
  cast(case min(doc_id) % 4 when 0 then 1 when 1 then 8 when 3 then 4 end as double) as h3,
  cast(case min(doc_id) % 4 when 0 then 0 when 1 then 4 when 3 then 3 end as double) as h2,
  cast(case min(doc_id) % 4 when 0 then 0 when 1 then 8 when 3 then 33 end as double) as h1
from v_reviews group by asin
"""

SNAPSHOTS = """
select asin, cast(floor(sum(star) * 10.0 / count(*) + 0.5) / 10 as double) as displayed_rating, cast(sum(l_quantity) as bigint) as total_ratings,
  cast(floor(100.0 * sum(case when star = 5 then 1 else 0 end) / count(*) + 0.5) as double) as h5,
  cast(floor(100.0 * sum(case when star = 4 then 1 else 0 end) / count(*) + 0.5) as double) as h4,
  cast(floor(100.0 * sum(case when star = 3 then 1 else 0 end) / count(*) + 0.5) as double) as h3,
  cast(floor(100.0 * sum(case when star = 2 then 1 else 0 end) / count(*) + 0.5) as double) as h2,
  cast(floor(100.0 * sum(case when star = 1 then 1 else 0 end) / count(*) + 0.5) as double) as h1
from (select concat('P', lpad(cast(l_partkey as varchar(20)), 9, '0')) as asin, l_quantity,
  case when l_partkey % 5 = 0 and l_quantity > 2 then 5 when l_partkey % 5 = 1 and l_quantity > 13 then 5 when l_partkey % 5 = 1 then 1 when l_partkey % 5 = 2 and l_quantity > 8 then 5 else cast(ceil(l_quantity / 10) as bigint) end as star
  from lineitem) s group by asin
"""

OBSERVATIONS = """
select event_id as obs_id, concat('U', lpad(cast(user_id as varchar(20)), 9, '0')) as asin, ts as observed_at,
  case when event_id % 17 = 0 then null else cast(4.0 + floor(event_id / 900.0) % 3 * 0.25 as double) end as displayed_rating,
  cast(100 + floor(event_id / 800.0) * 40 as bigint) as total_ratings,
  case when event_id % 29 = 0 then null else concat('t', cast(cast(floor(event_id / 2500.0) as bigint) as varchar(20))) end as title_hash
from events
"""

EDGES = """
select distinct concat('c', cast(o_custkey as varchar(20))) as reviewer, concat('P', lpad(cast(l_partkey as varchar(20)), 9, '0')) as asin
from orders join lineitem on o_orderkey = l_orderkey
"""

#: Each review of a listing also stands for a day on which the listing was seen.
HISTORY = """
select doc_id as obs_id, asin, cast(review_date as timestamp) as observed_at,
  cast(3.75 + doc_id % 3 * 0.25 as double) as displayed_rating, cast(90 + seq * 40 as bigint) as total_ratings,
  concat('t', cast(cast(floor(seq / 4.0) as bigint) % 2 as varchar(20))) as title_hash
from v_reviews
"""

#: A product page a review, in three styles of markup; a block without a rating stands behind it.
PAGES = """
select doc_id as page_id, concat('https://shop.example/dp/', asin, '?ref=x') as url,
  concat('<html><head><title>x</title></head><body>',
    case style when 0 then concat('<span id="productTitle">  Item ', asin, ' </span>') when 1 then concat('<div id="title"><span>Item ', asin, '</span></div>') else concat('<h1 id="title">Item ', asin, '</h1>') end,
    case style when 0 then concat('<span data-hook="rating-out-of-text">', replace(stars, '.', ','), ' out of 5</span>') when 1 then concat('<a id="acrPopover" title="', stars, ' out of 5 stars"></a>') else concat('<div id="averageCustomerReviews"><i class="a-icon-alt">', stars, ' out of 5</i></div>') end,
    case style when 0 then concat('<span id="acrCustomerReviewText">', total, ' ratings</span>') else concat('<div id="reviewsMedley"><span data-hook="total-review-count">', total, ' global ratings</span></div>') end,
    case when b5 is null then '' when style = 0 then concat('<div id="histogramTable"><b>5 stars</b><b>4 stars</b><b>3 stars</b><b>2 stars</b><b>1 star</b><i>', b5, '%</i><i>', b4, '%</i><i>', b3, '%</i><i>', b2, '%</i><i>', b1, '%</i></div>')
      when style = 1 then concat('<ul id="histogramTable"><li><a aria-label="5 stars represent ', b5, '% of rating"></a></li><li><a aria-label="4 stars represent ', b4, '% of rating"></a></li><li><a aria-label="3 stars represent ', b3, '% of rating"></a></li><li><a aria-label="2 stars represent ', b2, '% of rating"></a></li><li><a aria-label="1 stars represent ', b1, '% of rating"></a></li></ul>')
      else concat('<table id="histogramTable"><tr><td>5 star rated ', b5, '%</td></tr><tr><td>4 star rated ', b4, '%</td></tr><tr><td>3 star rated ', b3, '%</td></tr><tr><td>2 star rated ', b2, '%</td></tr><tr><td>1 star rated ', b1, '%</td></tr></table>') end,
    case style when 0 then concat('<div data-hook="review" id="R', id, '">') when 1 then concat('<li data-hook="review" id="R', id, '">') else concat('<div id="customer_review-R', id, '">') end,
    '<a class="a-profile" href="/gp/profile/', reviewer_id, '/ref=x"><span class="a-profile-name">N ', reviewer_id, '</span></a>',
    case style when 0 then concat('<i data-hook="review-star-rating"><span class="a-icon-alt">', score, '.0 out of 5 stars</span></i>') when 1 then concat('<i data-hook="review-star-rating" title="', score, '.0 out of 5 stars"></i>') else concat('<i class="a-icon a-star-x" aria-label="', score, '.0 out of 5 stars"></i>') end,
    case style when 0 then concat('<a data-hook="review-title"><span class="a-icon-alt">', score, '.0 out of 5 stars</span><span>Fine</span></a>') when 1 then concat('<h5>', score, '.0 out of 5 stars Fine</h5>') else '<h5><a>Fine</a></h5>' end,
    '<span data-hook="review-date">Reviewed in Spain on ', case extract(month from review_date) when 1 then 'January' when 2 then 'February' when 3 then 'March' when 4 then 'April' when 5 then 'May' when 6 then 'June' when 7 then 'July' when 8 then 'August' when 9 then 'September' when 10 then 'October' when 11 then 'November' else 'December' end, ' ', cast(extract(day from review_date) as varchar(20)), ', ', cast(extract(year from review_date) as varchar(20)), '</span>',
    case when verified then '<span data-hook="avp-badge">Verified Purchase</span>' else '' end,
    case style when 0 then concat('<div data-hook="review-body"><span class="x">Format: paper</span><span>', body, ' Read more</span></div>') when 1 then concat('<div data-hook="reviewText">', body, ' Read more Read less</div>') else concat('<p>', body, '</p>') end,
    case helpful_votes when 0 then '' when 1 then '<span data-hook="helpful-vote-statement">One person found this helpful</span>' else concat('<span data-hook="helpful-vote-statement">', cast(helpful_votes as varchar(20)), ' people found this helpful</span>') end,
    case style when 0 then '</div><div data-hook="review"><p>none</p></div>' when 1 then '</li><li data-hook="review"><p>none</p></li>' else '</div><div id="customer_review-none"><p>none</p></div>' end,
    '</body></html>') as html
from (select r.asin, doc_id, doc_id % 3 as style, cast(doc_id as varchar(20)) as id, cast(rating as varchar(20)) as score, reviewer_id, review_date, verified, helpful_votes,
    replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') as body, cast(displayed_rating as varchar(20)) as stars, cast(total_ratings as varchar(20)) as total,
    cast(cast(h1 as bigint) as varchar(20)) as b1, cast(cast(h2 as bigint) as varchar(20)) as b2, cast(cast(h3 as bigint) as varchar(20)) as b3, cast(cast(h4 as bigint) as varchar(20)) as b4, cast(cast(h5 as bigint) as varchar(20)) as b5
  from v_reviews r join v_listings l on r.asin = l.asin) x
"""

#: A request a row; ``event_id % 24`` chooses which rule it breaks, 22 and 23 none.
REQUESTS = """
select event_id, case when event_id % 24 = 0 then '{"contractVersion":1,' when event_id % 24 = 1 then '[1,2]' else concat('{"contractVersion":', case when event_id % 24 = 2 then '99' else '1' end,
  case when event_id % 24 = 3 then ',"extra":1' else '' end,
  ',"asin":"', case when event_id % 24 = 4 then 'short' else concat('U', lpad(cast(user_id as varchar(20)), 9, '0')) end, '"',
  case when event_id % 24 = 5 then ',"displayedRating":9' when event_id % 24 = 6 then ',"displayedRating":"4"' else ',"displayedRating":4.5' end,
  case when event_id % 24 = 7 then ',"totalRatings":-5' else ',"totalRatings":120' end,
  case when event_id % 24 = 8 then ',"titleHash":"xyz"' else ',"titleHash":"ab12"' end,
  case when event_id % 24 = 9 then ',"histogram":{"5":400}' when event_id % 24 = 10 then ',"histogram":{"9":10}' else ',"histogram":{"5":80,"1":20.0}' end,
  ',"reviews":', case when event_id % 24 = 11 then '"none"' else concat('[{"id":', case when event_id % 24 = 12 then '7' else '"a"' end,
    ',"rating":', case when event_id % 24 = 13 then '6' when event_id % 24 = 14 then '4.5' when event_id % 24 = 15 then '"5"' else '5.0' end,
    ',"verified":', case when event_id % 24 = 16 then '1' else 'true' end,
    case when event_id % 24 = 17 then '' else ',"text":"fine"' end,
    ',"helpfulVotes":', case when event_id % 24 = 18 then '-1' else '3' end,
    case when event_id % 24 = 19 then ',"date":"June 3"' else ',"date":"2026-06-03"' end,
    case when event_id % 24 = 20 then ',"reviewerId":5' else ',"reviewerId":"p"' end,
    case when event_id % 24 = 21 then ',"name":"x"' else '' end, '}]') end, '}') end as body
from events
"""

VIEWS = {"v_reviews": REVIEWS, "v_listings": LISTINGS, "v_snapshots": SNAPSHOTS, "v_observations": OBSERVATIONS, "v_history": HISTORY, "v_pages": PAGES, "v_edges": EDGES, "v_requests": REQUESTS}
_NEEDS = {"v_reviews": ["documents"], "v_listings": ["v_reviews"], "v_snapshots": ["lineitem"], "v_observations": ["events"], "v_history": ["v_reviews"], "v_pages": ["v_reviews", "v_listings"], "v_edges": ["orders", "lineitem"], "v_requests": ["events"]}


def view(spark: SparkSession, sf_dir: str, name: str, made: dict[str, DataFrame] | None = None) -> DataFrame:
    """A table of the driver, or an adapter over some; ``made`` has those that are there already."""
    if name in (made or {}):
        return made[name]
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return _plain(spark, VIEWS[name], {n: view(spark, sf_dir, n, made) for n in _NEEDS[name]})


def _plain(spark: SparkSession, sql: str, inputs: dict[str, DataFrame]) -> DataFrame:
    """The SQL over temporary views of its inputs, which go once it is resolved."""
    for n, df in inputs.items():
        df.createOrReplaceTempView(f"plumbline_{n}")
        sql = sql.replace(f"from {n}", f"from plumbline_{n}").replace(f"join {n}", f"join plumbline_{n}")
    try:
        return spark.sql(sql)
    finally:
        for n in inputs:
            spark.catalog.dropTempView(f"plumbline_{n}")


def with_views(sql: str) -> str:
    """The SQL behind the definitions of the adapters it names, for another engine."""
    wanted: list[str] = []

    def need(text: str) -> None:
        for n in VIEWS:
            if n in text and n not in wanted:
                need(VIEWS[n])
                if n not in wanted:
                    wanted.append(n)

    need(sql)
    parts = [f"{n} as ({VIEWS[n]})" for n in wanted]
    body = sql.strip()
    if body.lower().startswith("with "):
        return "with " + ", ".join(parts + [body[5:]]) if parts else body
    return ("with " + ", ".join(parts) + " " if parts else "") + body
