"""SQL for DuckDB, written from the definitions and not from the DataFrame code."""

from __future__ import annotations

from plumbline.functions.text import INCENTIVE_PHRASES, TEMPLATE_PHRASES
from plumbline.operators.corpus import FINDINGS
from plumbline.operators.corpus import LABELS as FINDING_LABELS
from plumbline.operators.scoring import LABELS, SENTENCES
from plumbline.operators.signals import DISTRIBUTION, REASONS, REGISTRY
from plumbline.sources.adapters import with_views

TOK = "regexp_extract_all(lower({}), '[a-z0-9'']+')"
SENT = "list_filter(list_transform(string_split_regex({}, '[.!?]+(?:\\s|$)'), lambda s: trim(s)), lambda s: length(s) > 0)"
W = "[A-Za-z0-9_]"


def r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def count(pattern: str, text: str = "text") -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


MEASURE = count("(?i)\\b\\d+(?:\\.\\d+)?\\s?(?:inch|inches|cm|mm|ft|lb|lbs|kg|g|oz|ml|l|hours?|days?|weeks?|months?|years?)\\b")
PCT, PRICE, DOLLARS, MODEL = count("\\b\\d+(?:\\.\\d+)?%"), count("\\$\\d+(?:\\.\\d{2})?"), count("\\$\\d+"), count("\\b[A-Z]{2,}[-\\s]?\\d{2,}\\b")
SPECIFICS = f"({MEASURE} + {PCT} + {PRICE} + {MODEL})"
SHORT = f"({MEASURE} + {PCT} + {DOLLARS})"
T = TOK.format("text")
DIVERSITY = f"case when len({T}) < 5 then 1.0 else least(1.0, len(list_distinct({T})) / sqrt(len({T})) / 7) end"
FLAT = "regexp_replace(lower(text), '\\s+', ' ', 'g')"


def hits(phrases: list[str]) -> str:
    return "(" + " + ".join(f"contains({FLAT}, '{p}')::bigint" for p in phrases) + ")"


def text(sentence: str) -> str:
    """A sentence as an SQL literal."""
    return "'" + sentence.replace("'", "''") + "'"


LENGTHS = f"list_transform({SENT.format('text')}, lambda s: len({TOK.format('s')}))"
#: Reviews with their text measures.
MEASURED = f"""measured as (select asin, seq, review_id, doc_id, rating, verified, helpful_votes, review_date, text, len(toks) as words, distinct_toks, specifics, short, incentives, templates, contractions,
  case when len(toks) < 5 then 1.0 else least(1.0, distinct_toks / sqrt(len(toks)) / 7) end as diversity,
  case when len(ls) < 3 or list_sum(ls) = 0 then 1.0 else stddev_ls / (list_sum(ls) / len(ls)) end as variation,
  case when len(bs) < 3 then 1.0 else stddev_bs / (list_sum(bs) / len(bs)) end as burstiness
  from (select *, list_aggregate(ls, 'stddev_pop') as stddev_ls, list_aggregate(bs, 'stddev_pop') as stddev_bs from (
    select *, {T} as toks, len(list_distinct({T})) as distinct_toks, {SPECIFICS} as specifics, {SHORT} as short, {hits(INCENTIVE_PHRASES)} as incentives, {hits(TEMPLATE_PHRASES)} as templates,
    {count("(?i)\\b\\w+''(?:s|t|re|ve|ll|d|m)\\b")} as contractions, {LENGTHS} as ls, list_filter({LENGTHS}, lambda n: n > 0) as bs from v_reviews)))"""
CLAMP = "greatest(0.0, least(1.0, {}))"
PHRASING = "case when length(trim(text)) = 0 then 0.0 else case when incentives > 0 then 0.45 else 0.0 end + case when templates >= 2 then 0.12 * least(templates, 3) else 0.0 end + case when words >= 40 and variation < 0.35 and diversity < 0.55 and specifics = 0 then 0.3 * (((0.35 - variation) / 0.35) * ((0.55 - diversity) / 0.55)) else 0.0 end end"
DEPTH = "case when rating in (1, 5) and words < 15 and specifics = 0 then 0.22 * (15 - words) / 15 end"
GRAMS = """grams as (select asin, seq, review_id, len(regexp_extract_all(lower(text), '[a-z0-9'']+')) as words, case when length(f) >= 3 then list_distinct(list_transform(range(1, length(f) - 1), lambda i: substring(f, i, 3))) else []::varchar[] end as g
  from (select asin, seq, review_id, text, trim(regexp_replace(lower(text), '\\s+', ' ', 'g')) as f from v_reviews))"""
PAIRS = """pairs as (select a.asin, a.review_id as a, b.review_id as b, a.seq * 10000 + b.seq * 10 as place, a.words as aw, b.words as bw, len(list_intersect(a.g, b.g)) / (len(a.g) + len(b.g) - len(list_intersect(a.g, b.g))) as sim from grams a join grams b on a.asin = b.asin and a.seq < b.seq where len(a.g) > 0 and len(b.g) > 0)"""
DUPES = """dupes as (select r as review_id, count(*) as matches, max(sim) as peak, min(place) as place from (select a as r, sim, place from pairs where aw >= 12 and bw >= 12 and sim >= 0.55 union all select b, sim, place + 1 from pairs where aw >= 12 and bw >= 12 and sim >= 0.55) group by r)"""
DUPE_DELTA = "least(1.0, 0.35 * peak + 0.15 * least(matches, 3))"
BURSTS = f"""dated as (select asin, seq, review_id, review_date as t, count(*) over (partition by asin) as n, max(review_date) over (partition by asin) - min(review_date) over (partition by asin) as span from v_reviews where review_date is not null),
  ahead as (select a.asin, a.t, min(a.seq) as seq, a.n, a.span, count(distinct b.review_id) as inside from dated a join dated b on a.asin = b.asin and b.t between a.t and a.t + 3 where a.n >= 5 and a.span >= 30 group by a.asin, a.t, a.n, a.span),
  best as (select * from (select *, row_number() over (partition by asin order by inside desc, t, seq) as k from ahead) where k = 1),
  bursts as (select d.review_id, (d.t - date '2000-01-01') * 1000 + d.seq as place, printf({text(REASONS["burst"])}, inside, best.t::varchar, best.span) as reason, inside / best.n as share, least(1.0, 0.4 * greatest(0.0, (inside / best.n - greatest(0.01, least(1.0, 3 / best.span))) / (1 - greatest(0.01, least(1.0, 3 / best.span))))) as delta
    from best join dated d on d.asin = best.asin and d.t between best.t and best.t + 3 where inside / best.n >= 0.5 and inside >= 3)"""
DIST = """dist as (select asin, h1, s1, s5, mid, coalesce(h1, h2, h3, h4, h5) is null as missing, tot is not null and tot > 0 as known, case when total_ratings > 0 then greatest(0.0, least(1.0, log10(total_ratings + 1) / 3)) else 0.3 end as conf,
  greatest(0.0, least(1.0, case when s5 > 0.8 and s1 < 0.02 then 0.55 * ((0.02 - s1) / 0.02) * least(1.0, (s5 - 0.8) / 0.15) else 0 end + case when s5 > 0.75 and mid < 0.08 then 0.35 * ((0.08 - mid) / 0.08) else 0 end + case when s5 > 0.5 and s1 > 0.2 and mid < 0.15 then 0.25 else 0 end)) as x
  from (select *, coalesce(h1, 0) / nullif(tot, 0) as s1, coalesce(h5, 0) / nullif(tot, 0) as s5, coalesce(h2, 0) / nullif(tot, 0) + coalesce(h3, 0) / nullif(tot, 0) + coalesce(h4, 0) / nullif(tot, 0) as mid from (select *, coalesce(h1, 0) + coalesce(h2, 0) + coalesce(h3, 0) + coalesce(h4, 0) + coalesce(h5, 0) as tot from {})))"""
DIST_STATUS = "case when not known then 'insufficient-data' when x >= 0.5 then 'fail' when x >= 0.2 then 'warn' else 'pass' end"
ASSESSED = f"""{MEASURED}, {GRAMS}, {PAIRS}, {DUPES}, {BURSTS},
  broken as (select asin, count(*) >= 3 and avg(case when length(trim(text)) > 0 then 1.0 else 0.0 end) < 0.35 as bad, count(*) as n from v_reviews group by asin),
  deltas as (select m.asin, m.review_id, m.seq, bad, n,
    case when not verified then case when rating = 5 then 0.4 else 0.18 end end as verified,
    case when not bad and ({PHRASING}) > 0 then {PHRASING} end as phrasing,
    case when not bad and peak is not null then {DUPE_DELTA} end as duplication, bursts.delta as burst,
    case when not bad then {DEPTH} end as depth,
    case when l.total_ratings >= 200 and rating = 5 and helpful_votes = 0 and date '2026-01-01' - review_date >= 90 then 0.12 end as helpfulness
    from measured m join broken using (asin) left join v_listings l on l.asin = m.asin left join dupes on dupes.review_id = m.review_id left join bursts on bursts.review_id = m.review_id),
  assessed as (select *, least(1.0, coalesce(verified, 0) + coalesce(phrasing, 0) + coalesce(duplication, 0) + coalesce(burst, 0) + coalesce(depth, 0) + coalesce(helpfulness, 0)) as suspicion from deltas)"""
PCT_OF = "concat(floor({} * 100 + 0.5)::bigint, '%')"
FIVE, ONE, MIDDLE = PCT_OF.format("s5"), PCT_OF.format("s1"), PCT_OF.format("mid")
DIST_EVIDENCE = f"list_filter([case when s5 > 0.8 and s1 < 0.02 then printf({text(DISTRIBUTION['tail'])}, {FIVE}, {ONE}) end, case when s5 > 0.75 and mid < 0.08 then printf({text(DISTRIBUTION['hollow'])}, {MIDDLE}) end, case when s5 > 0.5 and s1 > 0.2 and mid < 0.15 then printf({text(DISTRIBUTION['polar'])}, {FIVE}, {ONE}) end], lambda x: x is not null)"
DIST_DETAIL = f"case when missing then {text(DISTRIBUTION['missing'])} when not known then {text(DISTRIBUTION['empty'])} when len({DIST_EVIDENCE}) > 0 then ({DIST_EVIDENCE})[1] else printf({text(DISTRIBUTION['clear'])}, {FIVE}, {ONE}) end"
SAID = f"""said as (select m.asin, m.review_id, m.seq, bad, n,
    case when not verified then case when rating = 5 then {text(REASONS['verified_5'])} else {text(REASONS['verified'])} end end as verified, m.seq as p_verified,
    case when not bad and length(trim(text)) > 0 then nullif(concat_ws('; ', case when incentives > 0 then {text(REASONS['incentive'])} end, case when templates >= 2 then {text(REASONS['template'])} end, case when words >= 40 and variation < 0.35 and diversity < 0.55 and specifics = 0 then {text(REASONS['machine'])} end), '') end as phrasing, m.seq as p_phrasing,
    case when not bad and peak is not null then case when matches = 1 then {text(REASONS['duplicate_1'])} else printf({text(REASONS['duplicate_n'])}, matches) end end as duplication, dupes.place as p_duplication,
    bursts.reason as burst, bursts.place as p_burst,
    case when not bad and ({DEPTH}) is not null then case when words = 0 then printf({text(REASONS['empty'])}, rating) else printf({text(REASONS['thin'])}, rating, words, case when words = 1 then 'word' else 'words' end) end end as depth, m.seq as p_depth,
    case when l.total_ratings >= 200 and rating = 5 and helpful_votes = 0 and date '2026-01-01' - review_date >= 90 then printf({text(REASONS['unvoted'])}, date '2026-01-01' - review_date) end as helpfulness, m.seq as p_helpfulness
    from measured m join broken using (asin) left join v_listings l on l.asin = m.asin left join dupes on dupes.review_id = m.review_id left join bursts on bursts.review_id = m.review_id)"""
NAMES = ["verified", "phrasing", "duplication", "burst", "depth", "helpfulness"]


def scored(extra_sus: str = "0", joins: str = "", w: str = "0", ws: str = "0", concerns: str = "0", deep_join: str = "") -> str:
    """The analysis, with further deltas and signals."""
    return f"""final as (select a.*, least(1.0, coalesce(verified, 0) + coalesce(phrasing, 0) + coalesce(duplication, 0) + coalesce(burst, 0) + coalesce(depth, 0) + coalesce(helpfulness, 0) + {extra_sus}) as sus from assessed a {joins}),
  per as (select asin, count(*) as n, avg(sus) as m, count(*) filter (where sus >= 0.4) as disc, {' + '.join(f'(count({x}) > 0)::int' for x in NAMES)} as hot, least(1.0, log10(count(*) + 1) / log10(26)) as sc from final group by asin),
  {DIST.format('v_listings')},
  joined as (select l.*, coalesce(n, 0) as n_, coalesce(m, 0) as m_, coalesce(disc, 0) as disc_, coalesce(sc, 0) as sc_, coalesce(hot, 0) + ({DIST_STATUS} in ('warn', 'fail'))::int + {concerns} as conc, case when n > 0 then 1.6 * sc else 0 end as w1, case when known then 1.4 * conf else 0 end as w2, 1 - x as ds, {w} as w3, {ws} as ws3 from v_listings l join dist using (asin) left join per using (asin) {deep_join}),
  judged as (select *, (w1 + w2 + w3 < 0.15) or (n_ < 3 and coalesce(total_ratings, 0) < 50) as insuff from joined),
  trusted as (select *, case when insuff then 50 else floor(100 * ((1 - m_) * w1 + coalesce(ds, 0) * w2 + ws3) / (w1 + w2 + w3) + 0.5)::bigint end as trust from judged),
  graded as (select *, case when trust >= 85 then 1 when trust >= 70 then 2 when trust >= 55 then 3 when trust >= 40 then 4 else 5 end as g0, case when disc_ >= 0.5 * n_ and n_ > 0 then case when conc < 2 then 3 else 4 end when disc_ >= 0.35 * n_ and n_ > 0 then 3 when disc_ >= 0.15 * n_ and n_ > 0 then 2 else 1 end as fl from trusted),
  answer as (select *, case when insuff then 'C' else substr('ABCDF', greatest(g0, fl), 1) end as grade, substr('ABCDF', g0, 1) as g_raw, case when insuff then null when m_ >= 0.85 then null when m_ <= 0.01 then floor(displayed_rating * 10 + 0.5) / 10 else floor(greatest(1.0, least(5.0, displayed_rating + ((displayed_rating - 5 * m_) / (1 - m_) - displayed_rating) * sc_)) * 10 + 0.5) / 10 end as adj,
    case when insuff then 'very-low' when n_ >= 20 and h5 is not null then 'high' when n_ >= 8 and h5 is not null then 'moderate' when n_ >= 8 or h5 is not null then 'low' else 'very-low' end as level from graded)"""


SHINGLES = """toks as (select asin, review_id, doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') as t from v_reviews),
  grams6 as (select asin, review_id, doc_id, unnest(list_transform(range(1, greatest(len(t) - 4, 1)), lambda i: left(sha256(array_to_string(t[i:i + 5], ' ')), 32))) as h from toks),
  seen as (select distinct h, asin, date '2026-07-01' + (doc_id % 3)::int as day from grams6),
  spread as (select h, count(distinct day) as days, count(distinct asin) as asins from seen group by h having count(distinct day) >= 2 and count(distinct asin) >= 3)"""
TEMPLATED = """totals as (select asin, review_id, count(*) as total from grams6 group by all),
  reusing as (select g.asin, g.review_id, count(*) as reused, max(asins - 1) as peak from (select distinct asin, review_id, h from grams6) g join spread using (h) where asins - 1 >= 3 group by all),
  templated as (select asin, review_id, reused, total, peak, least(1.0, 0.3 + 0.4 * reused / total) as delta from reusing join totals using (asin, review_id) where reused / total >= 0.25)"""
MACHINE = """machine as (select asin, review_id, case when words < 40 then 0.0 when (u > 0.3)::int + (n > 0.3)::int + (st > 0.5)::int + (g = 1)::int >= 3 then least(1.0, s) else 0.4 * s end as likelihood from (
  select *, 0.35 * u + 0.3 * n + 0.2 * st + 0.15 * g as s from (select asin, review_id, words, greatest(0, (0.45 - burstiness) / 0.45) as u, greatest(0, (0.6 - diversity) / 0.6) as n, case when contractions = 0 then 1.0 else greatest(0, (0.02 - contractions / words) / 0.02) end as st, case when short = 0 then 1 else 0 end as g from measured)))"""
#: What the corpus finds of reviews: template reuse, machine likelihood, reviewer network.
R_FINDINGS = """r_edges as (select distinct reviewer_id as reviewer, asin from v_reviews where reviewer_id <> ''),
  r_shared as (select a.reviewer as r1, b.reviewer as r2, count(*) as c from r_edges a join r_edges b on a.asin = b.asin and a.reviewer < b.reviewer group by all having count(*) >= 3),
  r_links as (select a.asin, r1, r2, c - 1 as shared from r_edges a join r_edges b on a.asin = b.asin and a.reviewer < b.reviewer join r_shared on r1 = a.reviewer and r2 = b.reviewer),
  r_net as (select asin, r as reviewer_id, count(*) as links, max(shared) as npeak from (select asin, r1 as r, shared from r_links union all select asin, r2, shared from r_links) group by all),
  r_ids as (select asin, count(*) as n, count(*) filter (where reviewer_id <> '') as identifiable from v_reviews group by asin),
  f as (select v.asin, v.review_id, v.seq, n, identifiable, t.delta as d_template, t.peak, case when likelihood >= 0.45 then least(1.0, 0.35 * likelihood) end as d_machine, case when identifiable >= 4 and links is not null then least(1.0, 0.2 + 0.12 * links + 0.05 * npeak) end as d_network, links, npeak
    from v_reviews v join r_ids using (asin) left join templated t on t.asin = v.asin and t.review_id = v.review_id left join machine m on m.asin = v.asin and m.review_id = v.review_id left join r_net on r_net.asin = v.asin and r_net.reviewer_id = v.reviewer_id)"""
R_REASON = {
    "template": f"case when d_template is not null then printf({text(FINDINGS['template'])}, peak) end",
    "machine": f"case when d_machine is not null then {text(FINDINGS['machine'])} end",
    "network": f"case when d_network is not null then printf({text(FINDINGS['network'])}, links, case when links = 1 then 'reviewer' else 'reviewers' end, npeak) end",
}
FOUND = """found as (select asin, count(*) as n, coalesce(any_value(k), 0) as k from v_reviews left join (select asin, count(*) as k from (select asin from templated union all select asin from machine where likelihood >= 0.45) group by asin) using (asin) group by asin)"""
FOUND_STATUS = "case when k = 0 then 'pass' when k >= greatest(2, 0.3 * n) then 'fail' else 'warn' end"
LINKS = """shared as (select a.reviewer as r1, b.reviewer as r2, count(*) as c from v_edges a join v_edges b on a.asin = b.asin and a.reviewer < b.reviewer group by all having count(*) >= 3),
  links as (select a.asin, r1, r2, c - 1 as shared from v_edges a join v_edges b on a.asin = b.asin and a.reviewer < b.reviewer join shared on r1 = a.reviewer and r2 = b.reviewer)"""
NETWORK = f"""{LINKS}, ids as (select asin, count(*) as identifiable from v_edges group by asin),
  net as (select asin, r, count(*) as links, max(shared) as peak from (select asin, r1 as r, shared from links union all select asin, r2, shared from links) group by all)"""
PRUNED = """pruned as (select * from (select *, row_number() over w as k, lag(displayed_rating) over w as r0, lag(total_ratings) over w as n0, lag(title_hash) over w as t0 from v_observations window w as (partition by asin order by obs_id)) where k = 1 or displayed_rating is distinct from r0 or total_ratings is distinct from n0 or title_hash is distinct from t0)"""
HISTORY = f"""{PRUNED}, hist as (select * exclude (k, r0, n0, t0) from (select *, row_number() over (partition by asin order by observed_at, obs_id) as pos from pruned) where pos <= 200)"""
#: The past of listings, from the days on which their reviews were seen.
PAST = HISTORY.replace("v_observations", "v_history")
HIJACKS = """titled as (select asin, obs_id, observed_at, title_hash as t, coalesce(total_ratings, 0) as n, lag(title_hash) over w as t0, lag(coalesce(total_ratings, 0)) over w as n0 from hist where title_hash <> '' window w as (partition by asin order by observed_at, obs_id)),
  ch as (select asin, count(*) as c, bool_or(n0 > 100 and n >= 0.8 * n0) as carried from titled where t0 <> t group by asin),
  hj as (select asin, coalesce(c, 0) as changes, coalesce(carried, false) as carried, case when c is null then 'pass' when carried then 'fail' else 'warn' end as status from (select asin from hist group by asin having count(*) >= 2) left join ch using (asin))"""
SHIFTS = """mv as (select asin, obs_id, observed_at, displayed_rating as r, coalesce(total_ratings, 0) as n, displayed_rating - lag(displayed_rating) over w as m, lag(coalesce(total_ratings, 0)) over w as base from hist window w as (partition by asin order by observed_at, obs_id)),
  rs as (select asin, count(*) as rows_, count(*) filter (where abs(m) >= 0.4) as jumps, case when count(*) < 2 then 'insufficient-data' when count(*) filter (where abs(m) >= 0.4) = 0 then 'pass' when count(*) filter (where abs(m) >= 0.4) = 1 then 'warn' else 'fail' end as status from mv group by asin)"""
PF = """pf as (select asin, any_value(n) as n, any_value(identifiable) as identifiable, count(d_template) as templated, count(d_machine) as machined, count(d_network) as linked from f group by asin),
  st as (select pf.*, case when templated + machined = 0 then 'pass' when templated + machined >= greatest(2, 0.3 * n) then 'fail' else 'warn' end as s1, case when identifiable < 4 then 'insufficient-data' when linked >= 0.35 * identifiable then 'fail' when linked > 0 then 'warn' else 'pass' end as s2, coalesce(hj.status, 'insufficient-data') as s3, coalesce(rs.status, 'insufficient-data') as s4, rows_ from pf left join hj using (asin) left join rs using (asin))"""
DAY = "strftime(observed_at, '%Y-%m-%d')"
MOVE = "concat(case when m > 0 then '+' else '' end, printf('%.1f', m))"
P_FINDINGS = f"""lines as (select asin, 'ai-text' as signal, seq * 10 as place, {R_REASON['template']} as reason from f union all select asin, 'ai-text', seq * 10 + 1, {R_REASON['machine']} from f union all select asin, 'reviewer-network', seq * 10, {R_REASON['network']} from f),
  ev as (select asin, signal, list(reason order by place)[1:4] as e from lines where reason is not null group by all
    union all select asin, 'review-hijack', list(case when n0 > 100 and n >= 0.8 * n0 then printf({text(FINDINGS['hijack_carried'])}, {DAY}, format('{{:,}}', n)) else printf({text(FINDINGS['hijack_changed'])}, {DAY}) end order by observed_at, obs_id) from titled where t0 <> t group by asin
    union all select asin, 'rating-history', list(case when base > 200 and n - base < base * 0.15 then printf({text(FINDINGS['shift_few'])}, {MOVE}, printf('%.1f', floor(r * 10 + 0.5) / 10), {DAY}, format('{{:,}}', n - base), format('{{:,}}', base)) else printf({text(FINDINGS['shift_many'])}, {MOVE}, printf('%.1f', floor(r * 10 + 0.5) / 10), {DAY}, format('{{:,}}', n - base)) end order by observed_at, obs_id) from mv where abs(m) >= 0.4 group by asin),
  pfind as (select asin, 'ai-text' as signal, s1 as status, case when templated + machined = 0 then {text(FINDINGS['text_pass'])} else printf({text(FINDINGS['text_found'])}, templated, machined) end as detail from st
    union all select asin, 'reviewer-network', s2, case when identifiable < 4 then {text(FINDINGS['network_few'])} when linked = 0 then printf({text(FINDINGS['network_pass'])}, identifiable) else printf({text(FINDINGS['network_found'])}, linked, identifiable) end from st
    union all select asin, 'review-hijack', status, case status when 'pass' then {text(FINDINGS['hijack_pass'])} when 'fail' then {text(FINDINGS['hijack_fail'])} else {text(FINDINGS['hijack_warn'])} end from hj
    union all select asin, 'rating-history', status, case when rows_ < 2 then {text(FINDINGS['history_few'])} when status = 'pass' then printf({text(FINDINGS['shift_pass'])}, rows_) else {text(FINDINGS['shift_found'])} end from rs)"""
FINDING_LABEL = "case signal " + " ".join(f"when '{k}' then {text(v)}" for k, v in FINDING_LABELS.items()) + " end"
KEY = "left(sha256(concat(rating::varchar, '|', coalesce(review_date::varchar, ''), '|', regexp_replace(lower(left(text, 400)), '\\s+', ' ', 'g'))), 32)"
REASONS = {0: "malformed JSON", 1: "not an object", 2: "contractVersion", 3: "unknown field", 4: "asin", 5: "displayedRating", 6: "displayedRating", 7: "totalRatings", 8: "titleHash", 9: "histogram", 10: "histogram", 11: "reviews", 12: "review: id", 13: "review: rating", 14: "review: rating", 15: "review: rating", 16: "review: verified", 17: "review: text", 18: "review: helpfulVotes", 19: "review: date", 20: "review: reviewerId", 21: "review: unknown field"}
OUTCOME = "case event_id % 24 " + " ".join(f"when {k} then '{v}'" for k, v in REASONS.items()) + " else 'accepted' end"
URL = "upper(coalesce(nullif(regexp_extract(url, '(?i)/dp/([A-Z0-9]{10})(?:[/?]|$)', 1), ''), nullif(regexp_extract(url, '(?i)/gp/product/([A-Z0-9]{10})(?:[/?]|$)', 1), ''), nullif(regexp_extract(url, '(?i)/product-reviews/([A-Z0-9]{10})(?:[/?]|$)', 1), ''), nullif(regexp_extract(url, '(?i)[?&]asin=([A-Z0-9]{10})\\b', 1), '')))"
SPACES = "[\\t\\n\\x0B\\f\\r \\x{00A0}\\x{FEFF}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"
TONE = "case when insuff then 'unknown' when grade in ('D', 'F') then 'bad' when grade = 'C' then 'mixed' else 'good' end"
TITLE = f"case when insuff then {text(SENTENCES['title_unknown'])} else case grade " + " ".join(f"when '{g}' then {text(SENTENCES[f'title_{g}'])}" for g in "ABCDF") + " end end"
NOUN = "case when n_ = 1 then 'review' else 'reviews' end"
SUB = f"case when insuff then {text(SENTENCES['sub_unknown'])} when disc_ > 0 then concat(disc_, ' of ', n_, ' visible ', {NOUN}, ' discounted.') when conc = 1 then {text(SENTENCES['sub_one'])} when conc > 1 then concat('No review was discounted, but ', conc, ' checks raised concerns.') else concat('Nothing flagged across ', n_, ' visible ', {NOUN}, '.') end"
STARS = "concat(printf('%.1f', {}), '★')"
SHOWN = f"case when displayed_rating is null then 'the star rating' else {STARS.format('displayed_rating')} end"
GAP = "coalesce(displayed_rating - adj, 0) >= 0.3"
HEADLINE = f"case when insuff then {text(SENTENCES['headline_unknown'])} when grade in ('D', 'F') then case when {GAP} then concat('Don''t rely on ', {SHOWN}) else concat('Treat ', {SHOWN}, ' with caution') end when grade = 'C' then concat({SHOWN}, ' looks softer than it appears') when conc > 0 or disc_ > 0 then concat({SHOWN}, ' is broadly believable') when {GAP} then concat({SHOWN}, ' is roughly right') else concat({SHOWN}, ' looks earned') end"
RESTATED = f"case when adj is not null and {GAP} then printf({text(SENTENCES['restated'])}, {STARS.format('adj')}) else '' end"
ADVICE = f"case when insuff then {text(SENTENCES['advice_unknown'])} when grade in ('D', 'F') then concat({RESTATED}, {text(SENTENCES['advice_bad'])}) when grade = 'C' then concat({RESTATED}, {text(SENTENCES['advice_mixed'])}) when conc > 0 or disc_ > 0 then concat(case when disc_ > 0 then concat(disc_, ' of the ', n_, ' visible reviews were discounted') else concat(conc, case when conc = 1 then ' check' else ' checks' end, ' flagged something') end, {text(SENTENCES['noted'] + SENTENCES['hand_back'])}) else {text(SENTENCES['clear'] + SENTENCES['hand_back'])} end"
BASIS = f"case when insuff then {text(SENTENCES['basis_unknown'])} else concat('Based on the ', n_, ' ', {NOUN}, ' visible on this page', case when h5 is null then '' when coalesce(total_ratings, 0) > 0 then concat(' and the rating breakdown across all ', format('{{:,}}', total_ratings), ' ratings') else ' and the overall rating breakdown' end, {text(SENTENCES['basis_end'])}, case when bad and h5 is null then {text(f' Note: {SENTENCES["caveat_text"]}, and {SENTENCES["caveat_bars"]}.')} when bad then {text(f' Note: {SENTENCES["caveat_text"]}.')} when h5 is null then {text(f' Note: {SENTENCES["caveat_bars"]}.')} else '' end) end"
POPUP = f"case when insuff then {text(SENTENCES['popup_unknown'])} when adj is null then {text(SENTENCES['popup_none'])} else printf({text(SENTENCES['popup'])}, {STARS.format('adj')}, trust) end"
LEVEL = "case level " + " ".join(f"when '{k}' then '{v}'" for k, v in LABELS["confidence"].items()) + " end"
MEANING = "case grade " + " ".join(f"when '{g}' then {text(f'Grade {g} of A to F. ' + SENTENCES[f'title_{g}'] + '.')}" for g in "ABCDF") + " end"
STATUS = "case status " + " ".join(f"when '{k}' then '{v}'" for k, v in LABELS["status"].items()) + " end"
PADS = tuple("".join(f"{b ^ x:02x}" for b in b"pepper".ljust(64, b"\0")) for x in (0x36, 0x5C))


def build() -> dict[str, str]:
    full = f"with {ASSESSED}, {scored()}"
    corpus = f"{SHINGLES}, {TEMPLATED}, {MACHINE}, {R_FINDINGS}"
    past = f"{PAST}, {HIJACKS}, {SHIFTS}, {PF}"
    live = ["s1", "s2", "s3", "s4"]
    deep = f"with {ASSESSED}, {corpus}, {past}, " + scored(
        "coalesce(f.d_template, 0) + coalesce(f.d_machine, 0) + coalesce(f.d_network, 0)",
        "left join f on f.review_id = a.review_id and f.asin = a.asin",
        " + ".join(f"case when st.{x} = 'insufficient-data' then 0 else 1.2 end" for x in live),
        " + ".join(f"case st.{x} when 'insufficient-data' then 0 when 'fail' then 0.15 * 1.2 when 'warn' then 0.55 * 1.2 else 1.2 end" for x in live),
        " + ".join(f"(st.{x} in ('warn', 'fail'))::int" for x in live),
        "left join (select asin, s1, s2, s3, s4 from st) st using (asin)",
    )
    found = f"with {MEASURED}, {corpus}, {past}, {P_FINDINGS}"
    told = " union all ".join(f"select asin, '{r.name}' as signal, {text(r.label)} as label, {text(r.clear)} as clear, {r.of_text and 'bad' or 'false'} as skip, {r.name} as reason, p_{r.name} as place from said" for r in REGISTRY)
    listed = "v_reviews r join v_listings l using (asin)"
    fields = ["title", "displayed_rating", "total_ratings", "h1", "h2", "h3", "h4", "h5"]
    stored = f"stored as (select asin, {KEY} as k, doc_id, helpful_votes as v, review_date as d from v_reviews)"
    summary = " union all ".join(f"select asin, '{s}' as signal, count({s}) as flagged, count(*) as n, {'bool_or(bad)' if s in ('phrasing', 'duplication', 'depth') else 'false'} as skip from assessed group by asin" for s in NAMES)
    sql = {
        "text_tokens": f"select token, count(*) as n from (select unnest({T}) as token from v_reviews) group by token",
        "text_word_count": f"select review_id, len({T}) as words, len(regexp_extract_all(text, '\\S+')) as spaced from v_reviews",
        "text_diversity": f"select review_id, {r6(DIVERSITY)} as diversity from v_reviews",
        "text_sentence_variation": f"with {MEASURED} select review_id, {r6('variation')} as variation, {r6('burstiness')} as burstiness from measured",
        "text_specificity": f"with {MEASURED} select review_id, specifics, short as specifics_short, {r6('case when words = 0 then 0 else contractions / words end')} as contractions from measured",
        "phrase_hits": f"with {MEASURED} select review_id, incentives, templates from measured",
        "phrase_lists": f"select review_id, coalesce(array_to_string(list_filter([{', '.join(map(text, INCENTIVE_PHRASES + TEMPLATE_PHRASES))}], lambda p: contains({FLAT}, p)), ' | '), '') as phrases from v_reviews",
        "trigram_jaccard_pairs": f"with {GRAMS}, {PAIRS} select a, b, {r6('sim')} as sim from pairs where {r6('sim')} >= 0.55",
        "shingle_hashes": f"with {SHINGLES} select h as hash, count(*) as n from grams6 group by h",
        "review_key": f"select review_id, {KEY} as review_key from v_reviews",
        "title_hash": "select p_partkey, left(sha256(lower(trim(p_name))), 32) as title_hash from part",
        "reviewer_hash": f"select distinct reviewer_id, left(sha256(unhex('{PADS[1]}') || unhex(sha256(unhex('{PADS[0]}') || encode(reviewer_id)))), 32) as reviewer_hash from v_reviews",
        "sig_distribution": f"with {DIST.format('v_snapshots')} select asin, {DIST_STATUS} as status, {r6('case when known then 1 - x else 0.5 end')} as score, {r6('case when known then conf else 0 end')} as confidence from dist",
        "sig_verified": "select review_id, case when rating = 5 then 0.4::double else 0.18::double end as delta from v_reviews where not verified",
        "sig_phrasing": f"with {MEASURED} select review_id, {r6(PHRASING)} as delta from measured where ({PHRASING}) > 0",
        "sig_duplication": f"with {GRAMS}, {PAIRS}, {DUPES} select review_id, matches, {r6('peak')} as peak, {r6(DUPE_DELTA)} as delta from dupes",
        "sig_burst": f"with {BURSTS} select review_id, {r6('share')} as share, {r6('delta')} as delta from bursts where delta >= 0.1",
        "sig_depth": f"with {MEASURED} select review_id, {r6(DEPTH)} as delta from measured where ({DEPTH}) is not null",
        "sig_helpfulness": "select review_id, 0.12::double as delta from v_reviews join v_listings using (asin) where total_ratings >= 200 and rating = 5 and helpful_votes = 0 and date '2026-01-01' - review_date >= 90",
        "text_coverage": f"select asin, count(*) as n, {r6('avg(case when length(trim(text)) > 0 then 1.0 else 0.0 end)')} as coverage, count(*) >= 3 and avg(case when length(trim(text)) > 0 then 1.0 else 0.0 end) < 0.35 as text_failed from v_reviews group by asin",
        "review_suspicion": f"with {ASSESSED} select asin, review_id, {r6('suspicion')} as suspicion from assessed",
        "signal_summary": f"with {ASSESSED} select asin, signal, flagged, n, case when skip then 'insufficient-data' when flagged = 0 then 'pass' when flagged >= 0.4 * n then 'fail' else 'warn' end as status, {r6('case when skip then 0.5 else 1 - flagged / n end')} as score, {r6('case when skip then 0 else least(1.0, log10(n + 1) / log10(26)) end')} as confidence from ({summary})",
        "analysis": f"{full} select asin, n_ as sample_size, trust as trust_score, grade, {r6('displayed_rating')} as displayed_rating, {r6('adj')} as adjusted_rating, disc_ as discounted_count, conc::bigint as concerning_signals, level as confidence, insuff as insufficient_data, {r6('m_')} as mean_suspicion from answer",
        "trust_score": f"{full} select asin, trust as trust_score, insuff as insufficient_data from answer",
        "adjusted_rating": f"{full} select asin, {r6('displayed_rating')} as displayed_rating, {r6('adj')} as adjusted_rating from answer",
        "grade_distribution": f"{full} select grade, count(*) as listings from answer group by grade",
        "grade_cap": f"{full} select asin, grade, g_raw as uncapped, disc_ as discounted_count, conc::bigint as concerning_signals from answer",
        "confidence_level": f"{full} select asin, level as confidence from answer",
        "verdict_tone": f"{full} select {TONE} as tone, abs(coalesce(displayed_rating - adj, 0)) >= 0.1 as shows_old_rating, count(*) as listings from answer group by all",
        "verdict_texts": f"{full} select asin, {HEADLINE} as headline, {ADVICE} as advice, {BASIS} as basis, {POPUP} as popup, {LEVEL} as confidence_label, {MEANING} as grade_meaning from answer left join broken using (asin)",
        "review_reasons": f"with {ASSESSED}, {SAID} select asin, review_id, coalesce(array_to_string(list_filter([{', '.join(NAMES)}], lambda x: x is not null), ' | '), '') as reasons from said",
        "distribution_details": f"with {DIST.format('v_snapshots')} select asin, {DIST_STATUS} as status, {DIST_DETAIL} as detail, coalesce(array_to_string({DIST_EVIDENCE}, ' | '), '') as evidence from dist",
        "signal_details": f"with {ASSESSED}, {SAID}, {DIST.format('v_listings')}, told as ({told}), g as (select asin, signal, label, clear, bool_or(skip) as skip, count(*) as n, count(reason) as flagged, list(reason order by place) filter (where reason is not null) as e from told group by all), every_ as (select asin, signal, label, case when skip then 'insufficient-data' when flagged = 0 then 'pass' when flagged >= 0.4 * n then 'fail' else 'warn' end as status, case when skip then 0.5 else 1 - flagged / n end as score, 1.0::double as weight, case when skip then 0 else least(1.0, log10(n + 1) / log10(26)) end as confidence, case when skip then {text(SENTENCES['detail_text'])} when flagged = 0 then clear else printf('%d of %d visible reviews flagged.', flagged, n) end as detail, e[1:5] as e from g union all select asin, 'distribution', 'Rating distribution', {DIST_STATUS}, case when known then 1 - x else 0.5 end, 1.4::double, case when known then conf else 0 end, {DIST_DETAIL}, case when known then {DIST_EVIDENCE} end from dist) select asin, signal, label, status, {STATUS} as status_label, {r6('score')} as score, weight, {r6('confidence')} as confidence, detail, coalesce(array_to_string(e, ' | '), '') as evidence from every_",
        "headline": f"{full} select asin, {TITLE} as title, {SUB} as sub from answer",
        "shingle_spread": f"with {SHINGLES} select h as shingle_hash, days, asins from spread",
        "template_findings": f"with {SHINGLES}, {TEMPLATED} select review_id, reused, total, peak, {r6('delta')} as delta from templated",
        "machine_likelihood": f"with {MEASURED}, {MACHINE} select review_id, {r6('likelihood')} as likelihood from machine",
        "text_findings": f"with {MEASURED}, {SHINGLES}, {TEMPLATED}, {MACHINE}, {FOUND} select asin, k, {FOUND_STATUS} as status from found",
        "reviewer_links": f"with {LINKS} select asin, r1, r2, shared from links",
        "network_findings": f"with {NETWORK} select concat(asin, '-', r) as review_id, identifiable, links, peak, {r6('least(1.0, 0.2 + 0.12 * links + 0.05 * peak)')} as delta from net join ids using (asin) where identifiable >= 4",
        "network_status": f"with {NETWORK}, linked as (select asin, count(*) as l from net group by asin) select asin, identifiable, case when identifiable >= 4 then coalesce(l, 0) else 0 end as linked, case when identifiable < 4 then 'insufficient-data' when coalesce(l, 0) >= 0.35 * identifiable then 'fail' when l > 0 then 'warn' else 'pass' end as status from ids left join linked using (asin)",
        "obs_dedupe": f"with {PRUNED} select obs_id, asin, displayed_rating, total_ratings, title_hash from pruned",
        "listing_hijack": f"with {HISTORY}, titled as (select asin, title_hash as t, coalesce(total_ratings, 0) as n, lag(title_hash) over w as t0, lag(coalesce(total_ratings, 0)) over w as n0 from hist where title_hash <> '' window w as (partition by asin order by observed_at, obs_id)), ch as (select asin, count(*) as c, bool_or(n0 > 100 and n >= 0.8 * n0) as carried from titled where t0 <> t group by asin) select asin, coalesce(c, 0) as changes, coalesce(carried, false) as carried, case when c is null then 'pass' when carried then 'fail' else 'warn' end as status from (select asin from hist group by asin having count(*) >= 2) left join ch using (asin)",
        "rating_shifts": f"with {HISTORY}, mv as (select asin, abs(displayed_rating - lag(displayed_rating) over (partition by asin order by observed_at, obs_id)) as m from hist) select asin, count(*) filter (where m >= 0.4) as jumps, case when count(*) < 2 then 'insufficient-data' when count(*) filter (where m >= 0.4) = 0 then 'pass' when count(*) filter (where m >= 0.4) = 1 then 'warn' else 'fail' end as status from mv group by asin",
        "material_change": "select asin, obs_id, coalesce(title_hash <> t0, false) or coalesce(abs(total_ratings - n0) > greatest(50, 0.1 * n0), false) as material from (select *, lag(title_hash) over w as t0, lag(total_ratings) over w as n0, row_number() over w as k from v_observations window w as (partition by asin order by observed_at, obs_id)) where k > 1",
        "upsert_reviews": f"with {stored}, keyed as (select asin, k, coalesce(min(d) filter (where doc_id % 2 = 0), min(d) + 30) as first_seen, max(d) + 30 as last_seen, max_by(v, d) + 1 as votes from stored group by all) select asin, count(*) as n, sum(votes)::bigint as votes, min(first_seen) as first_seen, max(last_seen) as last_seen from keyed group by asin",
        "shingle_sightings": f"with {SHINGLES} select h as shingle_hash, asin, count(distinct day) as sightings, max(day) as last_counted from seen group by all",
        "retention_sweep": f"with {SHINGLES}, live as (select * from v_reviews where review_date + 30 >= date '2024-07-01'), sh as (select distinct h, asin from seen where asin in (select asin from live)) select 'reviews' as name, count(*) as kept from live union all select 'observations', count(*) from v_observations where observed_at >= timestamp '2024-07-01' union all select 'cache', count(*) from v_observations where observed_at >= timestamp '2026-06-24' union all select 'shingles', count(*) from sh union all select 'shingle_days', count(*) from (select distinct h, day from seen where h in (select h from sh))",
        "orphan_shingles": f"with {SHINGLES} select asin, count(distinct h) as orphans from seen where asin not in (select asin from v_reviews where review_date + 30 >= date '2024-07-01') group by asin",
        "cache_lookup": "select asin, max_by(obs_id, observed_at) as payload from v_observations group by asin having max(observed_at) >= timestamp '2024-01-30 17:00:00'",
        "request_validation": f"select event_id, {OUTCOME} as outcome from v_requests",
        "reject_reasons": f"select {OUTCOME} as outcome, count(*) as requests from v_requests group by all",
        "accepted_reviews": "select event_id, concat('U', lpad(user_id::varchar, 9, '0')) as asin, 5::bigint as rating, date '2026-06-03' as review_date, true as verified, 3::bigint as helpful_votes from events where event_id % 24 >= 22",
        "url_asin": f"select page_id, {URL} as asin, regexp_matches(url, '/(dp|gp/product|product-reviews)/') as product from pages",
        "interstitial_pages": "select coalesce(regexp_matches(html, '(?i)<form[^>]*action=[\"''][^\"'']*(validateCaptcha|/errors/)') or regexp_matches(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script>|<style\\b.*?</style>|<!--.*?-->', '', 'g'), '<[^>]*>', '', 'g'), '(?i)click the button below to continue shopping|enter the characters you see below|we just need to make sure you''?re not a robot|type the characters you see in this image'), false) as interstitial, count(*) as pages from pages group by all",
        "histogram_plausible": "select asin, h1 + h2 + h3 + h4 + h5 between 80 and 120 as plausible from v_snapshots",
        "review_findings": f"with {MEASURED}, {corpus} select asin, review_id, {r6('d_template')} as template, {r6('d_machine')} as machine, {r6('d_network')} as network, concat_ws(' | ', {', '.join(R_REASON.values())}) as reasons from f where coalesce(d_template, d_machine, d_network) is not null",
        "product_findings": f"{found} select asin, signal, {FINDING_LABEL} as label, status, detail, coalesce(array_to_string(e, ' | '), '') as evidence from pfind left join ev using (asin, signal)",
        "deep_augmentation": f"{found} select asin, concat('deep:', signal) as signal, {FINDING_LABEL} as label, status, case status when 'fail' then 0.15::double when 'warn' then 0.55::double else 1.0::double end as score, 1.2::double as weight, case when status = 'insufficient-data' then 0.0::double else 1.0::double end as confidence from pfind",
        "deep_reanalysis": f"{deep} select asin, trust as trust_score, grade, disc_ as discounted_count, conc::bigint as concerning_signals, {r6('m_')} as mean_suspicion from answer",
        "deep_answers": "with own as (select *, row_number() over (partition by asin order by observed_at desc, obs_id desc) as k, cast(substr(asin, 4) as bigint) % 6 as o from v_history), answers as (select asin, o = 0 and not (title_hash <> 't0' or abs(250 - total_ratings) > greatest(50, 0.1 * total_ratings)) as cached from own where k = 1 and o % 2 = 0) select asin, cached, case when cached then 0 else 4 end as product_findings from answers",
        "page_snapshots": f"select doc_id as page_id, asin, concat('Item ', asin) as title, displayed_rating, total_ratings, h1, h2, h3, h4, h5 from {listed}",
        "page_coverage": " union all ".join(f"select '{c}' as field, {'count(*)' if c == 'title' else f'count({c})'} as filled, count(*) as pages from {listed}" for c in fields),
        "page_reviews": f"select doc_id as page_id, asin, concat(case when doc_id % 3 = 2 then 'customer_review-R' else 'R' end, doc_id) as review_id, 'Fine' as title, rating, review_date, verified, helpful_votes, reviewer_id, concat('N ', reviewer_id) as reviewer_name, md5(trim(regexp_replace(text, '{SPACES}', ' ', 'g'))) as text_md5 from v_reviews",
        "conversation_reviews": f"select conv_id::varchar as asin, count(*) as n, {r6('avg(case when length(trim(text)) > 0 then 1.0 else 0.0 end)')} as coverage from conversations group by all",
    }
    return {name: with_views(text) for name, text in sql.items()}
