"""SQL for DuckDB of the corpus queries that SQL can express, written from their contracts."""

from __future__ import annotations

from plumbline.llm import licenses

SPACED = r"[^\x20\x09-\x0D]+"
ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Documents linked by their sets: from ``s`` (id, g: distinct members) to ``component`` (id, component).  Candidates
#: share one of each other's rarest fifth of members, which any two similar sets do.
SIMILAR = """
df as (select x, count(*) as c from (select unnest(g) as x from s) group by x),
ranked as (select id, n, x, row_number() over (partition by id order by c, x) as r from (select id, len(g) as n, unnest(g) as x from s) join df using (x)),
prefix as (select id, n, x from ranked where r <= n - ceil(0.8 * n) + 1),
candidates as (select distinct a.id as a, b.id as b from prefix a join prefix b on a.x = b.x and a.id < b.id where least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80),
shared as (select a, b, len(list_intersect(x.g, y.g)) as i, len(x.g) + len(y.g) as n from candidates join s x on x.id = a join s y on y.id = b),
links as (select a, b from shared where 100 * i >= 80 * (n - i)),
both_ways as (select a, b from links union all select b, a from links),
reached(id, lead) as (select id, id from s union select e.b, r.lead from reached r join both_ways e on e.a = r.id where r.lead < e.b),
component as (select id, min(lead) as component from reached group by id)"""

OP3 = f"""with recursive lines as (select doc_id, unnest(range(1, len(l) + 1)) as pos, unnest(l) as line from (select doc_id, string_split(text, chr(10)) as l from documents)),
worded as (select * from lines where regexp_matches(line, '{SPACED}')),
numbered as (select line, row_number() over (order by line) as id from (select distinct line from worded)),
s as (select id, list_distinct(list_transform(range(1, greatest(length(line) - 3, 2)), lambda i: substring(line, i, 5))) as g from numbered),
{SIMILAR},
placed as (select doc_id, pos, row_number() over (partition by component order by doc_id, pos) as k from worded join numbered using (line) join component using (id)),
kept as (select doc_id, string_agg(line, chr(10) order by pos) as text from lines left join placed using (doc_id, pos) where coalesce(k, 1) = 1 group by doc_id),
counts as (select doc_id, count(*) as n_lines, count(*) filter (where k > 1) as n_removed from placed group by doc_id)
select doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256
from documents left join counts using (doc_id) left join kept using (doc_id)"""

OP4 = """with h as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
starts as (select doc_id, p, substr(h, p + p - 1, 100) as w from (select doc_id, h, unnest(range(1, greatest(length(h) // 2 - 48, 1))) as p from h)),
hits as (select doc_id, p from (select doc_id, p, min(doc_id) over (partition by w) as least from starts) where doc_id > least),
edges as (select doc_id, p, coalesce(p > lag(p) over w + 50, true) as opens from hits window w as (partition by doc_id order by p)),
spans as (select doc_id, min(p) as a, max(p) + 50 as b from (select doc_id, p, sum(opens::int) over (partition by doc_id order by p) as k from edges) group by doc_id, k),
gaps as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 1) as from_ from spans),
kept as (select doc_id, string_agg(substr(h, from_ + from_ - 1, 2 * (a - from_)), '' order by a) as k, max(b) as last, sum(b - a) as removed, count(*) as n from gaps join h using (doc_id) group by doc_id)
select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(removed, 0)::bigint as n_removed, coalesce(n, 0)::bigint as n_spans, sha256(unhex(case when n is null then h else concat(k, substr(h, last + last - 1)) end)) as kept_sha256
from h left join kept using (doc_id)"""

OP6 = f"""with items as (select item_id::varchar as item_id, w, least(13, len(w)) as size from (select item_id, regexp_extract_all({LOWER.format('text')}, '{ALNUM}') as w from benchmark where item_id is not null) where len(w) > 0),
windows as (select distinct item_id, size, array_to_string(w[p:p + size - 1], ' ') as k from (select item_id, w, size, unnest(range(1, len(w) - size + 2)) as p from items)),
docs as (select doc_id, coalesce(regexp_extract_all({LOWER.format('text')}, '{ALNUM}'), []) as w from documents),
sizes as (select distinct size from windows),
starts as (select doc_id, size, p, array_to_string(w[p:p + size - 1], ' ') as k from (select doc_id, w, size, unnest(range(1, greatest(len(w) - size + 2, 1))) as p from docs, sizes)),
hits as (select doc_id, size, p, item_id from starts join windows using (size, k)),
words as (select doc_id, count(distinct i) as n_hit from (select doc_id, unnest(range(p, p + size)) as i from hits) group by doc_id),
found as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id, ',' order by item_id) as ids from hits group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit > 0 and 20 * n_hit >= len(w), false) as contaminated
from docs left join words using (doc_id) left join found using (doc_id)"""

OP7 = f"""with recursive w as (select doc_id, coalesce(regexp_extract_all({LOWER.format('text')}, '{SPACED}'), []) as w from documents),
every as (select doc_id as id, case when len(w) = 0 then []::varchar[] when len(w) < 4 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as g from w),
s as (select * from every where len(g) > 0),
{SIMILAR}
select every.id as doc_id, len(every.g) as n_shingles, coalesce(component, every.id) as component_id, coalesce(component, every.id) = every.id as kept from every left join component using (id)"""

OP8 = f"""with w as (select doc_id, coalesce(regexp_extract_all(text, '{SPACED}'), []) as w from documents),
starts as (select doc_id, p, array_to_string(w[p:p + 19], ' ') as k from (select doc_id, w, unnest(range(1, greatest(len(w) - 18, 1))) as p from w)),
hits as (select doc_id, p from (select doc_id, p, row_number() over (partition by k order by doc_id, p) as n from starts) where n > 1),
gone as (select distinct doc_id, unnest(range(p, p + 20)) as i from hits),
words as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as x from w),
kept as (select doc_id, string_agg(x, ' ' order by i) as k from words anti join gone using (doc_id, i) group by doc_id),
counts as (select doc_id, count(*) as n from gone group by doc_id)
select doc_id, len(w) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(k, '')) as kept_sha256 from w left join kept using (doc_id) left join counts using (doc_id)"""



def _licenses() -> str:
    entries, idf, rarest = licenses.vectors()
    quoted = lambda x: f"'{x}'" if isinstance(x, str) else repr(x)
    values = lambda rows: ", ".join(f"({', '.join(map(quoted, r))})" for r in rows)
    cue = f"regexp_matches(unit, '{licenses.CUE}')"
    return f"""with files as (select doc_id, text, concat_ws('/', source, lang, doc_id::varchar) as path from documents),
paths as (select doc_id, text, path, regexp_replace(path, '/[^/]*$', '') as dir from files),
split as (select doc_id, 0 as kind, string_split(text, chr(10)) as u from paths union all select doc_id, 1, string_split_regex(text, '{licenses.PARAGRAPH}') from paths),
units as (select doc_id, kind, pos, unit from (select doc_id, kind, unnest(range(len(u))) as pos, unnest(u) as unit from split) where {cue} and (kind = 0 or contains(unit, chr(10))) union all select doc_id, 2, 0, text as unit from paths where {cue}),
tf as (select doc_id, kind, pos, term, count(*) as tf from (select doc_id, kind, pos, unnest(regexp_extract_all(lower(unit), '{licenses.TOKEN}')) as term from units) group by all),
terms(term, idf) as (values {values(sorted(idf.items()))}),
templates(template, license, term, weight) as (values {values(entries)}),
weighed as (select tf.*, idf, tf * coalesce(idf, {rarest!r}) as w from tf left join terms using (term)),
norms as (select doc_id, kind, pos, sqrt(sum(w * w)) as norm from weighed group by all),
dots as (select doc_id, kind, pos, template, license, sum(w * weight) as dot from weighed join templates using (term) group by all),
scored as (select doc_id, kind, license, round(dot / norm, 6) as cosine from dots join norms using (doc_id, kind, pos) where round(dot / norm, 6) >= {licenses.THRESHOLD}),
best as (select * from (select doc_id, license, cosine, bool_or(kind = 2) over (partition by doc_id) as whole, row_number() over (partition by doc_id order by cosine desc, license) as k from scored) where k = 1),
own as (select p.doc_id, path, dir, license, cosine, whole from paths p left join best using (doc_id)),
licensed as (select * from (select dir, license as l, cosine as c, row_number() over (partition by dir order by cosine desc, license, path) as k from own where license is not null and dir is not null and (whole or regexp_matches(path, '{licenses.NAMES}'))) where k = 1),
up as (select dir, unnest(range(len(string_split(dir, '/')) + 1)) as depth from (select distinct dir from own where dir is not null)),
near as (select * from (select up.dir, l, c, row_number() over (partition by up.dir order by depth desc) as k from up join licensed on licensed.dir = array_to_string(string_split(up.dir, '/')[1:depth], '/')) where k = 1)
select doc_id, path, coalesce(license, l) as license, case when license is not null then cosine else c end as cosine, case when license is not null then 'header' when l is not null then 'directory' else 'none' end as origin from own left join near on near.dir = own.dir"""


ORACLES = {"op3_line_dedup": OP3, "op4_suffix_array": OP4, "op6_decontamination": OP6, "op7_near_dedup": OP7, "op8_substring_dedup": OP8, "op9_license_scan": _licenses()}
