"""SQL for the registered queries, where SQL can express them, over the same tables."""

from __future__ import annotations

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES: dict[str, str] = {
    "op1_decontaminate": rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '{_WORD}') as w from documents),
items as (select item_id, regexp_extract_all({_LOWER}, '{_WORD}') as w from benchmark),
wins as (select distinct item_id, array_to_string(list_slice(w, s, s + least(13, len(w)) - 1), ' ') as g, least(13, len(w)) as n
    from (select item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) as s from items where len(w) > 0)),
sizes as (select distinct n from wins),
places as (select doc_id, s, n, array_to_string(list_slice(w, s, s + n - 1), ' ') as g
    from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as s from d, sizes where len(w) >= n)),
found as (select p.doc_id, p.s, p.n, i.item_id from places p join wins i on p.g = i.g and p.n = i.n),
hit as (select doc_id, count(distinct x) as n_hit from (select doc_id, unnest(range(s, s + n)) as x from found) group by doc_id),
its as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as l from found group by doc_id)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
    sha256(coalesce(l, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join its using (doc_id)""",
    "op2_substring_dedup": r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
wins as (select doc_id, s, md5(array_to_string(list_slice(w, s, s + 49), ' ')) as g
    from (select doc_id, w, unnest(range(1, len(w) - 48)) as s from d where len(w) >= 50)),
firsts as (select g, min(doc_id) as f from wins group by g),
gone as (select distinct doc_id, unnest(range(s, s + 50)) as p from wins join firsts using (g) where doc_id > f),
each as (select doc_id, w, unnest(range(1, len(w) + 1)) as p from d),
kept as (select doc_id, string_agg(w[p], ' ' order by p) as t, count(*) as n from each anti join gone using (doc_id, p) group by doc_id)
select doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from d left join kept using (doc_id)""",
    "op3_near_dedup": rf"""
with recursive t as (select min(doc_id) as id, text from documents where text is not null group by text),
w as (select id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') as w from t),
sh as (select id, g, count(*)::double as tf from (
    select id, array_to_string(list_slice(w, s, s + 4), ' ') as g from (select id, w, unnest(range(1, len(w) - 3)) as s from w where len(w) >= 5)
    union all select id, array_to_string(w, ' ') from w where len(w) between 1 and 4) group by id, g),
df as (select g, least(1, ln(1 + (select count(*) from t)::double / count(*)) / ln(1001)) ^ (1.0::double / 3) as idf from sh group by g),
v as (select id, g, tf * idf as x from sh join df using (g)),
total as (select id, sum(x) as x from v group by id),
pairs as (select a.id as u, b.id as v, sum(least(a.x, b.x)) as m from v a join v b on a.g = b.g and a.id < b.id group by all),
links as (select u, v from pairs join total a on a.id = u join total b on b.id = v where m / (a.x + b.x - m) >= 0.8),
edges as (select u, v from links union select v, u from links),
reach as (select id, id as r from t union select reach.id, edges.v from reach join edges on reach.r = edges.u),
label as (select id, min(r) as l from reach group by id)
select d.doc_id, l as class_id, l = d.doc_id as kept from documents d join t on t.text = d.text join label on label.id = t.id""",
    "op10_suffix_dedup": r"""
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h, strlen(coalesce(text, '')) as n from documents),
w as (select doc_id, i, md5(substr(h, (2 * i + 1)::bigint, 200)) as g from (select doc_id, h, unnest(range(0, n - 99)) as i from d where n >= 100)),
later as (select doc_id, i from w qualify row_number() over (partition by g order by doc_id, i) > 1),
marked as (select doc_id, i, case when i <= lag(i) over (partition by doc_id order by i) + 100 then 0 else 1 end as new from later),
runs as (select doc_id, min(i) as a, max(i) + 100 as b from (select doc_id, i, sum(new) over (partition by doc_id order by i) as k from marked) group by doc_id, k),
gaps as (select doc_id, b as a, lead(a) over (partition by doc_id order by a) as b from runs union all select doc_id, 0, min(a) from runs group by doc_id),
kept as (select doc_id, string_agg(substr(h, (2 * gaps.a + 1)::bigint, (2 * (coalesce(b, n) - gaps.a))::bigint), '' order by gaps.a) as h from gaps join d using (doc_id) group by doc_id),
sums as (select doc_id, count(*) as n_spans, sum(b - a) as n_removed from runs group by doc_id)
select d.doc_id, n::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans, sha256(unhex(coalesce(kept.h, d.h))) as kept_sha256
from d left join sums using (doc_id) left join kept using (doc_id)""",
    "op8_quality": r"""
with recursive d as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
tri as (select doc_id, i, w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from d where len(w) >= 3)),
rep as (select doc_id, i from tri qualify count(*) over (partition by doc_id, g) > 1),
cov as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from rep) group by doc_id),
f as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as l, coalesce(cov.n, 0)::bigint as n_repeat_words, len(list_distinct(w)) as n_distinct,
    length(regexp_replace(t, '[^\p{L}]+', '', 'g')) as n_letters, length(regexp_replace(t, '[^\p{Lu}]+', '', 'g')) as n_upper, length(t) - length(regexp_replace(t, '[.!?]', '', 'g')) as n_stops
    from d left join cov using (doc_id)),
x as (select *, (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f),
v as (select *, case when n_words = 0 then [0, 0, 0, 0, 0, 0, 0, 0] else [
    case when word_chars / n_words < 2 or word_chars / n_words > 14 then -1 else 0 end, case when n_symbols / n_words > 0.2 then -1 else 0 end,
    case when len(l) > 0 and n_dup_lines / len(l) > 0.3 then -1 else 0 end, case when n_repeat_words / n_words > 0.3 then -1 else 0 end,
    case when n_words >= 50 and n_distinct / n_words < 0.15 then -1 else 0 end, case when n_letters / word_chars < 0.7 then -1 else 0 end,
    case when n_letters > 0 and n_upper / n_letters > 0.5 then -1 else 0 end,
    case when n_words >= 100 and n_stops / n_words < 0.002 then -1 when n_stops / n_words between 0.02 and 0.4 then 1 else 0 end] end as votes from x),
p as (select list({'v': votes, 'n': n}) as ps from (select votes, count(*)::double as n from v where not base_failed group by votes)),
em as (
    select 0 as round, 0.8::double as prior, list_transform(range(8), lambda j: [ln(0.004 / 0.3), ln(0.896 / 0.64), ln(0.1 / 0.06)]) as ratios
    union all
    select round + 1,
        greatest(0.01, least(0.99, (10 * 0.8 + list_sum(list_transform(e, lambda r: r.n * r.q))) / (10 + list_sum(list_transform(e, lambda r: r.n))))),
        list_transform(range(1, 9), lambda j: [
            least(0, ln((0.04 + list_sum(list_transform(e, lambda r: case when r.v[j] = -1 then r.n * r.q else 0 end))) / (10 + list_sum(list_transform(e, lambda r: r.n * r.q))))
                - ln((3.0 + list_sum(list_transform(e, lambda r: case when r.v[j] = -1 then r.n * (1 - r.q) else 0 end))) / (10 + list_sum(list_transform(e, lambda r: r.n * (1 - r.q)))))),
            ln((8.96 + list_sum(list_transform(e, lambda r: case when r.v[j] = 0 then r.n * r.q else 0 end))) / (10 + list_sum(list_transform(e, lambda r: r.n * r.q))))
                - ln((6.4 + list_sum(list_transform(e, lambda r: case when r.v[j] = 0 then r.n * (1 - r.q) else 0 end))) / (10 + list_sum(list_transform(e, lambda r: r.n * (1 - r.q))))),
            greatest(0, ln((1.0 + list_sum(list_transform(e, lambda r: case when r.v[j] = 1 then r.n * r.q else 0 end))) / (10 + list_sum(list_transform(e, lambda r: r.n * r.q))))
                - ln((0.6 + list_sum(list_transform(e, lambda r: case when r.v[j] = 1 then r.n * (1 - r.q) else 0 end))) / (10 + list_sum(list_transform(e, lambda r: r.n * (1 - r.q))))))])
    from (select round, list_transform(ps, lambda r: {'v': r.v, 'n': r.n, 'q': 1 / (1 + exp(-(ln(prior / (1 - prior)) + list_sum(list_transform(range(1, 9), lambda j: ratios[j][r.v[j] + 2])))))}) as e from em, p where round < 25)),
m as (select prior, ratios from em where round = 25)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    not base_failed and coalesce(ln(prior / (1 - prior)) + list_sum(list_transform(range(1, 9), lambda j: ratios[j][votes[j] + 2])) >= 0, true) as kept
from v left join m on true""",
}
