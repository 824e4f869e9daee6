"""DuckDB SQL for the queries of catalog.py, written apart from the operators."""

OP5 = r"""
with docs as (select doc_id, string_split(text, chr(10)) as l from documents),
windows as (
  select doc_id, unnest(range(1, len(l) - 1)) as i, l from docs where len(l) >= 3
), texts as (
  select doc_id, i, l[i] || chr(10) || l[i + 1] || chr(10) || l[i + 2] as w from windows
), ranked as (
  select doc_id, i, row_number() over (partition by w order by doc_id, i) as r from texts where regexp_matches(w, '[^\x20\x09-\x0D]')
), gone as (
  select distinct doc_id, i + j as i from ranked, (select unnest([0, 1, 2]) as j) where r > 1
), lined as (
  select doc_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as line from docs
), cut as (
  select lined.doc_id, count(*) as n_lines, count(gone.i) as n_removed,
    coalesce(string_agg(case when gone.i is null then line end, chr(10) order by lined.i), '') as t
  from lined left join gone on lined.doc_id = gone.doc_id and lined.i = gone.i group by 1
)
select doc_id, n_lines, n_removed, sha256(t) as text_sha256 from cut
"""

OP7 = r"""
with d as (select doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
lens as (select distinct least(len(w), 13) as n from b where len(w) > 0),
bw as (select item_id, least(len(w), 13) as n, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' '))) as phrase from b where len(w) > 0),
dw as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' '))) as phrase from d, lens where len(w) >= n),
hits as (select distinct doc_id, item_id, i, dw.n from dw join bw on dw.phrase = bw.phrase and dw.n = bw.n),
covered as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by 1),
found as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hits group by 1),
items as (select row_number() over (order by item_id, w) as k, * from (select distinct item_id, w from b where len(w) > 0)),
spread as (select doc_id, unnest(range(len(w))) as pos, unnest(w) as term from d where w is not null),
counts as (select term, count(*) as n from spread group by 1),
placed as (select k, item_id, len(w) as size, least(len(w), 13) as span, unnest(range(len(w))) as o, unnest(w) as term from items),
ranked as (select k, p.term, row_number() over (partition by k, s order by coalesce(n, 0), o) as r from (select *, unnest(range(greatest(0, o - span + 1), least(o, size - span) + 1)) as s from placed) p left join counts using (term)),
rare as (select k, term, count(*) over (partition by k) as terms from (select distinct k, term from ranked where r <= 3)),
occ as (select doc_id, k, terms, len(w) + 8 as reach, pos, term from spread join rare using (term) join items using (k)),
near as (select doc_id, count(distinct item_id) as n_near from (
  select x.doc_id, x.k from occ x join occ y on x.doc_id = y.doc_id and x.k = y.k and y.pos between x.pos and x.pos + x.reach - 1
  group by x.doc_id, x.k, x.pos, x.terms having count(distinct y.term) = x.terms) join items using (k) group by 1)
select d.doc_id, coalesce(len(w), 0)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= coalesce(len(w), 0) as contaminated,
  coalesce(n_near, 0)::bigint as n_near
from d left join covered using (doc_id) left join found using (doc_id) left join near using (doc_id)
"""

def _tree(shards: int, base: int = 40) -> str:
    """Shards of the tree as VALUES rows (region, rack, shard); all weights are 1."""
    rows = [(s // 8, s // 8 * 10_000 + s % 8 // 4, s) if s < base else (5 + s - base, (5 + s - base) * 10_000, s) for s in range(shards)]
    return ", ".join(map(str, rows))


def _drawn(label: str, weight: str = "1") -> str:
    return f"-ln((('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || '/' || {label}), 1, 13))::bigint::double + 0.5) / 4503599627370496.0) / {weight}"


def _descent(name: str, shards: int) -> str:
    return f"""{name}_tree as (select * from (values {_tree(shards)}) t(region, rack, shard)),
{name}_region as (select doc_id, arg_min(region, {_drawn("'r' || region", "n")}) as region from documents, (select region, count(*)::double as n from {name}_tree group by 1) group by 1),
{name}_rack as (select doc_id, arg_min(rack, {_drawn("'k' || rack", "n")}) as rack from {name}_region join (select region, rack, count(*)::double as n from {name}_tree group by 1, 2) using (region) group by 1),
{name}_shard as (select doc_id, arg_min(shard, {_drawn("'s' || shard")}) as shard, any_value(region) as region, any_value(rack) as rack from {name}_rack join {name}_tree using (rack) group by 1)"""


#: crc32 byte by byte, with the reflected polynomial. Slots follow doc_id while a shard is one
#: slot group, up to 40 * SLOT_GROUP documents.
OP1 = f"""
with {_descent("now", 40)}, {_descent("grown", 41)},
steps as (select list(c order by i) as table_ from (
  select i, list_reduce(list_prepend(i::ubigint, list_transform(range(8), lambda k: 0::ubigint)), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384::ubigint) else a >> 1 end) as c from range(256) t(i))),
bytes as (select doc_id, strlen(coalesce(text, '')) as n, list_transform(range(strlen(coalesce(text, ''))), lambda k: ('0x' || substr(hex(encode(coalesce(text, ''))), 2 * k + 1, 2))::ubigint) as b from documents),
crc as (select doc_id, n, xor(list_reduce(list_prepend(4294967295::ubigint, b), lambda a, x: xor(a >> 8, table_[(xor(a & 255, x) + 1)::bigint])), 4294967295::ubigint) as c from bytes, steps)
select doc_id, (n + 16)::bigint as size, c::bigint as text_crc32, 'key' as law, now_shard.shard, row_number() over (partition by now_shard.shard order by doc_id) - 1 as slot, grown_shard.shard as grown_shard, now_shard.region, now_shard.rack % 10000 as rack
from crc join now_shard using (doc_id) join grown_shard using (doc_id)
"""

OP10 = r"""
with docs as (select doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w, string_split(coalesce(text, ''), chr(10)) as l from documents),
five as (select doc_id, unnest(range(1, len(w) - 3)) as i, unnest(list_transform(range(1, len(w) - 3), lambda k: array_to_string(list_slice(w, k, k + 4), ' '))) as p from docs where len(w) >= 5),
twice as (select doc_id, i from five qualify count(*) over (partition by doc_id, p) > 1),
repeats as (select doc_id, count(distinct j) as n from (select doc_id, unnest(range(i, i + 5)) as j from twice) group by 1),
lined as (select doc_id, unnest(range(len(l))) as i, unnest(l) as line from docs),
judged as (
  select doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) as n,
    regexp_matches(line, '[.!?:;,…。！？][\[\]"''”»)]*[\x20\x09-\x0D]*$') as ended,
    len(regexp_extract_all(line, '[#*$%&<>]{2,}|[!?]{2,}')) as marks,
    regexp_matches(lower(line), '(\|[^|]*){3,}|(»[^»]*){2,}|( > [^>]*){2,}|^(home|menu|login|log in|sign up|next|previous|back to top|contact us|about us|startseite|anmelden|impressum|weiter|accueil|connexion|suivant|inicio|iniciar sesión|siguiente)\W*$') as nav,
    regexp_matches(lower(line), 'all rights reserved|privacy policy|terms of (use|service)|cookie|enable javascript|lorem ipsum|subscribe to our|click here|©|alle rechte vorbehalten|datenschutzerklärung|tous droits réservés|politique de confidentialité|todos los derechos reservados|política de privacidad') as boiler
  from lined
), good as (select *, n > 0 and (ended or n >= 12) and marks < 0.4 * n and not nav and not boiler as ok from judged),
lines as (
  select doc_id, count(*) as n_lines, count(*) filter (ok) as n_good_lines, count(*) filter (n > 0) - count(distinct line) filter (n > 0) as n_dup_lines,
    coalesce(string_agg(line, chr(10) order by i) filter (ok), '') as clean
  from good group by 1
), counted as (
  select doc_id, len(w)::bigint as n_words, (length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')))::bigint as word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::bigint as n_symbols, n_dup_lines, coalesce(repeats.n, 0) as n_repeat_words, n_lines, n_good_lines, clean
  from docs join lines using (doc_id) left join repeats using (doc_id)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and length(clean) - len(regexp_extract_all(clean, '[\x20\x09-\x0D]')) >= 0.5 * word_chars as kept,
  n_lines, n_good_lines, sha256(clean) as clean_sha256
from counted
"""

OP4 = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
win as (select doc_id, unnest(range(1, len(w) - 33)) as i, unnest(list_transform(range(1, len(w) - 33), lambda k: sha256(array_to_string(list_slice(w, k, k + 34), ' ')))) as p from d where len(w) >= 35),
again as (select doc_id, i from win qualify count(*) over (partition by p) > 1),
gone as (select distinct doc_id, unnest(range(i, i + 35)) as i from again),
each as (select doc_id, unnest(range(1, len(w) + 1)) as i, unnest(w) as x from d),
cut as (select each.doc_id, count(gone.i) as n_removed, string_agg(case when gone.i is null then x end, ' ' order by each.i) as kept from each left join gone on each.doc_id = gone.doc_id and each.i = gone.i group by 1)
select d.doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join cut using (doc_id)
"""

OP3 = r"""
with recursive d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (select doc_id, list_distinct(case when len(w) = 0 then []::varchar[] when len(w) = 1 then w else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) as s from d),
one as (select doc_id, len(s) as n, unnest(s) as x from sets),
shared as (select a.doc_id as u, b.doc_id as v, count(*) as k, any_value(a.n) as na, any_value(b.n) as nb from one a join one b on a.x = b.x and a.doc_id < b.doc_id where 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) group by 1, 2),
links as (select u, v from shared where 100 * k >= 80 * (na + nb - k) union all select v, u from shared where 100 * k >= 80 * (na + nb - k)),
reach as (select doc_id as u, doc_id as v from d union select reach.u, links.v from reach join links on reach.v = links.u),
least_ as (select u as doc_id, min(v) as component_id from reach group by 1)
select doc_id, len(s)::bigint as n_shingles, component_id, doc_id = component_id as kept from sets join least_ using (doc_id)
"""

OP11 = r"""
with p as (select page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path from pages),
rules as (select * from (values ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')) t(rh, rp, v)),
named as (select *, list_has_any(string_split_regex(host, '[.-]'), ['ads', 'adult', 'bets', 'casino', 'pills', 'porn', 'spam']) as listed from p)
select page_id, host, path, best.rule as rule, coalesce(best.v, case when listed then 'block' else 'allow' end) as verdict, listed
from (select *, (select max_by({'rule': rh || rp, 'v': v}, length(rh || rp)) from rules where (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp)) as best from named)
"""

SQL = {"op11_url_filter": OP11, "op3_near_dedup": OP3, "op4_repeated_phrases": OP4, "op1_sharding": OP1, "op10_quality_rules": OP10, "op5_line_dedup": OP5, "op7_decontamination": OP7}
