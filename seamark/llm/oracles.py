"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

OP3 = r"""
with recursive d as (
  select doc_id, regexp_extract_all(lower_ascii, '[^\x20\x09-\x0D]+') w from (
    select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') lower_ascii from documents)),
s as (
  select doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
    else list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) end) g from d),
n as (select doc_id, count(*) n from s group by 1),
-- of sets that are equal, the one with the smallest id stands for all
k as (select doc_id, md5(string_agg(g, chr(10) order by g)) h from s group by 1),
r as (select h, min(doc_id) rep from k group by 1),
t as (select s.doc_id, g from s join r on s.doc_id = r.rep),
p as (select a.doc_id a, b.doc_id b, count(*) i from t a join t b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * i >= 80 * (x.n + y.n - i)),
both_ways as (select a, b from e union all select b, a from e),
reach(v, o) as (select rep, rep from r union select b, o from reach join both_ways on a = v),
c as (select v, min(o) c from reach group by 1)
select d.doc_id, coalesce(n.n, 0)::bigint n_shingles, coalesce(c.c, d.doc_id) component_id, d.doc_id = coalesce(c.c, d.doc_id) kept
from d left join n using (doc_id) left join k using (doc_id) left join r on r.h = k.h left join c on c.v = r.rep
"""

OP9 = r"""
with t as (
  select conv_id, turn, role, coalesce(text, '') x from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
f as (select *, case role when 'user' then 'User' when 'assistant' then 'Assistant' when 'system' then 'System' else '=' || hex(encode(role)) end h,
  regexp_replace(x, '(\\*(?:###|</turn>))', '\\\1', 'g') b from t)
select conv_id, count(*) n_turns,
  sha256(string_agg(role || chr(10) || x || chr(10), '' order by turn, role, x)) turns_sha256,
  coalesce(sum(length(x)) filter (where role = 'assistant'), 0)::bigint loss_chars,
  sha256(coalesce(string_agg(x, '' order by turn, role, x) filter (where role = 'assistant'), '')) loss_sha256,
  sum(length('### ' || h || ': ' || b || chr(10) || '</turn>' || chr(10)))::bigint formatted_chars
from f group by conv_id
"""

OP10 = r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size from documents),
s as (select source, sum(size)::bigint source_size from d group by 1),
w as (select *, [5, 2, 1][((row_number() over (order by source is null, encode(source)) - 1) % 3 + 1)::int]::double weight, source_size * 2.0::double cap from s),
h as (select *,
  coalesce(sum(cap) over (order by cap / weight, source is null, encode(source) rows between unbounded preceding and 1 preceding), 0) held,
  sum(weight) over (order by cap / weight, source is null, encode(source) rows between current row and unbounded following) free,
  (sum(source_size) over ())::double * 1.5::double all_words from w),
l as (select *, (all_words - held) / free lev from h),
g as (select min({r: cap / weight, lev: lev}) filter (where cap > lev * weight) g from l),
t as (select source, source_size, round(coalesce(least(cap, g.g.lev * weight), cap), 6) target from l, g),
r as (select d.*, row_number() over (partition by source order by size, doc_id) k from d),
j as (select r.doc_id, r.source, size, source_size, target, k, case when source_size > 0 then target / source_size else 0.0 end rate,
  (('0x' || substr(sha256('42:' || coalesce('s' || r.source, 'n')), 1, 8))::bigint)::double / 4294967296.0::double u
  from r join t on r.source is not distinct from t.source)
select doc_id, source, size, source_size, target,
  (floor(u + k * rate) - floor(u + (k - 1) * rate))::int copies,
  ((floor(u + k * rate) - floor(u + (k - 1) * rate)) * size)::bigint taken
from j
"""

OP11 = r"""
with d as (select row_number() over () r, coalesce(lang, '') lang, coalesce(source, '') as source,
  unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) term from documents),
kept as (select lang, term from d group by 1, 2 having count(distinct r) >= 3),
c as (select lang, source, term, count(*)::hugeint n from d semi join kept using (lang, term) group by all),
v as (select lang, count(*)::hugeint v from kept group by 1),
g as (select distinct coalesce(lang, '') lang, coalesce(source, '') as source from documents),
gn as (select g.lang, g.source, coalesce(sum(n), 0)::hugeint total, coalesce(max(v), 0)::hugeint v from g left join c using (lang, source) left join v on v.lang = g.lang group by 1, 2),
s as (select gn.lang, gn.source, kept.term, coalesce(c.n, 0)::hugeint n, 1 + (1000000000 * (coalesce(c.n, 0)::hugeint + 1)) // (total + v) p
  from gn join kept on kept.lang = gn.lang left join c on c.lang = gn.lang and c.source = gn.source and c.term = kept.term),
l as (select lang, term, 1 + (1000000000 * (sum(n) + 1)) // (any_value(t.total) + any_value(v.v)) q from c join (select lang, sum(n) total from c group by 1) t using (lang) join v using (lang) group by lang, term),
pair as (select a.lang, a.source, b.source item, coalesce(sum(((x.p - y.p) * (x.p - y.p)) // y.p), 0)::bigint as value
  from gn a join gn b on a.lang = b.lang and a.source <> b.source left join s x on x.lang = a.lang and x.source = a.source left join s y on y.lang = b.lang and y.source = b.source and y.term = x.term
  group by 1, 2, 3),
term as (select s.lang, s.source, s.term item, (((p - q) * (p - q)) // q)::bigint as value from s join l using (lang, term) where n > 0 and p > q)
select lang, source, 'pair' part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from pair
union all select * from (select lang, source, 'term' part, item, value, (row_number() over (partition by lang, source order by value desc, item))::int as rank from term) where rank <= 200
"""

OP12 = r"""
with r as (select vec_id, (case when vec_id % 7 = 0 then (label + 1) % 10 else label end)::bigint l, list_transform(embedding, lambda x: floor(256 * x::double)) v from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id anchor_id, b.vec_id other, a.l = b.l alike, list_inner_product(a.v, b.v)::bigint score from r a join r b on a.vec_id <> b.vec_id and len(a.v) = len(b.v) where a.vec_id % 50 = 0),
p as (select anchor_id, other positive_id, score positive_score from s where alike qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other)::int as rank, other negative_id, positive_score, score negative_score
from p join s using (anchor_id) where not alike and 50 * positive_score <= 100 * score and 100 * score <= 95 * positive_score
qualify rank <= 3
"""

ORACLES = {"op3_near_dup": OP3, "op9_chat": OP9, "op10_mix": OP10, "op11_source_audit": OP11, "op12_hard_negatives": OP12}
