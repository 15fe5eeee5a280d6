"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from codeloom.llm import quality_rules as Q

OP1 = r"""
with dw as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from documents),
iw as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from benchmark),
ds as (select distinct doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) as s from dw),
sh as (select distinct item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) as s from iw),
n as (select item_id, count(*) as n_shingles from sh group by 1),
p as (select doc_id, item_id, count(*) as n_shared from ds join sh using (s) group by 1, 2)
select doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles::DOUBLE as containment from p join n using (item_id) where n_shared >= ceil(0.8::DOUBLE * n_shingles - 1e-9::DOUBLE)
"""

_SCORES = ", ".join(f"({k}, '{name}', ({rule.replace(' / ', '::DOUBLE / ')}))" for k, (name, rule) in enumerate(Q.RULES.items()))
OP3 = rf"""
with b as (select doc_id, lang, coalesce(text, '') as t from documents),
w as (select doc_id, lang, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l from b),
win as (select doc_id, unnest(range(1, len(w) - 6)) as i, unnest(list_transform(range(1, len(w) - 6), lambda i: array_to_string(w[i : i + 7], ' '))) as s from w where len(w) > 8),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, s) as n from win) where n > 1),
rep as (select doc_id, sum(least(8, coalesce(nxt - i, 8)))::BIGINT as r from (select *, lead(i) over (partition by doc_id order by i) as nxt from twice) group by 1),
f as (select doc_id, lang, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, len(l) as n_lines,
  len(l) - len(list_distinct(l)) as n_dup_lines, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) as n_capitals, length(t) - length(regexp_replace(t, '!', '', 'g')) as n_shouts, coalesce(r, 0) as n_repeat_words
  from w left join rep using (doc_id)),
g as (select *, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed from f),
sc as (select doc_id, lang as stratum, base_failed, ord, rule, least(ceil(score * {Q.GRID}), {Q.GRID}) as step, ceil(score * {Q.GRID}) as raw from g, lateral (values {_SCORES}) v(ord, rule, score)),
h as (select stratum, rule, step from sc join labels using (doc_id) where quality = 1 and not base_failed),
hist as (select stratum, rule, step, count(*) as docs from h group by 1, 2, 3),
n as (select stratum, rule, sum(docs)::DOUBLE as n from hist group by 1, 2),
tests as (select greatest((select count(*) from (select distinct stratum from n)), 1) * {len(Q.RULES) * Q.GRID} as tests from n),
x as (select n.stratum, n.rule, n.n, k, coalesce((select sum(docs) from hist where hist.stratum is not distinct from n.stratum and hist.rule = n.rule and step > k), 0)::BIGINT as x from n, range({Q.GRID}) r(k)),
p as (select x.*, (select sum(exp(lgamma(x.n + 1) - lgamma(i + 1) - lgamma(x.n - i + 1) + i * ln({Q.TOTAL_RATE / len(Q.RULES)}::DOUBLE) + (x.n - i) * ln(1 - {Q.TOTAL_RATE / len(Q.RULES)}::DOUBLE))) from range(0, x.x + 1) s(i)) as p
  from x where x.x <= x.n * {Q.TOTAL_RATE / len(Q.RULES)}::DOUBLE),
cut as (select stratum, rule, min(k) as k from p, tests where p <= {Q.DELTA}::DOUBLE / tests group by 1, 2),
br as (select doc_id, string_agg(sc.rule, ',' order by ord) as broken from sc join cut on sc.stratum is not distinct from cut.stratum and sc.rule = cut.rule where raw > k group by 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines::BIGINT as n_dup_lines, n_repeat_words, base_failed, not base_failed and broken is null as kept, coalesce(broken, '') as broken from g left join br using (doc_id)
"""

OP5 = r"""
with n as (select source, count(*) as n from documents group by 1), a as (select sum(n)::DOUBLE as total, count(*)::DOUBLE as sources from n),
r as (select source, 1.0::DOUBLE / sources * total / n as rate from n, a),
k as (select source, rate, unnest(range(0, ceil(rate + 12 * sqrt(rate) + 30)::INT + 1)) as k from r),
c as (select source, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) over (partition by source order by k rows unbounded preceding) as cdf from k),
d as (select *, ('0x' || md5('20240601:' || coalesce(doc_id::VARCHAR, 'null'))[1:13])::BIGINT / 4503599627370496.0::DOUBLE as u from documents),
t as (select d.*, (select count(*) from c where c.source is not distinct from d.source and c.cdf <= d.u) as times from d),
e as (select doc_id, text, lang, source, n_chars, unnest(range(1, times + 1))::INT as copy from t)
select *, md5('20240601:' || coalesce(doc_id::VARCHAR, 'null') || ':' || copy) as mix_key from e
"""

OP11 = r"""
with d as (select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t from documents),
w as (select *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from d),
l as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels where doc_id is not null group by 1),
f as (select part, good, toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t), regexp_matches(t, '[#$%&*|]'),
  coalesce(doc_id > min(doc_id) over (partition by t), false)] as fails from w left join l using (doc_id)),
c as (select part, fails, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f group by 1, 2),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select part, filter_order, unnest(range(1, 6))::INT as step, n, good, toxic, list_transform(string_split(filter_order, ''), lambda z: fails[ascii(z) - 64]) as seen from c, o),
r as (select part, filter_order, step, sum(case when list_bool_or(seen[:step]) then 0 else n end)::BIGINT as kept, sum(case when seen[step] and not coalesce(list_bool_or(seen[: step - 1]), false) then n else 0 end)::BIGINT as removed,
  sum(case when seen[step] and coalesce(list_bool_or(seen[: step - 1]), false) then n else 0 end)::BIGINT as redundant, sum(case when seen[step] and len(list_filter(seen, lambda z: z)) = 1 then n else 0 end)::BIGINT as unique_fails,
  sum(case when seen[step] and not coalesce(list_bool_or(seen[: step - 1]), false) then good else 0 end)::BIGINT as good_lost, sum(case when seen[step] and not coalesce(list_bool_or(seen[: step - 1]), false) then toxic else 0 end)::BIGINT as toxic_lost
  from s group by 1, 2, 3)
select *, sum(removed) over (partition by part, filter_order[step])::BIGINT as shapley from r
"""

# CRC-32 bytewise, with its table of 256 entries made from the polynomial; the buckets are worked out once for each distinct word.
OP13 = r"""
with z as (select list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, n: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) order by i) as z from range(256) r(i)),
dw as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents),
bw as (select list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from benchmark),
du as (select doc_id, unnest(w) as w from dw), bu as (select unnest(w) as w from bw),
v as (select w, hex(encode(w)) as h from (select w from du union select w from bu)),
k as (select w, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, z[1 + (xor(c, b) & 255)])), 4294967295) % 10000 as bucket from v, z),
s as (select bucket, count(*) as s from du join k using (w) group by 1), t as (select bucket, count(*) as t from bu join k using (w) group by 1),
n as (select (select coalesce(sum(s), 0) from s)::DOUBLE as s_all, (select coalesce(sum(t), 0) from t)::DOUBLE as t_all),
g as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT as gain from s left join t using (bucket), n),
f as (select doc_id, count(*) as n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT as weight from du join k using (w) join g using (bucket) group by 1),
a as (select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight, ('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT as h from documents left join f using (doc_id)),
b as (select doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT as score from a),
r as (select *, case when n_features >= 20 then row_number() over (partition by n_features >= 20 order by score desc, doc_id) end as place from b)
select doc_id, n_features, weight, score, case when place <= 10 * (select count(*) from b where n_features >= 20) // 100 then place end as rank from r
"""

SQL = {"op1_decontamination": OP1, "op3_quality_rules": OP3, "op5_mixing": OP5, "op11_filter_audit": OP11, "op13_importance": OP13}
