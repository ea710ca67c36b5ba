"""DuckDB SQL of the divergence query."""

OP13 = r"""
with d as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as w
  from documents),
o as (select row, lang, source, unnest(w) as term from d),
k as (select lang, term, count(*) as n from o group by lang, term having count(distinct row) >= 30),
v as (select lang, count(*)::hugeint as v, sum(n)::hugeint as n from k group by lang),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from o semi join k using (lang, term) group by all),
t as (select lang, source, sum(n)::hugeint as n from c group by all),
p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as n,
         1 + 1000000000::hugeint * (coalesce(c.n, 0) + 5) // (coalesce(t.n, 0) + 5 * v.v) as p,
         1 + 1000000000::hugeint * (k.n + 5) // (v.n + 5 * v.v) as q
  from g join k using (lang) join v using (lang) left join t using (lang, source) left join c using (lang, source, term)),
pairs as (
  select a.lang, a.source, b.source as item, coalesce(f, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source
  left join (
    select x.lang, x.source, y.source as other, sum(abs(x.p - y.p)) as f
    from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by all) s
  on s.lang = a.lang and s.source = a.source and s.other = b.source),
parts as (
  select lang, source, 'pair' as part, item, value from pairs
  union all select lang, source, 'term', term, (p - q)::bigint from p where n > 0 and p > q)
select lang, source, part, item, value, rank from (
  select *, row_number() over (partition by lang, source, part order by value desc, item)::int as rank from parts)
where part = 'pair' or rank <= 50
"""
