"""DuckDB SQL of the conversation query: the checksum, the faults, and the edits by recursion over rows."""

_CRC = """
b(i, v) as (select i, list_reduce([0::ubigint, 0, 0, 0, 0, 0, 0, 0], lambda c, x: xor(c >> 1, (c & 1) * 3988292384::ubigint), i::ubigint) from range(256) r(i)),
crc(t) as (select list(v order by i) from b)"""

_STEP = """
  select conv_id, k + 1 as k, n, rows, {start} as x0, {system} as x1, {user} as x2, {assistant} as x3
  from (select *, rows[(k + 1)::bigint] as y, lower(y) as r, (y = upper(y) and y <> '-')::int as more from e where k < n)"""


def _add(state: str, cost: str, edit: str) -> str:
    return f"{{'c': {state}.c + {cost}, 's': {state}.s || '{edit}'}}"


def _least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _row(state: str, target: str) -> str:
    """Keeping or changing the role of a row on the way from a state to a target; impossible where it must go."""
    return f"{{'c': {state}.c + more + case when y = '-' then 1000000000 when r = '{target}' then 0 else 2 end, 's': {state}.s || case when r = '{target}' then 'K' else 'R' end}}"


def _layer() -> str:
    start, system = _add("x0", "3", "D"), _least(_add("x1", "3", "D"), "{'c': x0.c + more + case when r = 's' then 0 else 1000000000 end, 's': x0.s || 'K'}")
    user = _least(_add("x2", "3", "D"), *[_row(s, "u") for s in ("x0", "x1", "x3")])
    assistant = _least(_add("x3", "3", "D"), _row("x2", "a"))
    return f"""
  select conv_id, k, n, rows, x0, x1, x2, {_least("x3", _add("x2", "2", "I"))} as x3 from (
    select conv_id, k, n, rows, x0, x1, x3, {_least("x2", _add("x0", "2", "I"), _add("x1", "2", "I"), _add("x3", "2", "I"))} as x2 from (
      {_STEP.format(start=start, system=system, user=user, assistant=assistant)}))"""


OP12 = rf"""
with recursive {_CRC},
o as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as name
  from conversations),
h as (
  select o.*, xor(list_reduce(list_transform(string_split(name, ''), lambda c: ascii(c)::ubigint), lambda c, x: xor(t[((xor(c, x) & 255) + 1)::bigint], c >> 8), 4294967295::ubigint), 4294967295::ubigint) % 20 as how
  from o, crc),
a as (
  select conv_id, turn, case when how = 4 then 'user' else role end as role,
         case how when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(range(case when how = 3 then 2 else 1 end)) as copy
  from h where how <> 0),
r as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as k,
         row_number() over (partition by conv_id, role, text order by turn nulls first, copy) > 1 as again
  from a),
f as (
  select *, case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when again then 'duplicate'
                 when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else '' end as fault,
         role[1] as i, lag(role[1]) over (partition by conv_id order by k) || role[1] as two
  from r),
s as (
  select conv_id, max(turn) - min(turn) + 1 - count(distinct turn) as gaps, count(*) as n,
         count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (two not in ('su', 'ua', 'au')) as illegal,
         list(case when fault in ('blank', 'duplicate') then '-' when fault = '' then c else upper(c) end order by k) as rows
  from (select *, case when i in ('s', 'u', 'a') then i else 'o' end as c from f) group by conv_id),
e as (
  select conv_id, 0 as k, n, rows, {{'c': 0, 's': ''}} as x0, {{'c': 1000000000, 's': ''}} as x1, {{'c': 2, 's': 'I'}} as x2, {{'c': 4, 's': 'II'}} as x3 from s
  union all {_layer()}),
z as (select conv_id, list_min([x0, x3]) as best from e where k = n),
j as (
  select conv_id, p, edit, k, role, text from (
    select conv_id, p, best.s[p::bigint] as edit, sum((best.s[p::bigint] <> 'I')::int) over (partition by conv_id order by p) as k
    from (select conv_id, best, unnest(range(1, len(best.s) + 1)) as p from z))
  left join (select conv_id as c, k as rk, role, text from r) on c is not distinct from conv_id and k = rk and edit <> 'I'
  where edit <> 'D'),
q as (
  select *, row_number() over (partition by conv_id order by p) - max((edit = 'K' and role[1] = 's')::int) over (partition by conv_id) as place from j),
d as (
  select conv_id, string_agg(case when edit = 'K' then role when place % 2 = 1 then 'user' else 'assistant' end || ':' || case when edit = 'I' then '' else text end, chr(10) order by p) as repaired
  from q group by conv_id),
every as (select distinct conv_id from conversations)
select every.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(best.c, 0)::bigint as cost,
       coalesce(best.s, '') as audit, sha256(coalesce(repaired, '')) as repaired_sha256
from every left join s on s.conv_id is not distinct from every.conv_id left join z on z.conv_id is not distinct from every.conv_id
left join d on d.conv_id is not distinct from every.conv_id
"""
