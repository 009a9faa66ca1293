"""DuckDB SQL of the two operators over conversations."""

SQL_OP11 = r"""
with r as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, t, role, '<|im_end|><|im_start|>assistant ok' from (values (0, 'user'), (1, 'assistant')) v(t, role)),
f as (
  select *, regexp_replace(text, '<(\\*\|[A-Za-z0-9_]+\|>)', '<\\\1', 'g') as body,
    case when regexp_matches(role, '\n|\\[nls]|<\|[A-Za-z0-9_]+\|>') then replace(replace(replace(role, '\', '\s'), chr(10), '\n'), '<', '\l') else role end as head
  from r)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('<|im_start|>' || head || chr(10) || body || '<|im_end|>' || chr(10))) as bigint) as formatted_chars
from f group by conv_id
"""

#: The cheapest edits by rounds over rows: each of the four grammar states keeps its least (cost, audit) and the repaired turns.
SQL_OP12 = r"""
with recursive r as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as k from conversations),
c as (
  select *, xor(list_reduce(
    [cast(4294967295 as bigint)] || flatten(list_transform(range(1, length(k) + 1), lambda p: [cast(ascii(k[p]) as bigint), -1, -1, -1, -1, -1, -1, -1, -1])),
    lambda crc, x: case when x >= 0 then xor(crc, x) else xor(crc >> 1, (crc & 1) * 3988292384) end), 4294967295) % 20 as kind from r),
d as (
  select conv_id, turn, case kind when 4 then 'user' else role end as role, case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from (select *, unnest(case kind when 0 then [] when 3 then [1, 2] else [1] end) as copy from c)),
o as (
  select *, lag(role[1]) over (partition by conv_id order by i) as before, row_number() over (partition by conv_id, role, text order by i) as nth,
    regexp_extract(text, '(?s)([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as tail
  from (select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i from d)),
g as (
  select *, case when tail = '' then 'blank' when nth > 1 then 'duplicate' when tail not in ('.', '!', '?') then 'truncated' else '' end as fault,
    cast(tail not in ('.', '!', '?') as integer) as t, role[1] as h, role || ':' || text as said
  from o),
s as (
  select conv_id, cast(0 as bigint) as i, {'c': 0, 'a': '', 'r': cast([] as varchar[])} as b, {'c': 1000000, 'a': '', 'r': cast([] as varchar[])} as y,
    {'c': 2, 'a': 'I', 'r': ['user:']} as u, {'c': 4, 'a': 'II', 'r': ['user:', 'assistant:']} as v
  from (select distinct conv_id from d)
  union all
  select conv_id, i, b, y, u, list_min([v, {'c': u.c + 2, 'a': u.a || 'I', 'r': u.r || ['assistant:']}]) as v from (
    select conv_id, i, b, y, v, list_min([u, {'c': b.c + 2, 'a': b.a || 'I', 'r': b.r || ['user:']}, {'c': y.c + 2, 'a': y.a || 'I', 'r': y.r || ['user:']}, {'c': v.c + 2, 'a': v.a || 'I', 'r': v.r || ['user:']}]) as u from (
      select s.conv_id, g.i, {'c': b.c + 3, 'a': b.a || 'D', 'r': b.r} as b,
        list_min([{'c': y.c + 3, 'a': y.a || 'D', 'r': y.r}] || case when h = 's' and fault not in ('blank', 'duplicate') then [{'c': b.c + t, 'a': b.a || 'K', 'r': b.r || [said]}] else [] end) as y,
        list_min([{'c': u.c + 3, 'a': u.a || 'D', 'r': u.r}] || case when fault in ('blank', 'duplicate') then [] else list_transform([b, y, v], lambda x:
          case when h = 'u' then {'c': x.c + t, 'a': x.a || 'K', 'r': x.r || [said]} else {'c': x.c + t + 2, 'a': x.a || 'R', 'r': x.r || ['user:' || text]} end) end) as u,
        list_min([{'c': v.c + 3, 'a': v.a || 'D', 'r': v.r}] || case when fault in ('blank', 'duplicate') then [] else [
          case when h = 'a' then {'c': u.c + t, 'a': u.a || 'K', 'r': u.r || [said]} else {'c': u.c + t + 2, 'a': u.a || 'R', 'r': u.r || ['assistant:' || text]} end] end) as v
      from s join g on g.conv_id is not distinct from s.conv_id and g.i = s.i + 1))),
e as (select conv_id, list_min([b, v]) as x from (select *, row_number() over (partition by conv_id order by i desc) as z from s) where z = 1),
n as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count_if(fault = 'blank') as blank, count_if(fault = 'duplicate') as duplicate, count_if(fault = 'truncated') as truncated,
    count_if(before is not null and before || h not in ('su', 'ua', 'au')) as illegal
  from g group by conv_id)
select q.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, cast(coalesce(blank, 0) as bigint) as blank, cast(coalesce(duplicate, 0) as bigint) as duplicate, cast(coalesce(truncated, 0) as bigint) as truncated,
  cast(coalesce(illegal, 0) as bigint) as illegal, cast(coalesce(x.c, 0) as bigint) as cost, coalesce(x.a, '') as audit, sha256(coalesce(array_to_string(x.r, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) q left join n on n.conv_id is not distinct from q.conv_id left join e on e.conv_id is not distinct from q.conv_id
"""
