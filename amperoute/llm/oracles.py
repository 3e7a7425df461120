"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from . import secrets, sharding

ORACLES: dict[str, str] = {}

ORACLES["op5_near_duplicates"] = r"""
with recursive split as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
sets as (
    select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
        else list_sort(list_distinct(list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')))) end as s from split),
classes as (select s, min(doc_id) as rep, count(*) as copies from sets where len(s) > 0 group by s),
grams as (select rep, len(s) as n, unnest(s) as g from classes),
pairs as (
    select a.rep as x, b.rep as y, any_value(a.n) as n, any_value(b.n) as m, count(*) as common
    from grams a join grams b on a.g = b.g and a.rep < b.rep group by a.rep, b.rep),
links as (select x, y from pairs where 100 * common >= 75 * (n + m - common)),
edges as (select x, y from links union all select y, x from links),
reach as (select rep as node, rep as root from classes union select e.y, r.root from reach r join edges e on e.x = r.node),
roots as (select node, min(root) as root from reach group by node)
select d.doc_id, len(d.s)::bigint as n_shingles,
       case when len(d.s) = 0 then d.doc_id else r.root end as component_id, coalesce(c.copies, 1)::bigint as copies
from sets d left join classes c on c.s = d.s left join roots r on r.node = c.rep
"""

ORACLES["op7_extendible_shards"] = f"""
with entries as (
    select doc_id, ('0x' || substr(md5(coalesce(doc_id::varchar, '-') || ':' || coalesce(text, '') || case when text is null then '-' else '+' end), 1, {sharding.BITS // 4}))::bigint as hash,
           coalesce(strlen(text), 0)::bigint as n_bytes from documents),
levels as (select unnest(generate_series(0, 30)) as depth),
nodes as (select l.depth, e.hash >> ({sharding.BITS} - l.depth) as prefix, sum(e.n_bytes)::bigint as bytes from entries e, levels l group by all),
placed as (
    select e.doc_id, e.n_bytes, e.hash, min(n.depth) as depth
    from entries e join nodes n on n.prefix = e.hash >> ({sharding.BITS} - n.depth) and n.bytes <= {sharding.LIMIT_BYTES} group by all)
select p.doc_id, p.n_bytes,
       case when p.depth = 0 then '' else right(lpad(bin(p.hash >> ({sharding.BITS} - p.depth)), 64, '0'), p.depth) end as shard,
       p.depth::int as depth, n.bytes as shard_bytes, p.n_bytes > {sharding.LIMIT_BYTES} as oversize
from placed p join nodes n on n.depth = p.depth and n.prefix = p.hash >> ({sharding.BITS} - p.depth)
"""


def _spans_sql() -> str:
    def spans(order: int, rule: secrets.Rule) -> str:
        pattern = rule.pattern.replace("'", "''")
        whole = f"regexp_extract_all(t, '{pattern}', 0)"
        return f"""
        select doc_id, {order} as kind, '{rule.name}' as name,
               list_sum([len(x) for x in gaps[:i]])::bigint + coalesce(list_sum([len(x) for x in m[:i - 1]]), 0)::bigint as start, len(m[i]) as size
        from (select doc_id, m, v, gaps, unnest(generate_series(1, len(m))) as i
              from (select doc_id, {whole} as m, regexp_extract_all(t, '{pattern}', {rule.group}) as v, string_split_regex(t, '{pattern}') as gaps from d))
        where len(v[i]) >= {rule.least}"""

    union = " union all ".join(spans(order, rule) for order, rule in enumerate(secrets.RULES))
    n_base = len(secrets.BASE)
    listed = "string_agg(name || ':' || start || ':' || (start + size), ',' order by start, kind)"
    return f"""
with d as (select doc_id, coalesce(text, '') as t from documents), spans as ({union}),
found as (
    select doc_id, count(*) filter (kind = 0) as a, count(*) filter (kind = 1) as k, count(*) filter (kind = 2) as h,
           {listed} filter (kind < {n_base}) as base, {listed} as every from spans group by doc_id)
select d.doc_id, coalesce(a, 0)::bigint as n_assign, coalesce(k, 0)::bigint as n_access, coalesce(h, 0)::bigint as n_hex,
       sha256(coalesce(base, '')) as base_sha256, coalesce(every, '') as spans
from d left join found f using (doc_id)
"""


ORACLES["op9_secret_scans"] = _spans_sql()

ORACLES["op12_hard_negatives"] = """
with sound as (
    select distinct vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda c: floor(256 * c::double)::bigint) as x
    from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda c: c is null or not isfinite(c))) = 0),
scores as (
    select a.vec_id as anchor, b.vec_id as other, a.label = b.label as same, coalesce(list_sum(list_transform(list_zip(a.x, b.x), lambda p: p[1] * p[2])), 0)::bigint as score
    from sound a join sound b on a.vec_id <> b.vec_id and len(a.x) = len(b.x) where a.vec_id % 100 = 0),
positives as (select * from scores where same qualify row_number() over (partition by anchor order by score desc, other) <= 5)
select p.anchor as anchor_id, p.other as positive_id, row_number() over (partition by p.anchor, p.other order by n.score desc, n.other)::int as rank,
       n.other as negative_id, p.score as positive_score, n.score as negative_score
from positives p join scores n on n.anchor = p.anchor and not n.same and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score
qualify row_number() over (partition by p.anchor, p.other order by n.score desc, n.other) <= 5
"""

# The automaton's states are 0 start, 1 system, 2 user, 3 assistant; an edit leads from p to q.
ORACLES["op11_conversation_repair"] = r"""
with recursive keyed as (
    select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k
    from conversations),
bits as (
    select k, 0 as i, 4294967295::bigint as c from (select distinct k from keyed)
    union all
    select k, i + 1, xor(b >> 1, 3988292384 * (b & 1)) from (
        select k, i, case when i % 8 = 0 then xor(c, ascii(substr(k, (i // 8 + 1)::bigint, 1))::bigint) else c end as b from bits where i < 8 * length(k))),
faults as (select k, xor(c, 4294967295) % 20 as fault from bits where i = 8 * length(k)),
rows as (
    select conv_id, turn, case when fault = 4 then 'user' else role end as role,
           case when fault = 1 then '' when fault = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
           unnest(generate_series(1, case when fault = 3 then 2 else 1 end)) as copy
    from keyed join faults using (k) where fault <> 0),
placed as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(text), copy) as n from rows),
judged as (
    select *, not regexp_matches(text, '[^\x20\x09-\x0D]') as blank, row_number() over (partition by conv_id, role, text order by n) > 1 as again,
           not regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') as open_end, left(role, 1) as r, lag(left(role, 1)) over (partition by conv_id order by n) as r0
    from placed),
moves(p, e, s, q, cost) as (
    select p, e, s, case when e = 'D' then p when e = 'K' then (case s when 's' then 1 when 'u' then 2 else 3 end) when p = 2 then 3 else 2 end,
           case e when 'D' then 3 when 'K' then 0 else 2 end
    from (values (0), (1), (2), (3)) a(p), (values ('D'), ('K'), ('R'), ('I')) b(e), (values ('s'), ('u'), ('a'), ('-')) c(s)
    where e <> 'K' or (s = 's' and p = 0) or (s = 'u' and p <> 2) or (s = 'a' and p = 2)),
-- a way is a state with its cheapest, least letters and the lines they make; phase 0: rows before n done, 1 to 3: insertions
ways as (
    select conv_id, 0::bigint as n, 0 as phase, 0 as p, 0::bigint as cost, '' as audit, []::varchar[] as lines from (select distinct conv_id from judged)
    union all
    select conv_id, n, phase, p, cost, audit, lines from (
        select conv_id, n, phase, p, cost, audit, lines, row_number() over (partition by conv_id, n, phase, p order by cost, audit) as pick from (
            select w.conv_id, w.n, w.phase + 1 as phase, w.p, w.cost, w.audit, w.lines from ways w where w.phase < 3
            union all
            select w.conv_id, w.n, w.phase + 1, case when w.p = 2 then 3 else 2 end, w.cost + 2, w.audit || 'I',
                   list_append(w.lines, case when w.p = 2 then 'assistant:' else 'user:' end) from ways w where w.phase < 3
            union all
            select w.conv_id, j.n, 0, m.q, w.cost + m.cost + case when m.e <> 'D' and j.open_end then 1 else 0 end, w.audit || m.e,
                   case m.e when 'D' then w.lines when 'K' then list_append(w.lines, j.role || ':' || j.text)
                        else list_append(w.lines, case when m.q = 3 then 'assistant:' else 'user:' end || j.text) end
            from ways w join judged j on j.conv_id is not distinct from w.conv_id and j.n = w.n + 1
            join moves m on m.p = w.p and m.e <> 'I' and m.s = case when j.r in ('s', 'u', 'a') then j.r else '-' end and (m.e = 'D' or not (j.blank or j.again))
            where w.phase = 3)) where pick = 1),
counts as (
    select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (blank)::bigint as blank,
           count(*) filter (not blank and again)::bigint as duplicate, count(*) filter (not blank and not again and open_end)::bigint as truncated,
           count(*) filter (r0 is not null and r0 || r not in ('su', 'ua', 'au'))::bigint as illegal, max(n) as n from judged group by conv_id),
best as (
    select w.*, row_number() over (partition by w.conv_id order by w.cost, w.audit) as pick
    from ways w join counts c on c.conv_id is not distinct from w.conv_id and c.n = w.n where w.phase = 3 and w.p in (0, 3))
select o.conv_id, coalesce(c.gaps, 0) as gaps, coalesce(c.blank, 0) as blank, coalesce(c.duplicate, 0) as duplicate, coalesce(c.truncated, 0) as truncated,
       coalesce(c.illegal, 0) as illegal, coalesce(b.cost, 0) as cost, coalesce(b.audit, '') as audit,
       sha256(coalesce(array_to_string(b.lines, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o
left join counts c on c.conv_id is not distinct from o.conv_id
left join best b on b.conv_id is not distinct from o.conv_id and b.pick = 1
"""
