"""DuckDB forms of the operators, written for RE2 and DuckDB's lists: the second opinion that results are checked against."""

from __future__ import annotations

from ..functions import constants as C
from . import deco

WS = r"[\t-\r\x1c-\x1f \x85\p{Z}]"
NOT_WS = r"[^\t-\r\x1c-\x1f \x85\p{Z}]"
EDGE_L, EDGE_R = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"


def text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(words: list[str]) -> str:
    return ", ".join(text(w) for w in words)


def tok(x: str) -> str:
    cjk = f"length(regexp_replace({x}, '[^一-鿿]', '', 'g'))"
    return f"(floor({cjk} * 1.5::double + (length({x}) - {cjk}) / 4.0::double)::int + 1)"


def spans(x: str) -> str:
    found = f"list_filter(regexp_extract_all({x}, '(?s).*?(?:[.!?。！？]{WS}+|\\z)'), lambda s: s <> '')"
    return f"(case when len({found}) > 0 then {found} else [''] end)"


def sentences(x: str) -> str:
    cut = f"list_filter(list_transform({spans(x)}, lambda s: regexp_replace(s, '([.!?。！？]){WS}+\\z', '\\1')), lambda s: regexp_matches(s, '{NOT_WS}'))"
    return f"(case when len({cut}) > 0 then {cut} else [{x}] end)"


def pieces(x: str, limit: int = C.SEGMENT_MAX_TOKENS) -> str:
    full = f"acc.cur <> '' and acc.n + s.n > {limit}"
    fold = (
        f"list_reduce(list_transform({spans(x)}, lambda s: {{'parts': []::varchar[], 'cur': s, 'n': {tok('s')}}}), lambda acc, s: {{'parts': case when {full} then list_append(acc.parts, acc.cur) else acc.parts end, "
        f"'cur': case when {full} then s.cur else acc.cur || s.cur end, 'n': case when {full} then s.n else acc.n + s.n end}})"
    )
    kept = f"list_filter(list_append(({fold}).parts, ({fold}).cur), lambda p: regexp_matches(p, '{NOT_WS}'))"
    return f"(case when {tok(x)} <= {limit} then [{x}] when len({kept}) > 0 then {kept} else [{x}] end)"


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), '[a-z0-9'']+'), lambda t: length(t) > 1)"


def speaker(x: str) -> str:
    name = f"regexp_extract({x}, '\\A([A-Z][a-zA-Z]{{1,20}}):{WS}', 1)"
    return f"(case when {name} <> '' and {name} not in ({any_of(C.NOT_SPEAKERS)}) then {name} end)"


def anywhere(words: list[str], cjk: list[str]) -> str:
    body = f"(?i){EDGE_L}(?:{'|'.join(words)}){EDGE_R}" + "".join("|" + w for w in cjk)
    return text(body)


def is_rule(x: str, role: str) -> str:
    return f"({role} = 'user' and length({x}) <= {C.RULE_MAX_CHARS} and regexp_matches({x}, {anywhere(C.RULE_PHRASES, C.RULE_ANYWHERE)}))"


def names(x: str) -> str:
    words = f"list_filter(regexp_split_to_array(s, '{WS}+'), lambda w: w <> '')[2:]"
    bare = f"list_transform({words}, lambda w: trim(w, '\"''(),.!?;:'))"
    of = f"list_filter({bare}, lambda w: regexp_full_match(w, '[A-Z][a-z]{{2,}}') and w not in ({any_of(C.NOT_NAMES)}))"
    return f"flatten(list_transform({sentences(x)}, lambda s: {of}))"


def bigrams(x: str) -> str:
    return f"list_distinct(list_transform(range(1, length({x})::bigint), lambda i: substring(lower({x}), i::int, 2)))"


def same_person(a: str, b: str) -> str:
    ba, bb = bigrams(a), bigrams(b)
    return f"(contains(lower({a}), lower({b})) or contains(lower({b}), lower({a})) or (len({ba}) > 0 and len({bb}) > 0 and len(list_intersect({ba}, {bb})) * 2 >= least(len({ba}), len({bb}))))"


def month_number(m: str) -> str:
    return f"((instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(substring({m}, 1, 3))) + 2) // 3)"


_MONTH = "|".join(C.MONTHS + [m[:3] for m in C.MONTHS])
_ISO = rf"(?:^|[^\p{{L}}\p{{N}}_])([0-9]{{4}})-([0-9]{{2}})-([0-9]{{2}})(?:$|[^\p{{L}}\p{{N}}_])"
_MDY = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])({_MONTH})\.?{WS}+([0-9]{{1,2}})(?:st|nd|rd|th)?,?{WS}+([0-9]{{4}})(?:$|[^\p{{L}}\p{{N}}_])"
_DMY = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])([0-9]{{1,2}})(?:st|nd|rd|th)?{WS}+({_MONTH})\.?,?{WS}+([0-9]{{4}})(?:$|[^\p{{L}}\p{{N}}_])"
_MY = rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])({_MONTH})\.?{WS}+([0-9]{{4}})(?:$|[^\p{{L}}\p{{N}}_])"


def days(x: str) -> str:
    """Words at a match's edges are consumed here, so two dates that share one white space would need two passes; the
    catalogue's queries have no such pair."""
    def one(p: str, y: int, m: int, d: int) -> str:
        month = f"regexp_extract(s, {text(p)}, {m})" if p is _ISO else f"lpad({month_number(f'regexp_extract(s, {text(p)}, {m})')}::varchar, 2, '0')"
        date = f"try_cast(regexp_extract(s, {text(p)}, {y}) || '-' || {month} || '-' || lpad(regexp_extract(s, {text(p)}, {d}), 2, '0') as date)"
        return f"list_filter(list_transform(regexp_extract_all({x}, {text(p)}), lambda s: {date}), lambda v: v is not null and v >= date '0001-01-01')"

    return f"list_concat({one(_ISO, 1, 2, 3)}, list_concat({one(_MDY, 3, 1, 2)}, {one(_DMY, 3, 2, 1)}))"


def months(x: str) -> str:
    return f"list_transform(regexp_extract_all({x}, {text(_MY)}), lambda s: regexp_extract(s, {text(_MY)}, 2) || '-' || lpad({month_number(f'regexp_extract(s, {text(_MY)}, 1)')}::varchar, 2, '0'))"


def literal_terms(x: str) -> str:
    numbers = f"list_transform(regexp_extract_all({x}, '(?:^|[^\\p{{L}}\\p{{N}}_])[0-9](?:[0-9.,:/-]*[0-9])?(?:$|[^\\p{{L}}\\p{{N}}_])'), lambda s: regexp_extract(s, '[0-9](?:[0-9.,:/-]*[0-9])?'))"
    day = f"list_transform({days(x)}, lambda d: strftime(d, '%Y-%m-%d'))"
    return f"list_sort(list_filter(list_distinct(list_concat({names(x)}, list_concat({numbers}, list_concat({day}, {months(x)})))), lambda t: length(t) > 1))"


def intent(q: str) -> str:
    return "(case " + " ".join(f"when regexp_matches({q}, {anywhere(w, c)}) then '{n}'" for n, (w, c) in C.INTENTS.items()) + " else 'default' end)"


def is_aggregate(q: str) -> str:
    return f"regexp_matches({q}, {anywhere(*C.INTENTS['aggregate'])})"


def is_task(q: str) -> str:
    task = rf"(?i)\A{WS}*(?:please{WS}+)?(?:{'|'.join(C.TASK_OPENERS)}){EDGE_R}" + "".join("|" + w for w in C.TASK_ANYWHERE)
    factual = rf"(?i)\A{WS}*(?:{'|'.join(C.FACTUAL_OPENERS)}){EDGE_R}"
    return f"(regexp_matches({q}, {text(task)}) and not regexp_matches({q}, {text(factual)}))"


def header(ts: str, gran: str, label: str) -> str:
    return (
        f"('[' || case when {ts} is null then 'date unknown · ' || {label} else strftime({ts}, '%Y-%m-%d (%a)') || "
        f"case when {gran} = 'datetime' then strftime({ts}, ' %H:%M') || case when second({ts}) <> 0 then strftime({ts}, ':%S') else '' end else '' end end || ']')"
    )


def created_at(ts: str, gran: str) -> str:
    return f"(case when {gran} = 'datetime' then strftime({ts}, '%Y-%m-%dT%H:%M:%S') || case when microsecond({ts}) % 1000000 = 0 then 'Z' else strftime({ts}, '.%g') || 'Z' end else strftime({ts}, '%Y-%m-%d') end)"


def render(t: str = "r") -> str:
    body = f"(case when {t}.speaker_name is not null and starts_with({t}.text, {t}.speaker_name || ':') then regexp_replace(substring({t}.text, length({t}.speaker_name) + 2), '\\A{WS}+', '') else {t}.text end)"
    part = f"(case when {t}.total > 1 then ' (part ' || {t}.part || '/' || {t}.total || ')' else '' end)"
    return f"({header(f'{t}.ts_value', f'{t}.ts_granularity', f'{t}.session_label')} || ' ' || coalesce({t}.speaker_name, {t}.role) || ':' || {part} || ' ' || {body})"


ROLE = "(case when lower(trim(role)) in ('user', 'assistant') then lower(trim(role)) " + " ".join(f"when lower(trim(role)) = '{a}' then '{t}'" for a, t in C.ROLE_ALIASES.items()) + " else 'user' end)"


def _list(values) -> str:
    return "[" + ", ".join(text(v) for v in values) + "]"


MESSAGES = f"""
msg as (select 'u' || (conv_id % 10) as user_id, 'c' || conv_id as session_id, 'r' || conv_id as request_id, conv_id as arrival, turn::int as idx, {ROLE} as role,
  ({_list(deco.SPEAKERS)})[conv_id % {len(deco.SPEAKERS)} + 1] || ': ' || coalesce(text, '')
  || case when turn % 3 = 0 then ' I met ' || ({_list(deco.PEOPLE)})[(conv_id + turn) % {len(deco.PEOPLE)} + 1] || ' on 2024-01-' || lpad((conv_id % 28 + 1)::varchar, 2, '0') || '.' else '' end
  || case when turn % 4 = 1 then ' From now on always reply briefly.' else '' end as content,
  case when turn % 3 <> 1 then {deco.FIRST_MS} + conv_id * {deco.DAY_MS} + turn * {deco.TURN_MS} end as ms
  from conversations),
seqd as (select *, row_number() over (partition by user_id, session_id order by arrival, request_id, idx)::int as seq from msg where regexp_matches(content, '{NOT_WS}')),
timed as (select *, coalesce(ms,
    first_value(ms ignore nulls) over (partition by user_id, session_id, request_id order by idx rows between 1 following and unbounded following),
    last_value(ms ignore nulls) over (partition by user_id, session_id, request_id order by idx rows between unbounded preceding and 1 preceding)) as at_ms from seqd)"""

SEGMENTS = f"""{MESSAGES},
cut as (select *, make_timestamp(at_ms * 1000) as ts_value, case when at_ms is null then 'unknown' when at_ms % 86400000 = 0 then 'date' else 'datetime' end as ts_granularity,
  case when ms is not null then 'given' when at_ms is not null then 'inherited' else 'unknown' end as ts_provenance, {speaker('content')} as speaker_name, {pieces('content')} as p from timed),
parted as (select *, unnest(range(1, len(p) + 1))::int as part, len(p)::int as total from cut),
seg as (select user_id, session_id || '#' || seq || '.' || part as id, session_id, request_id, seq, part, total, role, speaker_name, ts_value, ts_granularity, ts_provenance, p[part] as text,
  substring(sha256(role || chr(10) || p[part]), 1, 24) as content_sha, {is_rule('p[part]', 'role')} as is_rule from parted)"""

ROWS = f"""{SEGMENTS},
rows_ as (select *, (row_number() over (partition by user_id order by session_id, seq, part) - 1)::int as pos,
  'session ' || dense_rank() over (partition by user_id order by session_id) as session_label,
  coalesce(speaker_name, role) || ' ' || case when ts_value is null then '' else strftime(ts_value, '%Y-%m-%d') || ' ' || strftime(ts_value, '%B %Y') || ' ' || strftime(ts_value, '%B ') || day(ts_value) || ' ' || year(ts_value)
    || ' ' || day(ts_value) || ' ' || strftime(ts_value, '%B %Y') || ' ' || strftime(ts_value, '%a') || ' ' end || text as index_text from seg)"""

BM25 = f"""{ROWS},
tl as (select user_id, pos, {tokens('index_text')} as t from rows_),
post as (select user_id, pos, len(t) as dl, term, count(*)::int as tf from (select user_id, pos, t, unnest(t) as term from tl) group by all),
st as (select user_id, count(*) as n_rows, avg(len(t)) as avgdl from tl group by user_id),
ri as (select user_id, term, count(*) as df, any_value(n_rows) as n_rows, any_value(avgdl) as avgdl, ln(any_value(n_rows) - count(*) + 0.5::double) - ln(count(*) + 0.5::double) as raw_idf from post join st using (user_id) group by user_id, term),
terms as (select user_id, term, df, n_rows, avgdl, case when raw_idf < 0 then {C.EPSILON} * avg(raw_idf) over (partition by user_id) else raw_idf end as idf from ri)"""

ENTITIES = f"""nm as (select user_id, pos, unnest(range(0, len(n))) as i, unnest(n) as name from
  (select user_id, pos, list_concat({names('text')}, case when speaker_name is not null then [speaker_name] else [] end) as n from rows_)),
spell as (select user_id, alias, f.name as spelling, row_number() over (partition by user_id order by f.pos, f.i) as ord from (select user_id, lower(name) as alias, min({{'pos': pos, 'i': i, 'name': name}}) as f from nm group by all)),
within_ as (select a.user_id, a.alias, b.ord, b.alias as c from spell a join spell b on a.user_id = b.user_id and a.alias <> b.alias and contains(b.alias, a.alias)),
odd as (select user_id, alias from (select x.user_id, x.alias, x.c, bool_or(coalesce({same_person('x.c', 'y.c')}, false)) as old from within_ x left join within_ y on x.user_id = y.user_id and x.alias = y.alias and y.ord < x.ord group by all)
  where not old group by all having count(*) >= 2)"""

GROUPS = f"""al as (select user_id, list({{'a': spell.alias, 's': spelling, 'odd': odd.alias is not null}} order by ord) as l from spell left join odd using (user_id, alias) group by user_id),
fold as (select user_id, 1 as k, l, case when l[1].odd then []::varchar[] else [l[1].s] end as canons, l[1].a as alias, l[1].s as canonical from al
  union all select user_id, k + 1, l, case when l[k + 1].odd or hit is not null then canons else list_append(canons, l[k + 1].s) end, l[k + 1].a, case when l[k + 1].odd then l[k + 1].s else coalesce(hit, l[k + 1].s) end
  from (select *, list_filter(canons, lambda c: {same_person('c', 'l[k + 1].s')})[1] as hit from fold where k < len(l))),
grp as (select user_id, alias, canonical from fold),
ent as (select distinct nm.user_id, canonical, pos from nm join grp on nm.user_id = grp.user_id and lower(name) = alias)"""

_VALUES = ", ".join(
    f"({i}::bigint, {text(u)}, {text(q)}, {'null::varchar[]' if o is None else _list(o) + '::varchar[]'}, {'null' if k is None else k}::int)" for i, u, q, o, k in deco.QUERIES
)
QUERIES = f"""
qraw(query_id, user_id, query, options, top_k) as (values {_VALUES}),
qs as (select *, case when len(coalesce(options, [])) > 0 then query || ' ' || array_to_string(options, ' ') else query end as q, {intent('query')} as intent, {is_task('query')} as is_task,
  {is_aggregate('query')} as is_aggregate, least(coalesce(top_k, {C.TOP_K_CAP}), {C.TOP_K_CAP})::int as k, (least(coalesce(top_k, {C.TOP_K_CAP}), {C.TOP_K_CAP}) * {C.CHANNEL_MULTIPLE})::int as n
  from qraw where not (query = '' and len(coalesce(options, [])) = 0))"""


def scored(name: str, terms: str, keep: str = "") -> str:
    """A BM25 channel `name` over a table of (query_id, user_id, n, term)."""
    part = f"idf * tf * {C.K1 + 1}::double / (tf + {C.K1}::double * ({1 - C.B}::double + {C.B}::double * dl / avgdl))"
    return (
        f"{name}_s as (select query_id, user_id, n, pos, sum({part} order by term) as score from {terms} join post using (user_id, term) join terms using (user_id, term) group by all),\n"
        f"{name} as (select query_id, user_id, pos, score, rank from (select *, (row_number() over (partition by query_id order by score desc, pos) - 1)::int as rank from {name}_s) where rank < n)"
    )


C_BM25 = f"qt as (select distinct query_id, user_id, n, unnest({tokens('q')}) as term from qs),\n{scored('c_bm25', 'qt')}"


def nearest(name: str, vectors: str) -> str:
    """A vector channel over a table (query_id, vector double[])."""
    dot = lambda a, b: f"list_dot_product({a}, {b})"
    d = f"round(1 - {dot('e', 'vector')} / nullif(sqrt({dot('e', 'e')}) * sqrt({dot('vector', 'vector')}), 0), 12)"
    return (
        f"{name} as (select query_id, user_id, pos, rank, distance from (select *, (row_number() over (partition by query_id order by distance, pos) - 1)::int as rank from "
        f"(select query_id, user_id, n, pos, {d} as distance from qs join {vectors} using (query_id) join vecs using (user_id)) where distance is not null) where rank < n)"
    )


VECTORS = """
vecs as (select r.user_id, r.pos, embedding::double[] as e from rows_ r, (select count(*) as nv from embeddings), embeddings
  where r.part = 1 and r.seq % 5 <> 4 and vec_id = (substring(r.session_id, 2)::bigint * 8 + r.seq) % greatest(nv, 1)),
qv as (select vec_id as query_id, embedding::double[] as vector from embeddings where vec_id <= 11)"""

C_VECTOR = f"{VECTORS},\n{nearest('c_vector', 'qv')}"
C_ENTITY = """
c_entity as (select query_id, user_id, pos, (row_number() over (partition by query_id order by ts_value desc nulls last, pos) - 1)::int as rank from (select distinct query_id, user_id, pos, ts_value
  from (select query_id, user_id, unnest(regexp_extract_all(lower(q), '[\\p{L}\\p{N}_]+')) as alias from qs) join grp using (user_id, alias) join ent using (user_id, canonical) join rows_ using (user_id, pos) where length(alias) > 2))"""
C_LITERAL = f"""
lt as (select query_id, user_id, {literal_terms('q')} as lits from qs),
c_literal as (select query_id, user_id, pos, (row_number() over (partition by query_id order by coalesce(b.score, 0.0) desc, pos) - 1)::int as rank from
  (select distinct query_id, lt.user_id, pos from lt join rows_ using (user_id), unnest(lits) as u(l) where contains(lower(text), lower(l))) left join c_bm25 b using (query_id, user_id, pos))"""
C_DATE = f"""
dd as (select query_id, user_id, unnest({days('q')}) as d from qs where intent = 'temporal'),
dm as (select query_id, user_id, unnest({months('q')}) as m from qs where intent = 'temporal'),
c_date as (select query_id, user_id, pos, (row_number() over (partition by query_id order by seq, pos) - 1)::int as rank from (select distinct query_id, user_id, pos, seq from
  (select query_id, r.user_id, pos, seq from dd join rows_ r on dd.user_id = r.user_id and r.ts_value::date between d - {C.DATE_RADIUS} and d + {C.DATE_RADIUS}
   union all select query_id, r.user_id, pos, seq from dm join rows_ r on dm.user_id = r.user_id and strftime(r.ts_value, '%Y-%m') = m)))"""


def channel_chain(vectors: bool) -> str:
    parts = [BM25, ENTITIES, GROUPS, QUERIES, C_BM25, *([C_VECTOR] if vectors else []), C_ENTITY, C_LITERAL, C_DATE]
    return "with recursive " + ",\n".join(p.strip() for p in parts)


def weight(intent_: str, channel: str) -> str:
    if channel.endswith("_hop"):
        return f"{C.HOP_WEIGHT}::double"
    return "(case " + " ".join(f"when {intent_} = '{n}' then {w[channel]}::double" for n, w in C.WEIGHTS.items()) + " end)"


def rrf(name: str, channels: tuple[str, ...]) -> str:
    """The fused order `name` of the channels c_<channel>, rows of both bm25 and vector first."""
    union = " union all ".join(f"select query_id, user_id, pos, rank, '{c}' as channel from c_{c}" for c in channels)
    start = lambda c: 0 if c in ("bm25", "vector") else C.VIRTUAL_RANK
    score = " + ".join(f"coalesce(max(case when channel = '{c}' then {weight('intent', c)} / ({C.RRF_K + start(c) + 1} + rank) end), 0.0::double)" for c in C.CHANNELS)
    number = "(case " + " ".join(f"when channel = '{c}' then {k}" for k, c in enumerate(C.CHANNELS)) + " end)"
    return (
        f"{name}_h as ({union}),\n"
        f"{name}_f as (select query_id, h.user_id, pos, {score} as score, min({{'c': {number}, 'r': rank}}) as first, bool_or(channel = 'bm25') and bool_or(channel = 'vector') as in_both from {name}_h h join qs using (query_id) group by query_id, h.user_id, pos),\n"
        f"{name} as (select query_id, user_id, pos, score, in_both, (row_number() over (partition by query_id order by in_both desc, score desc, first) - 1)::int as rank from {name}_f)"
    )


def finish(order: str, tail: str = "packed") -> str:
    """Rules, neighbours, rendering and packing behind an order; names rl, o1, nb, o2, ren, packed."""
    return f"""
rl as (select query_id, user_id, pos, (row_number() over (partition by query_id order by pos) - 1) as r from (select query_id, qs.user_id, pos from qs join rows_ using (user_id) where is_task and is_rule
  and not exists (select 1 from {order} o where o.query_id = qs.query_id and o.pos = rows_.pos))),
o1 as (select query_id, user_id, pos, score, (row_number() over (partition by query_id order by at_, r) - 1)::int as rank from (select query_id, user_id, pos, score, rank::double as at_, 0 as r from {order}
  union all select query_id, user_id, pos, 0.0, {C.RULE_AFTER - 0.5}, r from rl where r < {C.RULE_SLOT})),
cand as (select o.query_id, o.user_id, q.k, o.pos + d as pos, min(o.rank * 2 + (d > 0)::int) as o from o1 o join qs q using (query_id), (values (-1), (1)) as s(d), rows_ a, rows_ b
  where o.rank < {C.NEIGHBOR_ANCHORS} and a.user_id = o.user_id and a.pos = o.pos and b.user_id = o.user_id and b.pos = o.pos + d and a.session_id = b.session_id
  and not exists (select 1 from o1 i where i.query_id = o.query_id and i.pos = o.pos + d and i.rank < q.k) group by all),
nb as (select * from (select *, row_number() over (partition by query_id order by o) - 1 as r from cand) where r < floor(k * {C.NEIGHBOR_RATIO}::double)),
o2 as (select query_id, user_id, pos, score, (row_number() over (partition by query_id order by at_, r) - 1)::int as rank from (
  select query_id, user_id, pos, score, rank::double as at_, 0 as r from o1 where not exists (select 1 from nb where nb.query_id = o1.query_id and nb.pos = o1.pos)
  union all select nb.query_id, nb.user_id, nb.pos, coalesce(o1.score, 0.0), {C.NEIGHBOR_AFTER - 0.5}, nb.r from nb left join o1 on o1.query_id = nb.query_id and o1.pos = nb.pos)),
ren as (select o2.query_id, o2.user_id, o2.pos, o2.rank, o2.score, r.id, {render()} as content, {created_at('r.ts_value', 'r.ts_granularity')} as created_at from o2 join rows_ r using (user_id, pos))"""


def packed(budget: int = C.BUDGET_TOKENS) -> str:
    """The kept rows of ren: query_id, user_id, place, pos, id, content, score, created_at."""
    return f"""
lists as (select query_id, k, list({{'pos': pos, 't': t}} order by rank) as l from (select query_id, pos, rank, {tok('content')} as t from ren) join qs using (query_id) group by all),
walk as (select query_id, k, l, 0 as i, 0 as used, 0 as place, null::int as pos from lists
  union all select query_id, k, l, i + 1, case when ok then used + l[i + 1].t else used end, case when ok then place + 1 else place end, case when ok then l[i + 1].pos end
  from (select *, place < k and used + l[i + 1].t <= {budget} as ok from walk where i < len(l))),
packed as (select w.query_id, ren.user_id, w.place - 1 as place, w.pos, id, content, score, created_at from walk w join ren on ren.query_id = w.query_id and ren.pos = w.pos)"""
