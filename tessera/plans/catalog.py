"""Queries of the driver contract, one or more per operator, each with its DuckDB form. Keys begin with the operators' ids."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..operators import channels as CH
from ..operators import coerce as P
from ..operators import evaluation as E
from ..operators import fusion as FU
from ..operators import index as I
from ..operators import segments as G
from ..sources.scratch import new_path
from . import deco
from . import sql as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
table = deco.table


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def values(spark: SparkSession, rows: list, schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple]) -> str:
    lit = lambda v: "null" if v is None else S.text(v) if isinstance(v, str) else str(v)
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


# coercion -------------------------------------------------------------------------------------------------------------


@query(f"select conv_id, turn, {S.ROLE} as norm_role from conversations")
def p01_role_normalize(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", P.normalize_role(F.col("role")).alias("norm_role"))


@query(f"select conv_id, turn from conversations where regexp_matches(text, '{S.NOT_WS}')")
def p12_message_filter_blank(spark, sf_dir):
    return P.drop_blank(table(spark, sf_dir, "conversations"), "text").select("conv_id", "turn")


CONTENTS = [
    (1, '"plain"'), (2, "null"), (3, '[{"type":"text","text":"hello"},{"type":"image_url","image_url":{"url":"x"}}]'), (4, '[{"id":"c1","type":"cell","value":"28"}]'),
    (5, '[{"text":42,"type":"text"}]'), (6, "[]"), (7, '{"a":1,"b":[true,null]}'), (8, "12"), (9, "true"), (10, '["one","two"]'), (11, '[{"type":"image","x":1}]'), (12, '["  "]'), (13, "1.5"),
    (14, '["a",{"type":"text","text":"b"},{"type":"input_image"}]'), (15, '"caf\\u00e9"'),
]


#: JSON made of each turn's text, its letters kept to ASCII: a string, a list of a string and a block, or a number.
_RAW_TEXT = "regexp_replace(coalesce(text, ''), '[^A-Za-z0-9 .,!?]', ' ', 'g')"
_RAW = f"select 1000 + conv_id * 100 + turn, case turn % 3 when 0 then '\"' || {_RAW_TEXT} || '\"' when 1 then '[\"' || {_RAW_TEXT} || '\",{{\"text\":\"' || {_RAW_TEXT} || '\",\"type\":\"text\"}}]' else conv_id::varchar end from conversations"


def raw_sql(cases: list) -> str:
    """v (i, raw): the written cases, and the conversations as JSON."""
    return f"v as (select i::bigint as i, raw from (values {sql_values(cases)}) as l(i, raw) union all {_RAW})"


def raw_json(spark: SparkSession, sf_dir: str, cases: list) -> DataFrame:
    t, turn = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z0-9 .,!?]", " "), F.col("turn") % 3
    block = F.concat(F.lit('["'), t, F.lit('",{"text":"'), t, F.lit('","type":"text"}]'))
    raw = F.when(turn == 0, F.concat(F.lit('"'), t, F.lit('"'))).when(turn == 1, block).otherwise(F.col("conv_id").cast("string"))
    return values(spark, cases, "i long, raw string").unionByName(table(spark, sf_dir, "conversations").select((1000 + F.col("conv_id") * 100 + F.col("turn")).alias("i"), raw.alias("raw")))


def _items(j: str) -> str:
    return f"(case when json_type({j}) = 'ARRAY' then json_extract({j}, '$[*]') else [] end)"


_IMG = "(json_type(e) = 'OBJECT' and coalesce(e->>'$.type', '') in ('image_url', 'image', 'input_image'))"
_TXT = "(json_type(e) = 'OBJECT' and coalesce(e->>'$.type', '') = 'text' and coalesce(json_type(e, '$.text'), '') = 'VARCHAR')"


def content_sql(j: str) -> str:
    known = f"len(list_filter({_items(j)}, lambda e: not (json_type(e) = 'VARCHAR' or {_TXT} or {_IMG}))) = 0"
    joined = f"array_to_string(list_transform(list_filter({_items(j)}, lambda e: not {_IMG}), lambda e: case when json_type(e) = 'VARCHAR' then e->>'$' else e->>'$.text' end), chr(10))"
    return (
        f"(case json_type({j}) when 'NULL' then '' when 'VARCHAR' then {j}->>'$' when 'OBJECT' then {j}::varchar when 'BOOLEAN' then upper(({j}::varchar)[1]) || ({j}::varchar)[2:] "
        f"when 'ARRAY' then case when len({_items(j)}) = 0 then '' when {known} and regexp_matches({joined}, '{S.NOT_WS}') then {joined} else {j}::varchar end else {j}::varchar end)"
    )


@query(f"with {raw_sql(CONTENTS)} select i, {content_sql('j')} as content from (select i::bigint as i, raw::json as j from v)")
def p02_content_to_text(spark, sf_dir):
    return raw_json(spark, sf_dir, CONTENTS).select("i", P.content_to_text(F.parse_json("raw")).alias("content"))


@query("select page_id, length(replace(html, chr(0), ''))::bigint as n_chars, html as content from pages where html is not null")
def p03_clean_text(spark, sf_dir):
    clean = P.clean_text(F.col("html"))
    return table(spark, sf_dir, "pages").where("html is not null").select("page_id", F.length(clean).cast("long").alias("n_chars"), clean.alias("content"))


MESSAGES = [
    (1, '{"role":"human","content":"hi","timestamp":1704067200000}'), (2, '"just text"'), (3, "17"), (4, '{"role":" Assistant ","content":["a","b"],"timestamp":"2024-01-01"}'),
    (5, '{"role":"system","content":{"k":1}}'), (6, '{"role":5,"content":null,"timestamp":-4}'), (7, '{"content":"no role","timestamp":" 12 "}'), (8, '{"role":"GPT","content":true}'),
]
_R = "lower(trim(coalesce(case when json_type(j, '$.role') = 'VARCHAR' then j->>'$.role' end, '')))"
_ALIAS = " ".join(f"when {_R} = '{a}' then '{t}'" for a, t in C.ROLE_ALIASES.items())


@query(
    f"""with v(i, raw) as (values {sql_values(MESSAGES)}), m as (select i::bigint as i, raw::json as j from v),
c as (select i, j, case when json_type(j) = 'OBJECT' then coalesce(json_extract(j, '$.content'), 'null'::json) else j end as cj, case when json_type(j) = 'OBJECT' then json_extract(j, '$.timestamp') end as tj from m)
select i, case when json_type(j) <> 'OBJECT' then 'user' when {_R} in ('user', 'assistant') then {_R} {_ALIAS} else 'user' end as role, {content_sql('cj')} as content,
case when json_type(tj) = 'VARCHAR' and try_cast(trim(tj->>'$') as double) is null then epoch_ms(try_cast(tj->>'$' as timestamp))::double
     when try_cast(trim(tj->>'$') as double) between 0 and {C.MAX_TS_MS} then try_cast(trim(tj->>'$') as double) end as timestamp_ms from c"""
)
def p04_message(spark, sf_dir):
    return values(spark, MESSAGES, "i long, raw string").select("i", P.message(F.parse_json("raw")).alias("m")).select("i", "m.role", "m.content", "m.timestamp_ms")


STAMPS = [
    (1, "1683504000000", 1683504000000.0), (2, "4104153600000", 4104153600000.0), (3, '"1970-01-01T00:00:01.001Z"', 1001.0), (4, '"1970-01-01T00:00:01.003Z"', 1003.0),
    (5, '"2023-05-08T13:56:00+08:00"', 1683525360000.0), (6, '"2023-05-08T13:56:00.123456789Z"', 1683554160123.0), (7, '"1969-12-31T23:59:59.999999Z"', None),
    (8, '"2023/05/20 (Sat) 02:21"', 1684549260000.0), (9, '"2023/05/20 (Sat) 02:21 x"', None), (10, "1e30", None), (11, "-5", None), (12, '"nan"', None), (13, '"yesterday"', None),
    (14, '"1704067200000"', 1704067200000.0), (15, '" 12 "', 12.0), (16, '"1_000"', 1000.0), (17, "true", 1.0), (18, "null", None), (19, '"2023/5/8"', 1683504000000.0), (20, '"2023/05/08 13:56:07"', 1683554167000.0),
    (21, '"2023-02-30"', None), (22, "253402214400000", 253402214400000.0), (23, "253402214400001", None), (24, '"2024-01-01 10:00"', 1704103200000.0), (25, "[1]", None),
]


@query(f"with v(i, raw, timestamp_ms) as (values {sql_values(STAMPS)}) select i::bigint as i, timestamp_ms::double as timestamp_ms from v")
def p05_timestamp_coerce(spark, sf_dir):
    return values(spark, [(i, raw) for i, raw, _ in STAMPS], "i long, raw string").select("i", P.timestamp_ms(F.parse_json("raw")).alias("timestamp_ms"))


DATES = [(i, raw[1:-1], ms) for i, raw, ms in STAMPS if raw[0] == '"' and i not in (14, 15, 16)]


@query(f"with v(i, raw, ms) as (values {sql_values(DATES)}) select i::bigint as i, ms::bigint as ms from v")
def p06_date_string_parse(spark, sf_dir):
    return values(spark, [(i, raw) for i, raw, _ in DATES], "i long, raw string").select("i", P.date_to_ms(F.col("raw")).alias("ms"))


IDS = [(1, '"u1"'), (2, "12"), (3, "true"), (4, "null"), (5, '"a\\u0000b"'), (6, '""'), (7, "[1]"), (8, "1.5")]


@query(f"with {raw_sql(IDS)} select i::bigint as i, case when i = 5 then null when json_type(raw) in ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE') then raw::json->>'$' end as id from v")
def p07_check_id(spark, sf_dir):
    return raw_json(spark, sf_dir, IDS).select("i", P.check_id(F.parse_json("raw")).alias("id"))


LISTS = [(1, "null"), (2, '"hi"'), (3, '[null,"a",{"role":"user"}]'), (4, '{"role":"user"}'), (5, "7"), (6, "[]"), (7, "true")]


@query(f"with {raw_sql(LISTS)} select i::bigint as i, case json_type(raw) when 'ARRAY' then len(list_filter(json_extract(raw, '$[*]'), lambda e: json_type(e) <> 'NULL')) when 'NULL' then 0 when 'BOOLEAN' then 0 else 1 end::int as n from v")
def p08_messages_coerce(spark, sf_dir):
    return raw_json(spark, sf_dir, LISTS).select("i", F.size(P.messages(F.parse_json("raw"))).alias("n"))


ASKED = [(1, "null"), (2, '"who"'), (3, '{"a":1}'), (4, "5"), (5, "true"), (6, '["x",1]')]


@query(f"with {raw_sql(ASKED)} select i::bigint as i, case json_type(raw) when 'NULL' then '' when 'VARCHAR' then raw::json->>'$' when 'BOOLEAN' then 'True' else raw::json::varchar end as q from v")
def p09_query_coerce(spark, sf_dir):
    return raw_json(spark, sf_dir, ASKED).select("i", P.query_text(F.parse_json("raw")).alias("q"))


TOPS = [(1, "true", 1), (2, "5.0", 5), (3, '"10"', 10), (4, "250", 100), (5, "0", 100), (6, '"lots"', 100), (7, "null", 100), (8, '"7.9"', 7), (9, "-3", 100), (10, "[3]", 100)]


@query(f"with v(i, raw, k) as (values {sql_values(TOPS)}) select i::bigint as i, least(k, 100)::int as k from v")
def p10_topk_coerce(spark, sf_dir):
    return values(spark, [(i, raw) for i, raw, _ in TOPS], "i long, raw string").select("i", P.top_k(F.parse_json("raw")).alias("k"))


OPTIONS = [(1, "null"), (2, '"a"'), (3, '["a",null,2,{"b":1}]'), (4, "3"), (5, "[]")]


@query(f"with {raw_sql(OPTIONS)} select i::bigint as i, case json_type(raw) when 'NULL' then null when 'ARRAY' then array_to_string(list_transform(list_filter(json_extract(raw, '$[*]'), lambda e: json_type(e) <> 'NULL'), lambda e: e->>'$'), '|') else raw::json->>'$' end as opts from v")
def p11_options_coerce(spark, sf_dir):
    o = P.options(F.parse_json("raw"))
    return raw_json(spark, sf_dir, OPTIONS).select("i", F.when(o.isNotNull(), F.array_join(o, "|")).alias("opts"))


@query(f"with {S.SEGMENTS} select id, user_id, coalesce(speaker_name, role) || ': ' || text as embed_text from seg")
def p13_embed_text(spark, sf_dir):
    return deco.segments(spark, sf_dir).select("id", "user_id", P.embed_text(F.col("speaker_name"), F.col("role"), F.col("text")).alias("embed_text"))


ADDS = [
    (1, '{"request_id":"r","user_id":"u","messages":[]}'), (2, '{"request_id":"","user_id":"u"}'), (3, '{"user_id":7,"request_id":8,"session_id":true}'), (4, "[1]"), (5, "broken"), (6, '{"request_id":"a\\u0000","user_id":"u"}'),
]


@query("select * from (values (2::bigint, 'request_id'), (3, 'session_id'), (4, 'body'), (4, 'request_id'), (4, 'user_id'), (5, 'body'), (5, 'request_id'), (5, 'user_id'), (6, 'request_id')) as t(i, loc)")
def p14_validation_errors(spark, sf_dir):
    _, bad = P.add_requests(values(spark, ADDS, "i long, value string"))
    return bad.select("i", "loc")


# segments -------------------------------------------------------------------------------------------------------------


@query(
    """with r as (select event_id, user_id::varchar as user_id, event_type as request_id, sha256(coalesce(props, '')) as payload_sha from events),
f as (select *, row_number() over w as n, first_value(payload_sha) over w as won from r window w as (partition by user_id, request_id order by event_id, payload_sha))
select event_id, case when n = 1 then 'accepted' when payload_sha = won then 'replay' else 'conflict' end as status from f"""
)
def g01_request_idempotency(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    r = e.select("event_id", F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("request_id"), F.sha2(F.coalesce("props", F.lit("")), 256).alias("payload_sha"), F.col("event_id").alias("arrival"))
    return G.idempotency_gate(r).select("event_id", "status")


@query(
    """with r as (select event_id, user_id::varchar as user_id, event_type as request_id, sha256(coalesce(props, '')) as payload_sha from events),
l as (select user_id, request_id, payload_sha from (select *, row_number() over (partition by user_id, request_id order by event_id) as n from r where event_id % 2 = 0) where n = 1),
f as (select r.*, l.payload_sha as stored, row_number() over w as n, first_value(r.payload_sha) over w as won from r left join l using (user_id, request_id) where event_id % 2 = 1 window w as (partition by r.user_id, r.request_id order by event_id))
select event_id, case when stored is null and n = 1 then 'accepted' when payload_sha = coalesce(stored, won) then 'replay' else 'conflict' end as status from f"""
)
def s06_ledger_gate(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    r = e.select("event_id", F.col("user_id").cast("string").alias("user_id"), F.col("event_type").alias("request_id"), F.sha2(F.coalesce("props", F.lit("")), 256).alias("payload_sha"), F.col("event_id").alias("arrival"))
    ledger = G.idempotency_gate(r.where("event_id % 2 = 0")).where("status = 'accepted'").select("user_id", "request_id", "payload_sha")
    return G.idempotency_gate(r.where("event_id % 2 = 1"), ledger).select("event_id", "status")


@query("select conv_id, turn, row_number() over (partition by conv_id order by turn)::int as seq from conversations where text is not null and regexp_matches(text, '[^ ]')")
def g02_seq_assign(spark, sf_dir):
    m = G.assign_seq(P.drop_blank(deco.messages(spark, sf_dir)))
    return m.select(F.col("arrival").alias("conv_id"), F.col("idx").cast("long").alias("turn"), F.col("seq").cast("int").alias("seq"))


@query(
    f"""with {S.MESSAGES} select arrival as conv_id, idx, strftime(make_timestamp(at_ms * 1000), '%Y-%m-%d %H:%M:%S') as ts,
case when at_ms is null then 'unknown' when at_ms % 86400000 = 0 then 'date' else 'datetime' end as granularity,
case when ms is not null then 'given' when at_ms is not null then 'inherited' else 'unknown' end as provenance from timed"""
)
def g03_timestamp_impute(spark, sf_dir):
    m = G.impute_timestamps(G.assign_seq(P.drop_blank(deco.messages(spark, sf_dir))))
    return m.select(F.col("arrival").alias("conv_id"), "idx", iso(F.col("ts_value")).alias("ts"), F.col("ts_granularity").alias("granularity"), F.col("ts_provenance").alias("provenance"))


@query("select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as at, case when ts = date_trunc('day', ts) then 'date' else 'datetime' end as granularity from events")
def g04_granularity(spark, sf_dir):
    ts = G.ts_from_ms(F.unix_micros(F.col("ts").cast("timestamp")) / 1000.0)
    return table(spark, sf_dir, "events").select("event_id", iso(ts).alias("at"), G.granularity(ts).alias("granularity"))


@query(f"select doc_id, i - 1 as i, s[i] as sentence from (select doc_id, s, unnest(range(1, len(s) + 1)) as i from (select doc_id, {S.spans("coalesce(text, '')")} as s from documents))")
def g05_sentence_spans(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(T.sentence_spans(F.coalesce("text", F.lit("")))).alias("i", "sentence")).withColumn("i", F.col("i").cast("long"))


@query(f"select conv_id, turn, len({S.sentences('text')})::int as n_sentences, array_to_string({S.sentences('text')}, '¦') as joined from (select conv_id, turn, coalesce(text, '') as text from conversations)")
def g06_sentence_split(spark, sf_dir):
    d = table(spark, sf_dir, "conversations").withColumn("s", T.split_sentences(F.coalesce("text", F.lit(""))))
    return d.select("conv_id", "turn", F.size("s").alias("n_sentences"), F.array_join("s", "¦").alias("joined"))


@query(f"select doc_id, len(p)::int as n_parts, i::int as part, p[i] as piece, {S.tok('p[i]')} as n_tokens from (select doc_id, p, unnest(range(1, len(p) + 1)) as i from (select doc_id, {S.pieces("coalesce(text, '')")} as p from documents))")
def g07_segment_split(spark, sf_dir):
    p = T.let(T.split_long(F.coalesce("text", F.lit(""))), lambda p: F.transform(p, lambda x: F.struct(x.alias("piece"), F.size(p).alias("n_parts"))))
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(p).alias("i", "p")).select("doc_id", "i", "p.*")
    return d.select("doc_id", "n_parts", (F.col("i") + 1).alias("part"), "piece", T.token_count(F.col("piece")).alias("n_tokens"))


@query(f"select doc_id, {S.tok('text')} as n_tokens from (select doc_id, coalesce(text, '') as text from documents)")
def g08_token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.token_count(F.coalesce("text", F.lit(""))).alias("n_tokens"))


@query(f"with {S.MESSAGES} select arrival as conv_id, idx, {S.speaker('content')} as speaker from msg")
def g09_speaker_prefix(spark, sf_dir):
    return deco.messages(spark, sf_dir).select(F.col("arrival").alias("conv_id"), "idx", T.speaker_prefix(F.col("content")).alias("speaker"))


@query(f"with {S.MESSAGES} select arrival as conv_id, idx, {S.is_rule('content', 'role')} as is_rule from msg")
def g10_rule_flag(spark, sf_dir):
    return deco.messages(spark, sf_dir).select(F.col("arrival").alias("conv_id"), "idx", T.looks_like_rule(F.col("content"), F.col("role")).alias("is_rule"))


@query("select conv_id, turn, substring(sha256(role || chr(10) || coalesce(text, '')), 1, 24) as content_sha from conversations")
def g11_content_sha(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.content_sha(F.col("role"), F.coalesce("text", F.lit(""))).alias("content_sha"))


_SEG = "user_id, id, session_id, request_id, seq, part, total, role, speaker_name, ts_value, ts_granularity, ts_provenance, text, content_sha, is_rule"


@query(f"with {S.SEGMENTS} select {_SEG.replace('ts_value', chr(115) + 'trftime(ts_value, ' + repr('%Y-%m-%d %H:%M:%S') + ') as ts_value')} from seg")
def g12_segments(spark, sf_dir):
    return deco.segments(spark, sf_dir).withColumn("ts_value", iso(F.col("ts_value"))).select(*G.SEGMENT_COLUMNS)


@query(f"with {S.SEGMENTS} select coalesce(speaker_name, role) || ': ' || text as embed_text, count(*) as n_segments from seg group by 1")
def g13_embed_dedup(spark, sf_dir):
    s = deco.segments(spark, sf_dir)
    one = G.embed_inputs(s).withColumn("embedding", F.array(F.length("embed_text").cast("float")))
    back = G.attach_vectors(s, one)
    return back.groupBy(P.embed_text(F.col("speaker_name"), F.col("role"), F.col("text")).alias("embed_text")).agg(F.count("embedding").alias("n_segments"))


# storage --------------------------------------------------------------------------------------------------------------


def _stored(spark, sf_dir, stream: bool, embed=None):
    """Conversations as raw Add lines, through the store in a scratch folder of the shared directory."""
    from ..sources.store import Store, add_lines
    from ..streaming.ingest import add_stream

    base = new_path(spark, "store")
    m = deco.messages(spark, sf_dir)
    one = F.struct("idx", "role", "content", F.col("timestamp_ms").cast("long").alias("timestamp"))
    r = m.groupBy("user_id", "session_id", "request_id", "arrival").agg(F.array_sort(F.collect_list(one)).alias("messages"))
    lines = r.select(F.to_json(F.struct("user_id", "session_id", "request_id", "arrival", "messages")).alias("value"), "arrival")
    store = Store(spark, f"{base}/store")
    if stream:
        lines.select("value").write.text(f"{base}/in")
        add_stream(spark.readStream.text(f"{base}/in"), store, f"{base}/check").awaitTermination()
    else:
        add_lines(store, lines, 1, embed)
    return store


_STORED = f"with {S.SEGMENTS} select id, user_id, seq, part, total, strftime(ts_value, '%Y-%m-%d %H:%M:%S') as ts, text, is_rule from seg"


def _stored_rows(store):
    return store.segments().select("id", "user_id", "seq", "part", "total", iso(F.col("ts_value")).alias("ts"), "text", "is_rule")


@query(_STORED)
def s01_add_batch(spark, sf_dir):
    return _stored_rows(_stored(spark, sf_dir, False))


@query(_STORED)
def s01_add_stream(spark, sf_dir):
    return _stored_rows(_stored(spark, sf_dir, True))


@query(f"with {S.SEGMENTS} select id, user_id, length(coalesce(speaker_name, role) || ': ' || text)::double as vector from seg")
def s08_backfill_vectors(spark, sf_dir):
    from ..sources.store import embedder
    from ..streaming.ingest import backfill_all

    store = _stored(spark, sf_dir, False)
    backfill_all(store, embedder(lambda texts: [[float(len(t))] for t in texts], clip=10**9), 2, limit=1_000_000)
    return store.segments().select("id", "user_id", F.col("embedding")[0].cast("double").alias("vector"))


@query(f"with {S.SEGMENTS} select user_id, id, session_id, seq, part, (row_number() over (partition by user_id order by session_id, seq, part) - 1)::int as pos from seg where user_id in ('u1', 'u3')")
def s04_user_scan(spark, sf_dir):
    return I.positions(_stored(spark, sf_dir, False).segments(["u1", "u3"])).select("user_id", "id", "session_id", "seq", "part", "pos")


@query("select true as ok, 'whole' as state union all select false, 'without a table'")
def s03_health(spark, sf_dir):
    """A store, and one whose ledger was lost."""
    from ..sources.store import Store

    store = Store(spark, new_path(spark, "store"))
    store.create()
    whole = store.health().withColumn("state", F.lit("whole"))
    return whole.unionByName(Store(spark, new_path(spark, "store")).health().withColumn("state", F.lit("without a table")))


@query(f"with {S.SEGMENTS} select user_id, id, length(coalesce(speaker_name, role) || ': ' || text)::double as vector from seg where seq = 2")
def s10_anchor_vectors(spark, sf_dir):
    from ..sources.store import embedder

    store = _stored(spark, sf_dir, False, embedder(lambda texts: [[float(len(t))] for t in texts], clip=10**9))
    wanted = deco.segments(spark, sf_dir).where("seq = 2").select("user_id", "id")
    return store.anchor_vectors(wanted.unionByName(spark.createDataFrame([("u0", "none#1.1")], "user_id string, id string"))).select("user_id", "id", F.col("embedding")[0].cast("double").alias("vector"))


@query("select unnest(['requests', 'segments', 'vectors']) as name, unnest([true, true, true]) as found_stale, unnest([0, 0, 0])::bigint as n_rows")
def s12_stale_schema(spark, sf_dir):
    """A store whose table notes another schema is stale, and empty after its rebuilding."""
    out = None
    for name in ("requests", "segments", "vectors"):
        store = _stored(spark, sf_dir, False)
        held = spark.read.parquet(f"{store.path}/schema")
        changed = held.withColumn("ddl", F.when(F.col("name") == name, F.lit("id string")).otherwise(F.col("ddl"))).collect()  # three rows
        spark.createDataFrame(changed, held.schema).write.mode("overwrite").parquet(f"{store.path}/schema")
        stale = store.stale()
        store.rebuild()
        row = store.segments().agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), F.lit(stale).alias("found_stale"), "n_rows")
        out = row if out is None else out.unionByName(row)
    return out


@query("select item_id, case when item_id % 10 = 3 then null else length(t)::double end as vector from (select item_id, substring(text, 1, 50) as t from benchmark)")
def s13_embed_batches(spark, sf_dir):
    """Texts in batches of one, clipped; those of each tenth item fail at every try."""
    from ..sources.store import embedder

    def encode(texts):
        if any(t.startswith("#3#") for t in texts):
            raise RuntimeError("refused")
        return [[float(len(t) - 3)] for t in texts]

    d = table(spark, sf_dir, "benchmark").withColumn("embed_text", F.concat(F.lit("#"), (F.col("item_id") % 10).cast("string"), F.lit("#"), "text"))
    vectors = embedder(encode, batch=1, clip=53, tries=2, wait=0.0)(d.select("embed_text").distinct())
    return d.join(vectors, "embed_text").select("item_id", F.col("embedding")[0].cast("double").alias("vector"))


@query(
    f"""{S.channel_chain(True)}, qe as (select query_id, list_transform(range(1, 65), lambda i: length(q) / i::double) as vector from qs),
{S.nearest('near', 'qe')} select query_id, user_id, pos, rank from near"""
)
def s14_query_vectors(spark, sf_dir):
    """Queries embedded by a step like that of the segments, then searched."""
    from ..sources.store import embedder

    q = CH.prepare_queries(deco.queries(spark))
    embed = embedder(lambda texts: [[len(t) / i for i in range(1, 65)] for t in texts])
    v = q.select("query_id", F.col("q").alias("embed_text")).join(embed(q.select(F.col("q").alias("embed_text")).distinct()), "embed_text")
    v = v.select("query_id", F.transform("embedding", lambda x: x.cast("double")).alias("vector"))
    return CH.vector(q, v, deco.index(spark, sf_dir, vectors=True)).select("query_id", "user_id", "pos", "rank")


@query(
    """with o as (select conv_id as query_id, turn::int as pos, (row_number() over (partition by conv_id order by turn) - 1)::int as rank, count(*) over (partition by conv_id) as n, length(coalesce(text, ''))::double as len from conversations)
select query_id, pos, (row_number() over (partition by query_id order by case when query_id % 4 = 0 and n > 1 then -len end, rank) - 1)::int as rank from o"""
)
def s15_rerank_scores(spark, sf_dir):
    """Scores count for one conversation in four; for the others the scorer fails, gives too few or gives no number."""
    from ..sources.store import reranker

    d = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id"), F.lit("u").alias("user_id"), F.col("turn").cast("int").alias("pos"), F.coalesce("text", F.lit("")).alias("content"))
    order = FU._rerank(d, F.col("pos")).withColumn("score", F.lit(0.0))

    def score(q, docs):
        if q == "1":
            raise RuntimeError("refused")
        return [float(len(t)) for t in docs] if q == "0" else [1.0] * (len(docs) + 1) if q == "2" else [float("nan")] * len(docs)

    rs = reranker(score)(order.withColumn("q", (F.col("query_id") % 4).cast("string")))
    return FU.apply_rerank(order.drop("content"), rs).select("query_id", "pos", "rank")


# replay files ---------------------------------------------------------------------------------------------------------


def _turns(spark, sf_dir):
    """Conversations as the turns of the replay formats: sessions of four turns, rising."""
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.floor(F.col("turn") / 4).cast("int").alias("s"), P.normalize_role(F.col("role")).alias("role"), F.coalesce("text", F.lit("")).alias("content"))


_TURNS = f"t as (select conv_id, turn, (turn // 4)::int as s, {S.ROLE} as role, coalesce(text, '') as content from conversations)"
_NOT_BLANK = f"regexp_matches(content, '{S.NOT_WS}')"


def _array_file(spark, rows, name):
    """rows (value), JSON texts, as a folder of files, each one JSON array of one partition's rows."""
    path = new_path(spark, name)

    def array(batches):
        before = "["
        for b in batches:
            for at in range(0, len(b), 256):
                out = []
                for v in b.column(0).slice(at, 256).to_pylist():
                    out.append(before + v)
                    before = ","
                yield pa.RecordBatch.from_pydict({"value": out})
        yield pa.RecordBatch.from_pydict({"value": ["[]" if before == "[" else "]"]})

    rows.mapInArrow(array, "value string").write.text(path)
    return path


def _listed(d, *fields):
    return F.transform(F.array_sort(F.collect_list(F.struct("turn", F.struct(*fields).alias("t")))), lambda x: x["t"])


@query(f"""with {_TURNS} select conv_id::varchar as who, (s + 1)::int as session, case when turn = first_value(turn) over w or role = first_value(role) over w then 'user' else 'assistant' end as role,
  role || ': ' || content as content, 'D' || turn as ref, (row_number() over w)::int as ord, (1683550560000 + s * 86400000)::double as timestamp_ms from t window w as (partition by conv_id order by turn)""")
def s16_sessions_json(spark, sf_dir):
    from ..sources import datasets as D

    t = _turns(spark, sf_dir)
    s = t.groupBy("conv_id", "s").agg(_listed(t, F.col("role").alias("speaker"), F.col("content").alias("text"), F.concat(F.lit("D"), F.col("turn").cast("string")).alias("dia_id")).alias("turns"))
    named = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("session_"), (F.col("s") + 1).cast("string")), F.to_json("turns"))))
    dates = F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("session_"), (F.col("s") + 1).cast("string"), F.lit("_date_time")), F.concat(F.lit('"12:56 pm on '), F.date_format(F.date_add(F.lit("2023-05-08").cast("date"), F.col("s")), "d MMMM, yyyy"), F.lit('"')))))
    body = F.array_join(F.transform(F.map_entries(F.map_concat("a", "b")), lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"])), ", ")
    c = s.groupBy("conv_id").agg(named.alias("a"), dates.alias("b"))
    rows = c.select(F.concat(F.lit('{"qa": [{"question": "'), F.col("conv_id").cast("string"), F.lit('", "answer": "x", "category": 1}], "conversation": {'), body, F.lit("}}")).alias("value"))
    m, q = D.read_sessions_json(spark, _array_file(spark, rows, "sessions"))
    m = m.join(q.select("conv", F.col("question").alias("who")), "conv")
    return m.select("who", "session", "role", "content", "ref", F.col("ord").cast("int").alias("ord"), "timestamp_ms")


@query(f"""with {_TURNS}, k as (select * from t where {_NOT_BLANK})
select conv_id::varchar as qid, s as session, 'h' || s as ref, role, content, (row_number() over (partition by conv_id order by turn))::int as ord, turn % 3 = 0 as has_answer from k""")
def s17_haystack_json(spark, sf_dir):
    from ..sources import datasets as D

    t = _turns(spark, sf_dir)
    s = t.groupBy("conv_id", "s").agg(_listed(t, "role", "content", (F.col("turn") % 3 == 0).alias("has_answer")).alias("turns"))
    one = F.array_sort(F.collect_list(F.struct("s", "turns")))
    c = s.groupBy("conv_id").agg(one.alias("l"))
    ids = F.transform("l", lambda x: F.concat(F.lit("h"), x["s"].cast("string")))
    row = F.struct(
        F.col("conv_id").cast("string").alias("question_id"), F.lit("q").alias("question"), F.lit("t").alias("question_type"), F.lit("2023/05/30 (Tue) 10:00").alias("question_date"), F.lit("a").alias("answer"), F.slice(ids, 1, 1).alias("answer_session_ids"),
        ids.alias("haystack_session_ids"), F.transform("l", lambda x: F.lit("2023/05/20 (Sat) 02:21")).alias("haystack_dates"), F.transform("l", lambda x: x["turns"]).alias("haystack_sessions"),
    )
    m, q = D.read_haystack_json(spark, _array_file(spark, c.select(F.to_json(row).alias("value")), "haystack"))
    return m.join(q.select("conv", "qid"), "conv").select("qid", "session", "ref", "role", "content", F.col("ord").cast("int").alias("ord"), "has_answer")


@query(f"""with {_TURNS}, k as (select * from t where {_NOT_BLANK} and role in ('user', 'assistant'))
select conv_id::varchar as conv, s as session, role, content, (row_number() over (partition by conv_id order by turn))::int as ord, case when turn % 2 = 0 then (1710460800000 + s * 86400000)::double end as timestamp_ms from k""")
def s18_nested_parquet(spark, sf_dir):
    from ..sources import datasets as D

    t = _turns(spark, sf_dir)
    anchor = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("March-"), (F.col("s") + 15).cast("string"), F.lit("-2024")))
    s = t.groupBy("conv_id", "s").agg(_listed(t, "role", "content", anchor.alias("time_anchor")).alias("turns"))
    c = s.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("s", "turns"))), lambda x: x["turns"]).alias("chat"))
    path = new_path(spark, "nested")
    c.select(F.col("conv_id").cast("string").alias("conversation_id"), "chat", F.lit('{"recall": [{"question": "q", "rubric": ["r"]}]}').alias("probing_questions")).write.parquet(path)
    m, _ = D.read_nested_parquet(spark, path)
    return m.select("conv", "session", "role", "content", F.col("ord").cast("int").alias("ord"), "timestamp_ms")


@query(f"""with {_TURNS}, i as (select *, row_number() over (partition by conv_id order by turn) - 1 as i from t)
select 'x' || conv_id || ':2' as conv, case when role = 'system' then 'user' else role end as role, case when role = 'system' then '[System]: ' || content else content end as content,
  (row_number() over (partition by conv_id order by turn))::int as ord from i where i <= 2 and {_NOT_BLANK} and role in ('user', 'assistant', 'system')""")
def s19_contexts(spark, sf_dir):
    from ..sources import datasets as D

    t = _turns(spark, sf_dir)
    c = t.groupBy("conv_id").agg(_listed(t, "role", "content").alias("turns")).withColumn("id", F.concat(F.lit("x"), F.col("conv_id").cast("string")))
    lines, questions = new_path(spark, "contexts"), new_path(spark, "questions")
    c.select(F.concat(F.lit('{"'), "id", F.lit('": '), F.to_json("turns"), F.lit("}")).alias("value")).write.text(lines)
    ask = c.select(
        F.col("conv_id").alias("question_id"), F.lit("t").alias("question_type"), F.lit("q").alias("user_question_or_message"), F.lit("['yes', 'no']").alias("all_options"), F.lit("yes").alias("correct_answer"),
        F.col("id").alias("shared_context_id"), F.lit(2).alias("end_index_in_shared_context"),
    )
    ask.write.option("header", True).csv(questions)
    m, _ = D.read_contexts(spark, questions, lines)
    return m.select("conv", "role", "content", F.col("ord").cast("int").alias("ord"))


@query(f"""with {_TURNS}, k as (select conv_id as query_id, role = 'assistant' as second, '[2024] ' || role || ': ' || content as line, turn from t)
select query_id, 'user' as speaker_1_name, 'assistant' as speaker_2_name, coalesce(string_agg(line, chr(10) order by turn) filter (not second), '') as speaker_1_memories,
  coalesce(string_agg(line, chr(10) order by turn) filter (second), '') as speaker_2_memories from k group by query_id""")
def s20_memories_by_speaker(spark, sf_dir):
    """The report is written as JSON lines and read again."""
    from ..sources import datasets as D
    from ..sources import sinks

    t = _turns(spark, sf_dir)
    results = t.select(F.col("conv_id").alias("query_id"), F.col("turn").cast("int").alias("place"), F.concat(F.lit("[2024] "), "role", F.lit(": "), "content").alias("content"))
    path = new_path(spark, "report")
    sinks.write_jsonl(sinks.memories_by_speaker(results, t.select(F.col("conv_id").alias("query_id")).distinct()), path)
    return D.read_jsonl(spark, path, "query_id long, speaker_1_name string, speaker_2_name string, speaker_1_memories string, speaker_2_memories string")


@query("select doc_id, case when doc_id % 5 = 0 then null else text || chr(8232) || 'x' end as text, lang from documents")
def s21_jsonl_roundtrip(spark, sf_dir):
    """Lines end at newlines only: U+2028 within a text, and null fields, come back as they were."""
    from ..sources import datasets as D
    from ..sources import sinks

    path = new_path(spark, "lines")
    sinks.write_jsonl(table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.concat("text", F.lit("\u2028x"))).alias("text"), "lang"), path)
    return D.read_jsonl(spark, path, "doc_id long, text string, lang string")


@query("select doc_id, '{\"doc_id\":' || doc_id || ',\"toxic\":' || case when doc_id % 5 = 0 then 'null' else toxic::varchar end || '}' as line from labels")
def s22_jsonl_lines(spark, sf_dir):
    """What stands in the file, null fields included."""
    from ..sources import sinks

    path = new_path(spark, "lines")
    sinks.write_jsonl(table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("toxic")).alias("toxic")), path)
    lines = spark.read.option("lineSep", "\n").text(path)
    return lines.select(F.get_json_object("value", "$.doc_id").cast("long").alias("doc_id"), F.col("value").alias("line"))


# index ----------------------------------------------------------------------------------------------------------------


@query(f"with {S.ROWS} select user_id, id, pos, session_label from rows_")
def i01_position_and_label(spark, sf_dir):
    return I.index_rows(deco.segments(spark, sf_dir)).select("user_id", "id", "pos", "session_label")


@query(f"with {S.ROWS} select user_id, pos, index_text from rows_")
def i02_index_text(spark, sf_dir):
    return I.index_rows(deco.segments(spark, sf_dir)).select("user_id", "pos", "index_text")


@query(
    "select event_id, strftime(ts, '%Y-%m-%d') || '|' || strftime(ts, '%B %Y') || '|' || strftime(ts, '%B ') || day(ts) || ' ' || year(ts) || '|' || day(ts) || ' ' || strftime(ts, '%B %Y') || '|' || strftime(ts, '%a') as dates from events"
)
def i03_date_strings(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.array_join(T.date_strings(F.col("ts").cast("timestamp")), "|").alias("dates"))


@query(f"select term, count(*) as cf, count(distinct doc_id) as df from (select doc_id, unnest({S.tokens('text')}) as term from documents) group by term")
def i04_tokenize_df(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(T.tokens(F.col("text"))).alias("term"))
    return d.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf")).groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))


@query(f"with {S.BM25} select user_id, term, df, n_rows, round(avgdl, 6) as avgdl, round(idf, 6) + 0.0 as idf from terms")
def i05_bm25_stats(spark, sf_dir):
    idx = deco.index(spark, sf_dir)
    return idx.terms.select("user_id", "term", "df", "n_rows", F.round("avgdl", 6).alias("avgdl"), (F.round("idf", 6) + 0.0).alias("idf"))


@query(f"with {S.BM25} select user_id, pos, term, tf, dl::int as dl from post")
def i06_postings(spark, sf_dir):
    return I.postings(I.index_rows(deco.segments(spark, sf_dir))).select("user_id", "pos", "term", "tf", "dl")


@query(f"select doc_id, i::int as i, n[i + 1] as name from (select doc_id, n, unnest(range(0, len(n))) as i from (select doc_id, {S.names("coalesce(text, '')")} as n from documents))")
def i07_extract_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.names(F.coalesce("text", F.lit("")))).alias("i", "name"))


@query(f"with {S.ROWS}, {S.ENTITIES} select user_id, pos, i::int as i, name from nm")
def i08_row_names(spark, sf_dir):
    return I.names_of_rows(I.index_rows(deco.segments(spark, sf_dir)))


PEOPLE = ["Ann", "Anna", "Annabel", "Joanna", "Bob", "Bobby", "Rob", "Robert", "Roberto", "Al", "X", "Caroline", "Carol", "Caro", "Melanie", "Mel", "Camel", "Élan"]


@query(f"with n(x) as (values {sql_values([(p,) for p in PEOPLE])}) select x, array_to_string(list_sort({S.bigrams('x')}), ',') as grams from n where length(x) > 0")
def i09_name_bigrams(spark, sf_dir):
    return values(spark, [(p,) for p in PEOPLE], "x string").select("x", F.array_join(F.array_sort(T.bigrams(F.col("x"))), ",").alias("grams"))


@query(f"with n(x) as (values {sql_values([(p,) for p in PEOPLE])}) select a.x as a, b.x as b, {S.same_person('a.x', 'b.x')} as same from n a, n b where a.x < b.x")
def i10_same_person_pairs(spark, sf_dir):
    n = values(spark, [(p,) for p in PEOPLE], "a string")
    return n.join(n.select(F.col("a").alias("b")), F.col("a") < F.col("b")).withColumn("same", T.same_person(F.col("a"), F.col("b")))


@query(f"with {S.ROWS}, {S.ENTITIES} select user_id, alias from odd")
def i11_ambiguous_names(spark, sf_dir):
    return I.ambiguous_names(I.first_spellings(I.names_of_rows(I.index_rows(deco.segments(spark, sf_dir)))))


@query(f"with recursive {S.ROWS.strip()}, {S.ENTITIES}, {S.GROUPS} select user_id, alias, canonical from grp")
def i12_alias_groups(spark, sf_dir):
    return I.alias_groups(I.names_of_rows(I.index_rows(deco.segments(spark, sf_dir))))


@query(f"with recursive {S.ROWS.strip()}, {S.ENTITIES}, {S.GROUPS} select user_id, canonical, pos from ent")
def i13_entity_postings(spark, sf_dir):
    n = I.names_of_rows(I.index_rows(deco.segments(spark, sf_dir)))
    return I.entity_postings(n, I.alias_groups(n))


@query(f"with {S.ROWS} select user_id, pos, strftime(ts_value, '%Y-%m-%d') as day, strftime(ts_value, '%Y-%m') as month from rows_ where ts_value is not null")
def i14_date_postings(spark, sf_dir):
    return I.date_postings(I.index_rows(deco.segments(spark, sf_dir))).select("user_id", "pos", "day", "month")


@query("select strftime(ts, '%Y-%m') as month, count(*) as n, count(distinct user_id) as users from events group by 1")
def i14_month_counts(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))


@query(f"with {S.ROWS} select user_id, pos from rows_ where is_rule")
def i15_rule_rows(spark, sf_dir):
    return I.rule_rows(I.index_rows(deco.segments(spark, sf_dir)))


@query(f"with {S.ROWS} select user_id, session_id, any_value(session_label) as session_label, count(*) as n from rows_ group by user_id, session_id")
def i16_session_labels(spark, sf_dir):
    rows = I.index_rows(deco.segments(spark, sf_dir))
    return rows.groupBy("user_id", "session_id").agg(F.first("session_label").alias("session_label"), F.count(F.lit(1)).alias("n"))


@query(
    f"""with {S.BM25}, p as (select post.user_id, post.pos, post.term, tf, dl, df, idf from post join terms using (user_id, term))
select user_id, term, count(*) as n_rows, sum(tf)::bigint as tf, sum(dl)::bigint as dl, sum(pos)::bigint as pos, any_value(df) as df, round(any_value(idf), 6) + 0.0 as idf from p group by user_id, term"""
)
def i17_index_roundtrip(spark, sf_dir):
    """Written under a version, found again by it, and rebuilt for another one from other segments (none)."""
    path = new_path(spark, "index")
    build = lambda: deco.segments(spark, sf_dir)
    I.Index.current(spark, path, "a", build, vectors=False)
    I.Index.current(spark, path, "b", lambda: build().limit(0), vectors=False)

    def fails():
        raise ValueError("an index of this version is there")

    back = I.Index.current(spark, path, "a", fails, vectors=False)
    d = back.postings.join(back.terms.select("user_id", "term", "df", "idf"), ["user_id", "term"])
    total = lambda c: F.sum(c).cast("long").alias(c)
    return d.groupBy("user_id", "term").agg(F.count(F.lit(1)).alias("n_rows"), total("tf"), total("dl"), total("pos"), F.first("df").alias("df"), (F.round(F.first("idf"), 6) + 0.0).alias("idf"))


# query analysis -------------------------------------------------------------------------------------------------------

ASK = [
    "What is she currently doing?", "When did they last meet?", "how many days since June", "How many books are there", "list all of them", "whose cat is this", "just tell me", "现在怎么样", "多少钱", "谁来了",
    "Nowhere to go", "please write a poem", "Can you recommend a place?", "what can you do", "  draft an email", "any good ideas for us", "help me plan 2024", "帮我找", "How often do I write", "let's go", "wholly owned", "élast time",
    "the total in 20245", "from Alice on March 5th, 2024 and 8 May 2023, May 2023 too", "2023-02-30 or 2023-12-31", "Sept 3, 2024; sep 03 2024", "3 Jan. 2021, Feb. 2020", "I met Caroline and Bob (Maria)! Then Zoe came.",
    "price 12.50, code 7-11 at 10:30", "room 5", "",
]
_ASK = [(i, q) for i, q in enumerate(ASK)]


#: The written questions, and the text of every turn.
_ASKED = f"v as (select i::bigint as i, q from (values {sql_values(_ASK)}) as l(i, q) union all select 1000 + conv_id * 100 + turn, coalesce(text, '') from conversations)"


def _asked(spark, sf_dir):
    said = table(spark, sf_dir, "conversations").select((1000 + F.col("conv_id") * 100 + F.col("turn")).alias("i"), F.coalesce("text", F.lit("")).alias("q"))
    return values(spark, _ASK, "i long, q string").unionByName(said)


@query(f"with {_ASKED} select i::bigint as i, {S.intent('q')} as intent from v")
def q01_intent_route(spark, sf_dir):
    return _asked(spark, sf_dir).select("i", T.intent(F.col("q")).alias("intent"))


@query(f"with {_ASKED} select i::bigint as i, {S.is_aggregate('q')} as aggregate_type from v")
def q02_aggregate_type(spark, sf_dir):
    return _asked(spark, sf_dir).select("i", T.is_aggregate(F.col("q")).alias("aggregate_type"))


@query(f"with {_ASKED} select i::bigint as i, {S.is_task('q')} as is_task from v")
def q03_task_request(spark, sf_dir):
    return _asked(spark, sf_dir).select("i", T.is_task_request(F.col("q")).alias("is_task"))


@query(f"with {S.QUERIES.strip()} select query_id, q, intent, is_task, is_aggregate, k, n from qs")
def q04_query_expansion(spark, sf_dir):
    return CH.prepare_queries(deco.queries(spark)).select("query_id", "q", "intent", "is_task", "is_aggregate", "k", "n")


@query(f"with {_ASKED} select i::bigint as i, array_to_string({S.literal_terms('q')}, '|') as terms from v")
def q05_literal_terms(spark, sf_dir):
    return _asked(spark, sf_dir).select("i", F.array_join(T.literal_terms(F.col("q")), "|").alias("terms"))


@query(f"with {_ASKED} select i::bigint as i, array_to_string(list_transform({S.days('q')}, lambda d: strftime(d, '%Y-%m-%d')), '|') as days, array_to_string({S.months('q')}, '|') as months from v")
def q06_extract_dates(spark, sf_dir):
    days = F.transform(T.query_days(F.col("q")), lambda d: F.date_format(d, "yyyy-MM-dd"))
    return _asked(spark, sf_dir).select("i", F.array_join(days, "|").alias("days"), F.array_join(T.query_months(F.col("q")), "|").alias("months"))


MONTH_NAMES = [(m[:n].upper() if k % 2 else m[:n],) for k, m in enumerate(C.MONTHS) for n in (3, 9)]


@query(f"with v(m) as (values {sql_values(MONTH_NAMES)}) select m, {S.month_number('m')}::int as n from v")
def q07_month_lookup(spark, sf_dir):
    return values(spark, MONTH_NAMES, "m string").select("m", T.month_number(F.col("m")).alias("n"))


# channels -------------------------------------------------------------------------------------------------------------


@query(f"{S.channel_chain(False)} select query_id, user_id, pos, rank, round(score, 6) + 0.0 as score from c_bm25")
def c01_bm25_topn(spark, sf_dir):
    d = CH.bm25(CH.prepare_queries(deco.queries(spark)), deco.index(spark, sf_dir))
    return d.select("query_id", "user_id", "pos", "rank", (F.round("score", 6) + 0.0).alias("score"))


@query(
    f"""with recursive {S.BM25.strip()}, qs as (select item_id as query_id, 'u' || (item_id % 10) as user_id, text as q, 20 as n from benchmark), {S.C_BM25}
select query_id, user_id, pos, rank, round(score, 6) + 0.0 as score from c_bm25"""
)
def c01_bm25_benchmark(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit("u"), (F.col("item_id") % 10).cast("string")).alias("user_id"), F.col("text").alias("q"), F.lit(20).alias("n"))
    return CH.bm25(q, deco.index(spark, sf_dir)).select("query_id", "user_id", "pos", "rank", (F.round("score", 6) + 0.0).alias("score"))


@query(f"{S.channel_chain(True)} select query_id, user_id, pos, rank, round(distance, 6) + 0.0 as distance from c_vector")
def c02_vector_topn(spark, sf_dir):
    idx = deco.index(spark, sf_dir, vectors=True)
    d = CH.vector(CH.prepare_queries(deco.queries(spark)), deco.query_vectors(spark, sf_dir), idx)
    return d.select("query_id", "user_id", "pos", "rank", (F.round("distance", 6) + 0.0).alias("distance"))


def _channel(name: str):
    return f"{S.channel_chain(False)} select query_id, user_id, pos, rank from {name}"


@query(_channel("c_entity"))
def c03_entity_hits(spark, sf_dir):
    return CH.entity(CH.prepare_queries(deco.queries(spark)), deco.index(spark, sf_dir))


@query(_channel("c_literal"))
def c04_literal_hits(spark, sf_dir):
    q, idx = CH.prepare_queries(deco.queries(spark)), deco.index(spark, sf_dir)
    return CH.literal(q, idx, CH.bm25(q, idx))


@query(_channel("c_date"))
def c05_date_hits(spark, sf_dir):
    return CH.date(CH.prepare_queries(deco.queries(spark)), deco.index(spark, sf_dir))


ALL5 = ("bm25", "vector", "entity", "literal", "date")
_FUSED = f"{S.channel_chain(True)},\n{S.rrf('fused', ALL5)}"
_HOP = f"""{_FUSED},
anch as (select query_id, f.user_id, pos from fused f join qs using (query_id) where rank < {C.HOP_ANCHORS} and (is_aggregate or intent = 'aggregate')),
ht as (select query_id, user_id, term, weight, (row_number() over (partition by query_id order by weight desc, term) - 1)::int as rank from
  (select query_id, a.user_id, term, count(*) * greatest(any_value(idf), 0.0) as weight from anch a join post using (user_id, pos) join terms using (user_id, term)
   where length(term) > 2 and term not in ({S.any_of(C.HOP_STOP)}) and not regexp_full_match(term, '[0-9]+') and not exists (select 1 from qt where qt.query_id = a.query_id and qt.term = post.term) group by all)),
hq as (select query_id, ht.user_id, n, term from ht join qs using (query_id) where rank < {C.HOP_TERMS}),
{S.scored('c_bm25_hop', 'hq')}"""
_ROCCHIO = f"""
au as (select query_id, pos, list_transform(e, lambda x: x / case when list_dot_product(e, e) = 0 then 1 else sqrt(list_dot_product(e, e)) end) as u from anch join vecs using (user_id, pos)),
am as (select query_id, list(m order by i) as c from (select query_id, i, sum(u[i] order by pos) / count(*) as m from au, (select unnest(range(1, 65)) as i) group by query_id, i) group by query_id),
hv as (select query_id, list_transform(list_zip(vector, c), lambda z: {C.HOP_QUERY_WEIGHT}::double * (z[1] / sqrt(list_dot_product(vector, vector))) + {1 - C.HOP_QUERY_WEIGHT}::double * z[2]) as vector from qv join am using (query_id)),
{S.nearest('c_vector_hop', 'hv')}"""


def _first_order(spark, sf_dir, index):
    v = deco.query_vectors(spark, sf_dir)
    q, found, order = FU.first_round(deco.queries(spark), index, v)
    return q, v, found, order


def _hop_inputs(spark, sf_dir):
    idx = deco.index(spark, sf_dir, vectors=True)
    q, v, found, order = _first_order(spark, sf_dir, idx)
    q = q.where("is_aggregate or intent = 'aggregate'")
    return idx, q, v, CH.hop_anchors(order).join(q.select("query_id"), "query_id", "left_semi")


@query(f"{_HOP} select query_id, user_id, term, rank, round(weight, 6) + 0.0 as weight from ht where rank < {C.HOP_TERMS}")
def c06_hop_terms(spark, sf_dir):
    idx, q, _, anchors = _hop_inputs(spark, sf_dir)
    return CH.hop_terms(q, anchors, idx).select("query_id", "user_id", "term", "rank", (F.round("weight", 6) + 0.0).alias("weight"))


@query(f"{_HOP} select query_id, user_id, pos, rank from c_bm25_hop")
def c07_bm25_hop(spark, sf_dir):
    idx, q, _, anchors = _hop_inputs(spark, sf_dir)
    return CH.bm25_hop(q, CH.hop_terms(q, anchors, idx), idx)


@query(f"{_HOP},{_ROCCHIO} select query_id, user_id, pos, rank from c_vector_hop")
def c08_vector_hop(spark, sf_dir):
    idx, q, v, anchors = _hop_inputs(spark, sf_dir)
    return CH.vector_hop(q, v, anchors, idx)


_HOPPED = f"{_HOP},{_ROCCHIO},\n{S.rrf('again', (*ALL5, 'bm25_hop', 'vector_hop'))}"


@query(f"{_HOPPED} select query_id, user_id, pos, rank, round(score, 6) + 0.0 as score from again")
def c09_second_hop(spark, sf_dir):
    idx = deco.index(spark, sf_dir, vectors=True)
    q, v, found, order = _first_order(spark, sf_dir, idx)
    out, _ = FU.second_hop(q, order, found, v, idx)
    return out.select("query_id", "user_id", "pos", "rank", (F.round("score", 6) + 0.0).alias("score"))


# fusion ---------------------------------------------------------------------------------------------------------------


@query(f"{_FUSED} select query_id, user_id, pos, round(score, 6) + 0.0 as score, (row_number() over (partition by query_id order by score desc, first) - 1)::int as rank from fused_f")
def f01_rrf_fuse(spark, sf_dir):
    q, _, found, _ = _first_order(spark, sf_dir, deco.index(spark, sf_dir, vectors=True))
    return FU.rrf(q, FU.union_channels(found)).select("query_id", "user_id", "pos", (F.round("score", 6) + 0.0).alias("score"), "rank")


@query(f"{_FUSED} select query_id, user_id, pos, rank, round(score, 6) + 0.0 as score from fused")
def f02_both_first(spark, sf_dir):
    _, _, _, order = _first_order(spark, sf_dir, deco.index(spark, sf_dir, vectors=True))
    return order.select("query_id", "user_id", "pos", "rank", (F.round("score", 6) + 0.0).alias("score"))


_MIX = 0.75


@query(
    f"""{_FUSED}, w as (select *, least(count(*) over (partition by query_id), {C.RERANK_WINDOW}) as wn, ((pos * 7919 + query_id * 104729) % 1000) / 1000.0::double as rs from fused),
z as (select *, rank < {C.RERANK_WINDOW} as inside, case when rank < {C.RERANK_WINDOW} and wn >= 2 then {_MIX}::double * rs + {1 - _MIX}::double * (1 - rank / wn::double) end as mixed from w)
select query_id, user_id, pos, (row_number() over (partition by query_id order by inside desc, mixed desc nulls last, rank) - 1)::int as rank, round(coalesce(round(mixed, 6), score), 6) + 0.0 as score from z"""
)
def f03_rerank_mix(spark, sf_dir):
    _, _, _, order = _first_order(spark, sf_dir, deco.index(spark, sf_dir, vectors=True))
    rs = order.where(F.col("rank") < C.RERANK_WINDOW).select("query_id", "pos", (((F.col("pos") * 7919 + F.col("query_id") * 104729) % 1000) / 1000.0).alias("rs"))
    out = FU.apply_rerank(order, rs, mix=_MIX)
    return out.select("query_id", "user_id", "pos", "rank", (F.round("score", 6) + 0.0).alias("score"))


_DONE = f"{_FUSED},{S.finish('fused')}"


@query(f"{_DONE} select query_id, user_id, pos, rank, round(score, 6) + 0.0 as score from o1")
def f04_rule_slot(spark, sf_dir):
    idx = deco.index(spark, sf_dir, vectors=True)
    q, _, _, order = _first_order(spark, sf_dir, idx)
    return FU.insert_rules(q, order, idx).select("query_id", "user_id", "pos", "rank", (F.round("score", 6) + 0.0).alias("score"))


@query(f"{_DONE} select query_id, user_id, pos, rank, round(score, 6) + 0.0 as score from o2")
def f05_neighbors(spark, sf_dir):
    idx = deco.index(spark, sf_dir, vectors=True)
    q, _, _, order = _first_order(spark, sf_dir, idx)
    return FU.add_neighbors(q, FU.insert_rules(q, order, idx), idx).select("query_id", "user_id", "pos", "rank", (F.round("score", 6) + 0.0).alias("score"))


@query(f"with {S.ROWS} select user_id, id, {S.render()} as content from rows_ r")
def f06_render(spark, sf_dir):
    r = I.index_rows(deco.segments(spark, sf_dir))
    content = T.render(*(F.col(c) for c in ("ts_value", "ts_granularity", "session_label", "speaker_name", "role", "part", "total", "text")))
    return r.select("user_id", "id", content.alias("content"))


@query(f"with {S.ROWS} select user_id, id, {S.header('ts_value', 'ts_granularity', 'session_label')} as header from rows_")
def f07_date_header(spark, sf_dir):
    r = I.index_rows(deco.segments(spark, sf_dir))
    return r.select("user_id", "id", T.date_header(F.col("ts_value"), F.col("ts_granularity"), F.col("session_label")).alias("header"))


@query(f"select event_id, {S.created_at('ts', 'g')} as created_at from (select event_id, ts, case when ts = date_trunc('day', ts) then 'date' else 'datetime' end as g from events)")
def f08_created_at(spark, sf_dir):
    ts = F.col("ts").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", T.created_at(ts, G.granularity(ts)).alias("created_at"))


_SMALL = 900


@query(f"{_DONE},{S.packed(_SMALL)} select query_id, user_id, place::int as place, pos, id from packed")
def f09_budget_pack(spark, sf_dir):
    idx = deco.index(spark, sf_dir, vectors=True)
    q, _, _, order = _first_order(spark, sf_dir, idx)
    order = FU.add_neighbors(q, FU.insert_rules(q, order, idx), idx)
    return FU.pack_budget(FU.render_rows(order, idx), q, _SMALL).select("query_id", "user_id", "place", "pos", "id")


_RESULT = "query_id, user_id, place::int as place, id, content, round(score, 6) + 0.0 as score, created_at"


@query(f"{_DONE},{S.packed()} select {_RESULT} from packed")
def search_end_to_end(spark, sf_dir):
    idx = deco.index(spark, sf_dir, vectors=True)
    out = FU.search(deco.queries(spark), idx, deco.query_vectors(spark, sf_dir))
    return out.withColumn("score", F.col("score") + 0.0)


@query(f"{_HOPPED},{S.finish('again')},{S.packed()} select {_RESULT} from packed")
def search_with_hop(spark, sf_dir):
    idx = deco.index(spark, sf_dir, vectors=True)
    return FU.search(deco.queries(spark), idx, deco.query_vectors(spark, sf_dir), hop=True).withColumn("score", F.col("score") + 0.0)


# evaluation -----------------------------------------------------------------------------------------------------------


@query(
    f"""with recursive m as (select conv_id // 10 as grp, conv_id * 1000 + turn as ord, len(regexp_extract_all(coalesce(text, ''), '{S.NOT_WS}+')) as w from conversations),
l as (select grp, list({{'o': ord, 'w': w}} order by ord) as l from m group by grp),
f as (select grp, l, 1 as k, 0 as chunk, 1 as n, l[1].w as words from l
  union all select grp, l, k + 1, chunk + nw, case when nw = 1 then 1 else n + 1 end, case when nw = 1 then l[k + 1].w else words + l[k + 1].w end
  from (select *, (n >= 20 or words + l[k + 1].w > 2000)::int as nw from f where k < len(l)))
select grp, l[k].o as ord, chunk::int as chunk from f"""
)
def e01_platform_chunks(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").select(F.floor(F.col("conv_id") / 10).cast("long").alias("grp"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ord"), F.coalesce("text", F.lit("")).alias("text"))
    return E.platform_chunks(c, ["grp"], "ord", "text")


_KNN = """with d as (select q.vec_id as query_id, q.label as gold, e.vec_id as item, e.label,
  round(1 - list_dot_product(q.embedding::double[], e.embedding::double[]) / nullif(sqrt(list_dot_product(q.embedding::double[], q.embedding::double[])) * sqrt(list_dot_product(e.embedding::double[], e.embedding::double[])), 0), 12) as dist
  from embeddings q, embeddings e where q.vec_id % 20 = 0 and q.vec_id <> e.vec_id),
res as (select query_id, item, place from (select *, row_number() over (partition by query_id order by dist, item) - 1 as place from d where dist is not null) where place < 100),
gold as (select q.vec_id as query_id, e.vec_id as item from embeddings q join embeddings e on q.label = e.label and q.vec_id <> e.vec_id where q.vec_id % 20 = 0),
hits as (select query_id, count(*) as n_gold, """ + ", ".join(f"count(place) filter (place < {k}) > 0 as any_{k}, count(place) filter (place < {k}) = count(*) as all_{k}" for k in E.KS) + " from gold left join res using (query_id, item) group by query_id)"


def _knn(spark, sf_dir):
    """Nearest neighbours of every vector whose id is divisible by 20 among all others; gold is every other row of its label."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"), "label")
    items = e.select(F.col("vec_id").alias("item"), "embedding", "label")
    results = E.nearest(q.select("query_id", "vector"), items.select("item", "embedding"), 100)
    gold = q.select("query_id", "label").join(items.select("item", "label"), "label").where("query_id <> item").select("query_id", "item")
    return results, gold


@query(f"{_KNN} select * from hits")
def e02_hit_at_k(spark, sf_dir):
    return E.hit_at_k(*_knn(spark, sf_dir))


@query(
    f"""with recursive {S.ROWS.strip()}, turns as (select id, user_id, session_id, seq from rows_),
res as (select session_id as query_id, id, (row_number() over (partition by session_id order by substring(sha256(id || 'x'), 1, 8), id) - 1) as place from turns),
gold as (select distinct session_id as query_id, seq from turns where seq % 3 = 1),
m as (select query_id, regexp_extract(id, '#([0-9]+)\\.[0-9]+$', 1)::int as seq, min(place) as place from res group by all)
select query_id, count(*) as n_gold, """ + ", ".join(f"count(place) filter (place < {k}) > 0 as any_{k}, count(place) filter (place < {k}) = count(*) as all_{k}" for k in (2, 5)) + " from gold left join m using (query_id, seq) group by query_id"
)
def e03_turn_hits(spark, sf_dir):
    from pyspark.sql import Window as W

    s = deco.segments(spark, sf_dir).select("id", F.col("session_id").alias("query_id"), "seq")
    place = (F.row_number().over(W.partitionBy("query_id").orderBy(F.substring(F.sha2(F.concat("id", F.lit("x")), 256), 1, 8), "id")) - 1).cast("int")
    results = s.select("query_id", E.segment_seq(F.col("id")).alias("item"), place.alias("place"))
    return E.hit_at_k(results, s.where("seq % 3 = 1").select("query_id", F.col("seq").alias("item")), (2, 5))


@query(f"{_KNN}, x as (select h.*, label as grp from hits h join embeddings on vec_id = query_id) select grp, count(*) as n, round(avg(any_10::int), 4) as any_10_mean, median(any_10::int)::double as any_10_median, max(any_10::int)::double as any_10_max, round(avg(n_gold), 4) as n_gold_mean, median(n_gold)::double as n_gold_median, max(n_gold)::double as n_gold_max from x group by rollup(grp)")
def e04_group_summary(spark, sf_dir):
    labels = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("grp"))
    hits = E.hit_at_k(*_knn(spark, sf_dir)).withColumn("any_10", F.col("any_10").cast("int")).join(labels, "query_id")
    return E.group_summary(hits, "grp", ["any_10", "n_gold"])


@query(f"with {S.SEGMENTS} select id, user_id, seq as parsed from seg")
def e05_segment_id_parse(spark, sf_dir):
    return deco.segments(spark, sf_dir).select("id", "user_id", E.segment_seq(F.col("id")).alias("parsed"))


@query("select doc_id, coalesce(case when doc_id % 3 = 0 then quality end, case when doc_id % 3 = 1 then toxic end, 0.5)::double as score from labels")
def e06_score_select(spark, sf_dir):
    a, b = F.when(F.col("doc_id") % 3 == 0, F.col("quality")), F.when(F.col("doc_id") % 3 == 1, F.col("toxic"))
    return table(spark, sf_dir, "labels").select("doc_id", E.pick_score(a, b, F.lit(0.5)).alias("score"))


@query("select 0::bigint as repeated_a, 0::bigint as repeated_b, (select count(*) from documents where doc_id not in (select doc_id from labels)) as only_a, (select count(*) from labels where doc_id not in (select doc_id from documents)) as only_b, (select count(*) from documents where doc_id not in (select doc_id from labels)) + (select count(*) from labels where doc_id not in (select doc_id from documents)) = 0 as same")
def e07_id_parity(spark, sf_dir):
    return E.id_parity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "doc_id")


@query("select lang, round(avg(quality), 4) as accuracy, count(*) as n from labels join documents using (doc_id) group by lang")
def e08_accuracy_by_category(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return E.accuracy_by_category(d, "lang", "quality")


@query("select lang, count(*) as n, sum((toxic > quality)::int)::bigint as wins, sum((toxic < quality)::int)::bigint as losses, sum((toxic > quality)::int - (toxic < quality)::int)::bigint as net from labels join documents using (doc_id) group by rollup(lang)")
def e09_paired_compare(spark, sf_dir):
    d = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    return E.paired_compare(d.withColumn("s", F.col("quality")), d.withColumn("s", F.col("toxic")), "doc_id", "lang", "s")


@query("select doc_id, before, after, direction from (select doc_id, quality as before, toxic as after, case when toxic > quality then 'win' else 'loss' end as direction, row_number() over (partition by toxic > quality order by doc_id) as n from labels where toxic <> quality) where n <= 20")
def e09_flip_list(spark, sf_dir):
    d = table(spark, sf_dir, "labels")
    return E.flips(d.select("doc_id", F.col("quality").alias("s")), d.select("doc_id", F.col("toxic").alias("s")), "doc_id", "s")


@query(
    f"""with {S.SEGMENTS}, v as (select seg.*, (select count(*) from embeddings) as nv from seg),
e as (select v.*, embeddings.vec_id from v left join embeddings on v.part = 1 and v.seq % 5 <> 4 and embeddings.vec_id = (substring(session_id, 2)::bigint * 8 + seq) % greatest(nv, 1))
select count(*) as segments, count(vec_id) as vectors, count(distinct user_id) as users, count(distinct (user_id, session_id)) as sessions, round(count(vec_id) / count(*), 4) as coverage from e"""
)
def e10_manifest_stats(spark, sf_dir):
    return E.manifest(deco.segments_with_vectors(spark, sf_dir))


@query(f"with {S.SEGMENTS} select 'granularity' as what, ts_granularity as value, count(*) as n from seg group by all union all select 'provenance', ts_provenance, count(*) from seg group by all")
def e10_manifest_groups(spark, sf_dir):
    return E.manifest_groups(deco.segments(spark, sf_dir))


#: The numbers of the contract, written out here so that a changed constant shows.
_CONFIG = [
    ("B", "0.75"),
    ("BUDGET_TOKENS", "60000"),
    ("CHANNEL_MULTIPLE", "2"),
    ("DATE_RADIUS", "3"),
    ("EMBED_BATCH", "10"),
    ("EMBED_CLIP", "6000"),
    ("EMBED_DIM", "1024"),
    ("EPSILON", "0.25"),
    ("HOP_ANCHORS", "5"),
    ("HOP_QUERY_WEIGHT", "0.6"),
    ("HOP_RESERVE", "20"),
    ("HOP_TERMS", "8"),
    ("HOP_WEIGHT", "0.6"),
    ("K1", "1.5"),
    ("MAX_TS_MS", "253402214400000"),
    ("NEIGHBOR_AFTER", "20"),
    ("NEIGHBOR_ANCHORS", "10"),
    ("NEIGHBOR_RADIUS", "1"),
    ("NEIGHBOR_RATIO", "0.05"),
    ("RERANK_MIX", "1.0"),
    ("RERANK_WINDOW", "200"),
    ("RRF_K", "60"),
    ("RULE_AFTER", "10"),
    ("RULE_MAX_CHARS", "400"),
    ("RULE_SLOT", "8"),
    ("SEGMENT_MAX_TOKENS", "350"),
    ("TOP_K_CAP", "100"),
    ("VIRTUAL_RANK", "4"),
]


@query(f"select * from (values {sql_values(_CONFIG)}) as t(name, value)")
def e11_effective_config(spark, sf_dir):
    return values(spark, [(k, str(v)) for k, v in E.effective_config().items() if isinstance(v, int | float)], "name string, value string")


ANCHORS = [
    (1, "1:56 pm on 8 May, 2023", "2023-05-08 13:56:00"), (2, "12:05 am on 31 December, 2022", "2022-12-31 00:05:00"), (3, "March-15-2024", "2024-03-15 00:00:00"), (4, "2023/05/20 (Sat) 02:21", "2023-05-20 02:21:00"),
    (5, "2023/05/20", "2023-05-20 00:00:00"), (6, "30 February", None), (7, "February-30-2024", None), (8, "12:00 pm on 1 jan, 2024", "2024-01-01 12:00:00"),
]


@query(f"with v(i, raw, ts) as (values {sql_values(ANCHORS)}) select i::bigint as i, ts from v")
def e12_anchor_time(spark, sf_dir):
    return values(spark, [(i, raw) for i, raw, _ in ANCHORS], "i long, raw string").select("i", iso(E.anchor_time(F.col("raw"))).alias("ts"))
