"""Replay datasets as message and question tables (S16-S19, S21): messages (conv, session, ord, role, content, timestamp_ms,
ref), questions (conv, qid, category, question, options, answer, gold)."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain, groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.evaluation import anchor_time
from .scratch import cut

# Names of the question categories.
CATEGORIES = {1: "multi-hop", 2: "temporal", 3: "open-domain", 4: "single-hop", 5: "adversarial"}


def _ms(ts: Column) -> Column:
    return F.unix_millis(ts)


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines split at newlines only, so that U+2028 within a text is no end of line."""
    reader = spark.read.option("lineSep", "\n")
    return (reader.schema(schema) if schema else reader).json(path)


_ESCAPE = re.compile(r"(?s)\\.")
_BEFORE = re.compile(r'(?s)(?:[^"{]|"(?:[^"\\]|\\.)*")*')


def _braces(piece: str) -> tuple[int, int, int]:
    """(quotes, opening braces before the first quote, behind the second and so on, opening braces between the others)."""
    parts = (_ESCAPE.sub("", piece) if "\\" in piece else piece).split('"')
    return len(parts) - 1, sum(p.count("{") for p in parts[::2]), sum(p.count("{") for p in parts[1::2])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], bool, Iterator[str]]]:
    """((file, start), whether the file ends here, pieces) of each part of a file that a task reads."""
    rows = ((f, at, end, v) for b in batches for k in range(0, len(b), 1024) for v, f, at, end in zip(*(c.to_pylist() for c in b.slice(k, 1024).columns)))
    for (f, at, end), group in groupby(rows, key=lambda r: r[:3]):
        yield (f, at), end, (r[3] for r in group)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each part of a file and for either state at its start (outside a string, inside one): the state at its end,
    the change of depth, the lowest depth behind a closing brace and how often it is reached. The file's last piece has
    no closing brace here."""
    for (file, start), end, pieces in _runs(batches):
        state = [[inside, 0, 1, 0] for inside in (0, 1)]
        held = None
        for piece in chain(pieces, [None]):
            if held is not None:
                quotes, even, odd = _braces(held)
                for x in state:
                    x[1] += odd if x[0] else even
                    x[0] ^= quotes & 1
                    if not x[0] and not (end and piece is None):
                        x[1] -= 1
                        if x[1] <= x[2]:
                            x[2:] = [x[1], x[3] + 1 if x[1] == x[2] else 1]
            held = piece
        yield pa.RecordBatch.from_pylist([{"file": file, "start": start, "end": end, "before": k, "inside": x[0], "delta": x[1], "low": x[2], "lows": x[3]} for k, x in enumerate(state)])


def _documents(spark: SparkSession, path: str) -> DataFrame:
    """(conv, v): each object of JSON array files, or of JSON lines files, as a variant with its number, in the order of
    files and places. Values that are no objects are left out. A file is read in pieces that end at a brace, by as many tasks
    as Spark splits it for: first each part of a file tells what it does to quotes and depth, then, with the state at its
    start known, its objects are cut out; those that cross parts are put together. So a file may be of any size, and one
    object of up to the size of a variant."""
    m = F.col("_metadata")
    ends = m["file_block_start"] + m["file_block_length"] >= m["file_size"]
    pieces = spark.read.option("lineSep", "}").text(path).select("value", m["file_path"].alias("file"), m["file_block_start"].alias("start"), ends.alias("end"))
    parts = pieces.mapInArrow(_summed, "file string, start long, end boolean, before long, inside long, delta long, low long, lows long").collect()  # two rows a part
    known: dict[tuple[str, int], tuple[int, int, int]] = {}
    last, inside, depth, number = None, 0, 0, 0
    for (file, start), rows in groupby(sorted(parts, key=lambda r: (r["file"], r["start"], r["before"])), key=lambda r: (r["file"], r["start"])):
        if file != last:
            number += depth > 0
            last, inside, depth = file, 0, 0
        known[file, start] = (inside, depth, number)
        r = list(rows)[inside]
        number += r["lows"] if depth + r["low"] == 0 else 0
        inside, depth = r["inside"], depth + r["delta"]

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (file, start), end, pieces in _runs(batches):
            inside, depth, number = known[file, start]
            whole, parts, out, size = depth == 0, [], [], 0
            for piece in pieces:
                quotes, even, odd = _braces(piece)
                if not depth:
                    if not even:
                        inside ^= quotes & 1
                        continue
                    piece = piece[_BEFORE.match(piece).end() :]
                depth += odd if inside else even
                inside ^= quotes & 1
                parts += [piece, "}"]
                if not inside:
                    depth -= 1
                    if not depth:
                        out.append((number, start, whole, "".join(parts)))
                        size += len(out[-1][3])
                        number, whole, parts = number + 1, True, []
                if size > 1 << 22:
                    yield _rows(out)
                    out, size = [], 0
            if parts:
                out.append((number, start, False, "".join(parts)))
            if out:
                yield _rows(out)

    found = cut(pieces.mapInArrow(cut_out, "conv long, start long, whole boolean, value string"), "objects")
    crossing = found.where("not whole").groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda x: x["value"]), "").alias("value"))
    return found.where("whole").select("conv", "value").unionByName(crossing).select("conv", F.try_parse_json("value").alias("v"))


def _rows(out: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["conv", "start", "whole", "value"])


def read_sessions_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Conversations whose session_1, session_2, ... are lists of turns, flattened in numeric order. The speaker of the
    first turn is the user, all others are assistants; captions of shared images go behind the text; the speaker comes
    before it."""
    d = _documents(spark, path).select("conv", F.try_variant_get("v", "$.conversation", "map<string,variant>").alias("c"), F.try_variant_get("v", "$.qa", "array<variant>").alias("qa"))
    entries = d.select("conv", "c", F.explode(F.map_entries("c")).alias("e")).where(F.col("e.key").rlike(r"^session_[0-9]+$"))
    time = anchor_time(F.try_variant_get(F.element_at("c", F.concat(F.col("e.key"), F.lit("_date_time"))), "$", "string"))
    turns = entries.select(
        "conv", F.regexp_extract("e.key", "([0-9]+)", 1).cast("int").alias("session"), _ms(time).cast("double").alias("timestamp_ms"),
        F.posexplode(F.try_variant_get("e.value", "$", "array<struct<speaker:string,text:string,blip_caption:string,dia_id:string>>")).alias("turn", "t"),
    )
    order = W.partitionBy("conv").orderBy("session", "turn")
    text = F.when(F.coalesce(F.col("t.blip_caption"), F.lit("")) != "", F.concat(F.col("t.text"), F.lit(" [shared image: "), F.col("t.blip_caption"), F.lit("]"))).otherwise(F.col("t.text"))
    messages = turns.select(
        "conv", "session", F.row_number().over(order).alias("ord"),
        F.when(F.col("t.speaker") == F.first("t.speaker").over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        F.concat(F.col("t.speaker"), F.lit(": "), text).alias("content"), "timestamp_ms", F.col("t.dia_id").alias("ref"),
    )
    q = d.select("conv", F.posexplode("qa").alias("qid", "q"))
    category = F.try_variant_get("q", "$.category", "int")
    named = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CATEGORIES.items() for x in kv]), category), category.cast("string"))
    answer = F.coalesce(F.nullif(F.try_variant_get("q", "$.answer", "string"), F.lit("")), F.try_variant_get("q", "$.adversarial_answer", "string"), F.lit(""))
    questions = q.select(
        "conv", "qid", named.alias("category"), F.try_variant_get("q", "$.question", "string").alias("question"), F.lit(None).cast("array<string>").alias("options"), answer.alias("answer"),
        F.coalesce(F.try_variant_get("q", "$.evidence", "array<string>"), F.array().cast("array<string>")).alias("gold"),
    )
    return messages, questions


def read_haystack_json(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A question with parallel lists of session ids, dates and sessions; blank turns are dropped. ref is the session's
    id, has_answer marks the turns that hold the answer."""
    schema = (
        "struct<question_id:string,question:string,question_type:string,question_date:string,answer:variant,answer_session_ids:array<string>,haystack_session_ids:array<string>,"
        "haystack_dates:array<string>,haystack_sessions:array<array<struct<role:string,content:string,has_answer:boolean>>>>"
    )
    d = _documents(spark, path).select("conv", F.try_variant_get("v", "$", schema).alias("x")).select("conv", "x.*")
    zipped = F.arrays_zip(F.col("haystack_session_ids").alias("id"), F.col("haystack_dates").alias("date"), F.col("haystack_sessions").alias("turns"))
    s = d.select("conv", F.posexplode(zipped).alias("session", "s"))
    t = s.select("conv", "session", F.col("s.id").alias("ref"), _ms(anchor_time(F.col("s.date"))).cast("double").alias("timestamp_ms"), F.posexplode("s.turns").alias("turn", "t")).where(~T.is_blank(F.col("t.content")))
    messages = t.select(
        "conv", "session", F.row_number().over(W.partitionBy("conv").orderBy("session", "turn")).alias("ord"), F.col("t.role").alias("role"), F.col("t.content").alias("content"), "timestamp_ms", "ref",
        F.coalesce(F.col("t.has_answer"), F.lit(False)).alias("has_answer"),
    )
    questions = d.select("conv", F.col("question_id").alias("qid"), F.col("question_type").alias("category"), "question", F.lit(None).cast("array<string>").alias("options"), F.try_variant_get("answer", "$", "string").alias("answer"), F.col("answer_session_ids").alias("gold"))
    return messages, questions


def read_nested_parquet(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Chat is a list of sessions of turns; only users' and assistants' turns that are not blank stay. Probing questions
    are JSON by type; those without a question or a rubric are dropped."""
    d = spark.read.parquet(path)
    s = d.select(F.col("conversation_id").alias("conv"), F.posexplode("chat").alias("session", "turns"))
    t = s.select("conv", "session", F.posexplode("turns").alias("turn", "t")).where(F.col("t.role").isin("user", "assistant") & ~T.is_blank(F.col("t.content")))
    order = W.partitionBy("conv").orderBy("session", "turn")
    messages = t.select("conv", "session", F.row_number().over(order).alias("ord"), F.col("t.role").alias("role"), F.col("t.content").alias("content"), _ms(day_anchor(F.col("t.time_anchor"))).cast("double").alias("timestamp_ms"), F.lit(None).cast("string").alias("ref"))
    by_type = d.select(F.col("conversation_id").alias("conv"), F.explode(F.try_variant_get(F.try_parse_json("probing_questions"), "$", "map<string,variant>")).alias("category", "list"))
    q = by_type.select("conv", "category", F.posexplode(F.try_variant_get("list", "$", "array<variant>")).alias("n", "q"))
    rubric = F.coalesce(F.try_variant_get("q", "$.rubric", "array<string>"), F.try_variant_get("q", "$.rubrics", "array<string>"), F.array_compact(F.array(F.try_variant_get("q", "$.ideal_response", "string"))))
    questions = q.select(
        "conv", F.concat_ws(":", F.col("conv").cast("string"), "category", F.col("n").cast("string")).alias("qid"), "category", F.try_variant_get("q", "$.question", "string").alias("question"),
        F.lit(None).cast("array<string>").alias("options"), F.coalesce(F.try_variant_get("q", "$.ideal_response", "string"), F.lit("")).alias("answer"), rubric.alias("gold"),
    )
    return messages, questions.where((F.coalesce("question", F.lit("")) != "") & (F.size("gold") > 0))


def day_anchor(x: Column) -> Column:
    """E12: 'March-15-2024', 'Mar-15-2024', 'March 15, 2024' or '2024-03-15'."""
    t = T.strip(x)
    spaced = rf"(?i)\A([a-z]+){T.WS}+([0-9]{{1,2}}),{T.WS}*([0-9]{{4}})\z"
    dashed = F.regexp_replace(t, spaced, "$1-$2-$3")
    return F.when(t.rlike(r"\A[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"), F.try_to_timestamp(t)).otherwise(anchor_time(dashed))


def read_contexts(spark: SparkSession, questions_csv: str, contexts_jsonl: str) -> tuple[DataFrame, DataFrame]:
    """Contexts by id, cut behind the index that a question names; system turns become user turns marked [System]; blank
    turns and other roles are dropped. conv is the context's id and the index."""
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(questions_csv)
    end = F.col("end_index_in_shared_context").cast("int")
    q = raw.withColumn("end", end).withColumn("conv", F.concat_ws(":", "shared_context_id", end.cast("string")))
    listed = F.coalesce(
        F.try_variant_get(F.try_parse_json("all_options"), "$", "array<string>"),
        F.try_variant_get(F.try_parse_json(F.regexp_replace("all_options", r"(?<=[\[ ,])'|'(?=[\],])", '"')), "$", "array<string>"),
    )
    questions = q.select("conv", F.col("question_id").alias("qid"), F.col("question_type").alias("category"), F.col("user_question_or_message").alias("question"), listed.alias("options"), F.col("correct_answer").alias("answer"), F.lit(None).cast("array<string>").alias("gold"))
    lines = spark.read.option("lineSep", "\n").text(contexts_jsonl).select(F.explode(F.try_variant_get(F.try_parse_json("value"), "$", "map<string,variant>")).alias("id", "v"))
    turns = lines.select("id", F.posexplode(F.try_variant_get("v", "$", "array<struct<role:string,content:string>>")).alias("i", "t"))
    used = q.select("conv", F.col("shared_context_id").alias("id"), "end").distinct()
    t = used.join(turns, "id").where((F.col("i") <= F.col("end")) & F.col("t.role").isin("user", "assistant", "system") & ~T.is_blank(F.col("t.content")))
    system = F.col("t.role") == "system"
    messages = t.select(
        "conv", F.lit(0).alias("session"), F.row_number().over(W.partitionBy("conv").orderBy("i")).alias("ord"), F.when(system, F.lit("user")).otherwise(F.col("t.role")).alias("role"),
        F.when(system, F.concat(F.lit("[System]: "), F.col("t.content"))).otherwise(F.col("t.content")).alias("content"), F.lit(None).cast("double").alias("timestamp_ms"), F.lit(None).cast("string").alias("ref"),
    )
    return messages, questions
