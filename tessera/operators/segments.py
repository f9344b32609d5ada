"""Segment construction (G01-G13): from accepted requests to stored segments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from .coerce import drop_blank, embed_text

SEGMENT_COLUMNS = (
    "user_id", "id", "session_id", "request_id", "seq", "part", "total", "role", "speaker_name", "ts_value", "ts_granularity", "ts_provenance", "text", "content_sha", "is_rule",
)


def ts_from_ms(ms: Column) -> Column:
    return F.timestamp_micros(F.round(ms * 1000).cast("long"))


def granularity(ts: Column) -> Column:
    """Date for a UTC midnight, datetime for any other moment, unknown for null."""
    return F.when(ts.isNull(), F.lit("unknown")).when(F.date_trunc("day", ts) == ts, F.lit("date")).otherwise(F.lit("datetime"))


def idempotency_gate(requests: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Requests (user_id, request_id, payload_sha, arrival, ...) with status accepted, replay or conflict.

    The first arrival of a key wins unless the ledger holds the key already; a later one with the same payload is a replay
    and with another a conflict. Equal arrivals are ordered by payload_sha.
    """
    keys = ["user_id", "request_id"]
    first = W.partitionBy(*keys).orderBy("arrival", "payload_sha")
    d = requests.withColumn("__n", F.row_number().over(first)).withColumn("__sha", F.first("payload_sha").over(first))
    if ledger is not None:
        d = d.join(ledger.select(*keys, F.col("payload_sha").alias("__stored")), keys, "left")
    else:
        d = d.withColumn("__stored", F.lit(None).cast("string"))
    won = F.coalesce("__stored", "__sha")
    status = F.when(F.col("__stored").isNull() & (F.col("__n") == 1), F.lit("accepted")).when(F.col("payload_sha") == won, F.lit("replay")).otherwise(F.lit("conflict"))
    return d.withColumn("status", status).drop("__n", "__sha", "__stored")


def session_state(segments: DataFrame) -> DataFrame:
    """Per (user_id, session_id): last seq, and the last known time with its granularity."""
    last = F.max(F.when(F.col("ts_value").isNotNull(), F.struct("seq", "part", "ts_value", "ts_granularity")))
    return segments.groupBy("user_id", "session_id").agg(F.max("seq").alias("last_seq"), last.alias("__l")).select("user_id", "session_id", "last_seq", F.col("__l.ts_value").alias("last_ts"), F.col("__l.ts_granularity").alias("last_granularity"))


def messages_of(requests: DataFrame) -> DataFrame:
    """One row per message that is not blank, with its place in the request."""
    d = requests.select("user_id", "session_id", "request_id", "arrival", F.posexplode("messages").alias("idx", "m"))
    return drop_blank(d.select("user_id", "session_id", "request_id", "arrival", "idx", "m.role", "m.content", "m.timestamp_ms"))


def assign_seq(messages: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Seq rises by one per message of a session, from the session's last one."""
    order = W.partitionBy("user_id", "session_id").orderBy("arrival", "request_id", "idx")
    d = messages.withColumn("seq", F.row_number().over(order))
    if state is None:
        return d
    d = d.join(state.select("user_id", "session_id", "last_seq"), ["user_id", "session_id"], "left")
    return d.withColumn("seq", (F.col("seq") + F.coalesce("last_seq", F.lit(0))).cast("int")).drop("last_seq")


def impute_timestamps(messages: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """A message's own time, else the next one in its request, else the previous one there, else the last one of the
    session before it. Granularity travels with the time; provenance says given, inherited or unknown."""
    ts = ts_from_ms(F.col("timestamp_ms"))
    d = messages.withColumn("__own", F.when(ts.isNotNull(), F.struct(ts.alias("t"), granularity(ts).alias("g"))))
    request = W.partitionBy("user_id", "session_id", "request_id").orderBy("idx")
    d = d.withColumn("__next", F.first("__own", ignorenulls=True).over(request.rowsBetween(1, W.unboundedFollowing)))
    d = d.withColumn("__prev", F.last("__own", ignorenulls=True).over(request.rowsBetween(W.unboundedPreceding, -1)))
    near = F.coalesce("__own", "__next", "__prev")
    session = W.partitionBy("user_id", "session_id").orderBy("arrival", "request_id", "idx").rowsBetween(W.unboundedPreceding, -1)
    d = d.withColumn("__near", near).withColumn("__before", F.last("__near", ignorenulls=True).over(session))
    found = F.coalesce("__near", "__before")
    if state is not None:
        stored = state.select("user_id", "session_id", F.when(F.col("last_ts").isNotNull(), F.struct(F.col("last_ts").alias("t"), F.col("last_granularity").alias("g"))).alias("__stored"))
        d = d.join(stored, ["user_id", "session_id"], "left")
        found = F.coalesce("__near", "__before", "__stored")
    d = d.withColumn("__found", found)
    provenance = F.when(F.col("__own").isNotNull(), F.lit("given")).when(F.col("__found").isNotNull(), F.lit("inherited")).otherwise(F.lit("unknown"))
    d = d.withColumns({"ts_value": F.col("__found.t"), "ts_granularity": F.coalesce(F.col("__found.g"), F.lit("unknown")), "ts_provenance": provenance})
    return d.drop("__own", "__next", "__prev", "__near", "__before", "__stored", "__found", "timestamp_ms")


def assemble(messages: DataFrame) -> DataFrame:
    """Messages with seq and time -> one row per piece."""
    d = messages.withColumn("speaker_name", T.speaker_prefix(F.col("content")))
    pieces = T.let(T.split_long(F.col("content")), lambda p: F.transform(p, lambda x: F.struct(x.alias("text"), F.size(p).alias("total"))))
    d = d.select("*", F.posexplode(pieces).alias("__i", "__p")).select("*", "__p.text", "__p.total", (F.col("__i") + 1).cast("int").alias("part"))
    return d.select(
        "user_id",
        F.concat(F.col("session_id"), F.lit("#"), F.col("seq").cast("string"), F.lit("."), F.col("part").cast("string")).alias("id"),
        "session_id", "request_id", F.col("seq").cast("int").alias("seq"), "part", "total", "role", "speaker_name", "ts_value", "ts_granularity", "ts_provenance", "text",
        T.content_sha(F.col("role"), F.col("text")).alias("content_sha"), T.looks_like_rule(F.col("text"), F.col("role")).alias("is_rule"),
    )


def build_segments(requests: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Accepted requests -> segments, given the sessions' state so far."""
    return assemble(impute_timestamps(assign_seq(messages_of(requests), state), state))


def embed_inputs(segments: DataFrame) -> DataFrame:
    """The distinct texts to embed, so that no text is embedded twice."""
    return segments.select(embed_text(F.col("speaker_name"), F.col("role"), F.col("text")).alias("embed_text")).distinct()


def attach_vectors(segments: DataFrame, vectors: DataFrame) -> DataFrame:
    """Vectors (embed_text, embedding) back to every segment with that text."""
    return segments.withColumn("embed_text", embed_text(F.col("speaker_name"), F.col("role"), F.col("text"))).join(vectors, "embed_text", "left").drop("embed_text")
