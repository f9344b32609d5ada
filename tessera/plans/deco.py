"""Inputs of the catalogue: conversations as messages, decorated with speakers, names, dates and rules, which the raw table
lacks; a fixed set of queries; vectors aligned with segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import coerce as P
from ..operators import index as I
from ..operators import segments as G
from ..sources.scratch import cut, new_path

SPEAKERS = ("Alice", "Bob", "Carol", "Maria")
PEOPLE = ("Caroline", "Caro", "Melanie", "Mel", "Roberto", "Ann", "Annabella", "Joanne")
FIRST_MS, DAY_MS, TURN_MS = 1704067200000, 86400000, 61000

#: (query_id, user_id, query, options, top_k)
QUERIES = (
    (1, "u0", "When did Caroline meet Alice on 2024-01-05?", [], 40),
    (2, "u1", "who is Melanie to the others", [], 30),
    (3, "u2", "please write a note about the plan for Caro and Bob", [], 25),
    (4, "u3", "how many times did Roberto and the others meet before 12 January 2024", ["Mel", "2024-01-12"], 100),
    (5, "u4", "what is the latest from Alice and of the rest", [], 10),
    (6, "u5", "tell me about Carol in January 2024", None, 100),
    (7, "u6", "since March 3rd, 2024 the last one from Maria", ["the", "and"], None),
    (8, "u0", "", [], 10),
    (9, "u1", "", ["Caroline"], 20),
    (10, "nobody", "who is there", [], 20),
    (11, "u7", "帮我 list every rule of 2024", [], 60),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, session_id, request_id, arrival, idx, role, content, timestamp_ms): one request per conversation."""
    c, t = F.col("conv_id"), F.col("turn")
    met = F.concat(
        F.lit(" I met "), F.element_at(F.array(*map(F.lit, PEOPLE)), ((c + t) % len(PEOPLE) + 1).cast("int")), F.lit(" on 2024-01-"), F.lpad((c % 28 + 1).cast("string"), 2, "0"), F.lit("."),
    )
    content = F.concat(
        F.element_at(F.array(*map(F.lit, SPEAKERS)), (c % len(SPEAKERS) + 1).cast("int")), F.lit(": "), F.coalesce("text", F.lit("")),
        F.when(t % 3 == 0, met).otherwise(F.lit("")), F.when(t % 4 == 1, F.lit(" From now on always reply briefly.")).otherwise(F.lit("")),
    )
    ms = F.when(t % 3 != 1, (F.lit(FIRST_MS) + c * DAY_MS + t * TURN_MS).cast("double"))
    return table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("u"), (c % 10).cast("string")).alias("user_id"), F.concat(F.lit("c"), c.cast("string")).alias("session_id"), F.concat(F.lit("r"), c.cast("string")).alias("request_id"),
        c.alias("arrival"), t.cast("int").alias("idx"), P.normalize_role(F.col("role")).alias("role"), content.alias("content"), ms.alias("timestamp_ms"),
    )


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.assemble(G.impute_timestamps(G.assign_seq(P.drop_blank(messages(spark, sf_dir)))))


def segments_with_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First parts of four messages in five get a vector of the embeddings table by a fixed rule."""
    emb = table(spark, sf_dir, "embeddings")
    n = emb.agg(F.count(F.lit(1)).alias("n"))  # one row
    s = segments(spark, sf_dir).crossJoin(F.broadcast(n))
    place = (F.substring("session_id", 2, 20).cast("long") * 8 + F.col("seq")) % F.greatest(F.col("n"), F.lit(1))
    s = s.withColumn("vec_id", F.when((F.col("part") == 1) & (F.col("seq") % 5 != 4), place)).drop("n")
    return s.join(emb.select("vec_id", "embedding"), "vec_id", "left").drop("vec_id")


_indexes: dict[tuple[str, str], str] = {}


def index(spark: SparkSession, sf_dir: str, vectors: bool = False) -> I.Index:
    """The index of the decorated conversations, with vectors, written once for each application and state of the input and
    then read (I17)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        _indexes[key] = new_path(spark, "index")
    version = "+".join(I.version_of(table(spark, sf_dir, t)) for t in ("conversations", "embeddings"))
    return I.Index.current(spark, _indexes[key], version, lambda: cut(segments_with_vectors(spark, sf_dir), "segments"), vectors)


def queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(QUERIES), "query_id long, user_id string, query string, options array<string>, top_k int")


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vector of query k is that of vec_id k."""
    emb = table(spark, sf_dir, "embeddings").where(F.col("vec_id") <= max(q[0] for q in QUERIES))
    return emb.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
