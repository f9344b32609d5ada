"""Retrieval channels (C01-C09). Queries are a table (query_id, user_id, q, intent, k); a channel is a table
(query_id, user_id, pos, rank[, score]) with rank from 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from .index import Index

KEYS = ["query_id", "user_id"]


def prepare_queries(queries: DataFrame) -> DataFrame:
    """Q01-Q04: queries (query_id, user_id, query, options, top_k) with q, intent, is_task, is_aggregate, k and n. Rows with
    an empty query and no options are dropped."""
    opts = F.coalesce("options", F.array().cast("array<string>"))
    d = queries.where(~((F.col("query") == "") & (F.size(opts) == 0)))
    k = F.least(F.coalesce("top_k", F.lit(C.TOP_K_CAP)), F.lit(C.TOP_K_CAP))
    return d.select(
        "query_id", "user_id", "query", "options", T.expand(F.col("query"), F.col("options")).alias("q"), T.intent(F.col("query")).alias("intent"),
        T.is_task_request(F.col("query")).alias("is_task"), T.is_aggregate(F.col("query")).alias("is_aggregate"), k.cast("int").alias("k"),
        (k * C.CHANNEL_MULTIPLE).cast("int").alias("n"),
    )


def _ranked(d: DataFrame, *order: Column) -> DataFrame:
    return d.withColumn("rank", (F.row_number().over(W.partitionBy(*KEYS).orderBy(*order)) - 1).cast("int"))


def query_terms(queries: DataFrame) -> DataFrame:
    """(query_id, user_id, n, term): the distinct tokens of each query."""
    return queries.select(*KEYS, "n", F.explode(F.array_distinct(T.tokens(F.col("q")))).alias("term"))


def _bm25(terms: DataFrame, index: Index) -> DataFrame:
    """Top n rows by score among those with at least one of the terms, ties by pos."""
    hits = terms.join(index.postings, ["user_id", "term"]).join(index.terms.select("user_id", "term", "idf", "avgdl"), ["user_id", "term"])
    norm = C.K1 * (F.lit(1 - C.B) + C.B * F.col("dl") / F.col("avgdl"))
    part = F.col("idf") * F.col("tf") * (C.K1 + 1) / (F.col("tf") + norm)
    # summed in the order of the terms, so that the score does not depend on the plan
    summed = F.aggregate(F.array_sort(F.collect_list(F.struct("term", part.alias("s")))), F.lit(0.0), lambda acc, x: acc + x["s"])
    scored = hits.groupBy(*KEYS, "n", "pos").agg(summed.alias("score"))
    return _ranked(scored, F.desc("score"), F.col("pos")).where("rank < n").drop("n")


def bm25(queries: DataFrame, index: Index) -> DataFrame:
    """C01."""
    return _bm25(query_terms(queries), index)


_dot = T.dot


def cosine_distance(a: Column, b: Column) -> Column:
    """Null for a vector of zeros."""
    return 1 - F.try_divide(_dot(a, b), T.norm(a) * T.norm(b))


def vector(queries: DataFrame, query_vectors: DataFrame | None, index: Index) -> DataFrame | None:
    """Exact nearest neighbours within a user; query_vectors (query_id, vector). None without vectors."""
    if query_vectors is None or index.vectors is None:
        return None
    q = queries.select(*KEYS, "n").join(query_vectors, "query_id").withColumn("q_norm", T.norm(F.col("vector")))
    distance = 1 - F.try_divide(_dot(F.col("embedding"), F.col("vector")), F.col("norm") * F.col("q_norm"))  # one product a pair
    d = q.join(index.vectors, "user_id").withColumn("distance", F.round(distance, 12))
    d = d.where("distance is not null").select(*KEYS, "n", "pos", "distance")
    return _ranked(d, F.col("distance"), F.col("pos")).where("rank < n").drop("n")


def entity(queries: DataFrame, index: Index) -> DataFrame:
    """Rows about a person that the query names as a whole word, newest first, rows without a time last."""
    words = queries.select(*KEYS, F.explode(F.array_distinct(F.regexp_extract_all(F.lower("q"), F.lit(r"(?U)\w+"), F.lit(0)))).alias("alias"))
    hit = words.where("length(alias) > 2").join(index.aliases, ["user_id", "alias"]).select(*KEYS, "canonical").distinct()
    rows = hit.join(index.entities, ["user_id", "canonical"]).select(*KEYS, "pos").distinct()
    rows = rows.join(index.rows.select("user_id", "pos", "ts_value"), ["user_id", "pos"])
    return _ranked(rows, F.col("ts_value").desc_nulls_last(), F.col("pos")).select(*KEYS, "pos", "rank")


def literal(queries: DataFrame, index: Index, bm25_hits: DataFrame) -> DataFrame:
    """Rows that hold a literal term of the query, by their BM25 score, 0 for rows outside that channel."""
    terms = queries.select(*KEYS, F.transform(T.literal_terms(F.col("q")), F.lower).alias("terms")).where(F.size("terms") > 0)
    rows = terms.join(index.rows.select("user_id", "pos", F.lower("text").alias("low")), "user_id")
    rows = rows.where(F.exists("terms", lambda t: F.contains(F.col("low"), t))).select(*KEYS, "pos")
    rows = rows.join(bm25_hits.select(*KEYS, "pos", "score"), [*KEYS, "pos"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return _ranked(rows, F.desc("score"), F.col("pos")).select(*KEYS, "pos", "rank")


def date(queries: DataFrame, index: Index) -> DataFrame:
    """For temporal queries, rows within three days of a named day or in a named month, by seq. The range join is an
    equi-join on the exploded days; days beyond year 1 or 9999 are skipped."""
    q = queries.where("intent = 'temporal'")
    first, last = F.lit("0001-01-01").cast("date"), F.lit("9999-12-31").cast("date")
    around = lambda d: F.sequence(F.greatest(F.date_sub(d, C.DATE_RADIUS), first), F.least(F.date_add(d, C.DATE_RADIUS), last))
    days = F.transform(F.flatten(F.transform(T.query_days(F.col("q")), around)), lambda d: F.date_format(d, "yyyy-MM-dd"))
    by_day = q.select(*KEYS, F.explode(F.array_distinct(days)).alias("day")).join(index.dates, ["user_id", "day"]).select(*KEYS, "pos")
    by_month = q.select(*KEYS, F.explode(F.array_distinct(T.query_months(F.col("q")))).alias("month")).join(index.dates, ["user_id", "month"]).select(*KEYS, "pos")
    rows = by_day.unionByName(by_month).distinct().join(index.rows.select("user_id", "pos", "seq"), ["user_id", "pos"])
    return _ranked(rows, F.col("seq"), F.col("pos")).select(*KEYS, "pos", "rank")


def hop_anchors(order: DataFrame) -> DataFrame:
    return order.where(F.col("rank") < C.HOP_ANCHORS).select(*KEYS, "pos")


def hop_terms(queries: DataFrame, anchors: DataFrame, index: Index) -> DataFrame:
    """(query_id, user_id, term, weight, rank) of the words that extend a query: not in it, no stop word, longer than
    two, not a number; by anchors that have it times idf, ties by term."""
    words = anchors.join(index.postings.select("user_id", "pos", "term"), ["user_id", "pos"]).join(index.terms.select("user_id", "term", "idf"), ["user_id", "term"])
    words = words.where((F.length("term") > 2) & ~F.col("term").isin(C.HOP_STOP) & ~F.col("term").rlike("^[0-9]+$"))
    words = words.join(query_terms(queries).select(*KEYS, "term"), [*KEYS, "term"], "left_anti")
    scored = words.groupBy(*KEYS, "term").agg((F.count(F.lit(1)) * F.greatest(F.first("idf"), F.lit(0.0))).alias("weight"))
    return _ranked(scored, F.desc("weight"), F.col("term")).where(F.col("rank") < C.HOP_TERMS)


def bm25_hop(queries: DataFrame, terms: DataFrame, index: Index) -> DataFrame:
    """C07."""
    return _bm25(terms.select(*KEYS, "term").join(queries.select("query_id", "n"), "query_id"), index).drop("score")


def _unit(v: Column) -> Column:
    norm = F.sqrt(_dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(norm == 0, F.lit(1.0)).otherwise(norm))


def rocchio(query_vectors: DataFrame, anchors: DataFrame, index: Index) -> DataFrame:
    """(query_id, vector): the unit query vector mixed with the mean of the anchors' unit vectors."""
    d = anchors.join(index.vectors, ["user_id", "pos"]).select("query_id", "pos", F.posexplode(_unit(F.col("embedding"))).alias("i", "x"))
    total = F.aggregate(F.array_sort(F.collect_list(F.struct("pos", "x"))), F.lit(0.0), lambda acc, s: acc + s["x"])
    mean = d.groupBy("query_id", "i").agg((total / F.count(F.lit(1))).alias("m"))
    mean = mean.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))
    both = query_vectors.join(mean, "query_id").withColumn("vector", _unit(F.col("vector")))
    mixed = F.zip_with("vector", "c", lambda a, b: C.HOP_QUERY_WEIGHT * a + (1 - C.HOP_QUERY_WEIGHT) * b)
    return both.select("query_id", mixed.alias("vector"))


def vector_hop(queries: DataFrame, query_vectors: DataFrame, anchors: DataFrame, index: Index) -> DataFrame:
    """C08."""
    return vector(queries, rocchio(query_vectors, anchors, index), index).drop("distance")
