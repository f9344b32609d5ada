"""Fusion and post-processing (F01-F10). An order is a table (query_id, user_id, pos, rank, score), rank from 0."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..sources.scratch import cut
from . import channels as CH
from .index import Index

KEYS = CH.KEYS


def _weight(intent: Column, channel: str) -> Column:
    if channel.endswith("_hop"):
        return F.lit(C.HOP_WEIGHT)
    out = F.lit(C.WEIGHTS["default"][channel])
    for name, w in C.WEIGHTS.items():
        out = F.when(intent == name, F.lit(w[channel])).otherwise(out)
    return out


def _rerank(d: DataFrame, *order: Column) -> DataFrame:
    return d.withColumn("rank", (F.row_number().over(W.partitionBy(*KEYS).orderBy(*order)) - 1).cast("int"))


def union_channels(found: dict[str, DataFrame | None]) -> DataFrame:
    """Channels as one table with their name; a missing channel is left out."""
    out = None
    for name in C.CHANNELS:
        if found.get(name) is not None:
            d = found[name].select(*KEYS, "pos", "rank", F.lit(name).alias("channel"))
            out = d if out is None else out.unionByName(d)
    return out


def rrf(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """weighted reciprocal ranks, summed in the fixed order of the channels; ties go to the row that came in through the
    earlier channel, then to its rank there. Adds in_both for F02."""
    d = hits.join(queries.select("query_id", "intent"), "query_id")
    start = lambda c: 0 if c in ("bm25", "vector") else C.VIRTUAL_RANK
    parts = {c: F.max(F.when(F.col("channel") == c, _weight(F.col("intent"), c) / (F.lit(C.RRF_K + start(c) + 1) + F.col("rank")))) for c in C.CHANNELS}
    number = F.lit(len(C.CHANNELS))
    for k, c in enumerate(C.CHANNELS):
        number = F.when(F.col("channel") == c, F.lit(k)).otherwise(number)
    g = d.groupBy(*KEYS, "pos").agg(*[x.alias(f"__{c}") for c, x in parts.items()], F.min(F.struct(number.alias("c"), "rank")).alias("__first"))
    score = F.lit(0.0)
    for c in C.CHANNELS:
        score = score + F.coalesce(f"__{c}", F.lit(0.0))
    g = g.withColumn("score", score).withColumn("in_both", F.col("__bm25").isNotNull() & F.col("__vector").isNotNull())
    out = _rerank(g, F.desc("score"), F.col("__first"))
    return out.select(*KEYS, "pos", "rank", "score", "in_both")


def both_first(order: DataFrame) -> DataFrame:
    """rows of both bm25 and vector to the front, order otherwise kept."""
    return _rerank(order.withColumn("__r", F.col("rank")), F.desc("in_both"), F.col("__r")).drop("__r", "in_both")


def rerank_window(order: DataFrame, must: DataFrame | None = None, window: int = C.RERANK_WINDOW) -> DataFrame:
    """order with __in, whether a row is in the window, and __r, its place; see apply_rerank()."""
    d = order.withColumn("__r", F.col("rank"))
    if must is not None:
        first = must.groupBy("query_id", "pos").agg(F.min("seq").alias("__m"))
        d = d.join(first, ["query_id", "pos"], "left").withColumn("__x", F.when((F.col("rank") >= window) & F.col("__m").isNotNull(), F.col("__m")))
        extra = F.count("__x").over(W.partitionBy(*KEYS))
        kept = F.when(extra > 0, F.greatest(F.lit(2), F.lit(window) - extra)).otherwise(F.lit(window))
        place = F.when(F.col("__r") < kept, F.lit(0)).when(F.col("__x").isNotNull(), F.lit(1)).otherwise(F.lit(2))
        d = _rerank(d.withColumn("__p", place).withColumn("__in", F.col("__p") < 2), F.col("__p"), F.col("__x"), F.col("__r")).withColumn("__r", F.col("rank"))
    else:
        d = d.withColumn("__in", F.col("rank") < window)
    return d


def apply_rerank(order: DataFrame, scores: DataFrame, must: DataFrame | None = None, window: int = C.RERANK_WINDOW, mix: float = C.RERANK_MIX) -> DataFrame:
    """scores (query_id, pos, rs) for the window's rows reorder the window and replace their scores; rows behind stay.

    must (query_id, pos, seq) names rows that have to be in the window: those that are not replace its tail. A query with
    fewer than two rows in its window, or whose scores are incomplete, repeated or not finite, stays as it is (S15).
    """
    d = rerank_window(order, must, window)
    ok = scores.groupBy("query_id", "pos").agg(F.count(F.lit(1)).alias("__c"), F.first("rs").alias("__rs"))
    d = d.join(ok, ["query_id", "pos"], "left")
    mine = W.partitionBy(*KEYS)
    size = F.sum(F.col("__in").cast("int")).over(mine)
    good = (F.col("__c") == 1) & F.col("__rs").isNotNull() & ~F.isnan("__rs") & (F.abs("__rs") < F.lit(float("inf")))
    usable = (size >= 2) & (F.sum((F.col("__in") & ~F.coalesce(good, F.lit(False))).cast("int")).over(mine) == 0)
    d = d.withColumn("__n", size).withColumn("__use", usable & F.col("__in"))
    mixed = F.lit(mix) * F.col("__rs") + F.lit(1 - mix) * (1 - F.col("__r") / F.col("__n"))
    d = d.withColumn("__mixed", F.when(F.col("__use"), mixed))
    out = _rerank(d, F.col("__in").desc(), F.desc_nulls_last("__mixed"), F.col("__r"))
    return out.withColumn("score", F.when(F.col("__use"), F.round("__mixed", 6)).otherwise(F.col("score"))).select(*KEYS, "pos", "rank", "score")


def insert_rules(queries: DataFrame, order: DataFrame, index: Index) -> DataFrame:
    """for task requests the first rule rows that are not in the order yet go in behind its first ten."""
    q = queries.where("is_task").select(*KEYS)
    new = q.join(index.rules, "user_id").join(order.select(*KEYS, "pos"), [*KEYS, "pos"], "left_anti")
    new = _rerank(new, F.col("pos")).where(F.col("rank") < C.RULE_SLOT)
    rules = new.select(*KEYS, "pos", F.lit(C.RULE_AFTER - 0.5).alias("__at"), F.col("rank").alias("__r"), F.lit(0.0).alias("score"))
    # an order shorter than ten keeps its rows before the rules, whose place is behind every rank below ten
    both = order.select(*KEYS, "pos", F.col("rank").cast("double").alias("__at"), F.lit(0).alias("__r"), "score").unionByName(rules)
    return _rerank(both, F.col("__at"), F.col("__r")).select(*KEYS, "pos", "rank", "score")


def add_neighbors(queries: DataFrame, order: DataFrame, index: Index, ratio: float = C.NEIGHBOR_RATIO) -> DataFrame:
    """rows beside the first ten, of the same session and not among the first k, go in behind the first twenty, at most
    int(k * ratio) of them; a row that stood further back moves."""
    d = order.join(queries.select("query_id", "k"), "query_id").withColumn("__cap", F.floor(F.col("k") * ratio).cast("int"))
    d = d.withColumn("__cap", F.coalesce("__cap", F.lit(0)))
    steps = F.array(*[F.struct(F.lit(2 * (d_ - 1) + (s > 0)).alias("o"), F.lit(s * d_).alias("d")) for d_ in range(1, C.NEIGHBOR_RADIUS + 1) for s in (-1, 1)])
    anchors = d.where((F.col("rank") < C.NEIGHBOR_ANCHORS) & (F.col("__cap") > 0))
    cand = anchors.select(*KEYS, "k", "__cap", "pos", "rank", F.explode(steps).alias("s"))
    cand = cand.select(*KEYS, "k", "__cap", F.col("pos").alias("anchor"), (F.col("pos") + F.col("s.d")).alias("pos"), (F.col("rank") * 2 * C.NEIGHBOR_RADIUS + F.col("s.o")).alias("__o"))
    where = index.rows.select("user_id", "pos", "session_id")
    cand = cand.join(where, ["user_id", "pos"]).join(where.select("user_id", F.col("pos").alias("anchor"), F.col("session_id").alias("__s")), ["user_id", "anchor"]).where("session_id = __s")
    inside = d.where(F.col("rank") < F.col("k")).select(*KEYS, "pos")
    first = cand.join(inside, [*KEYS, "pos"], "left_anti").groupBy(*KEYS, "__cap", "pos").agg(F.min("__o").alias("__o"))
    chosen = _rerank(first, F.col("__o")).where(F.col("rank") < F.col("__cap")).select(*KEYS, "pos", F.col("rank").alias("__r"))
    moved = order.join(chosen.select(*KEYS, "pos"), [*KEYS, "pos"], "left_anti")
    old = order.select(*KEYS, "pos", F.col("score").alias("__score"))
    new = chosen.join(old, [*KEYS, "pos"], "left").select(*KEYS, "pos", F.lit(C.NEIGHBOR_AFTER - 0.5).alias("__at"), "__r", F.coalesce("__score", F.lit(0.0)).alias("score"))
    both = moved.select(*KEYS, "pos", F.col("rank").cast("double").alias("__at"), F.lit(0).alias("__r"), "score").unionByName(new)
    return _rerank(both, F.col("__at"), F.col("__r")).select(*KEYS, "pos", "rank", "score")


def render_rows(order: DataFrame, index: Index) -> DataFrame:
    """Id, content and created_at of each row."""
    r = index.rows.select(
        "user_id", "pos", "id",
        T.render(F.col("ts_value"), F.col("ts_granularity"), F.col("session_label"), F.col("speaker_name"), F.col("role"), F.col("part"), F.col("total"), F.col("text")).alias("content"),
        T.created_at(F.col("ts_value"), F.col("ts_granularity")).alias("created_at"),
    )
    return order.join(r, ["user_id", "pos"])


def pack_budget(rendered: DataFrame, queries: DataFrame, budget: int = C.BUDGET_TOKENS) -> DataFrame:
    """whole items in order until top_k; one that would exceed the budget is left out and the next one tried."""
    d = rendered.join(queries.select("query_id", "k"), "query_id").withColumn("t", T.token_count(F.col("content"))).where(F.col("t") <= budget)
    lists = d.groupBy(*KEYS, "k").agg(F.array_sort(F.collect_list(F.struct("rank", "pos", "t"))).alias("items"))

    def step(acc: Column, x: Column) -> Column:
        take = (F.size(acc["out"]) < F.col("k")) & (acc["used"] + x["t"] <= budget)
        return F.struct(
            F.when(take, F.concat(acc["out"], F.array(x["pos"]))).otherwise(acc["out"]).alias("out"),
            F.when(take, acc["used"] + x["t"]).otherwise(acc["used"]).alias("used"),
        )

    start = F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("used"))
    kept = lists.select(*KEYS, F.posexplode(F.aggregate("items", start, step, lambda acc: acc["out"])).alias("place", "pos"))
    return kept.join(rendered.drop("rank"), [*KEYS, "pos"])


def search(
    queries: DataFrame,
    index: Index,
    query_vectors: DataFrame | None = None,
    scorer: Callable[[DataFrame], DataFrame] | None = None,
    hop: bool = False,
    budget: int = C.BUDGET_TOKENS,
) -> DataFrame:
    """results (query_id, user_id, place, id, content, score, created_at) for a whole set of queries in one plan.

    scorer turns (query_id, user_id, q, pos, content) of the rerank window into (query_id, pos, rs); without it the order of
    the channels stays. hop adds the second hop (C09) for aggregate questions. A query of an unknown user has no rows.
    """
    q, found, order = first_round(queries, index, query_vectors)
    must = None
    if hop:
        order, must = second_hop(q, order, found, query_vectors, index)
        order, must = cut(order, "order"), cut(must, "must")
    if scorer is not None:
        window = rerank_window(order, must).where("__in").drop("__in", "__r")  # the scorer sees no row beyond
        head = render_rows(window, index).join(q.select("query_id", "q"), "query_id")
        order = cut(apply_rerank(order, scorer(head), must), "order")
    order = cut(add_neighbors(q, cut(insert_rules(q, order, index), "order"), index), "order")
    packed = pack_budget(render_rows(order, index), q, budget)
    return packed.select(*KEYS, "place", "id", "content", F.round("score", 6).alias("score"), "created_at")


def first_round(queries: DataFrame, index: Index, query_vectors: DataFrame | None = None) -> tuple[DataFrame, dict[str, DataFrame | None], DataFrame]:
    """Prepared queries, their channels and the fused order. The BM25 hits, the channels' union and the order are written, as
    several later steps read each of them."""
    q = CH.prepare_queries(queries)
    lexical = cut(CH.bm25(q, index), "bm25")
    found = {
        "bm25": lexical,
        "vector": CH.vector(q, query_vectors, index),
        "entity": CH.entity(q, index),
        "literal": CH.literal(q, index, lexical),
        "date": CH.date(q, index),
    }
    hits = cut(union_channels(found), "hits")
    found = {name: hits.where(F.col("channel") == name).drop("channel") for name, d in found.items() if d is not None}
    return q, found, cut(both_first(rrf(q, hits)), "order")


def second_hop(queries: DataFrame, order: DataFrame, found: dict[str, DataFrame | None], query_vectors: DataFrame | None, index: Index) -> tuple[DataFrame, DataFrame]:
    """The order after the second hop, and the new rows that must reach the rerank window."""
    q = queries.where("is_aggregate or intent = 'aggregate'")
    anchors = cut(CH.hop_anchors(order).join(q.select("query_id"), "query_id", "left_semi"), "anchors")
    hops = {"bm25_hop": cut(CH.bm25_hop(q, cut(CH.hop_terms(q, anchors, index), "terms"), index), "hop")}
    if query_vectors is not None and index.vectors is not None:
        hops["vector_hop"] = cut(CH.vector_hop(q, query_vectors, anchors, index), "hop")
    must = None
    for k, (name, d) in enumerate(hops.items()):
        new = d.where(F.col("rank") < C.HOP_RESERVE).join(order.select(*KEYS, "pos"), [*KEYS, "pos"], "left_anti")
        new = new.select("query_id", "pos", (F.col("rank") + k * C.HOP_RESERVE).alias("seq"))
        must = new if must is None else must.unionByName(new)
    return both_first(rrf(queries, union_channels({**found, **hops}))), must
