"""Evaluation and reporting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T

KS = (10, 20, 50, 100)


def word_count(x: Column) -> Column:
    return F.regexp_count(x, F.lit(T.NOT_WS + "+"))


def platform_chunks(messages: DataFrame, key: list[str], order: str, text: str, max_messages: int = 20, max_words: int = 2000) -> DataFrame:
    """(key..., order, chunk): a new chunk begins where the current one has max_messages or would exceed max_words."""
    lists = messages.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), word_count(F.col(text)).alias("w")))).alias("m"))

    def step(acc: Column, x: Column) -> Column:
        new = (acc["n"] > 0) & ((acc["n"] >= max_messages) | (acc["words"] + x["w"] > max_words))
        chunk = acc["chunk"] + new.cast("int")
        return F.struct(
            chunk.alias("chunk"), F.when(new, F.lit(1)).otherwise(acc["n"] + 1).alias("n"), F.when(new, x["w"]).otherwise(acc["words"] + x["w"]).alias("words"),
            F.concat(acc["out"], F.array(F.struct(x["o"].alias("o"), chunk.alias("c")))).alias("out"),
        )

    kind = dict(messages.dtypes)[order]
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("n"), F.lit(0).alias("words"), F.array().cast(f"array<struct<o:{kind},c:int>>").alias("out"))
    return lists.select(*key, F.explode(F.aggregate("m", start, step, lambda acc: acc["out"])).alias("x")).select(*key, F.col("x.o").alias(order), F.col("x.c").alias("chunk"))


#: Queries that one pass over the items holds.
QUERY_BLOCK = 1024


def nearest(queries: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """Exact nearest neighbours by cosine: queries (query_id, vector), items (item, embedding) -> (query_id, item, place)
    with place from 0, ties by item, an item never its own query's. Null vectors and vectors of zeros have no distance.

    Queries go in blocks of QUERY_BLOCK, each against all items: a matrix product an Arrow batch, of which each query's n
    best are kept, so what is sorted afterwards are n rows a batch and query and not all pairs.
    """
    held = queries.where("vector is not null").select("query_id", "vector")
    blocks = max(1, -(-held.count() // QUERY_BLOCK))
    kinds = dict(held.dtypes)["query_id"], dict(items.dtypes)["item"]
    out = None
    for k in range(blocks):
        part = held if blocks == 1 else held.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == k)
        rows = part.collect()  # about QUERY_BLOCK rows
        found = items.mapInArrow(_best_of([r["query_id"] for r in rows], [r["vector"] for r in rows], n), f"query_id {kinds[0]}, item {kinds[1]}, dist double")
        out = found if out is None else out.unionByName(found)
    order = W.partitionBy("query_id").orderBy("dist", "item")
    return out.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n).select("query_id", "item", (F.col("rn") - 1).cast("int").alias("place"))


def _best_of(ids: list, vectors: list, n: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        q = np.array(vectors, dtype=float).reshape(len(ids), -1)
        q_norm = np.sqrt((q * q).sum(axis=1))
        for batch in batches:
            keep = [k for k, v in enumerate(batch.column(1).to_pylist()) if v is not None]
            if not keep or not ids:
                continue
            held = batch.column(0).take(pa.array(keep))
            v = np.array(batch.column(1).take(pa.array(keep)).to_pylist(), dtype=float)
            with np.errstate(divide="ignore", invalid="ignore"):
                dist = np.round(1 - (q @ v.T) / (q_norm[:, None] * np.sqrt((v * v).sum(axis=1))[None, :]), 12)
            items = held.to_pylist()
            for k, key in enumerate(ids):
                d = dist[k]
                at = [j for j in np.nonzero(np.isfinite(d))[0].tolist() if items[j] != key]
                best = sorted(at, key=lambda j: (d[j], items[j]))[:n]
                yield pa.RecordBatch.from_arrays([pa.array([key] * len(best), kind_of(key)), held.take(pa.array(best, pa.int64())), pa.array(d[best])], ["query_id", "item", "dist"])

    def kind_of(key):
        import pyarrow as pa

        return pa.scalar(key).type

    return run


def hit_at_k(results: DataFrame, gold: DataFrame, ks: tuple[int, ...] = KS, item: str = "item") -> DataFrame:
    """Results (query_id, place, item), gold (query_id, item) -> any@k and all@k per query. Queries without gold are
    skipped; result items that gold does not know keep their place."""
    g = gold.select("query_id", F.col(item)).distinct()
    need = g.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_gold"))
    best = results.groupBy("query_id", item).agg(F.min("place").alias("place"))
    found = g.join(best, ["query_id", item], "left")
    counts = [F.count(F.when(F.col("place") < k, True)).alias(f"__{k}") for k in ks]
    d = found.groupBy("query_id").agg(*counts).join(need, "query_id")
    return d.select("query_id", "n_gold", *[(F.col(f"__{k}") > 0).alias(f"any_{k}") for k in ks], *[(F.col(f"__{k}") == F.col("n_gold")).alias(f"all_{k}") for k in ks])


def group_summary(d: DataFrame, group: str, metrics: list[str]) -> DataFrame:
    """Count, mean (4 places), median and maximum of each metric, over all (a null group) and by group."""
    numbers = {m: F.col(m).cast("double") for m in metrics}
    agg = [F.count(F.lit(1)).alias("n")]
    for m, c in numbers.items():
        agg += [F.round(F.avg(c), 4).alias(f"{m}_mean"), F.percentile(c, F.lit(0.5)).alias(f"{m}_median"), F.max(c).alias(f"{m}_max")]
    return d.rollup(group).agg(*agg)


def segment_seq(segment_id: Column) -> Column:
    """The seq in a segment id, null where there is none."""
    return F.regexp_extract(segment_id, r"#([0-9]+)\.[0-9]+\z", 1).try_cast("int")


def pick_score(*candidates: Column) -> Column:
    """The first that is not null, as double; truth values count 1 and 0."""
    return F.coalesce(*[c.cast("double") for c in candidates])


def id_parity(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """One row: ids that repeat in either, ids missing in either, and whether both are equal sets of unique ids."""
    l, r = a.groupBy(key).agg(F.count(F.lit(1)).alias("na")), b.groupBy(key).agg(F.count(F.lit(1)).alias("nb"))
    d = l.join(r, key, "full_outer")
    out = d.agg(
        F.count(F.when(F.col("na") > 1, 1)).alias("repeated_a"), F.count(F.when(F.col("nb") > 1, 1)).alias("repeated_b"),
        F.count(F.when(F.col("nb").isNull(), 1)).alias("only_a"), F.count(F.when(F.col("na").isNull(), 1)).alias("only_b"),
    )
    return out.withColumn("same", F.expr("repeated_a + repeated_b + only_a + only_b = 0"))


def accuracy_by_category(d: DataFrame, category: str, score: str) -> DataFrame:
    """E08."""
    return d.groupBy(category).agg(F.round(F.avg(score), 4).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def paired_compare(a: DataFrame, b: DataFrame, key: str, category: str, score: str) -> DataFrame:
    """Wins, losses and net of b over a, by category, and over all under a null category."""
    d = a.select(key, category, F.col(score).alias("__a")).join(b.select(key, F.col(score).alias("__b")), key)
    win, loss = (F.col("__b") > F.col("__a")).cast("int"), (F.col("__b") < F.col("__a")).cast("int")
    return d.rollup(category).agg(F.count(F.lit(1)).alias("n"), F.sum(win).alias("wins"), F.sum(loss).alias("losses"), F.sum(win - loss).alias("net"))


def flips(a: DataFrame, b: DataFrame, key: str, score: str, n: int = 20) -> DataFrame:
    """The first n ids on which a and b differ, each way."""
    d = a.select(key, F.col(score).alias("before")).join(b.select(key, F.col(score).alias("after")), key).where("before <> after")
    d = d.withColumn("direction", F.when(F.col("after") > F.col("before"), F.lit("win")).otherwise(F.lit("loss")))
    return d.withColumn("__n", F.row_number().over(W.partitionBy("direction").orderBy(key))).where(F.col("__n") <= n).drop("__n")


def manifest(segments: DataFrame, prefix: str = "") -> DataFrame:
    """Segments, vectors, users, sessions and vector coverage of the users whose id begins with prefix."""
    d = segments.where(F.startswith("user_id", F.lit(prefix))) if prefix else segments
    out = d.agg(
        F.count(F.lit(1)).alias("segments"), F.count("embedding").alias("vectors"), F.countDistinct("user_id").alias("users"),
        F.countDistinct("user_id", "session_id").alias("sessions"),
    )
    return out.withColumn("coverage", F.round(F.try_divide(F.col("vectors"), F.col("segments")), 4))


def manifest_groups(segments: DataFrame) -> DataFrame:
    """Segments by granularity and by provenance, in one pass."""
    pairs = F.explode(F.array(F.struct(F.lit("granularity").alias("what"), F.col("ts_granularity").alias("value")), F.struct(F.lit("provenance").alias("what"), F.col("ts_provenance").alias("value"))))
    return segments.select(pairs.alias("p")).groupBy("p.what", "p.value").agg(F.count(F.lit(1)).alias("n"))


def effective_config() -> dict[str, object]:
    """Every constant of the contract; there are no secrets among them."""
    return {k: v for k, v in vars(C).items() if k.isupper()}


def anchor_time(x: Column) -> Column:
    """Session times: '1:56 pm on 8 May, 2023', 'March-15-2024', '2023/05/20 (Sat) 02:21', '2023/05/20 02:21'."""
    t = T.strip(x)
    spoken = rf"(?i)\A([0-9]{{1,2}}):([0-9]{{2}}){T.WS}*([ap])m{T.WS}+on{T.WS}+([0-9]{{1,2}}){T.WS}+([a-z]+),?{T.WS}+([0-9]{{4}})\z"
    dashed = r"(?i)\A([a-z]+)-([0-9]{1,2})-([0-9]{4})\z"
    slashed = rf"\A([0-9]{{4}})/([0-9]{{2}})/([0-9]{{2}}){T.WS}*(?:\([A-Za-z]{{3}}\))?{T.WS}*(?:([0-9]{{2}}):([0-9]{{2}}))?\z"
    g = lambda p, k: F.regexp_extract(t, p, k)
    two = lambda c: F.lpad(c, 2, "0")
    month = lambda c: two(F.when(T.month_number(c) > 0, T.month_number(c)).cast("string"))
    hour = (g(spoken, 1).try_cast("int") % 12 + F.when(F.lower(g(spoken, 3)) == "p", 12).otherwise(0)).cast("string")
    a = F.concat(g(spoken, 6), F.lit("-"), month(g(spoken, 5)), F.lit("-"), two(g(spoken, 4)), F.lit(" "), two(hour), F.lit(":"), g(spoken, 2), F.lit(":00"))
    b = F.concat(g(dashed, 3), F.lit("-"), month(g(dashed, 1)), F.lit("-"), two(g(dashed, 2)), F.lit(" 00:00:00"))
    clock = F.when(g(slashed, 4) == "", F.lit("00:00")).otherwise(F.concat(g(slashed, 4), F.lit(":"), g(slashed, 5)))
    c = F.concat(g(slashed, 1), F.lit("-"), g(slashed, 2), F.lit("-"), g(slashed, 3), F.lit(" "), clock, F.lit(":00"))
    return F.when(t.rlike(spoken), F.try_to_timestamp(a)).when(t.rlike(dashed), F.try_to_timestamp(b)).when(t.rlike(slashed), F.try_to_timestamp(c))
