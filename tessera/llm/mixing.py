"""Mixing sources to target weights by Poisson replication.

Each row gets a uniform number from a hash of seed and id, and the inverse Poisson distribution with its source's
repetition rate turns it into a number of copies (large rates: the sum of several such draws). Copies are exploded and dealt out in the order of a second hash, which
is a global shuffle that any run repeats.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free_name, raw

#: Bits taken from a digest: 13 hex digits fit a double exactly.
_DIGITS, _SCALE = 13, float(16**13)
#: The largest rate whose exp(-rate) a double holds with all its digits.
MAX_RATE = 708
#: Up to so many sources their rates go to every task, so that texts are not dealt out by source; a row has 9 KB at most.
FEW_SOURCES = 1000


def _uniform(*parts: Column) -> Column:
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return F.conv(F.substring(digest, 1, _DIGITS), 16, 10).cast("double") / F.lit(_SCALE)


def source_rates(docs: DataFrame, source_col: str = "source", weights: dict[str, float] | None = None, epochs: float = 1.0) -> DataFrame:
    """(src, n, rate): rate = epochs * (share wanted) / (share present).

    weights gives the wanted share of each source up to a factor; sources that it lacks get weight 0. Without weights a
    source of n rows weighs sqrt(n), which raises small sources. A null source is a source of its own, named null.
    """
    counts = docs.groupBy(F.coalesce(F.col(source_col).cast("string"), F.lit("null")).alias("src")).agg(F.count(F.lit(1)).alias("n"))
    if weights is None:
        weighed = counts.withColumn("w", F.sqrt(F.col("n").cast("double")))
    else:
        pick = F.lit(0.0)
        for name, w in weights.items():
            pick = F.when(F.col("src") == name, F.lit(float(w))).otherwise(pick)
        weighed = counts.withColumn("w", pick)
    total = weighed.agg(F.sum("w").alias("tw"), F.sum("n").alias("tn"))
    return weighed.crossJoin(F.broadcast(total)).select(  # one row on the right side
        "src", "n", F.when(F.col("tw") > 0, F.lit(float(epochs)) * F.col("tn") * (F.col("w") / F.col("tw")) / F.col("n")).otherwise(F.lit(0.0)).alias("rate")
    )


def _cdf(rate: Column) -> Column:
    """P(X <= j) for j = 0, 1, ... until the rest is below the resolution of the uniform number."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    start = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("all"))

    def step(acc: Column, j: Column) -> Column:
        p = acc["p"] * rate / j
        c = acc["c"] + p
        return F.struct(p.alias("p"), c.alias("c"), F.concat(acc["all"], F.array(c)).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), start, step, lambda acc: acc["all"])


def copies(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 0) -> DataFrame:
    """docs with __rate and __n (Poisson count) added. A rate above MAX_RATE is split evenly into as few parts below it as
    can be, and the count is the sum of one draw for each part, by a hash of its own. Where docs has such a column, it
    stays and the added one has underscores behind its name.

    Null ids hash as the word null, so such rows share one draw, as do rows that repeat an id.
    """
    rate, n_copies = free_name(docs, "__rate"), free_name(docs, "__n")
    src, cdf, parts_, u_ = (free_name(docs, c) for c in ("__src", "__cdf", "__parts", "__u"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("rate") / MAX_RATE)).cast("int")
    rates = source_rates(docs, source_col, weights, epochs).select(F.col("src").alias(src), F.col("rate").alias(rate), parts.alias(parts_), _cdf(F.col("rate") / parts).alias(cdf))
    rates = cut(rates, "rates")
    if rates.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        rates = F.broadcast(rates)

    def drawn(u: Column) -> Column:
        return F.size(F.filter(cdf, lambda c: u >= c))

    u = _uniform(F.lit(seed), F.lit("n"), F.col(id_col))
    joined = docs.withColumn(src, F.coalesce(F.col(source_col).cast("string"), F.lit("null"))).withColumn(u_, u).join(rates, src)
    others = F.aggregate(F.sequence(F.lit(2), parts_), F.lit(0), lambda acc, k: acc + drawn(_uniform(F.lit(seed), F.concat(F.lit("n"), k.cast("string")), F.col(id_col))))
    n = drawn(F.col(u_)) + F.when(F.col(parts_) > 1, others).otherwise(F.lit(0))
    return joined.withColumn(n_copies, F.when(F.col(rate) > 0, n).otherwise(F.lit(0))).select(*docs.columns, rate, n_copies)


def shuffle_key(id_col: str = "doc_id", copy_col: str = "__copy", seed: int = 0) -> Column:
    """The place of a copy in the global hash order."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("k"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col(copy_col).cast("string")))


def number_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "__copy") -> DataFrame:
    """A mixed table whose __copy was dropped, with it again as column `name`: rows equal in id and text count from 1. Which
    of them has which number is left open. A window holds the copies of one document only."""
    w = Window.partitionBy(id_col, F.xxhash64(raw(text_col))).orderBy(F.lit(0))
    return docs.withColumn(name, F.row_number().over(w))


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: dict[str, float] | None = None, epochs: float = 1.0, seed: int = 0) -> DataFrame:
    """The mixed table: every row as often as its Poisson count, in a global hash order; columns as in docs, then
    __rate, __n, __copy (from 1) and __key (the shuffle key, ties broken by id and copy), the last four with underscores
    behind their names where docs has such columns. An empty table stays empty."""
    out = copies(docs, id_col, source_col, weights, epochs, seed)
    rate, n = out.columns[-2:]
    copy, key = free_name(docs, "__copy"), free_name(docs, "__key")
    out = out.where(F.col(n) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n))))
    out = out.withColumn(key, shuffle_key(id_col, copy, seed))
    order = [key, F.col(id_col), copy]
    return out.repartitionByRange(*order).sortWithinPartitions(*order).select(*docs.columns, rate, n, copy, key)
