"""Exact deduplication by deterministic block naming, DataFrame operations only.

A text is cut into fixed-size byte blocks. Distinct blocks are sorted, and a block's place in that order is its
integer name. Adjacent names are paired, distinct pairs are sorted and named in turn, until every text has a single
name. Equal (level, name) means equal bytes: no hash decides equality. Texts whose 64-bit fingerprint occurs once
cannot have an equal. A filter of fixed size holds the others' fingerprints; texts that it lacks have no equal and never
enter the naming, so only texts with copies, and a few that meet the filter by chance, are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, free_name, may_hold, raw, row_filter

BLOCK_BYTES = 16_384


def _ranked(distinct: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Sort the distinct keys over the whole table; the place in that order becomes the column `name`.

    The order is by a short hash first, then by the keys themselves, so that the sample which sets the ranges holds eight
    bytes a key and not whole blocks. After a range partitioning by the hash and a sort within partitions by hash and keys,
    (partition << 33) + row is increasing in that order. The result is written before use, so a lost executor cannot
    renumber it.
    """
    hashed = distinct.withColumn("__h", F.xxhash64(*keys))
    ordered = hashed.repartitionByRange("__h").sortWithinPartitions("__h", *keys).drop("__h")
    return cut(ordered.withColumn(name, F.monotonically_increasing_id()), "names")


def text_names(texts: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """texts (uid, body binary) -> (uid, level, name): rows have the same level and name iff their bodies are equal.

    An empty body is one empty block. Bodies of different block counts may end at the same level only if their names
    differ, as a pair with a missing right half keeps -1 there.
    """
    n_blocks = F.greatest(F.lit(1), F.ceil(F.octet_length("body") / F.lit(block_bytes))).cast("int")
    blocks = texts.select(
        "uid",
        F.posexplode(F.transform(F.sequence(F.lit(0), n_blocks - 1), lambda i: F.substring(F.col("body"), i * block_bytes + 1, F.lit(block_bytes)))).alias("idx", "block"),
    )
    names = _ranked(blocks.select("block").distinct(), ["block"], "name")
    current = cut(blocks.join(names, "block").select("uid", "idx", "name"), "level")
    done, level = None, 0
    while True:
        sizes = current.groupBy("uid").agg(F.max("idx").alias("last"))
        single = sizes.where("last = 0").select("uid")
        finished = current.where("idx = 0").join(single, "uid", "left_semi").select("uid", F.lit(level).alias("level"), "name")
        done = finished if done is None else done.unionByName(finished)
        open_ = current.join(sizes.where("last > 0").select("uid"), "uid", "left_semi")
        if current.agg(F.max("idx")).first()[0] in (None, 0):
            return done
        half = F.col("idx") % 2 == 0
        pairs = open_.groupBy("uid", F.shiftright("idx", 1).alias("idx")).agg(
            F.max(F.when(half, F.col("name"))).alias("l"), F.coalesce(F.max(F.when(~half, F.col("name"))), F.lit(-1)).alias("r")
        )
        names = _ranked(pairs.select("l", "r").distinct(), ["l", "r"], "name")
        current = cut(pairs.join(names, ["l", "r"]).select("uid", "idx", "name"), "level")
        level += 1


def _twins(docs: DataFrame, id_col: str, text_col: str, block_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(filter, met): the filter of the fingerprints that occur twice, and for each row that meets it doc_id, keep_id,
    group_size, kept, h, text_sha256."""
    rows = docs.select(F.col(id_col).alias("doc_id"), raw(text_col).alias("body")).withColumn("h", F.xxhash64("body"))
    shared = rows.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h")
    found = cut(row_filter(shared), "filter")
    sha = F.sha2("body", 256).alias("text_sha256")
    twins = cut(may_hold(rows, "h", found).select(F.monotonically_increasing_id().alias("uid"), "doc_id", "body", "h", sha), "twins")
    named = cut(text_names(twins.select("uid", "body"), block_bytes).join(twins.select("uid", "doc_id", "h", "text_sha256"), "uid"), "named")
    groups = named.groupBy("level", "name").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "uid")).alias("best"))
    groups = cut(groups, "groups")  # the join then has exchanges of its own, which adaptive execution can split at hot names
    met = named.join(groups, ["level", "name"])
    return found, met.select("doc_id", "keep_id", "group_size", (F.col("uid") == F.col("best.uid")).alias("kept"), "h", "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest id stays. Null texts count as empty and are equal to empty ones. Null ids
    rank below all others; where every id of a group is null, keep_id is null. Rows that repeat an id within a group
    tie: exactly one of them is kept. An empty table gives an empty result. Other columns are not read, so their
    names cannot clash. Rows whose fingerprint the filter lacks have no block names: each is a group of its own.
    """
    found, met = _twins(docs, id_col, text_col, block_bytes)
    rows = docs.select(F.col(id_col).alias("doc_id"), raw(text_col).alias("body")).withColumn("h", F.xxhash64("body"))
    alone = may_hold(rows.select("doc_id", "h", F.sha2("body", 256).alias("text_sha256")), "h", found, False)
    alone = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return alone.unionByName(met.drop("h"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the rows that exact_dedup() drops; all columns stay as they are, whatever their names.

    Rows that repeat both id and text cannot be told apart by the result, so one of them is left here, with the values
    that any one of them has in each further column (which, is not defined). Only rows that may have to go are shuffled.
    """
    _, met = _twins(docs, id_col, text_col, block_bytes)
    l_id, l_sha, l_again = (free_name(docs, c) for c in ("loser_id", "loser_sha", "loser_again"))
    again = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = met.where("not kept").select(F.col("doc_id").alias(l_id), F.col("text_sha256").alias(l_sha), again.alias(l_again), "h").distinct()
    gone = cut(gone, "gone")
    h, sha = free_name(docs, "body_hash"), free_name(docs, "body_sha")
    keyed = docs.withColumn(h, F.xxhash64(raw(text_col)))
    found = cut(row_filter(gone.select("h")), "filter")
    near = may_hold(keyed, h, found).withColumn(sha, F.sha2(raw(text_col), 256))
    near = near.join(gone.drop("h"), F.col(id_col).eqNullSafe(F.col(l_id)) & (F.col(sha) == F.col(l_sha)), "left")
    plain = near.where(F.col(l_again).isNull()).select(*docs.columns)
    repeated = near.where(l_again).dropDuplicates([id_col, sha]).select(*docs.columns)
    return may_hold(keyed, h, found, False).select(*docs.columns).unionByName(plain).unionByName(repeated)
