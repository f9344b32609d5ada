"""Shared helpers: table readers, clash-free column names, row filters of fixed size."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import cut, new_path, release, written  # noqa: F401  for the operators of this subpackage

#: Words are runs of characters other than ASCII white space.
SPACES = " \t\n\x0b\x0c\r"

#: Bits of a row filter, a fixed 8 MB.
FILTER_BITS = 1 << 26


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def empty_if_null(text: str | Column) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def raw(text: str | Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.encode(empty_if_null(text), "UTF-8")


#: Texts that a Python worker holds as objects at a time.
TEXTS = 256


def give_back() -> None:
    """Return freed memory to the system, which an idle Python worker would keep otherwise."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # not this C library
        pass


def slices(batches: Iterator[pa.RecordBatch], size: int = TEXTS) -> Iterator[pa.RecordBatch]:
    """Batches in parts of a few rows, so that a worker's objects are those of a part; memory is given back at the end."""
    for batch in batches:
        for at in range(0, len(batch), size):
            yield batch.slice(at, size)
    give_back()


def each(column: pa.Array, size: int = TEXTS) -> Iterator:
    """The values of a column as Python objects, made a few at a time."""
    for at in range(0, len(column), size):
        yield from column.slice(at, size).to_pylist()


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores behind it that no column of df has (names differ in more than case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Bits of one bitmap of bitmap_construct_agg().
_BITMAP = 1 << 15


def row_filter(hashes: DataFrame) -> DataFrame:
    """hashes (h long) -> (bucket, bits): bitmaps of FILTER_BITS bits in all, those of the hashes set. There are FILTER_BITS /
    _BITMAP rows at most, whatever the number of hashes; with very many of them every row passes may_hold()."""
    place = F.pmod(F.col("h"), F.lit(FILTER_BITS))
    rows = hashes.select(F.floor(place / _BITMAP).cast("int").alias("bucket"), F.pmod(place, F.lit(_BITMAP)).alias("place"))
    return rows.groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))


def may_hold(df: DataFrame, h: str, found: DataFrame, holds: bool = True) -> DataFrame:
    """The rows of df whose hash h is in the filter, by chance or not; with holds=False those whose hash is surely not."""
    bucket, bits = free_name(df, "bucket"), free_name(df, "bits")
    place = F.pmod(F.col(h), F.lit(FILTER_BITS))
    byte = F.conv(F.hex(F.substring(F.col(bits), (F.pmod(place, F.lit(_BITMAP)) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = (F.floor(place / _BITMAP).cast("int") == F.col(bucket)) & (F.getbit(byte, F.pmod(place, F.lit(8)).cast("int")) == 1)
    return df.join(F.broadcast(found.toDF(bucket, bits)), on, "left_semi" if holds else "left_anti")  # 8 MB at most
