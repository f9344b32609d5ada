"""Token-id shards with a minimal perfect hash index.

A shard file holds, in ascending key order, the ids of a range of documents, and behind them an index: a minimal perfect
hash sends a key to a slot, the slot holds a fingerprint of its key and the first row and number of rows of that key,
and a table of offsets gives each row's place in the payload. Everything has a fixed width, so opening a shard reads its
head alone, whose size does not depend on the rows, and a lookup reads one block of bits a level (fewer than two on the
average), one slot and two offsets. Shards are written beside their final name and renamed, so a repeated task replaces
equal bytes. A manifest, a table with a row a shard, names them.

Layout, little-endian: 8 bytes magic; payload (2 or 4 bytes an id); keys int64[rows], which only scans read; offsets
int64[rows + 1]; slots of 20 bytes (fingerprint uint32, first row int64, number of rows int64); the levels' blocks of 72
bytes (number of bits set before it int64, 512 bits); head: int64 counts (id bytes, rows, null rows, keys, ids, levels),
int64 places of keys, offsets, slots and blocks, int64 bits of each level; 8 bytes place of the head; 8 bytes magic. Rows
whose key is null come first and are not hashed.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, each, empty_if_null, new_path, slices
from .tokens import default_path, encoder

MAGIC = b"TOKSHRD2"
#: Bits of a block, and its bytes with the count before it.
BLOCK, BLOCK_BYTES = 512, 72
SLOT = np.dtype([("print", "<u4"), ("first", "<i8"), ("count", "<i8")])
SHARD_IDS = 1 << 23
#: Files of the manifest, at most; it has one small row a shard.
MANIFEST_FILES = 8
END_ID = 1
GAMMA = 2


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    x = keys.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Levels of bit arrays: a key settles on the first level where no other key shares its bit; its slot is the number
    of set bits before its own."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before = np.cumsum([0, *(int(x.sum()) for x in levels)])
        self.ranks = [np.r_[0, np.cumsum(x)] for x in levels]

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """keys: distinct."""
        levels = []
        while len(keys):
            size = max(64, GAMMA * len(keys))
            at = (_mixed(keys, len(levels)) % np.uint64(size)).astype(np.int64)
            single = np.bincount(at, minlength=size) == 1
            levels.append(single)
            keys = keys[~single[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for keys that settle nowhere. Unknown keys may get any slot: compare fingerprints."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for k, bits in enumerate(self.levels):
            at = (_mixed(keys[left], k) % np.uint64(len(bits))).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = self.before[k] + self.ranks[k][at[hit]]
            left = left[~hit]
        return out


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mixed(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


def encode_shard(keys: list[int | None], rows: list[np.ndarray], id_bytes: int) -> Iterator[bytes]:
    """The bytes of a shard, part by part. keys ascending, nulls first; rows: the ids of each."""
    kind = "<u2" if id_bytes == 2 else "<u4"
    nulls = sum(k is None for k in keys)
    values = np.array([0 if k is None else k for k in keys], dtype="<i8")
    distinct, first, count = np.unique(values[nulls:], return_index=True, return_counts=True)
    mph = PerfectHash.build(distinct)
    slot = mph.slots(distinct)
    slots = np.zeros(len(distinct), SLOT)
    slots["print"][slot], slots["first"][slot], slots["count"][slot] = fingerprints(distinct), first + nulls, count
    offsets = np.cumsum([0, *map(len, rows)]).astype("<i8")
    blocks = []
    for before, bits in zip(mph.before.tolist(), mph.levels):
        full = np.zeros(-(-len(bits) // BLOCK) * BLOCK, dtype=bool)
        full[: len(bits)] = bits
        full = full.reshape(-1, BLOCK)
        counts = before + np.cumsum(np.r_[0, full.sum(axis=1)[:-1]])
        blocks.append(np.concatenate([counts.astype("<i8").view(np.uint8).reshape(-1, 8), np.packbits(full, axis=1)], axis=1).tobytes())
    parts = [values.tobytes(), offsets.tobytes(), slots.tobytes(), b"".join(blocks)]
    places = np.cumsum([len(MAGIC) + id_bytes * int(offsets[-1]), *map(len, parts)])
    head = np.array([id_bytes, len(keys), nulls, len(distinct), offsets[-1], len(mph.levels), *places[:4], *map(len, mph.levels)], dtype="<i8")
    yield MAGIC
    yield from (np.concatenate(rows[k : k + 1024]).astype(kind).tobytes() for k in range(0, len(rows), 1024))
    yield from [*parts, head.tobytes(), np.array([places[4]], dtype="<i8").tobytes(), MAGIC]


class Shard:
    """A shard opened from a random-access file: its head is read at once, all else where it is asked for."""

    def __init__(self, file, size: int):
        self.file = file
        tail = self._read(size - 16, 16)
        at = int(np.frombuffer(tail, "<i8", 1)[0])
        if tail[8:] != MAGIC:
            raise ValueError("not a token shard")
        head = np.frombuffer(self._read(at, size - 16 - at), "<i8").tolist()
        self.id_bytes, self.n_rows, self.nulls, self.n_keys, self.n_ids, depth = head[:6]
        self.at_keys, self.at_offsets, self.at_slots, self.at_blocks = head[6:10]
        self.sizes = head[10 : 10 + depth]

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def find(self, key: int) -> tuple[int, int]:
        """(first row, number of rows) of a key; number 0 where the fingerprint says that the key is unknown."""
        keys, at = np.array([key], dtype=np.int64), self.at_blocks
        for level, size in enumerate(self.sizes):
            bit = int(_mixed(keys, level)[0] % np.uint64(size))
            block = self._read(at + bit // BLOCK * BLOCK_BYTES, BLOCK_BYTES)
            bits, inner = int.from_bytes(block[8:], "big"), bit % BLOCK
            if bits >> (BLOCK - 1 - inner) & 1:
                slot = int.from_bytes(block[:8], "little") + (bits >> (BLOCK - inner)).bit_count()
                found = np.frombuffer(self._read(self.at_slots + slot * SLOT.itemsize, SLOT.itemsize), SLOT)[0]
                return (int(found["first"]), int(found["count"])) if found["print"] == fingerprints(keys)[0] else (0, 0)
            at += -(-size // BLOCK) * BLOCK_BYTES
        return 0, 0

    def ids(self, row: int) -> np.ndarray:
        a, b = np.frombuffer(self._read(self.at_offsets + 8 * row, 16), "<i8").tolist()
        return np.frombuffer(self._read(len(MAGIC) + self.id_bytes * a, self.id_bytes * (b - a)), "<u2" if self.id_bytes == 2 else "<u4").astype("<u4")

    # scans ------------------------------------------------------------------------------------------------------------

    def scan(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, offsets, ids) of the whole shard; the first `nulls` keys stand for nulls."""
        keys = np.frombuffer(self._read(self.at_keys, 8 * self.n_rows), "<i8")
        offsets = np.frombuffer(self._read(self.at_offsets, 8 * (self.n_rows + 1)), "<i8")
        return keys, offsets, np.frombuffer(self._read(len(MAGIC), self.id_bytes * self.n_ids), "<u2" if self.id_bytes == 2 else "<u4").astype("<u4")

    def rows_of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """find() of many keys at once, from the whole index."""
        if not self.n_keys:
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        levels, at = [], self.at_blocks
        for size in self.sizes:
            n = -(-size // BLOCK)
            blocks = np.frombuffer(self._read(at, n * BLOCK_BYTES), np.uint8).reshape(n, BLOCK_BYTES)
            levels.append(np.unpackbits(blocks[:, 8:], axis=1).ravel()[:size].astype(bool))
            at += n * BLOCK_BYTES
        slots = np.frombuffer(self._read(self.at_slots, self.n_keys * SLOT.itemsize), SLOT)
        slot = PerfectHash(levels).slots(keys)
        found = slots[np.maximum(slot, 0)]
        return found["first"], np.where((slot >= 0) & (found["print"] == fingerprints(keys)), found["count"], 0)


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return (pafs.LocalFileSystem(), uri) if uri.startswith("/") else pafs.FileSystem.from_uri(uri)


def open_shard(uri: str) -> Shard:
    fs, path = _place(uri)
    return Shard(fs.open_input_file(path), fs.get_file_info(path).size)


@dataclass
class Store:
    """A folder of shards and their manifest: uri, first and last key, n_rows, n_ids, ids before."""

    spark: SparkSession
    folder: str

    def shards(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/manifest")

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of every document with this key, in file order; [] for an unknown key, unless its fingerprint is by chance
        (1 in 2**32) that of another one."""
        near = self.shards().where(F.col("last").isNotNull() & (F.col("last") >= key) & (F.coalesce("first", F.lit(key)) <= key))
        found = []
        for r in near.orderBy("before").select("uri").collect():  # one shard, or those that a repeated key fills
            shard = open_shard(r["uri"])
            first, n = shard.find(key)
            found += [shard.ids(first + k) for k in range(n)]
        return found


def write_tokens(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = END_ID, shard_ids: int = SHARD_IDS) -> Store:
    """Encode every text, append end_id, and write shards of about shard_ids ids in ascending id order to folder, which
    driver and executors must share. Null texts are empty; null ids come first; rows that repeat an id are all kept,
    next to each other, in an order of their texts' hashes. An empty table gives a store without shards. Nothing comes to the
    driver."""
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        width = 2 if max(enc.vocab_size, end_id + 1) <= 1 << 16 else 4
        part = TaskContext.get().partitionId()
        fs, base = _place(folder)
        fs.create_dir(base, recursive=True)
        keys, rows, held, number = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            name = f"{part:08d}-{number:06d}.tok"
            temp = f"{base}/_{name}-{uuid.uuid4().hex}"
            with fs.open_output_stream(temp) as out:
                for data in encode_shard(keys, rows, width):
                    out.write(data)
            fs.move(temp, f"{base}/{name}")
            return pa.RecordBatch.from_pydict(
                {"part": [part], "number": [number], "uri": [f"{folder}/{name}"], "first": pa.array([keys[0]], pa.int64()), "last": pa.array([keys[-1]], pa.int64()), "n_rows": [len(keys)], "n_ids": [sum(map(len, rows))]}
            )

        for batch in slices(batches):
            for key, text in zip(each(batch.column(0)), each(batch.column(1))):
                ids = np.r_[enc.encode(text), np.uint32(end_id)]
                keys.append(key)
                rows.append(ids.astype("<u2") if width == 2 else ids)
                held += len(ids)
                if held >= shard_ids:
                    yield flush()
                    keys, rows, held, number = [], [], 0, number + 1
        if keys:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), empty_if_null(text_col).alias("text"))
    rows = rows.withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    said = cut(rows.mapInArrow(run, "part long, number long, uri string, first long, last long, n_rows long, n_ids long"), "shards")
    # ids before a part, over one row a part, and within it
    parts = said.groupBy("part").agg(F.sum("n_ids").alias("sum"))
    parts = parts.select("part", (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("earlier"))
    inner = F.sum("n_ids").over(Window.partitionBy("part").orderBy("number")) - F.col("n_ids")
    said = said.withColumn("inner", inner).join(parts, "part")
    said.select("uri", "first", "last", "n_rows", "n_ids", (F.col("earlier") + F.col("inner")).alias("before")).coalesce(MANIFEST_FILES).write.mode("overwrite").parquet(f"{folder}/manifest")
    return Store(docs.sparkSession, folder)


def read_tokens(store: Store) -> DataFrame:
    """One row per document, from the files: doc_id, start, n_tokens, ids_crc32. Every keyed row is fetched through the
    index of its shard; a row that the index does not give back raises an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = open_shard(uri)
                all_keys, offsets, ids = shard.scan()
                keys = np.unique(all_keys[shard.nulls :])
                first, n = shard.rows_of(keys)
                rows = [*range(shard.nulls), *(r for a, k in zip(first.tolist(), n.tolist()) for r in range(a, a + k))]
                if len(rows) != shard.n_rows or not np.array_equal(np.repeat(keys, n), all_keys[rows[shard.nulls :]]):
                    raise ValueError(f"the index of {uri} lacks rows")
                at = offsets.tolist()
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([None if r < shard.nulls else int(all_keys[r]) for r in rows], pa.int64()),
                        "start": pa.array([before + at[r] for r in rows], pa.int64()),
                        "n_tokens": pa.array([at[r + 1] - at[r] for r in rows], pa.int64()),
                        "ids_crc32": pa.array([zlib.crc32(ids[at[r] : at[r + 1]]) for r in rows], pa.int64()),
                    }
                )

    return store.shards().select("uri", "before").repartition("uri").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Write all documents and read them back; see write_tokens() and read_tokens()."""
    spark = docs.sparkSession
    return read_tokens(write_tokens(docs, folder or new_path(spark, "tokens"), id_col, text_col, tokenizer))
