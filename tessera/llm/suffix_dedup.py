"""Removal of repeated substrings by distributed, sparse prefix doubling.

Bytes covered by a string of `length` bytes that also starts elsewhere are removed. Naming every position at every
offset would multiply the input, so names are kept for positions that the text itself selects:

1. Within a text, names of 1, 2, 4, ... bytes are built by doubling. Every window of `length` bytes picks the smallest
   name of `gram` bytes within it as its anchor; equal windows have equal anchors at equal places, and consecutive windows
   share one. An anchor row stands for all of its windows.
2. Spark ranks anchors by their grams; those that are unique drop out, for none of their windows repeats. Anchors whose
   windows all repeat (equal grams and equal surroundings) are settled.
3. The other windows are named in groups of `group` neighbours at growing lengths: by the string that the windows of a
   group share, then by whole windows. What is unique at one length drops out before the next.

doubled_spans() is the plain method without a sample: Spark sorts the rank pairs of every position at growing offsets. It
is exact, but its tables and shuffles are over a hundred times the input, so it serves as the measure that the sample is
held to.

Two names that decide a removal together have 128 bits. Texts are read three times at most and shuffled once; what
follows runs over the texts that still have open anchors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, raw, slices
from .exact_dedup import _ranked

LENGTH = 400
GRAM = 100
GROUP = 16
#: Windows of a text that are processed at a time.
PIECE = 1 << 18
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)]
_VALUE = np.random.default_rng(5).integers(0, 2**64, 256, dtype=np.uint64)


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of a pair of names."""
    x = a * _M[0] + (b ^ (b >> np.uint64(29))) * _M[1]
    return (x ^ (x >> np.uint64(32))) * _M[2]


class Names:
    """names of substrings of one piece of text: level k names 2**k bytes, other lengths two overlapping levels."""

    def __init__(self, data: np.ndarray, longest: int):
        self.levels = [_VALUE[data]]
        while 2 << len(self.levels) - 1 <= min(longest, len(data)):
            half = 1 << (len(self.levels) - 1)
            low = self.levels[-1]
            self.levels.append(_join(low[:-half], low[half:]))

    def of(self, start: np.ndarray, size: np.ndarray | int) -> np.ndarray:
        size = np.broadcast_to(np.asarray(size, dtype=np.int64), start.shape)
        out = np.zeros(len(start), dtype=np.uint64)
        level = np.frexp(size.astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            at = level == k
            s, n = start[at], size[at]
            out[at] = _join(self.levels[k][s], self.levels[k][s + n - (1 << k)]) + n.astype(np.uint64) * _M[0]
        return out


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of `width` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def _pieces(body: bytes, length: int) -> Iterator[tuple[int, np.ndarray]]:
    """(place of the first window, bytes) of overlapping pieces that hold each window whole."""
    data = np.frombuffer(body, dtype=np.uint8)
    for at in range(0, len(data) - length + 1, PIECE):
        yield at, data[at : at + PIECE + length - 1]


def anchors(body: bytes, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(gram's name, name of all bytes of its windows with its place among them, anchor, first and last window): a row for
    each run of windows with one anchor."""
    out = []
    for base, data in _pieces(body, length):
        names = Names(data, 2 * length)
        places = np.arange(len(data) - gram + 1)
        grams = names.of(places, gram)
        keyed = (grams & ~np.uint64((1 << 24) - 1)) | places.astype(np.uint64)  # ties go to the left
        at = (_sliding_min(keyed, length - gram + 1) & np.uint64((1 << 24) - 1)).astype(np.int64)
        first = np.nonzero(np.r_[True, at[1:] != at[:-1]])[0]
        last = np.r_[first[1:] - 1, len(at) - 1]
        a = at[first]
        union = _join(names.of(first, last - first + length), (a - first).astype(np.uint64))
        out.append((grams[a], union, a + base, first + base, last + base))
    return tuple(np.concatenate(c) for c in zip(*out)) if out else tuple(np.zeros(0, np.uint64 if k < 2 else np.int64) for k in range(5))


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def _keys(batch: pa.RecordBatch, rows: np.ndarray) -> list[pa.Array]:
    return [batch.column(k).take(pa.array(rows, pa.int64())) for k in (0, 1)]


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, merged half-open spans; touching ones become one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def doubled_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """texts (uid, body) -> (uid, lo, hi): every string of `length` bytes that starts at two places, by prefix doubling.

    A position's first rank is its byte. At each offset the pairs of a position's rank and that of the position so far
    ahead are sorted over the whole table; a pair's place in that order is the new rank. Positions with a pair of their own
    start no repeated string and drop out, and with them those that would need their rank.
    """
    at = F.posexplode(F.split(F.hex("body"), "(?<=\\G..)")).alias("pos", "r")
    ranks = cut(texts.where(F.octet_length("body") >= length).select("uid", at).where("r <> ''").select("uid", "pos", F.conv("r", 16, 10).cast("long").alias("r")), "ranks")
    have = 1
    while have < length:
        step = min(have, length - have)
        ahead = ranks.select("uid", (F.col("pos") - step).alias("pos"), F.col("r").alias("s"))
        pairs = cut(ranks.join(ahead, ["uid", "pos"]), "pairs")
        names = _ranked(pairs.groupBy("r", "s").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("r", "s"), ["r", "s"], "name")
        ranks = cut(pairs.join(names, ["r", "s"]).select("uid", "pos", F.col("name").alias("r")), "ranks")
        have += step
    return ranks.select("uid", F.col("pos").cast("long").alias("lo"), (F.col("pos") + length).cast("long").alias("hi"))


#: A document is its id and its body's fingerprint; ids may be null.
_ON = "doc_id <=> w and h = wh"


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): spans (doc_id, h, lo, hi) cover every window of `length` bytes that occurs twice, texts (doc_id, h,
    body) are the documents that have such windows or had open anchors. h is a fingerprint of the body, so rows that
    repeat an id with another text stay apart; rows that repeat id and text have the same spans."""
    rows = docs.select(F.col(id_col).alias("doc_id"), raw(text_col).alias("body"))
    rows = rows.select("doc_id", F.xxhash64("body").alias("h"), "body")
    kind = dict(rows.dtypes)["doc_id"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [anchors(b, length, gram) for b in batch.column(2).to_pylist()]
            which = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            if not len(which):
                continue
            columns = [_long(np.concatenate(c)) for c in zip(*found)]
            yield pa.RecordBatch.from_arrays([*_keys(batch, which), *columns], ["doc_id", "h", "g", "u", "a", "lo", "hi"])

    # rank the grams; the surroundings of those that are not unique decide which anchors are settled and which stay open
    marks = rows.where(F.octet_length("body") >= length).mapInArrow(find, f"doc_id {kind}, h long, g long, u long, a long, lo long, hi long")
    marks = cut(marks, "anchors")
    # counts are written before they are joined: the join then has exchanges of its own, which adaptive execution splits at hot names
    twice = cut(marks.groupBy("g").agg(F.count(F.lit(1)).alias("gn")).where("gn > 1").select("g"), "twice")
    marks = cut(marks.join(twice, "g", "left_semi"), "shared")
    kinds = cut(marks.groupBy("g", "u").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "h", "a", "lo", "hi")).alias("one")), "kinds")
    several = cut(kinds.groupBy("g").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("g"), "several")
    settled = marks.join(kinds.where("n > 1").select("g", "u"), ["g", "u"], "left_semi").select("doc_id", "h", "lo", "hi")
    open_ = kinds.join(several, "g", "left_semi").select("g", "one.*")
    settled = cut(settled, "settled")
    per_doc = settled.select("doc_id", "h").distinct().unionByName(open_.select("doc_id", "h").distinct()).distinct()
    anchored = open_.groupBy(F.col("doc_id").alias("w"), F.col("h").alias("wh")).agg(F.collect_list(F.struct("g", "a", "lo", "hi")).alias("open"))
    wanted = cut(per_doc.join(anchored, F.expr(_ON), "left").select(F.col("doc_id").alias("w"), F.col("h").alias("wh"), "open"), "wanted")
    texts = rows.join(wanted, F.expr(_ON))
    texts = cut(texts.select("doc_id", "h", "body", "open"), "texts")

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for k, (body, todo) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                out = []
                data = np.frombuffer(body, dtype=np.uint8)
                for t in todo:
                    d0, d1 = t["a"] - t["hi"], t["a"] - t["lo"]  # distances from window to anchor
                    for x in range(d0 // group, d1 // group + 1):
                        near, far = max(d0, x * group), min(d1, x * group + group - 1)
                        out.append((t["g"], x, t["a"] - far, t["a"] - near, t["a"] - x * group, t["a"] - x * group - group + 1 + length))
                if not out:
                    continue
                g, x, lo, hi, c0, c1 = (np.array(v, dtype=np.int64) for v in zip(*out))
                common, whole = _named(data, c0, c1 - c0), _named(data, lo, hi - lo + length)
                place = x.astype(np.uint64)
                common = _join(common ^ g.view(np.uint64), place)
                whole = _join(whole, _join(place, (c0 - lo).astype(np.uint64)))
                yield pa.RecordBatch.from_arrays([*_keys(batch, np.full(len(g), k)), _long(common), _long(whole), _long(lo), _long(hi)], ["doc_id", "h", "c", "w", "lo", "hi"])

    some = texts.where("open is not null").distinct()  # rows that repeat id and text stand for one here
    named = cut(some.mapInArrow(groups, f"doc_id {kind}, h long, c long, w long, lo long, hi long"), "groups")
    kinds2 = named.groupBy("c", "w").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "h", "lo", "hi")).alias("one"))
    kinds2 = cut(kinds2, "kinds")
    several2 = cut(kinds2.groupBy("c").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("c"), "several")
    settled2 = named.join(kinds2.where("n > 1").select("c", "w"), ["c", "w"], "left_semi").select("doc_id", "h", "lo", "hi")
    left = kinds2.join(several2, "c", "left_semi").select("c", "one.*").groupBy("doc_id", "h").agg(F.collect_list(F.struct("c", "lo", "hi")).alias("todo"))
    left = left.withColumnRenamed("doc_id", "w").withColumnRenamed("h", "wh")

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for k, (body, todo) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                data = np.frombuffer(body, dtype=np.uint8)
                at = np.concatenate([np.arange(t["lo"], t["hi"] + 1) for t in todo])
                c = np.repeat(np.array([t["c"] for t in todo], dtype=np.int64), [t["hi"] - t["lo"] + 1 for t in todo])
                yield pa.RecordBatch.from_arrays([*_keys(batch, np.full(len(at), k)), _long(c), _long(_named(data, at, np.full(len(at), length))), _long(at)], ["doc_id", "h", "c", "w", "lo"])

    last = texts.where("open is not null").select("doc_id", "h", "body").distinct().join(left, F.expr(_ON))
    single = cut(last.select("doc_id", "h", "body", "todo").mapInArrow(windows, f"doc_id {kind}, h long, c long, w long, lo long"), "windows")
    twice = cut(single.groupBy("c", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("c", "w"), "twice")
    settled3 = single.join(twice, ["c", "w"], "left_semi").select("doc_id", "h", "lo", F.col("lo").alias("hi"))
    spans = settled.unionByName(settled2).unionByName(settled3).select("doc_id", "h", "lo", (F.col("hi") + length).alias("hi"))
    return texts.select("doc_id", "h", "body"), spans


def _named(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Names of the given substrings; long texts are named piece by piece."""
    out = np.zeros(len(start), dtype=np.uint64)
    order = np.argsort(start, kind="stable")
    k = 0
    while k < len(order):
        base = int(start[order[k]])
        stop = k + int(np.searchsorted(start[order[k:]], base + PIECE))
        rows = order[k:stop]
        names = Names(data[base : int((start + size)[rows].max())], int(size[rows].max()))
        out[rows] = names.of(start[rows] - base, size[rows])
        k = stop
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, group: int = GROUP, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept, the bytes left, if with_text).

    Every byte covered by a string of `length` bytes that starts at two places, in one document or two, is removed; all
    strings are judged on the input. Overlaps count. Null texts count as empty; texts shorter than `length` stay
    whole. Rows that repeat a text, their id or both are documents of their own and lose all of it that reaches the length.
    An empty table gives an empty result. Other columns are not read.
    """
    texts, spans = repeated_spans(docs, id_col, text_col, length, gram, group)
    merged = spans.distinct().groupBy("doc_id", "h").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
    merged = merged.withColumnRenamed("doc_id", "w").withColumnRenamed("h", "wh")
    kind = dict(texts.dtypes)["doc_id"]
    hit = texts.distinct().join(merged, F.expr(_ON)).select("doc_id", "h", "body", "spans")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            removed, runs, digests, kept = [], [], [], []
            for body, found in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                gone = covered([(s["lo"], s["hi"]) for s in found])
                edges = [0, *(x for s in gone for x in s), len(body)]
                rest = b"".join(body[a:b] for a, b in zip(edges[::2], edges[1::2]))
                removed.append(len(body) - len(rest))
                runs.append(len(gone))
                digests.append(hashlib.sha256(rest).hexdigest())
                kept.append(rest)
            columns = [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests)]
            yield pa.RecordBatch.from_arrays([*columns, *([pa.array(kept, pa.binary())] if with_text else [])], ["w", "wh", "r", "s", "d", *(["k"] if with_text else [])])

    changed = cut(hit.mapInArrow(remove, f"w {kind}, wh long, r long, s long, d string" + ", k binary" * with_text), "changed")
    every = docs.select(F.col(id_col).alias("doc_id"), raw(text_col).alias("body"))
    every = every.select("doc_id", F.xxhash64("body").alias("h"), F.octet_length("body").cast("long").alias("n_bytes"), F.sha2("body", 256).alias("whole"), *(["body"] if with_text else []))
    out = every.join(changed, F.expr(_ON), "left")
    return out.select(
        "doc_id", "n_bytes", F.coalesce("r", F.lit(0)).cast("long").alias("n_removed"), F.coalesce("s", F.lit(0)).cast("long").alias("n_spans"),
        F.coalesce("d", "whole").alias("kept_sha256"), *([F.coalesce("k", "body").alias("kept")] if with_text else []),
    )
