"""Exact Jaccard self-join of word-shingle sets by a prefix-tree join, reduced to components.

Sets are ordered by one global order, frequent shingles last. Rows of the first part of each ordered set meet in one
shuffle. That part is longer than the prefix that similar sets must share one name of: over a longer part they must share
many, so a set that shares fewer names with all others together is settled by a count, and only the rest is compared.
Sets are compared through a trie of ordered sets: a probe walks it once, sets that begin alike share the partial overlap,
and a subtree is left as soon as what remains cannot reach the threshold.

A group of thousands of near copies would meet in all pairs, so pairs of sets are never made. First each set is compared
with one hub that it often meets, a set of few names of its own (stars), and components are formed. Then sets of one
component and about one size form units, and units of different components that still meet often enough are compared: the
larger unit's sets are one trie, the smaller's sets walk it, and a walk ends at its first link, as one link joins two
components. No pair of units is left out unless a count shows that it holds no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TEXTS, cut, each, free_name, give_back, may_hold, raw, row_filter, slices
from .components import connected_components

SHINGLE, PERCENT = 5, 75
#: Shingles that the order puts last, at most; others keep their hash order. The order steers work, not results.
MAX_FREQUENT = 1 << 18
#: The share of each ordered set, in per cent, that takes part in the shuffle; at least the prefix.
PART = 35
#: Of the names that two sets must share, one in so many is asked for between units.
LEAST = 20
#: Sizes of a unit's sets differ by this factor at most.
BAND = 1.05
#: Names that a unit's sets hold together, about, and a group of probes, too: 4 MB a trie.
UNIT_NAMES = 1 << 19
#: Bits in the bitmap of the texts whose sets are needed again, a fixed 8 MB; when it fills up, more sets than needed are made.
BITMAP = 1 << 26
#: Shingles counted at a time; one that a block holds once is not carried on (lossy counting).
BLOCK = 1 << 20
#: The last place that a name's row tells apart, all of its lowest 16 bits.
LAST = (1 << 16) - 1
#: Sets that one task compares with one hub before the rest go to another.
PROBED = 1000

_rng = np.random.default_rng(3)
_VALUE = _rng.integers(0, 2**64, 256, dtype=np.uint64)
_VALUE[65:91] = _VALUE[97:123]  # A-Z count as a-z
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_M = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        for k, base in enumerate((_BASE, _INVERSE)):
            x = np.full(size, base, dtype=np.uint64)
            x[0] = 1
            _powers[k] = np.multiply.accumulate(x)
    return _powers[0][:n], _powers[1][:n]


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _M[0] + (b ^ (b >> np.uint64(31))) * _M[1]
    return (x ^ (x >> np.uint64(33))) * _M[2]


def shingles(body: bytes, size: int = SHINGLE) -> np.ndarray:
    """The set of 64-bit names of a text's word shingles, rising. Fewer words than `size` give one name for them all."""
    data = np.frombuffer(body, dtype=np.uint8)
    n = len(data)
    space = _SPACE[data]
    edge = np.diff(np.r_[True, space, True].astype(np.int8))
    begin, end = np.nonzero(edge == -1)[0], np.nonzero(edge == 1)[0]
    if not len(begin):
        return np.zeros(0, dtype=np.uint64)
    up, down = _power(n + 1)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data] * up[:n], out=total[1:])
    words = (total[end] - total[begin]) * down[begin]
    words = _mix(words, (end - begin).astype(np.uint64))
    k = min(size, len(words))
    name = words[: len(words) - k + 1]
    for j in range(1, k):
        name = _mix(name, words[j : len(words) - k + 1 + j])
    return np.unique(name if k == size else _mix(name, np.uint64([k])))


def digest(names: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums over a set, as signed integers."""
    with np.errstate(over="ignore"):
        a = np.add.reduce(_mix(names, names >> np.uint64(7)), dtype=np.uint64)
        b = np.add.reduce(_mix(names ^ _M[2], names), dtype=np.uint64)
    return int(a.view(np.int64)), int(b.view(np.int64))


def prefix_size(n: int, percent: int = PERCENT) -> int:
    """Sets of n names that reach the threshold with a set share a name within the first so many."""
    return n - -(-percent * n // 100) + 1


def part_size(n: int, percent: int = PERCENT) -> int:
    return max(prefix_size(n, percent), -(-PART * n // 100))


def _reach(lo, hi, lo2, hi2, percent: int):
    """(reach, reach2, least) for two sets of lo to hi and of lo2 to hi2 names: if they reach the threshold, they share at
    least `least` names that lie before place reach of the one and reach2 of the other. Of their alpha common names the
    k-th has alpha - k common ones behind it in both sets. A larger `least` asks more of a pair, but for longer parts."""
    alpha = lambda n, m: -(-percent * (n + m) // (100 + percent))  # noqa: E731  rises by less than 1 a name
    behind = [x - np.maximum(x - -(-percent * x // 100) + 1, -(-PART * x // 100)) for x in (hi, hi2)]  # names outside the part, rising with x
    few = alpha(lo, lo2)
    least = np.maximum(1, np.minimum(few // LEAST, few - np.maximum(*behind)))
    return hi - alpha(hi, lo2) + least, hi2 - alpha(lo, hi2) + least, least


class Order:
    """The global order: by count among the frequent names, 0 for all others, then by name."""

    def __init__(self, names: np.ndarray, counts: np.ndarray):
        at = np.argsort(names)
        self.names, self.counts = names[at], counts[at]

    def sort(self, names: np.ndarray) -> np.ndarray:
        """names rising -> names in global order."""
        if not len(self.names):
            return names
        at = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        weight = np.where(self.names[at] == names, self.counts[at], 0)
        return names[np.argsort(weight, kind="stable")] if weight.any() else names


class Trie:
    """Ordered sets as a path-compressed trie in arrays: sets sorted, each with the length it shares with the one before.

    walk() passes over the sets in that order, which is the trie's depth-first order, and keeps the overlap at each depth
    of the current path, so that a shared part is counted once."""

    STEP = 48

    def __init__(self, sets: list[np.ndarray]):
        self.order = sorted(range(len(sets)), key=lambda k: sets[k].tobytes())
        self.sets = [sets[k] for k in self.order]
        self.shared = [0]
        for a, b in zip(self.sets, self.sets[1:]):
            n = min(len(a), len(b))
            differ = np.nonzero(a[:n] != b[:n])[0]
            self.shared.append(int(differ[0]) if len(differ) else n)

    def walk(self, probe: np.ndarray, percent: int = PERCENT) -> Iterator[int]:
        """Numbers (as given to the constructor) of the sets that reach the threshold with probe (names rising)."""
        m = len(probe)
        path: list[tuple[int, int]] = [(0, 0)]  # (depth, overlap up to it) at places where it was counted
        dead = 1 << 62  # depth at which the current path was left
        for number, s, shared in zip(self.order, self.sets, self.shared):
            if shared >= dead:
                continue  # within the subtree that was left
            dead = 1 << 62
            while path[-1][0] > shared:
                path.pop()
            depth, overlap = path[-1]
            n = len(s)
            while depth < n:
                stop = min(n, depth + self.STEP)
                part = s[depth:stop]
                at = np.minimum(np.searchsorted(probe, part), m - 1)
                overlap += int((probe[at] == part).sum())
                depth = stop
                most = overlap + min(n - depth, m - overlap)
                path.append((depth, overlap))
                if 100 * m < percent * (m + depth - overlap):  # even if all of the probe's rest followed
                    dead = depth
                    break
                if 100 * most < percent * (n + m - most):
                    break
            else:
                if 100 * overlap >= percent * (n + m - overlap):
                    yield number


#: Rows of output that a Python worker holds at a time.
ROWS = 1 << 18


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _first_pass(docs: DataFrame, size: int) -> DataFrame:
    """A row for each document (doc_id, th, n, d0, d1) and, with d0 null, a row (g, c) for each name that a block of
    documents holds more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def repeated() -> pa.RecordBatch | None:
            names, c = np.unique(np.concatenate(held), return_counts=True)
            names, c = names[c > 1], c[c > 1]
            none = pa.nulls(len(names), pa.int64())
            return pa.RecordBatch.from_arrays([pa.nulls(len(names), kind), none, none, none, none, _signed(names), pa.array(c, pa.int64())], columns) if len(names) else None

        columns = ["doc_id", "th", "n", "d0", "d1", "g", "c"]
        kind = None
        seen: set[int] = set()
        for batch in slices(batches):
            kind = batch.schema.field(0).type
            n, d0, d1 = [], [], []
            for body in each(batch.column(2)):
                names = shingles(body, size)
                a, b = digest(names)
                n.append(len(names))
                d0.append(a)
                d1.append(b)
                if a not in seen:  # equal sets count once in a block
                    seen.add(a)
                    held.append(names)
                    count += len(names)
                if count >= BLOCK:
                    if (out := repeated()) is not None:
                        yield out
                    held, count, seen = [], 0, set()
            none = pa.nulls(len(n), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(d0, pa.int64()), pa.array(d1, pa.int64()), none, none], columns)
        if held and (out := repeated()) is not None:
            yield out

    kind = dict(docs.dtypes)["doc_id"]
    return docs.mapInArrow(run, f"doc_id {kind}, th long, n long, d0 long, d1 long, g long, c long")


def _parts(docs: DataFrame, order: Order, size: int, percent: int) -> DataFrame:
    """(k, d, n) for each name in the part of each distinct set of a task. k holds 48 bits of the name and below them its
    place from 0, LAST at most: names that fall together by chance and places that are told too early only add work. Of all
    shuffles this is the largest, and what differs between neighbours lies side by side, so that it is compressed well."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        k, d, n, held = [], [], [], 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([_signed(np.concatenate(k)), pa.array(np.concatenate(d)), pa.array(np.concatenate(n))], ["k", "d", "n"])

        for batch in slices(batches):
            for body in each(batch.column(2)):
                names = shingles(body, size)
                if not len(names) or (key := digest(names)[0]) in seen:
                    continue
                seen.add(key)
                part = part_size(len(names), percent)
                k.append(order.sort(names)[:part] & ~np.uint64(LAST) | np.minimum(np.arange(part, dtype=np.uint64), np.uint64(LAST)))
                d.append(np.full(part, key, dtype=np.int64))
                n.append(np.full(part, len(names), dtype=np.int32))
                held += part
                if held >= ROWS:
                    yield out()
                    k, d, n, held = [], [], [], 0
        if k:
            yield out()

    return docs.mapInArrow(run, "k long, d long, n int")


def _runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[list[np.ndarray]]:
    """Batches sorted by their first column -> tables that hold each of its values whole."""
    rest: list[np.ndarray] | None = None
    for batch in batches:
        now = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(width)]
        if not len(now[0]):
            continue
        if rest is not None:
            now = [np.r_[a, b] for a, b in zip(rest, now)]
        stop = int(np.searchsorted(now[0], now[0][-1]))
        if stop:
            yield [c[:stop] for c in now]
        rest = [c[stop:] for c in now]
    if rest is not None:
        yield rest


def _meetings(parts: DataFrame, percent: int) -> DataFrame:
    """(g, d, n, p): the rows whose name another set of a fitting size has, too. A run of one name is never held whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None  # the last row decided and those behind it
        known = 0
        for batch in batches:
            if not len(batch):
                continue
            k, d, n = (batch.column(c).to_numpy() for c in range(3))
            now = [k >> 16, d, n, (k & LAST).astype(np.int32)]
            rows = [np.r_[a, b] for a, b in zip(rest, now)] if rest else now
            g, d = rows[0], rows[1]
            fresh = np.r_[True, (g[1:] != g[:-1]) | (d[1:] != d[:-1])]  # equal sets of several tasks
            rows = [c[fresh] for c in rows]
            keep = fitting(rows)
            keep[:known] = keep[-1] = False  # the last row's next one is not known yet
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in rows], ["g", "d", "n", "p"])
            known = min(1, len(keep) - 1)
            rest = [c[-1 - known :] for c in rows]
        if rest:
            keep = fitting(rest)
            keep[:-1] = False
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in rest], ["g", "d", "n", "p"])
        give_back()

    def fitting(rows: list[np.ndarray]) -> np.ndarray:
        g, n = rows[0], rows[2].astype(np.int64)
        fits = (g[1:] == g[:-1]) & (100 * n[:-1] >= percent * n[1:])  # sizes rise within a run
        return np.r_[False, fits] | np.r_[fits, False]

    name = F.shiftright("k", 16)
    rows = parts.repartition(name).sortWithinPartitions(name, "n", "d")
    return rows.mapInArrow(run, "g long, d long, n int, p int")


def _stars(meetings: DataFrame) -> DataFrame:
    """(a, b): each open set b with the hub a that it meets most often. The hub of a name and size is the set that has the
    largest share of its names in common with others, as a text does whose copies were changed at places of their own."""
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(4 / 3)))).cast("int")
    rows = meetings.withColumn("band", band)
    hubs = rows.groupBy("g", "band").agg(F.max(F.struct("score", "d")).alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1")
    hubs = cut(hubs.select("g", "band", F.col("top.d").alias("lead")), "hubs")  # the join then has exchanges of its own, which can be split at hot names
    met = rows.join(hubs, ["g", "band"]).where("lead <> d")
    met = met.groupBy("d", "lead").agg(F.count(F.lit(1)).alias("c"))
    return met.groupBy(F.col("d").alias("b")).agg(F.max_by("lead", F.struct("c", "lead")).alias("a")).select("a", "b")


def _open_sets(meetings: DataFrame, percent: int) -> DataFrame:
    """(g, d, n, p, score): the rows of the sets that meet others often enough for a link to be possible at all, and the
    share of their part that meets. A set's rows meet in one shuffle, to be counted and kept at once; a set has no more of
    them than its part."""
    n = F.col("n").cast("long")
    up = lambda a, b: F.expr(f"(({a}) + {b} - 1) div {b}")
    counts = meetings.withColumn("c", F.count(F.lit(1)).over(Window.partitionBy("d")))
    counts = counts.withColumn("n", n).withColumn("lo", up(f"{percent} * n", 100)).withColumn("hi", F.expr(f"100 * n div {percent}"))
    part = lambda x: F.greatest(F.expr(f"{x}") - up(f"{percent} * {x}", 100) + 1, up(f"{PART} * {x}", 100))
    least = None
    for m in ("lo", "hi"):
        alpha = up(f"{percent} * (n + {m})", 100 + percent)
        value = alpha - F.greatest(F.col("n") - part("n"), F.col(m) - part(m))
        least = value if least is None else F.least(least, value)
    return counts.where(F.col("c") >= least - 2).select("g", "d", F.col("n").cast("int").alias("n"), "p", (F.col("c") / part("n")).alias("score"))  # 2: between the ends, rounding may take one or two off


def _addressed(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """sets (d, names), distinct, with where pairs (a, b), one of each b, take them: hub and salt of a set that is some b,
    parts of one that is an a; null if it is none. Done while the sets are together by d: names are not sent again for it."""
    salts = cut(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(PROBED)).cast("int").alias("parts")), "parts")
    led = pairs.join(salts, "a").select(F.col("b").alias("d"), F.col("a").alias("hub"), F.pmod(F.hash("b"), "parts").alias("salt"))
    return sets.join(led, "d", "left").join(salts.withColumnRenamed("a", "d"), "d", "left").select("d", "names", "hub", "salt", "parts")


def _linked(sets: DataFrame, percent: int) -> DataFrame:
    """sets as of _addressed() -> the pairs (hub, set) that reach the threshold. Each hub is a probe; its sets come behind
    it in sorted batches and form tries, so memory is bounded by a slice of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, probe = None, None
        for batch in slices(batches):
            a, b, kind = (batch.column(k).to_pylist() for k in (0, 1, 3))
            names = [np.frombuffer(x, dtype="<u8") for x in batch.column(2).to_pylist()]
            out: list[tuple[int, int]] = []
            k = 0
            while k < len(a):
                if not kind[k]:  # the probe's own row comes before its sets
                    lead, probe = a[k], np.sort(names[k])
                    k += 1
                    continue
                stop = k
                while stop < len(a) and kind[stop]:
                    stop += 1
                trie = Trie(names[k:stop])
                out += [(lead, b[k + j]) for j in trie.walk(probe, percent)]
                k = stop
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    other = sets.where("hub is not null").select(F.col("hub").alias("a"), "salt", F.col("d").alias("b"), "names", F.lit(1).alias("kind"))
    own = sets.where("parts is not null").select(F.col("d").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.col("d").alias("b"), "names", F.lit(0).alias("kind"))
    rows = own.unionByName(other).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind", "names")
    rows = rows.select(F.col("a"), F.col("b"), F.col("names"), "kind")
    return rows.mapInArrow(run, "a long, b long")


def _units(meetings: DataFrame, components: DataFrame) -> DataFrame:
    """(d, component, u, size): the unit of each open set. A unit has sets of one component and about one size, and few
    enough of them for one trie; size is the number of names that it holds."""
    members = meetings.groupBy("d").agg(F.first("n").cast("long").alias("n"))
    members = members.join(components.select(F.col("node").alias("d"), "component"), "d", "left").withColumn("component", F.coalesce("component", "d"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(BAND)))).cast("int")
    members = cut(members.withColumn("band", band), "members")
    parts = members.groupBy("component", "band").agg(F.ceil(F.sum("n") / F.lit(UNIT_NAMES)).cast("int").alias("parts"), F.sum("n").alias("size"))
    unit = F.xxhash64("component", "band", F.pmod(F.hash("d"), "parts"))
    return members.join(cut(parts, "parts"), ["component", "band"]).select("d", "component", unit.alias("u"), F.floor(F.col("size") / F.col("parts")).alias("size"))


def _unit_pairs(meetings: DataFrame, units: DataFrame, percent: int) -> DataFrame:
    """(a, b): units of different components that share enough names at the rare ends of their orders. A name counts for a
    pair only where it comes early enough in both (_reach), so a passage of many sets makes pairs only of those that hold
    little else. Within a name a unit is one row, however many sets it has there."""
    fewest = F.expr(f"({percent} * cast(n as long) + 99) div 100")  # names shared with a set of any fitting size
    rows = meetings.where(F.col("p") < F.col("n") - fewest + F.greatest(F.lit(1), F.floor(fewest / LEAST)))
    rows = rows.select("g", "d", F.col("n").cast("long").alias("n"), F.col("p").cast("long").alias("p")).join(units, "d")
    rows = rows.groupBy("g", "u", "component").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("p").alias("p"), F.first("size").alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0

        def counted() -> pa.RecordBatch:
            rows = np.concatenate(held)
            order = np.lexsort((rows[:, 1], rows[:, 0]))
            rows = rows[order]
            start = np.nonzero(np.r_[True, (rows[1:, :2] != rows[:-1, :2]).any(axis=1)])[0]
            c = np.diff(np.r_[start, len(rows)])
            return pa.RecordBatch.from_arrays([pa.array(rows[start, 0]), pa.array(rows[start, 1]), pa.array(np.minimum.reduceat(rows[:, 2], start)), pa.array(c.astype(np.int64))], ["a", "b", "least", "c"])

        for g, lo, hi, u, comp, p, size in _runs(batches, 7):
            start = np.r_[np.nonzero(np.r_[True, g[1:] != g[:-1]])[0], len(g)]
            for x, y in zip(start[:-1].tolist(), start[1:].tolist()):
                if y - x < 2:
                    continue
                names, c = np.unique(comp[x:y], return_counts=True)
                if len(names) < 2:
                    continue
                few = np.r_[np.nonzero(comp[x:y] != names[c.argmax()])[0]] + x  # pairs within the largest component are not wanted
                for k in few.tolist():
                    j = np.arange(x, y)
                    j = j[(comp[j] != comp[k]) & ((comp[j] == names[c.argmax()]) | (j > k)) & (100 * lo[j] <= 100 * 100 * hi[k] // percent) & (100 * lo[k] <= 100 * 100 * hi[j] // percent)]
                    reach, reaches, least = _reach(lo[k], hi[k], lo[j], hi[j], percent)
                    ok = (p[k] < reach) & (p[j] < reaches)
                    j, least = j[ok], least[ok]
                    if len(j):
                        mine = (size[j] < size[k]) | ((size[j] == size[k]) & (u[j] < u[k]))  # the larger unit is a
                        held.append(np.stack([np.where(mine, u[k], u[j]), np.where(mine, u[j], u[k]), least], axis=1))
                        count += len(j)
                    if count >= BLOCK:
                        yield counted()
                        held, count = [], 0
        if held:
            yield counted()
        give_back()

    found = rows.repartition("g").select("g", "lo", "hi", "u", "component", "p", "size").sortWithinPartitions("g", "lo", "u")
    found = found.mapInArrow(run, "a long, b long, least long, c long")
    return found.groupBy("a", "b").agg(F.sum("c").alias("c"), F.min("least").alias("least")).where("c >= least").select("a", "b")


def _joined(pairs: DataFrame, units: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs of units (a, b) -> links (a, b) that join their components: one at most for each unit a and component of the
    sets that meet it in a task. The sets of a form a trie and come first; those of its b walk it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, trie, held, done = None, None, [], set()
        for batch in slices(batches):
            a, salt, kind, d, component = (batch.column(k).to_pylist() for k in range(5))
            names = [np.frombuffer(x, dtype="<u8") for x in batch.column(5).to_pylist()]
            out: list[tuple[int, int]] = []
            for k in range(len(a)):
                if key != (a[k], salt[k]):
                    key, trie, held, done = (a[k], salt[k]), None, [], set()
                if not kind[k]:
                    held.append((d[k], names[k].copy()))
                    continue
                trie = trie or Trie([x for _, x in held])
                if component[k] not in done and (hit := next(trie.walk(np.sort(names[k]), percent), None)) is not None:
                    done.add(component[k])
                    out.append((held[hit][0], d[k]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"])

    own = units.select(F.col("u").alias("a"), "d", "component")
    probes = pairs.join(units.select(F.col("u").alias("b"), "d", "component", "size"), "b").select("a", "d", "component", "size")
    sets = sets.select("d", "names")
    sizes = sets.select("d", F.octet_length("names").alias("bytes"))  # before the join: names need not be sent to be counted
    salts = probes.join(sizes, "d").groupBy("a").agg(F.ceil(F.sum("bytes") / F.lit(8 * UNIT_NAMES)).cast("int").alias("parts"))
    salts = cut(salts, "salts")
    probes = probes.join(sets, "d").join(salts, "a").select("a", F.pmod(F.hash("d"), "parts").alias("salt"), F.lit(1).alias("kind"), "d", "component", "names")
    tries = salts.join(own, "a").join(sets, "d").select("a", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), F.lit(0).alias("kind"), "d", "component", "names")
    rows = tries.unionByName(probes).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind", "component", "d")
    return rows.mapInArrow(run, "a long, b long")


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """A bitmap of BITMAP bits in which the hashes (th) are set; its size does not depend on their number."""
    place = F.pmod(F.col("th"), F.lit(BITMAP))
    words = hashes.select((place / 64).cast("long").alias("w"), F.expr("shiftleft(1L, cast(pmod(th, 64) as int))").alias("b"))
    found = words.groupBy("w").agg(F.bit_or("b").alias("b")).toPandas()  # at most BITMAP / 64 rows
    bits = np.zeros(BITMAP // 64, dtype=np.uint64)
    bits[found["w"].to_numpy(np.int64)] = found["b"].to_numpy(np.int64).view(np.uint64)
    return bits


def _found(docs: DataFrame, id_col: str, text_col: str, size: int, percent: int) -> DataFrame:
    """One row per document: doc_id, th (hash of its text), n_shingles, component_id as in jaccard_components(), and
    component, a name of the component that is null only for documents without a set."""
    rows = docs.select(F.col(id_col).alias("doc_id"), raw(text_col).alias("body"))
    rows = rows.select("doc_id", F.xxhash64("body").alias("th"), "body")
    first = cut(_first_pass(rows, size), "sets")
    each = first.where("d0 is not null").select("doc_id", "th", "n", "d0", "d1")
    classes = each.where("n > 0").groupBy("d0", "d1").agg(F.min("doc_id").alias("least"), F.min("th").alias("th"))
    frequent = first.where("d0 is null").groupBy("g").agg(F.sum("c").alias("c"))
    top = frequent.orderBy(F.desc("c"), "g").limit(MAX_FREQUENT).toPandas()  # at most MAX_FREQUENT rows
    order = Order(top["g"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64))

    meetings = cut(_open_sets(_meetings(_parts(rows, order, size, percent), percent), percent), "meetings")
    open_ = cut(meetings.select("d").distinct(), "open")
    stars = cut(_stars(meetings), "stars")
    wanted = _bitmap(open_.select(F.col("d").alias("d0")).join(classes, "d0").select("th"))

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            th = batch.column(0).to_numpy()
            at = th % BITMAP
            hit = np.nonzero(wanted[at // 64] >> (at % 64).astype(np.uint64) & np.uint64(1))[0]
            for lo in range(0, len(hit), TEXTS):
                sets = [shingles(body, size) for body in batch.column(1).take(pa.array(hit[lo : lo + TEXTS])).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([digest(x)[0] for x in sets], pa.int64()), pa.array([order.sort(x).astype("<u8").tobytes() for x in sets], pa.binary())], ["d", "names"])
        give_back()

    sets = rows.select("th", "body").mapInArrow(ordered, "d long, names binary").join(open_.select("d"), "d", "left_semi")
    sets = cut(_addressed(sets.dropDuplicates(["d"]), stars), "ordered")

    links = cut(_linked(sets, percent), "links")
    units = cut(_units(meetings, connected_components(links)), "units")
    across = cut(_unit_pairs(meetings, units, percent), "across")
    links = links.unionByName(_joined(across, units, sets, percent))
    nodes = connected_components(links).withColumnRenamed("node", "d0")

    known = classes.select("d0", "d1", "least").join(nodes, "d0", "left").withColumn("component", F.coalesce("component", "d0"))
    known = cut(known, "classes")
    least = cut(known.groupBy("component").agg(F.min("least").alias("component_id")), "least")  # a join with exchanges of its own can be split
    named = known.join(least, "component").select(F.col("d0"), F.col("d1"), "component_id", "component")
    out = each.where("n > 0").join(named, ["d0", "d1"]).select("doc_id", "th", F.col("n").alias("n_shingles"), "component_id", "component")
    return out.unionByName(each.where("n = 0").select("doc_id", "th", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("long").alias("component")))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Words are runs of characters other than ASCII white space, A-Z lower-cased. A document's set are its distinct
    shingles of `size` words, or all its words as one where it has fewer. Documents link where 100 * intersection >=
    percent * union; component_id is the smallest doc_id reachable by links. Null and empty texts and texts without words
    have no set and link with nothing. Null ids are never the smallest; a component of null ids alone has a null
    component_id. Rows that repeat an id or a text are documents of their own; equal sets link. An empty table gives an
    empty result. Other columns are not read. Sets and shingles are compared by 64-bit names, classes of equal sets by 128.
    """
    return _found(docs, id_col, text_col, size, percent).select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs with one row of each component: that of the smallest id, null ids last, and of the smallest hash of the text
    among rows that repeat that id; all columns stay. Rows go by id and 64-bit hash of the text, so a row that repeats the
    id of a dropped one stays if it is of another component. Rows equal in id and text are reduced to one, whichever values
    their other columns have. Documents without a set all stay."""
    found = _found(docs, id_col, text_col, size, percent).where("component is not null")
    found = cut(found.groupBy("doc_id", "th").agg(F.min("component").alias("component"), F.count(F.lit(1)).alias("c")), "rows")
    best = found.groupBy("component").agg(F.min(F.struct(F.isnull("doc_id").alias("unnamed"), "doc_id", "th")).alias("best"))
    best = cut(best.select(F.col("best.doc_id").alias("__id"), F.col("best.th").alias("__th")), "best")

    on = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("th") == F.col("__th"))
    h, l_id, l_th, l_again = (free_name(docs, c) for c in ("body_hash", "loser_id", "loser_hash", "loser_again"))
    gone = found.join(best, on, "left_anti").select(F.col("doc_id").alias(l_id), F.col("th").alias(l_th), F.lit(False).alias(l_again))
    again = found.where("c > 1").join(best, on, "left_semi").select(F.col("doc_id").alias(l_id), F.col("th").alias(l_th), F.lit(True).alias(l_again))
    gone = cut(gone.unionByName(again), "gone")
    bits = cut(row_filter(gone.select(F.col(l_th).alias("h"))), "filter")
    keyed = docs.withColumn(h, F.xxhash64(raw(text_col)))
    near = may_hold(keyed, h, bits).join(gone, F.col(id_col).eqNullSafe(F.col(l_id)) & (F.col(h) == F.col(l_th)), "left")
    plain = near.where(F.col(l_again).isNull()).select(*docs.columns)
    repeated = near.where(l_again).dropDuplicates([id_col, h]).select(*docs.columns)
    return may_hold(keyed, h, bits, False).select(*docs.columns).unionByName(plain).unionByName(repeated)
