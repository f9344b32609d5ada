"""Order-preserving packing into fixed windows by dynamic programming.

The token stream of the documents, in id order or a given one, is cut into windows. Cuts may fall after a document, after
a sentence, or, where neither comes for a whole window, anywhere. The cost of a plan is its padding plus a penalty for each cut within
a document; a monotone queue finds the best previous cut of each cut in amortised constant time. Streams are planned in
blocks of about a million ids, so memory is bounded by a block and the longest document.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each, empty_if_null, slices
from .tokens import default_path, encoder

WINDOW = 4096
END_ID = 2
BLOCK_IDS = 1 << 20
SENTENCE_COST, HARD_COST = 4, 64
#: Whole windows of these lengths need no padding.
SHORT = (2048, 1024, 512)


def plan(ends: np.ndarray, costs: np.ndarray, window: int = WINDOW, short: tuple[int, ...] = SHORT) -> list[int]:
    """ends: rising places where a cut may fall, the last being the stream's end; costs: the penalty of each. Returns the
    chosen places, the end included. Where two ends are more than a window apart, cuts at HARD_COST are added."""
    if not len(ends):
        return []
    gaps = np.diff(np.r_[0, ends])
    if gaps.max() > window:
        more = [np.arange(a + window, b, window) for a, b in zip(np.r_[0, ends[:-1]][gaps > window], ends[gaps > window])]
        hard = np.concatenate(more)
        ends, costs = np.r_[ends, hard], np.r_[costs, np.full(len(hard), HARD_COST)]
        order = np.argsort(ends, kind="stable")
        ends, costs = ends[order], costs[order]
    pos = np.r_[0, ends].astype(np.int64)
    back = []
    for size in short:
        if size < window:
            at = np.searchsorted(pos, pos - size)
            back.append(np.where(pos[np.minimum(at, len(pos) - 1)] == pos - size, at, -1).tolist())
    p, c = pos.tolist(), [0, *costs.tolist()]
    best, prev = [0] * len(p), [0] * len(p)
    queue: deque[int] = deque([0])  # indexes with rising best + p
    for j in range(1, len(p)):
        here = p[j]
        while here - p[queue[0]] > window:
            queue.popleft()
        i = queue[0]
        cost = best[i] + window - (here - p[i])
        for b in back:
            k = b[j]
            if k >= 0 and best[k] < cost:
                cost, i = best[k], k
        cost += c[j]
        best[j], prev[j] = cost, i
        key = cost + here
        while queue and best[queue[-1]] + p[queue[-1]] >= key:
            queue.pop()
        queue.append(j)
    cuts, j = [], len(p) - 1
    while j:
        cuts.append(p[j])
        j = prev[j]
    return cuts[::-1]


def sentence_ids(tokens: dict[int, str]) -> np.ndarray:
    """Ids whose token is only sentence-ending marks."""
    return np.array(sorted(i for i, s in tokens.items() if (t := s.removesuffix("</w>")) and not t.strip(".!?")), dtype=np.uint32)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, window: int = WINDOW, end_id: int = END_ID, block_ids: int = BLOCK_IDS, carry: bool = False, order: Sequence[str | Column] = ()) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids if carry is set).

    A null text is an empty one and still has its end id. Null ids sort first. Rows that repeat an id are documents of
    their own, each counting its ids from 0. An empty table gives an empty result. sequence_id is unique over the
    table and rises with the documents' ids; it is not dense. Other columns are not read.

    With order, columns or expressions of docs, the stream has that order and sequence_id rises along it; ties are broken
    by id and text.
    """
    path = tokenizer or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        stops = np.zeros(max(enc.vocab_size, end_id + 1), dtype=bool)
        stops[sentence_ids(enc.token_strings())] = True
        sequence = TaskContext.get().partitionId() << 33
        closing = np.array([end_id], dtype=np.uint32)
        keys: list = []
        parts: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            ids = np.concatenate(parts)
            sizes = np.array([len(x) for x in parts], dtype=np.int64)
            last = np.cumsum(sizes)
            first = last - sizes
            cut = stops[ids]
            cut[:-1] &= ~cut[1:]  # after the last of several marks
            cut[last - 1] = False
            inner = np.nonzero(cut)[0] + 1
            inner = inner[~np.isin(inner, last)]
            ends = np.r_[inner, last]
            costs = np.r_[np.full(len(inner), SENTENCE_COST), np.zeros(len(last), dtype=np.int64)]
            order = np.argsort(ends, kind="stable")
            bounds = np.r_[0, plan(ends[order], costs[order], window)]
            edges = np.unique(np.r_[bounds, last])
            begin, end = np.r_[0, edges[:-1]], edges
            begin, end = begin[end > begin], end[end > begin]
            doc = np.searchsorted(last, begin, side="right")
            seq = np.searchsorted(bounds, begin, side="right") - 1
            data = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(begin.tolist(), end.tolist())]
            columns = {
                "doc_id": pa.array([keys[k] for k in doc.tolist()], kind),
                "start": pa.array(begin - first[doc]),
                "length": pa.array(end - begin),
                "ids_crc32": pa.array(crc, pa.int64()),
                "doc_tokens": pa.array(sizes[doc]),
                "sequence_id": pa.array(sequence + seq),
                "offset": pa.array(begin - bounds[seq]),
            }
            if carry:
                columns["ids"] = pa.array([ids[a:b].astype(np.int32) for a, b in zip(begin.tolist(), end.tolist())], pa.list_(pa.int32()))
            sequence += len(bounds) - 1
            return pa.RecordBatch.from_pydict(columns)

        kind = None
        for batch in slices(batches):
            kind = batch.schema.field(0).type
            for key, text in zip(each(batch.column(0)), each(batch.column(1))):
                ids = np.concatenate((enc.encode(text), closing))
                keys.append(key)
                parts.append(ids)
                held += len(ids)
                if held >= block_ids:
                    yield flush()
                    keys, parts, held = [], [], 0
        if keys:
            yield flush()

    by = {f"__order{k}": F.col(c) if isinstance(c, str) else c for k, c in enumerate(order)}
    rows = docs.select(F.col(id_col).alias("doc_id"), empty_if_null(text_col).alias("text"), *[c.alias(k) for k, c in by.items()])
    ties = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(*by, *ties).sortWithinPartitions(*by, *ties).select("doc_id", "text")
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids array<int>" * carry
    return rows.mapInArrow(run, schema)
