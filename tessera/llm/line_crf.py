"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's potential comes from its own binned features and those of its neighbours;
transitions tie neighbouring labels. Forward-backward marginals, weighted by line length, give a document's share of good
text, and a two-parameter logistic map turns that into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import exp, log1p

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import each, empty_if_null, slices

MAX_TRAIN = 3000
#: Lower bounds of the bins of each line feature; the first bin holds what lies below all bounds.
BINS = {
    "bytes": (1, 20, 60, 150, 400, 1000),
    "mean_word": (2, 4, 6, 8, 12),
    "symbols": (0.001, 0.01, 0.03, 0.08, 0.2),
    "pipes": (0.001, 0.02, 0.05, 0.1),
    "marks": (0.001, 0.02, 0.05, 0.1),
    "upper": (0.001, 0.05, 0.1, 0.3, 0.6),
    "digits": (0.001, 0.02, 0.05, 0.15),
    "adjacent": (0.001, 0.05, 0.2, 0.5),
    "stops": (0.001, 0.01, 0.03),
    "ends_mark": (0.5,),
}
_OFFSET = np.cumsum([0, *(len(v) + 1 for v in BINS.values())])
N_ONE = int(_OFFSET[-1])
#: Own features, those of the line before, those of the line after, first line, last line, bias.
N_FEATURES = 3 * N_ONE + 3

_CLASS = np.zeros((256, 7), dtype=np.int32)  # letters and other bytes, symbols, pipes, ! and ?, upper, digits, white space
for _b in range(256):
    _c = chr(_b)
    _k = 6 if _c in " \t\r\x0b\x0c\n" else 2 if _c == "|" else 1 if _c in "#*$%&<>" else 3 if _c in "!?" else 4 if "A" <= _c <= "Z" else 5 if "0" <= _c <= "9" else 0
    _CLASS[_b, _k] = 1
_KIND = _CLASS.argmax(axis=1).astype(np.uint8)
_VALUE = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)


def line_bins(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(lines, features) bin numbers and the lines' lengths in bytes, of the lines that are not empty."""
    data = np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)
    n = len(data)
    if not n:
        return np.zeros((0, len(BINS)), np.int64), np.zeros(0, np.int64)
    breaks = np.nonzero(data == 10)[0]
    begin, end = np.r_[0, breaks + 1], np.r_[breaks, n]
    keep = end > begin
    begin, end = begin[keep], end[keep]
    size = end - begin
    if not len(begin):
        return np.zeros((0, len(BINS)), np.int64), np.zeros(0, np.int64)
    kind = _KIND[data]
    line_of = np.repeat(np.arange(len(begin)), size)
    inside = kind[data != 10]
    counts = np.bincount(line_of * 7 + inside, minlength=7 * len(begin)).reshape(-1, 7)
    space = kind == 6
    w0 = np.nonzero(~space & np.r_[True, space[:-1]])[0]
    w1 = np.nonzero(~space & np.r_[space[1:], True])[0] + 1
    word_line = np.searchsorted(begin, w0, side="right") - 1
    n_words = np.bincount(word_line, minlength=len(begin))
    # equality of neighbouring words: first byte, length and a sum of random values of their bytes (anagrams pass: this is a feature, not a test)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(_VALUE[data], out=total[1:])
    code, long = total[w1] - total[w0], w1 - w0
    same = (code[1:] == code[:-1]) & (long[1:] == long[:-1]) & (word_line[1:] == word_line[:-1]) & (data[w0[1:]] == data[w0[:-1]])
    adjacent = np.bincount(word_line[1:][same], minlength=len(begin))
    short = (w1 - w0 <= 3) & (kind[w0] == 0)
    stops = np.bincount(word_line[short], minlength=len(begin))
    chars = np.maximum(size - counts[:, 6], 1)
    words = np.maximum(n_words, 1)
    values = (
        size, (size - counts[:, 6]) / words, counts[:, 1] / chars, counts[:, 2] / chars, counts[:, 3] / chars, counts[:, 4] / chars, counts[:, 5] / chars,
        adjacent / words, stops / words, np.isin(data[end - 1], [33, 46, 63]).astype(float),
    )
    return np.stack([np.searchsorted(edges, v, side="right") for edges, v in zip(BINS.values(), values)], axis=1), size


def potentials(bins: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log-odds of good for each line of one document."""
    one = bins + _OFFSET[:-1]
    own, prev, nxt = weights[:N_ONE], weights[N_ONE : 2 * N_ONE], weights[2 * N_ONE : 3 * N_ONE]
    out = own[one].sum(axis=1) + weights[-1]
    out[1:] += prev[one[:-1]].sum(axis=1)
    out[:-1] += nxt[one[1:]].sum(axis=1)
    out[0] += weights[-3]
    out[-1] += weights[-2]
    return out


def _message(x: np.ndarray, stay_good: float, stay_bad: float) -> np.ndarray:
    """Log-odds that a neighbour with log-odds x passes on, transitions weighing exp(stay) for equal labels."""
    return np.logaddexp(x + stay_good, 0.0) - np.logaddexp(x, stay_bad)


def marginals(node: np.ndarray, stay_good: float, stay_bad: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(log-odds of good given all lines, forward, backward messages) of one chain."""
    n = len(node)
    f, b = [0.0] * n, [0.0] * n
    x, sg, sb = node.tolist(), stay_good, stay_bad

    def log_add(a: float, c: float) -> float:
        return (a if a > c else c) + log1p(exp(-abs(a - c)))

    for k in range(1, n):
        v = f[k - 1] + x[k - 1]
        f[k] = log_add(v + sg, 0.0) - log_add(v, sb)
    for k in range(n - 2, -1, -1):
        v = b[k + 1] + x[k + 1]
        b[k] = log_add(v + sg, 0.0) - log_add(v, sb)
    f, b = np.array(f), np.array(b)
    return node + f + b, f, b


@dataclass(frozen=True)
class LineModel:
    weights: np.ndarray
    stay_good: float
    stay_bad: float
    scale: float
    shift: float

    def share(self, text: str) -> float:
        """Length-weighted mean marginal of good; 0.5 without lines."""
        bins, size = line_bins(text)
        if not len(size):
            return 0.5
        odds, _, _ = marginals(potentials(bins, self.weights), self.stay_good, self.stay_bad)
        return float((size / size.sum()) @ (1 / (1 + np.exp(-np.clip(odds, -40, 40)))))

    def score(self, text: str) -> float:
        s = min(max(self.share(text), 1e-6), 1 - 1e-6)
        return float(1 / (1 + np.exp(-(self.scale * np.log(s / (1 - s)) + self.shift))))


def _chains(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers (lines, used features; the bias's number fills) and the documents' ends."""
    rows = []
    for bins in sequences:
        one = bins + _OFFSET[:-1]
        n, pad = len(one), np.full((1, one.shape[1]), N_FEATURES)
        before, after = np.r_[pad, one[:-1] + N_ONE], np.r_[one[1:] + 2 * N_ONE, pad]
        first, last = np.full((n, 1), N_FEATURES), np.full((n, 1), N_FEATURES)
        first[0], last[-1] = N_FEATURES - 3, N_FEATURES - 2
        rows.append(np.hstack([one, before, after, first, last, np.full((n, 1), N_FEATURES - 1)]))
    return np.concatenate(rows), np.cumsum([len(r) for r in rows])


def fit(sequences: list[np.ndarray], labels: list[int], sizes: list[np.ndarray], steps: int = 120, ridge: float = 1e-3) -> LineModel:
    """sequences: bins of each document's lines; labels: 1 good, 0 bad, taken over by every line. Maximises the
    conditional likelihood by Adam with fixed steps, then fits the map from share to probability."""
    used = [k for k, s in enumerate(sequences) if len(s)]
    if not used or len({labels[k] for k in used}) < 2:
        rate = float(np.mean(labels)) if len(labels) else 0.5
        return LineModel(np.zeros(N_FEATURES), 0.0, 0.0, 0.0, float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))
    seqs = [sequences[k] for k in used]
    y_doc = np.array([labels[k] for k in used], dtype=float)
    ids, ends = _chains(seqs)
    starts = np.r_[0, ends[:-1]]
    length = ends - starts
    y = np.repeat(y_doc, length)
    share = np.repeat(1 / length, length)  # every document counts alike
    theta, m, v = np.zeros(N_FEATURES + 3), np.zeros(N_FEATURES + 3), np.zeros(N_FEATURES + 3)
    by_len = np.argsort(-length, kind="stable")
    rank_len = length[by_len]
    s0 = starts[by_len]
    inner = np.ones(len(y), dtype=bool)
    inner[starts] = False  # lines with a line before them
    pair = np.nonzero(inner)[0]
    for step in range(1, steps + 1):
        w, sg, sb = theta[: N_FEATURES + 1].copy(), theta[-2], theta[-1]
        w[N_FEATURES] = 0.0
        node = w[ids].sum(axis=1)
        f, b = np.zeros(len(y)), np.zeros(len(y))
        for k in range(1, int(rank_len[0])):
            at = s0[: np.searchsorted(-rank_len, -k, side="left")] + k
            f[at] = _message(f[at - 1] + node[at - 1], sg, sb)
            rows = np.nonzero(rank_len > k)[0]
            back = s0[rows] + rank_len[rows] - 1 - k
            b[back] = _message(b[back + 1] + node[back + 1], sg, sb)
        p = 1 / (1 + np.exp(-np.clip(node + f + b, -40, 40)))
        err = (y - p) * share
        grad = np.bincount(ids.ravel(), weights=np.repeat(err, ids.shape[1]), minlength=N_FEATURES + 1)[: N_FEATURES + 1]
        left, right = (node + f)[pair - 1], (node + b)[pair]
        z = np.stack([left + right + sg, left, right, np.full(len(pair), sb)])
        z = np.exp(z - z.max(axis=0))
        z /= z.sum(axis=0)
        grad = np.r_[grad, ((y[pair] - z[0]) * share[pair]).sum(), ((1 - y[pair] - z[3]) * share[pair]).sum()] / len(seqs)
        grad[N_FEATURES] = 0.0
        grad -= ridge * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += 0.15 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    model = LineModel(theta[:N_FEATURES], float(theta[-2]), float(theta[-1]), 1.0, 0.0)
    odds = np.zeros(len(seqs))
    for k, i in enumerate(used):
        o, _, _ = marginals(potentials(seqs[k], model.weights), model.stay_good, model.stay_bad)
        s = float((sizes[i] / sizes[i].sum()) @ (1 / (1 + np.exp(-np.clip(o, -40, 40)))))
        s = min(max(s, 1e-6), 1 - 1e-6)
        odds[k] = np.log(s / (1 - s))
    a, c = 1.0, 0.0
    for _ in range(300):
        p = 1 / (1 + np.exp(-np.clip(a * odds + c, -40, 40)))
        a += 0.02 * float(((y_doc - p) * odds).mean()) - 1e-4 * (a - 1)
        c += 0.3 * float((y_doc - p).mean())
    return LineModel(model.weights, model.stay_good, model.stay_bad, max(a, 0.05), c)


def held_out(id_col: str | Column) -> Column:
    """True where crc32 of the id as text leaves 1 when divided by 3; a null id counts as the text null."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.encode(F.coalesce(c.cast("string"), F.lit("null")), "UTF-8")) % 3 == 1


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> LineModel:
    """Fit on a bounded sample: the max_train labelled ids with the smallest hashes among those not held out, and of their
    rows (an id may repeat) the max_train with the smallest text hashes. Rows with a null label are not used; of
    contradicting labels of one id the larger counts."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    known = known.groupBy(F.col(id_col).alias("__id")).agg(F.max(label_col).cast("int").alias("__y"))
    chosen = known.orderBy(F.md5(F.col("__id").cast("string")), "__id").limit(max_train)
    rows = docs.select(F.col(id_col).alias("__id"), empty_if_null(text_col).alias("__t")).join(F.broadcast(chosen), "__id")  # at most max_train rows on the right
    rows = rows.withColumn("__h", F.xxhash64("__t")).orderBy("__h", "__id").limit(max_train).drop("__h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [line_bins(t) for t in each(batch.column("__t"))]
            yield pa.RecordBatch.from_pydict(
                {"__id": batch.column("__id"), "y": batch.column("__y"), "bins": pa.array([b.astype(np.uint8).tobytes() for b, _ in found], pa.binary()), "size": pa.array([s.astype("<i4").tobytes() for _, s in found], pa.binary())}
            )

    found = rows.mapInArrow(run, f"__id {dict(rows.dtypes)['__id']}, y int, bins binary, size binary").toPandas().sort_values(["__id", "bins"])
    bins = [np.frombuffer(b, np.uint8).reshape(-1, len(BINS)).astype(np.int64) for b in found["bins"]]
    return fit(bins, found["y"].tolist(), [np.frombuffer(s, "<i4") for s in found["size"]])


def score_quality(docs: DataFrame, model: LineModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Null and empty texts have a share of 0.5 and so a score too. An
    empty table gives an empty result; repeated rows give repeated rows; other columns are not read."""
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), empty_if_null(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            s = [model.score(t) for t in each(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, model: LineModel, text_col: str = "text") -> DataFrame:
    """docs without the rows that the model rejects; all columns stay, whatever their names."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            good = [model.score(t or "") >= 0.5 for t in each(batch.column(at))]
            yield batch.filter(pa.array(good, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
