"""Gradient-boosted trees on numpy: logistic loss, histogram splits, deterministic. fit() holds its rows; fit_sums() needs
only their histograms, so they may lie in a table of any size. Models are plain arrays that travel to executors inside a closure."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    base: float
    rate: float
    trees: list = field(default_factory=list)  # (feature, threshold, left, right, value) arrays

    def raw(self, x: np.ndarray) -> np.ndarray:
        x = np.asarray(x, dtype=np.float64)
        out = np.full(len(x), self.base)
        for feature, threshold, left, right, value in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(16):
                inner = feature[at] >= 0
                if not inner.any():
                    break
                go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            out += self.rate * value[at]
        return out

    def proba(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -50, 50)))


def fit(x: np.ndarray, y: np.ndarray, n_trees: int = 40, depth: int = 3, rate: float = 0.3, n_bins: int = 32, min_leaf: int = 5, ridge: float = 1.0) -> Boosted:
    """x (n, k) of finite numbers, y of 0 and 1. With an empty table or one class the model is a constant."""
    x, y = np.asarray(x, dtype=np.float64), np.asarray(y, dtype=np.float64)
    mean = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(mean / (1 - mean))), rate)
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, n_bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    score = np.full(len(y), model.base)
    for _ in range(n_trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        nodes: list[list] = [[-1, 0.0, 0, 0, 0.0]]
        todo = [(0, np.arange(len(y)), 0)]
        while todo:
            at, rows, d = todo.pop()
            sg, sh = g[rows].sum(), h[rows].sum()
            nodes[at][4] = sg / (sh + ridge)
            best = (1e-6, None, None)
            if d < depth:
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[rows, f]
                    cg, ch, cn = (np.cumsum(np.bincount(b, weights=v, minlength=len(e) + 1))[:-1] for v in (g[rows], h[rows], np.ones(len(rows))))
                    ok = (cn >= min_leaf) & (len(rows) - cn >= min_leaf)
                    gain = np.where(ok, cg**2 / (ch + ridge) + (sg - cg) ** 2 / (sh - ch + ridge) - sg**2 / (sh + ridge), -1)
                    k = int(gain.argmax())
                    if gain[k] > best[0] + 1e-12:
                        best = (gain[k], f, k)
            if best[1] is None:
                score[rows] += rate * nodes[at][4]
                continue
            _, f, k = best
            go = binned[rows, f] <= k
            nodes[at][:4] = [f, edges[f][k], len(nodes), len(nodes) + 1]
            nodes += [[-1, 0.0, 0, 0, 0.0], [-1, 0.0, 0, 0, 0.0]]
            todo += [(nodes[at][2], rows[go], d + 1), (nodes[at][3], rows[~go], d + 1)]
        f, t, left, right, v = zip(*nodes)
        model.trees.append((np.array(f), np.array(t, dtype=float), np.array(left), np.array(right), np.array(v, dtype=float)))
    return model


#: Gradients are summed as whole multiples of 1 / SCALE, so that sums do not depend on the order of rows.
SCALE = float(1 << 32)


def _arrays(nodes: list[list]) -> tuple[np.ndarray, ...]:
    f, t, left, right, v = zip(*nodes)
    return np.array(f), np.array(t, dtype=float), np.array(left), np.array(right), np.array(v, dtype=float)


def leaves(tree: tuple[np.ndarray, ...], x: np.ndarray) -> np.ndarray:
    """The node of a tree at which each row ends."""
    feature, threshold, left, right, _ = tree
    at = np.zeros(len(x), dtype=np.int64)
    for _ in range(16):
        inner = feature[at] >= 0
        if not inner.any():
            break
        go = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
        at = np.where(inner, np.where(go, left[at], right[at]), at)
    return at


def histogram(bins: np.ndarray, y: np.ndarray, score: np.ndarray, tree: tuple[np.ndarray, ...], level: list[int], n_bins: int) -> np.ndarray:
    """(nodes of level, features, bins, 3): sums of gradients, second derivatives and rows; 2**20 rows at most, so that sums
    of whole numbers are exact."""
    p = 1 / (1 + np.exp(-np.clip(score, -50, 50)))
    weights = [np.round((y - p) * SCALE), np.round(p * (1 - p) * SCALE), np.ones(len(y))]
    place = np.full(len(tree[0]), -1)
    place[level] = np.arange(len(level))
    slot = place[leaves(tree, bins)]
    rows = np.nonzero(slot >= 0)[0]
    out = np.zeros((len(level), bins.shape[1], n_bins, 3), dtype=np.int64)
    for f in range(bins.shape[1]):
        cell = slot[rows] * n_bins + bins[rows, f]
        for j, w in enumerate(weights):
            out[:, f, :, j] = np.bincount(cell, weights=w[rows], minlength=len(level) * n_bins).reshape(len(level), n_bins)
    return out


def fit_sums(sums, edges: list[np.ndarray], n: int, positive: int, n_trees: int = 40, depth: int = 3, rate: float = 0.3, min_leaf: int = 5, ridge: float = 1.0) -> Boosted:
    """fit() over n rows, `positive` of them 1, of which only sums are seen: sums(model, tree, level) is histogram() over all
    rows, with the model so far and the tree in the making, whose thresholds are numbers of bins."""
    mean = min(max(positive / n if n else 0.5, 1e-3), 1 - 1e-3)
    coarse = Boosted(float(np.log(mean / (1 - mean))), rate)
    model = Boosted(coarse.base, rate)
    if positive in (0, n):
        return model
    for _ in range(n_trees):
        nodes: list[list] = [[-1, 0.0, 0, 0, 0.0]]
        level = [0]
        for _ in range(depth):
            below = []
            for at, s in zip(level, sums(coarse, _arrays(nodes), level)):
                sg, sh, sn = s[0].sum(axis=0) / (SCALE, SCALE, 1)
                if at == 0:
                    nodes[0][4] = sg / (sh + ridge)
                best = (1e-6, None, None)
                for f, e in enumerate(edges):
                    if not len(e):
                        continue
                    cg, ch, cn = (np.cumsum(s[f], axis=0)[: len(e)] / (SCALE, SCALE, 1)).T
                    ok = (cn >= min_leaf) & (sn - cn >= min_leaf)
                    gain = np.where(ok, cg**2 / (ch + ridge) + (sg - cg) ** 2 / (sh - ch + ridge) - sg**2 / (sh + ridge), -1)
                    k = int(gain.argmax())
                    if gain[k] > best[0] + 1e-12:
                        best = (gain[k], f, k, cg[k] / (ch[k] + ridge), (sg - cg[k]) / (sh - ch[k] + ridge))
                if best[1] is None:
                    continue
                nodes[at][:4] = [best[1], best[2], len(nodes), len(nodes) + 1]
                below += [len(nodes), len(nodes) + 1]
                nodes += [[-1, 0.0, 0, 0, best[3]], [-1, 0.0, 0, 0, best[4]]]
            level = below
            if not level:
                break
        tree = _arrays(nodes)
        coarse.trees.append(tree)
        real = [edges[f][int(k)] if f >= 0 else 0.0 for f, k in zip(tree[0], tree[1])]
        model.trees.append((tree[0], np.array(real, dtype=float), *tree[2:]))
    return model


def calibrated_threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The lowest threshold at which the given share of the rows at or over it is positive; 1.01 if there is none."""
    order = np.argsort(-p, kind="stable")
    good = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    last = np.r_[p[order][1:] != p[order][:-1], True] if len(y) else np.zeros(0, bool)
    ok = np.nonzero((good >= precision) & last)[0]
    return float(p[order][ok[-1]]) if len(ok) else 1.01
