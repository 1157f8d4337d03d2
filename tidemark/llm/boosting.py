"""Histogram gradient-boosted trees on a bounded sample, flattened into arrays.

Features are cut into quantile bins once; each level sums gradients by (node, feature,
bin) and takes the best split for every node at once. A fitted model is five arrays, so
it is small to ship, and scoring walks all rows down one level per step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidemark.llm.common import by_value

by_value(__name__)


@dataclass
class Trees:
    """Node n of tree t: rows go left when x[feature] <= threshold; leaves point to themselves."""
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), dtype=np.int32)
            for _ in range(self.depth):
                go = x[rows, self.feature[t, node]] <= self.threshold[t, node]
                node = np.where(go, self.left[t, node], self.right[t, node])
            out += self.value[t, node]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15,
        l2: float = 1.0, min_hessian: float = 2.0) -> Trees:
    """Binary log loss. No rows: every score is 0.5; one class: its smoothed share."""
    n, m = x.shape
    width = 2 ** (depth + 1) - 1
    shape = (trees, width)
    own = np.tile(np.arange(width, dtype=np.int32), (trees, 1))
    model = Trees(np.zeros(shape, np.int32), np.zeros(shape), own.copy(), own.copy(), np.zeros(shape), 0.0, depth)
    share = (y.sum() + 0.5) / (n + 1.0)
    model.base = float(np.log(share / (1 - share)))
    if n == 0 or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(m)]
    codes = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1).astype(np.int64)
    margin = np.full(n, model.base)
    feature_at = np.arange(m) * bins
    for t in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, k = 2 ** level - 1, 2 ** level
            local = node - first
            live = local >= 0
            key = ((local[live] * m * bins)[:, None] + feature_at[None, :] + codes[live]).ravel()
            gs = np.bincount(key, np.repeat(g[live], m), k * m * bins).reshape(k, m, bins)
            hs = np.bincount(key, np.repeat(h[live], m), k * m * bins).reshape(k, m, bins)
            gl, hl = gs.cumsum(2), hs.cumsum(2)
            ga, ha = gl[:, :, -1:], hl[:, :, -1:]
            gain = gl ** 2 / (hl + l2) + (ga - gl) ** 2 / (ha - hl + l2) - ga ** 2 / (ha + l2)
            gain[(hl < min_hessian) | (ha - hl < min_hessian)] = -np.inf
            gain = gain.reshape(k, -1)
            best = gain.argmax(1)
            for i in range(k):
                f, b = divmod(int(best[i]), bins)
                if not gain[i, best[i]] > 1e-9 or b >= len(cuts[f]):
                    continue
                at = first + i
                model.feature[t, at], model.threshold[t, at] = f, cuts[f][b]
                model.left[t, at], model.right[t, at] = 2 * at + 1, 2 * at + 2
                rows = node == at
                node[rows] = np.where(codes[rows, f] <= b, 2 * at + 1, 2 * at + 2)
            node[(node >= first) & (node < first + k)] -= width  # rows of finished nodes stop here
        node[node < 0] += width
        gsum = np.bincount(node, g, width)
        hsum = np.bincount(node, h, width)
        model.value[t] = -rate * gsum / (hsum + l2)
        margin += model.value[t, node]
    return model
