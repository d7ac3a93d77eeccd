"""Gradient boosting of small regression trees for a binary label (histogram splits, numpy).

Fitted on the driver from a bounded sample; applied inside tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Boosted:
    """Trees as arrays by node: feature (-1: leaf), threshold, value; children of i are 2i+1, 2i+2."""
    start: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            while (inner := f[node] >= 0).any():
                right = x[rows, np.maximum(f[node], 0)] > t[node]
                node = np.where(inner, 2 * node + 1 + right, node)
            out += v[node]
        return out

    def predict(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(x)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 5) -> Boosted:
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    raw, nodes = np.full(len(y), start), 2 ** (depth + 1) - 1
    all_f, all_t, all_v = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        f, t, v = np.full(nodes, -1), np.zeros(nodes), np.zeros(nodes)
        node = np.zeros(len(y), np.int64)
        for at in range(nodes):
            own = np.flatnonzero(node == at)
            if not len(own):
                continue
            total_g, total_h = g[own].sum(), h[own].sum()
            v[at] = rate * total_g / (total_h + 1.0)
            best = (1e-6, -1, 0)
            if at < 2 ** depth - 1 and len(own) >= 2 * least:
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    b = binned[own, j]
                    left_g = np.cumsum(np.bincount(b, g[own], len(e) + 1))[:-1]
                    left_h = np.cumsum(np.bincount(b, h[own], len(e) + 1))[:-1]
                    left_n = np.cumsum(np.bincount(b, minlength=len(e) + 1))[:-1]
                    gain = left_g ** 2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - total_g ** 2 / (total_h + 1)
                    gain[(left_n < least) | (len(own) - left_n < least)] = 0
                    k = int(np.argmax(gain))
                    if gain[k] > best[0]:
                        best = (float(gain[k]), j, k)
            if best[1] >= 0:
                f[at], t[at] = best[1], edges[best[1]][best[2]]
                node[own] = 2 * at + 1 + (binned[own, best[1]] > best[2])
        raw += v[node]
        all_f.append(f)
        all_t.append(t)
        all_v.append(v)
    return Boosted(start, np.array(all_f), np.array(all_t), np.array(all_v))
