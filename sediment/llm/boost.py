"""Gradient-boosted trees for two classes, for small tables: logistic loss, binned features, level-wise trees."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """A sum of trees; each is (features, cuts, leaves) of a full binary tree of fixed depth."""

    base: float = 0.0
    depth: int = 3
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for features, cuts, leaves in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, features[node]] > cuts[node])
            out += leaves[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(np.asarray(x, float)))) if len(x) else np.zeros(0)


#: Most of a leaf's step before the rate. Where a class is rare its rows' curvature is next to none, so a whole step would overshoot by far
#: and the next trees swing back.
STEP = 4.0


def _edges(x: np.ndarray, y: np.ndarray, w: np.ndarray, bins: int) -> np.ndarray:
    """Where a feature is cut: at the quantiles of each class by weight and just below its least, so that a class of few rows doesn't
    share a bin with the other's, however many these are."""
    out = []
    for c in (0, 1):
        order = np.argsort(x[y == c])
        v, mass = x[y == c][order], w[y == c][order].cumsum()
        at = np.searchsorted(mass, np.linspace(0, 1, bins + 1)[1:-1] * mass[-1])
        out += [v[at], [np.nextafter(v[0], -np.inf), v[-1]]]
    return np.unique(np.concatenate(out))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0, weight: np.ndarray | None = None) -> Trees:
    """Trees fitted to the rows of x with labels y of 0 and 1, each as often as its weight says; with weights, each class has bins of its own.
    One class only, or no rows: a constant."""
    x, y = np.asarray(x, float), np.asarray(y, float)
    w = np.ones(len(y)) if weight is None else np.asarray(weight, float)
    x, y, w = x[w > 0], y[w > 0], w[w > 0]
    share = ((y * w).sum() + 0.5) / (w.sum() + 1)
    model = Trees(float(np.log(share / (1 - share))), depth)
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(v, np.linspace(0, 1, bins + 1)[1:-1])) if weight is None else _edges(v, y, w, bins) for v in x.T]
    binned = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], axis=1)
    raw = np.full(len(y), model.base)
    inner = 2**depth - 1
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = w * (p - y), w * np.maximum(p * (1 - p), 1e-6)
        features, cuts = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for at in range(inner):
            mine = np.flatnonzero(node == at)
            best = 1e-6
            if len(mine) > 1:
                sg, sh = g[mine].sum(), h[mine].sum()
                for j, e in enumerate(edges):
                    if not len(e):
                        continue
                    hg = np.bincount(binned[mine, j], g[mine], len(e) + 1).cumsum()[:-1]
                    hh = np.bincount(binned[mine, j], h[mine], len(e) + 1).cumsum()[:-1]
                    gain = hg**2 / (hh + ridge) + (sg - hg) ** 2 / (sh - hh + ridge) - sg**2 / (sh + ridge)
                    k = int(gain.argmax())
                    if gain[k] > best:
                        best, features[at], cuts[at] = gain[k], j, e[k]
            node[mine] = 2 * at + 1 + (x[mine, features[at]] > cuts[at])
        leaves = np.zeros(2**depth)
        index = node - inner
        sg, sh = np.bincount(index, g, 2**depth), np.bincount(index, h, 2**depth)
        leaves = -rate * np.clip(sg / (sh + ridge), -STEP, STEP)
        raw += leaves[index]
        model.trees.append((features, cuts, leaves))
    return model
