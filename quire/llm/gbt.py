"""Gradient-boosted trees for two classes, trained here and flattened into numpy node arrays.

Trees are complete binary trees in heap order, so a forest is four arrays and scoring is one gather per level for all
rows at once.  A feature can be held monotone: splits that go against it are refused, and values below a split stay on
their side of its middle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    base: float
    depth: int
    feature: np.ndarray  # [trees * inner]
    cut: np.ndarray  # [trees * inner], rows with a value over it go right
    value: np.ndarray  # [trees * leaves]

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        inner, leaves = 2**self.depth - 1, 2**self.depth
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature) // inner if inner else 0):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = t * inner + at
                at = 2 * at + 1 + (x[rows, self.feature[node]] > self.cut[node])
            total += self.value[t * leaves + at - inner]
        return 1 / (1 + np.exp(-total))


def fit(x: np.ndarray, y: np.ndarray, monotone: dict[int, int] | None = None, trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 32, ridge: float = 1.0, least: int = 5) -> Forest:
    """Trains on rows x and classes y (0 or 1); monotone: feature -> 1 (never falls) or -1 (never rises)."""
    monotone = monotone or {}
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for f in range(m)]
    code = np.stack([np.searchsorted(cuts[f], x[:, f]) for f in range(m)], 1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    feature, cut, value = np.zeros(trees * inner, np.int64), np.full(trees * inner, np.inf), np.zeros(trees * leaves)
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        grad, hess = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        bound = {0: (-np.inf, np.inf)}
        for at in range(inner):
            rows = np.flatnonzero(node == at)
            low, high = bound[at]
            best = None
            if len(rows) >= 2 * least:
                g0, h0 = grad[rows].sum(), hess[rows].sum()
                for f in range(m):
                    if not len(cuts[f]):
                        continue
                    size = len(cuts[f]) + 1
                    g, h, c = (np.bincount(code[rows, f], weights=w, minlength=size).cumsum()[:-1] for w in (grad[rows], hess[rows], np.ones(len(rows))))
                    gain = g**2 / (h + ridge) + (g0 - g) ** 2 / (h0 - h + ridge) - g0**2 / (h0 + ridge)
                    left, right = np.clip(g / (h + ridge), low, high), np.clip((g0 - g) / (h0 - h + ridge), low, high)
                    ok = (c >= least) & (len(rows) - c >= least)
                    if f in monotone:
                        ok &= (right - left) * monotone[f] >= 0
                    gain = np.where(ok, gain, -1)
                    k = int(gain.argmax())
                    if gain[k] > 1e-9 and (best is None or gain[k] > best[0]):
                        best = (gain[k], f, k, left[k], right[k])
            if best is None:
                bound[2 * at + 1] = bound[2 * at + 2] = (low, high)
                node[rows] = 2 * at + 1
                continue
            _, f, k, left, right = best
            feature[t * inner + at], cut[t * inner + at] = f, cuts[f][k]
            mid = (left + right) / 2
            sign = monotone.get(f, 0)
            bound[2 * at + 1] = (low, min(high, mid)) if sign > 0 else (max(low, mid), high) if sign < 0 else (low, high)
            bound[2 * at + 2] = (max(low, mid), high) if sign > 0 else (low, min(high, mid)) if sign < 0 else (low, high)
            node[rows] = 2 * at + 1 + (code[rows, f] > k)
        for leaf in range(leaves):
            rows = node == inner + leaf
            low, high = bound[inner + leaf]
            value[t * leaves + leaf] = rate * np.clip(grad[rows].sum() / (hess[rows].sum() + ridge), low, high)
        # leaves without rows take a value inside their bounds already; scores follow
        score += value[t * leaves + node - inner]
    return Forest(base, depth, feature, cut, value)
