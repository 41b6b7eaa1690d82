"""Decision trees over numpy histograms: gradient boosting with monotonic constraints, and random forests.

Training runs on a bounded sample on the driver. A fitted ensemble is a few flat arrays over all nodes of all trees, and
scoring walks all trees of a block of rows one level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass(frozen=True)
class Ensemble:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    base: float
    logistic: bool

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row."""
        out = np.empty(len(x))
        for i in range(0, len(x), 8192):
            some = x[i : i + 8192]
            at = np.repeat(self.roots[None, :], len(some), 0)
            row = np.arange(len(some))[:, None]
            while True:
                to = np.where(some[row, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
                if (to == at).all():
                    break
                at = to
            total = self.base + self.value[at].sum(1)
            out[i : i + 8192] = 1 / (1 + np.exp(-total)) if self.logistic else total / len(self.roots)
        return out


class _Builder:
    def __init__(self, x: np.ndarray):
        qs = np.linspace(0, 1, BINS + 1)[1:-1]
        self.edges = [np.unique(np.quantile(c, qs, method="lower")) for c in x.T]
        self.codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T)], 1)
        self.nodes: list[list] = []

    def tree(self, g, h, rows, depth, min_weight, reg, signs, rng=None, tries=None, rate=1.0) -> int:
        return self._grow(g, h, rows, depth, min_weight, reg, signs, rng, tries, rate, -np.inf, np.inf)

    def _grow(self, g, h, rows, depth, min_weight, reg, signs, rng, tries, rate, lo, hi) -> int:
        me = len(self.nodes)
        gs, hs = g[rows].sum(), h[rows].sum()
        weight = float(np.clip(-gs / (hs + reg), lo, hi))
        self.nodes.append([0, np.inf, me, me, rate * weight])
        if depth == 0 or hs < 2 * min_weight:
            return me
        best, found = 1e-9, None
        features = range(self.codes.shape[1]) if tries is None else rng.choice(self.codes.shape[1], tries, replace=False)
        for f in features:
            n = len(self.edges[f])
            if not n:
                continue
            c = self.codes[rows, f]
            gl = np.cumsum(np.bincount(c, weights=g[rows], minlength=n + 1))[:-1]
            hl = np.cumsum(np.bincount(c, weights=h[rows], minlength=n + 1))[:-1]
            gr, hr = gs - gl, hs - hl
            ok = (hl >= min_weight) & (hr >= min_weight)
            if signs is not None and signs[f]:
                wl, wr = np.clip(-gl / (hl + reg), lo, hi), np.clip(-gr / (hr + reg), lo, hi)
                ok &= (wr - wl) * signs[f] >= 0
            gain = np.where(ok, gl**2 / (hl + reg) + gr**2 / (hr + reg) - gs**2 / (hs + reg), 0)
            k = int(gain.argmax())
            if gain[k] > best:
                mid = 0.5 * (np.clip(-gl[k] / (hl[k] + reg), lo, hi) + np.clip(-gr[k] / (hr[k] + reg), lo, hi))
                best, found = gain[k], (int(f), k, float(mid))
        if found is None:
            return me
        f, k, mid = found
        low = self.codes[rows, f] <= k
        sign = 0 if signs is None else signs[f]
        bounds = ((lo, hi), (lo, hi)) if not sign else ((lo, mid), (mid, hi)) if sign > 0 else ((mid, hi), (lo, mid))
        left = self._grow(g, h, rows[low], depth - 1, min_weight, reg, signs, rng, tries, rate, *bounds[0])
        right = self._grow(g, h, rows[~low], depth - 1, min_weight, reg, signs, rng, tries, rate, *bounds[1])
        self.nodes[me] = [f, float(self.edges[f][k]), left, right, 0.0]
        return me

    def done(self, roots: list[int], base: float, logistic: bool) -> Ensemble:
        f, t, a, b, v = zip(*self.nodes) if self.nodes else ([],) * 5
        return Ensemble(np.array(f, np.int64), np.array(t, float), np.array(a, np.int64), np.array(b, np.int64), np.array(v, float), np.array(roots, np.int64), base, logistic)


def boost(x: np.ndarray, y: np.ndarray, signs: list[int] | None = None, trees: int = 60, depth: int = 4, rate: float = 0.15, min_weight: float = 2.0, reg: float = 1.0) -> Ensemble:
    """Logistic boosting. signs: +1 or -1 where the score must not fall or rise with a feature, else 0."""
    b, y = _Builder(x), y.astype(float)
    mean = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    base, roots, rows = float(np.log(mean / (1 - mean))), [], np.arange(len(y))
    total = np.full(len(y), base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        root = b.tree(p - y, p * (1 - p), rows, depth, min_weight, reg, signs, rate=rate)
        roots.append(root)
        one = b.done([root], 0.0, False)
        total += one.scores(x)
    return b.done(roots, base, True)


def forest(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 10, seed: int = 7) -> Ensemble:
    """Random forest: bootstrap rows, a random set of about sqrt(features) at each split, mean of leaf shares."""
    b, y, rng = _Builder(x), y.astype(float), np.random.default_rng(seed)
    tries, rows, roots = max(1, int(np.ceil(np.sqrt(x.shape[1])))), np.arange(len(y)), []
    for _ in range(trees):
        w = rng.poisson(1.0, len(y)).astype(float)
        roots.append(b.tree(-y * w, w, rows, depth, 1.0, 1e-9, None, rng, tries))
    return b.done(roots, 0.0, False)
