"""Gradient-boosted trees on histograms, in numpy, with monotonic constraints and isotonic calibration.

A fitted model is flat: one array each for the split feature, threshold, children and value of
all nodes of all trees. Scoring walks every row through a tree at once, a level at a time.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Trees:
    """Nodes of all trees in flat arrays; a leaf is its own child. ``roots`` has where each tree starts."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float
    knots: tuple[np.ndarray, np.ndarray] | None = field(default=None)

    def raw(self, x: np.ndarray) -> np.ndarray:
        """The margin of each row. NaN goes left."""
        rows, out = np.arange(len(x)), np.full(len(x), self.base)
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                right = x[rows, self.feature[at]] > self.threshold[at]
                at = np.where(right, self.right[at], self.left[at])
            out += self.value[at]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """A probability for each row: calibrated where knots are fitted."""
        p = 1 / (1 + np.exp(-self.raw(x)))
        return np.interp(p, *self.knots) if self.knots else p


def fit(x: np.ndarray, y: np.ndarray, *, trees: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64, l2: float = 2.0, least: int = 8, monotone: dict[int, int] | None = None, weight: np.ndarray | None = None) -> Trees:
    """Logistic boosting on quantile bins.

    ``monotone`` maps a feature to +1 or -1: a split on it that would break the direction is not
    taken, and the children's values are kept on their side of the split's middle. Ties between
    splits go to the first feature and bin, so a fit depends on the rows alone. With one class
    only, or no rows, the model is a constant.
    """
    monotone, n, m = monotone or {}, len(x), x.shape[1]
    w = np.ones(n) if weight is None else weight
    share = float(np.clip((w * y).sum() / max(w.sum(), 1e-9), 1e-3, 1 - 1e-3)) if n else 0.5
    base = float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0) for f in range(m)]
    code = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(m)], 1) if n else np.empty((0, m), int)
    flat = code + np.arange(m) * (bins + 1)
    sign = np.array([monotone.get(f, 0) for f in range(m)])[:, None]
    feature, threshold, left, right, value, roots = [], [], [], [], [], []
    margin = np.full(n, base)

    def node() -> int:
        for a, v in ((feature, 0), (threshold, np.inf), (left, len(left)), (right, len(right)), (value, 0.0)):
            a.append(v)
        return len(feature) - 1

    for _ in range(trees if n and 0 < y.sum() < n else 0):
        p = 1 / (1 + np.exp(-margin))
        g, h = w * (p - y), w * p * (1 - p)
        root = node()
        roots.append(root)
        todo = [(root, np.arange(n), -np.inf, np.inf, 0)]
        while todo:
            k, rows, low, high, d = todo.pop()
            gs, hs = g[rows].sum(), h[rows].sum()
            best = float(np.clip(-gs / (hs + l2), low, high))
            value[k] = rate * best
            if d == depth or len(rows) < 2 * least:
                margin[rows] += value[k]
                continue
            at = flat[rows].ravel()
            hist = [np.bincount(at, np.repeat(v, m), m * (bins + 1)).reshape(m, bins + 1).cumsum(1)[:, :-1] for v in (g[rows], h[rows], np.ones(len(rows)))]
            gl, hl, nl = hist
            gr, hr, nr = gs - gl, hs - hl, len(rows) - nl
            gain = gl**2 / (hl + l2) + gr**2 / (hr + l2) - gs**2 / (hs + l2)
            vl, vr = -gl / (hl + l2), -gr / (hr + l2)
            ok = (nl >= least) & (nr >= least) & (sign * (vr - vl) >= 0)
            gain = np.where(ok, gain, -1)
            f, b = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[f, b] <= 1e-6 or b >= len(edges[f]):
                margin[rows] += value[k]
                continue
            feature[k], threshold[k] = int(f), float(edges[f][b])
            middle = float(np.clip((vl[f, b] + vr[f, b]) / 2, low, high))
            left[k], right[k] = node(), node()
            s, goes = monotone.get(int(f), 0), code[rows, f] <= b
            limits = ((low, middle), (middle, high)) if s > 0 else ((middle, high), (low, middle)) if s < 0 else ((low, high), (low, high))
            todo += [(left[k], rows[goes], *limits[0], d + 1), (right[k], rows[~goes], *limits[1], d + 1)]
    arrays = (np.array(a) for a in (feature, threshold, left, right, value))
    return Trees(*arrays, np.array(roots, int), depth, base)


def isotonic(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing step fit of y on p (pool adjacent violators), smoothed at both ends."""
    order = np.argsort(p, kind="stable")
    blocks: list[list[float]] = []
    for a, b in zip(p[order].tolist(), y[order].tolist()):
        blocks.append([b, 1.0, a, a])
        if len(blocks) > 1 and blocks[-2][3] == a:  # ties pool at once
            s, k, _, _ = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += k
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, k, _, top = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += k
            blocks[-1][3] = top
    xs, ys = [0.0], [0.0]
    for s, k, lo, hi in blocks:
        v = (s + 0.5 * (s / k)) / (k + 0.5)
        xs += [lo, hi]
        ys += [v, v]
    xs, ys = np.array([*xs, 1.0]), np.maximum.accumulate(np.clip([*ys, max(ys[-1], 0.999)], 0, 1))
    return xs, ys
