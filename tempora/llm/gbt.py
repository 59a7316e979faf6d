"""Gradient-boosted trees for a binary label: histogram growth with monotone
constraints, flattened into node arrays for vectorised scoring."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Nodes of all trees in one set of arrays; a leaf is its own child."""
    root: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log-odds per row, all rows of a tree stepping together."""
        out = np.full(len(x), self.base)
        row = np.arange(len(x))
        for root in self.root:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                down = x[row, self.feature[at]] <= self.cut[at]
                at = np.where(down, self.left[at], self.right[at])
            out += self.value[at]
        return out


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.2,
        bins: int = 64, least: int = 10, ridge: float = 1.0) -> Trees:
    """``monotone`` per feature: 1 never falls, -1 never rises, 0 free.

    A split on a constrained feature must order its children's values, and the
    middle of the two bounds all values below them on either side.
    """
    n, m = x.shape
    mean = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.empty(0)
            for j in range(m)]
    code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1) \
        if n else np.empty((0, m), int)
    margin = np.full(n, base)
    nodes: dict[str, list] = {k: [] for k in ("feature", "cut", "left", "right", "value")}
    roots = []

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + ridge), low, high))

    def add(feature=0, cut=np.inf, value=0.0) -> int:
        i = len(nodes["feature"])
        for k, v in (("feature", feature), ("cut", cut), ("left", i), ("right", i), ("value", value)):
            nodes[k].append(v)
        return i

    def gain(g, h, v):
        return -(g * v + 0.5 * (h + ridge) * v * v)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, level: int, low: float, high: float) -> int:
        gs, hs = float(g[rows].sum()), float(h[rows].sum())
        value = leaf(gs, hs, low, high)
        best = (1e-6, None)
        if level < depth and len(rows) >= 2 * least:
            for j in range(m):
                k = len(cuts[j])
                if not k:
                    continue
                c = code[rows, j]
                gl = np.cumsum(np.bincount(c, g[rows], k + 1))[:-1]
                hl = np.cumsum(np.bincount(c, h[rows], k + 1))[:-1]
                nl = np.cumsum(np.bincount(c, minlength=k + 1))[:-1]
                vl = np.clip(-gl / (hl + ridge), low, high)
                vr = np.clip(-(gs - gl) / (hs - hl + ridge), low, high)
                ok = (nl >= least) & (len(rows) - nl >= least)
                if monotone[j]:
                    ok &= monotone[j] * (vr - vl) >= 0
                won = np.where(ok, gain(gl, hl, vl) + gain(gs - gl, hs - hl, vr) - gain(gs, hs, value), -np.inf)
                i = int(won.argmax())
                if won[i] > best[0]:
                    best = (float(won[i]), (j, i, float(vl[i]), float(vr[i])))
        if best[1] is None:
            margin[rows] += rate * value
            return add(value=rate * value)
        j, i, vl, vr = best[1]
        me = add(j, float(cuts[j][i]))
        mid = 0.5 * (vl + vr)
        bounds = {1: ((low, mid), (mid, high)), -1: ((mid, high), (low, mid)), 0: ((low, high), (low, high))}
        (ll, lh), (rl, rh) = bounds[monotone[j]]
        down = code[rows, j] <= i
        nodes["left"][me] = grow(rows[down], g, h, level + 1, ll, lh)
        nodes["right"][me] = grow(rows[~down], g, h, level + 1, rl, rh)
        return me

    if n and 0 < y.sum() < n:
        for _ in range(rounds):
            p = 1.0 / (1.0 + np.exp(-margin))
            roots.append(grow(np.arange(n), p - y, p * (1 - p), 0, -np.inf, np.inf))
    return Trees(np.array(roots, np.int64), np.array(nodes["feature"], np.int64), np.array(nodes["cut"], float),
                 np.array(nodes["left"], np.int64), np.array(nodes["right"], np.int64),
                 np.array(nodes["value"], float), depth, base)
