"""Flattened trees, scored vectorised over Arrow batches; MLlib fits them (see
``model.py``)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

@dataclass
class Forest:
    """Complete binary trees: ``cut`` is +inf where a node is not split, so its
    rows go left to the one leaf that holds its value."""

    base: float
    feature: np.ndarray     # trees x (2^depth - 1)
    cut: np.ndarray         # trees x (2^depth - 1)
    value: np.ndarray       # trees x 2^depth
    gain: np.ndarray        # per feature

    @property
    def depth(self) -> int:
        return int(np.log2(self.value.shape[1])) if self.value.size else 0

    def increments(self, x: np.ndarray):
        """Each tree's part of the prediction, in order."""
        row = np.arange(len(x))
        for f, c, v in zip(self.feature, self.cut, self.value):
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                at = 2 * at + 1 + (x[row, f[at]] > c[at])
            yield v[at - (len(v) - 1)]

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for part in self.increments(x):
            out += part
        return out
