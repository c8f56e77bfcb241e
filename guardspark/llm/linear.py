"""A logistic scorer over hashed sparse features, fitted on a bounded sample.

Rows are arrays of feature places with their values.  Fitting takes one
matrix of a few thousand rows in memory; scoring is left to the operators.
"""

from __future__ import annotations

import numpy as np


class Sparse:
    """Rows of (place, value) pairs, one after the other."""

    def __init__(self, places: list[np.ndarray], values: list[np.ndarray] | None, dim: int):
        self.n, self.dim = len(places), dim
        self.row = np.repeat(np.arange(self.n), [len(p) for p in places])
        self.col = np.concatenate([*places, np.zeros(0, np.int64)]).astype(np.int64)
        self.val = np.ones(len(self.col)) if values is None else np.concatenate([*values, np.zeros(0)])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, self.val * w[self.col], self.n)

    def back(self, e: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, self.val * e[self.row], self.dim)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.asarray(z)))


def fit(x: Sparse, y: np.ndarray, l2: float, steps: int = 300, rate: float = 0.2, weight: np.ndarray | None = None, twin: tuple[np.ndarray, Sparse] | None = None, pull: float = 0.0, scale: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias for targets ``y`` (0 to 1) by Adam on the mean log loss
    plus ``l2 / 2 * |w|^2``.

    ``twin`` holds counterfactual rows: which rows of ``x`` they belong to, and
    their features; ``pull`` times the squared difference of the two scores is
    added.  ``scale`` multiplies features (and returned weights)."""
    scale = np.ones(x.dim) if scale is None else scale
    weight = np.ones(x.n) if weight is None else weight
    w, b = np.zeros(x.dim), 0.0
    m, v, mb, vb = np.zeros(x.dim), np.zeros(x.dim), 0.0, 0.0
    total = max(weight.sum(), 1e-12)
    for t in range(1, steps + 1):
        z = x.dot(w * scale) + b
        e = (sigmoid(z) - y) * weight / total
        if twin is not None and len(twin[0]):
            of, other = twin
            z2 = other.dot(w * scale) + b
            p, q = sigmoid(z[of]), sigmoid(z2)
            gap = 2 * pull * (p - q) * weight[of] / total
            g = x.back(e + np.bincount(of, gap * p * (1 - p), x.n)) - other.back(gap * q * (1 - q))
            gb = e.sum() + (gap * (p * (1 - p) - q * (1 - q))).sum()
        else:
            g, gb = x.back(e), e.sum()
        g = g * scale + l2 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = rate / np.sqrt(t) if t > 100 else rate / 10
        w -= step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-8)
    return w * scale, float(b)
