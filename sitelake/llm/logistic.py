"""Logistic regression on a bounded sample held by the driver."""

from __future__ import annotations

import numpy as np


class Sparse:
    """Rows of a sparse matrix: the columns and values of row i stand from ``starts[i]`` to ``starts[i + 1]``."""

    def __init__(self, starts: np.ndarray, columns: np.ndarray, values: np.ndarray, width: int) -> None:
        self.rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        self.columns, self.values, self.shape = columns, values, (len(starts) - 1, width)

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * weights[self.columns], self.shape[0])

    def transposed_times(self, errors: np.ndarray) -> np.ndarray:
        return np.bincount(self.columns, self.values * errors[self.rows], self.shape[1])


class Dense(Sparse):
    """The same for a full matrix."""

    def __init__(self, matrix: np.ndarray) -> None:
        self.matrix, self.shape = matrix, matrix.shape

    def times(self, weights: np.ndarray) -> np.ndarray:
        return self.matrix @ weights

    def transposed_times(self, errors: np.ndarray) -> np.ndarray:
        return self.matrix.T @ errors


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def fit(x: Sparse, y: np.ndarray, l1: float = 0.0, l2: float = 0.0, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Weights and intercept of least mean log loss plus l1 * |w| + l2 / 2 * w * w; accelerated proximal gradient.

    No rows give zeros; labels of one kind give an intercept that says so.
    """
    n, width = x.shape
    if n == 0:
        return np.zeros(width), 0.0
    base = float(np.clip(y.mean(), 0.5 / (n + 1), 1 - 0.5 / (n + 1)))
    w, bias = np.zeros(width), float(np.log(base / (1 - base)))
    if y.min() == y.max() or width == 0:
        return w, bias
    # The largest curvature of the mean log loss, by power iteration.
    v = np.ones(width) / np.sqrt(width)
    for _ in range(20):
        v = x.transposed_times(x.times(v)) / n
        norm = np.linalg.norm(v)
        v = v / max(norm, 1e-12)
    step = 1 / (0.25 * (norm + 1) * 1.1 + l2)
    pw, pb, t = w, bias, 1.0
    for _ in range(rounds):
        errors = (sigmoid(x.times(pw) + pb) - y) / n
        nw = pw - step * (x.transposed_times(errors) + l2 * pw)
        nw = np.sign(nw) * np.maximum(np.abs(nw) - step * l1, 0)
        nb = pb - step * float(errors.sum())
        if float((pw - nw) @ (nw - w)) + (pb - nb) * (nb - bias) > 0:
            t = 1.0  # momentum points uphill: start it anew
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        pw, pb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - bias)
        moved = np.abs(nw - w).max() + abs(nb - bias)
        w, bias, t = nw, nb, nt
        if moved < 1e-7:
            break
    return w, bias
