"""Linear models of hashed indicators: hinge loss by dual coordinate descent."""

from __future__ import annotations

import numpy as np


def fit_hinge(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float | np.ndarray = 1.0, epochs: int = 20, seed: int = 7, unit: bool = False) -> tuple[np.ndarray, float]:
    """Weights of features and bias, L1 hinge loss, L2 penalty.

    ``rows``: indices of each example's features, whose values are ``scale`` there (divided by their norm, if ``unit``);
    ``labels``: +1 or -1; ``cost``: of each example. The bias is a feature of value 1.
    """
    weights, bias = np.zeros(len(scale)), 0.0
    values = [scale[r] for r in rows]
    if unit:
        values = [v / max(np.sqrt(v @ v), 1e-12) for v in values]
    squares = np.array([v @ v + 1.0 for v in values])
    most = np.broadcast_to(np.asarray(cost, dtype=float), len(rows))
    alpha = np.zeros(len(rows))
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in random.permutation(len(rows)):
            r, v, y = rows[i], values[i], labels[i]
            slope = y * (weights[r] @ v + bias) - 1.0
            new = min(max(alpha[i] - slope / squares[i], 0.0), most[i])
            step = (new - alpha[i]) * y
            if step:
                alpha[i] = new
                weights[r] += step * v
                bias += step
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return weights, bias


def fit_sigmoid(margins: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """(a, b) such that 1 / (1 + exp(-(a * margin + b))) fits; by Newton steps on smoothed targets, a at least a little over 0."""
    n1, n0 = positive.sum(), (~positive).sum()
    target = np.where(positive, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -35, 35)))
        g = np.array([((p - target) * margins).sum(), (p - target).sum()])
        w = p * (1 - p)
        h = np.array([[(w * margins * margins).sum() + 1e-6, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-7:
            break
    return max(a, 1e-3), b
