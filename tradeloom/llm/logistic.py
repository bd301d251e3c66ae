"""Logistic regression of a bounded sample with few features, by Newton steps with a ridge."""

from __future__ import annotations

import numpy as np


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, weight: np.ndarray | None = None, steps: int = 60) -> np.ndarray:
    """Coefficients, the intercept first; the intercept is not penalised. With one class only, zeros and its log-odds."""
    x = np.column_stack([np.ones(len(x)), x.astype(np.float64)])
    y = y.astype(np.float64)
    w = np.ones(len(y)) if weight is None else weight
    total, ones = w.sum(), (w * y).sum()
    beta = np.zeros(x.shape[1])
    beta[0] = np.log((ones + 0.5) / (total - ones + 0.5))
    if not 0 < ones < total:
        return beta
    penalty = np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        gradient = x.T @ (w * (y - p)) - penalty * beta
        curve = (x * (w * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(curve, gradient)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-7:
            break
    return beta
