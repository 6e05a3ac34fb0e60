"""Logistic regression with a lasso penalty over 0/1 features, on the driver's bounded sample."""

from __future__ import annotations

import numpy as np


def lasso_logistic(rows: np.ndarray, columns: np.ndarray, n_columns: int, y: np.ndarray, penalty: float, steps: int = 400, weights: np.ndarray | None = None) -> tuple[float, np.ndarray]:
    """(intercept, weights) from the places (rows, columns) of ones in a 0/1 matrix and labels y; accelerated proximal steps.

    penalty weighs the sum of absolute weights against the mean loss; weights
    gives each row's share. No rows, or one label alone, give zero weights and
    the smoothed log-odds as intercept.
    """
    y = np.asarray(y, float)
    share = np.ones(len(y)) if weights is None else np.asarray(weights, float)
    total = share.sum()
    if not len(y) or y.min() == y.max() or not len(rows):
        p = ((y * share).sum() + 0.5) / (total + 1)
        return float(np.log(p / (1 - p))), np.zeros(n_columns)
    share = share / total
    degree = np.bincount(rows, minlength=len(y))
    step = 4.0 / (1.0 + np.bincount(columns, weights=share[rows] * degree[rows], minlength=n_columns).max())
    w, b = np.zeros(n_columns), 0.0
    v, c, t = w, b, 1.0
    for _ in range(steps):
        z = np.bincount(rows, weights=v[columns], minlength=len(y)) + c
        r = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * share
        new = v - step * np.bincount(columns, weights=r[rows], minlength=n_columns)
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        new_b = c - step * r.sum()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, c, t = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b), t2
        w, b = new, new_b
    return float(b), w
