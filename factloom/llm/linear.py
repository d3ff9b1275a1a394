"""Logistic regression over sparse rows, with Platt calibration, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * np.clip(x, -60, 60)))


def fit(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, labels: np.ndarray, width: int, l2: float, rounds: int = 90) -> tuple[np.ndarray, float]:
    """Weights and bias of the penalised mean log loss, both labels weighted alike.

    ``rows``, ``cols`` and ``values`` are the non-zero cells. Full-batch Adam with a fixed
    number of rounds: the same rows always give the same model. With one label only, the
    weights are zero and the bias says that label.
    """
    n = len(labels)
    weights, bias = np.zeros(width), 0.0
    positive = labels.sum()
    if not n or positive in (0, n):
        return weights, 0.0 if not n else (4.0 if positive else -4.0)
    weight = np.where(labels == 1, n / (2 * positive), n / (2 * (n - positive)))
    m, v, bm, bv, step = np.zeros(width), np.zeros(width), 0.0, 0.0, 0.05
    for t in range(1, rounds + 1):
        z = np.bincount(rows, values * weights[cols], n) + bias
        g = weight * (sigmoid(z) - labels) / n
        grad = np.bincount(cols, values * g[rows], width) + l2 * weights
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        bm, bv = 0.9 * bm + 0.1 * g.sum(), 0.999 * bv + 0.001 * g.sum() ** 2
        rate = step * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        weights -= rate * m / (np.sqrt(v) + 1e-8)
        bias -= rate * bm / (np.sqrt(bv) + 1e-8)
    return weights, float(bias)


def platt(scores: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of the probability sigmoid(slope * score + shift), by Newton steps on
    the smoothed targets; (1, 0) if a label is absent. The slope is never negative."""
    positive, negative = int(labels.sum()), int((1 - labels).sum())
    if not positive or not negative:
        return 1.0, 0.0
    target = np.where(labels == 1, (positive + 1) / (positive + 2), 1 / (negative + 2))
    spread = scores.std() or 1.0
    x = np.stack([(scores - scores.mean()) / spread, np.ones(len(scores))], 1)
    w = np.array([1.0, 0.0])
    for _ in range(100):
        p = sigmoid(x @ w)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        move = np.linalg.solve(hess, x.T @ (p - target) + 1e-6 * w)
        w -= np.clip(move, -2, 2)
        if np.abs(move).max() < 1e-9:
            break
    slope = max(0.0, w[0]) / spread
    return float(slope), float(w[1] - slope * scores.mean())
