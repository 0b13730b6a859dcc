"""Logistic regression by Newton's method, for the small models that are fitted on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last is the intercept

    def logits(self, features: np.ndarray) -> np.ndarray:
        x = (np.asarray(features, dtype=np.float64) - self.mean) / self.scale
        return np.clip(x @ self.weights[:-1] + self.weights[-1], -30, 30)

    def scores(self, features: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(features))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(features: np.ndarray, target: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1.0) -> Logistic:
    """Without rows of both classes the model gives the share of ones, drawn towards one half."""
    x, y = np.asarray(features, dtype=np.float64), np.asarray(target, dtype=np.float64)
    w = np.ones(len(y)) if weight is None else weight
    width = x.shape[1]
    share = (float((w * y).sum()) + 0.5) / (float(w.sum()) + 1)
    start = np.append(np.zeros(width), np.log(share / (1 - share)))
    if not len(y) or len(np.unique(y)) < 2:
        return Logistic(np.zeros(width), np.ones(width), start)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    z = np.column_stack(((x - mean) / scale, np.ones(len(y))))
    penalty = np.full(width + 1, ridge)
    penalty[-1] = 1e-6

    def loss(v: np.ndarray) -> float:
        t = z @ v
        return float((w * (np.logaddexp(0, t) - y * t)).sum() + 0.5 * (penalty * v * v).sum())

    current, value = start, loss(start)
    for _ in range(60):
        p = sigmoid(z @ current)
        gradient = z.T @ (w * (p - y)) + penalty * current
        curve = (z * (w * p * (1 - p))[:, None]).T @ z + np.diag(penalty)
        step, size = np.linalg.solve(curve, gradient), 1.0
        while size > 1e-4 and loss(current - size * step) > value:
            size /= 2
        new = current - size * step
        after = loss(new)
        if value - after < 1e-7 * (1 + abs(value)):
            break
        current, value = new, after
    return Logistic(mean, scale, current)
