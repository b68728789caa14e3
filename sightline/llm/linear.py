"""Sparse linear classifiers trained by follow-the-regularised-leader with an elastic net."""

from __future__ import annotations

import numpy as np


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


class Ftrl:
    """Multinomial logistic regression over sparse rows, by FTRL-proximal steps per coordinate.

    A weight stays exactly zero until its accumulated gradient exceeds ``l1``. The last
    coordinate is the bias; it is not regularised.
    """

    def __init__(self, size: int, classes: int, alpha: float, beta: float = 1.0, l1: float = 1.0, l2: float = 1.0):
        self.alpha, self.beta = alpha, beta
        self.l1 = np.full((size + 1, 1), l1)
        self.l2 = np.full((size + 1, 1), l2)
        self.l1[-1] = self.l2[-1] = 0
        self.z = np.zeros((size + 1, classes))
        self.n = np.zeros((size + 1, classes))

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        shrunk = np.sign(z) * np.maximum(np.abs(z) - self.l1[at], 0)
        return -shrunk / ((self.beta + np.sqrt(n)) / self.alpha + self.l2[at])

    def step(self, at: np.ndarray, values: np.ndarray, label: int) -> None:
        at, values = np.append(at, len(self.z) - 1), np.append(values, 1.0)
        w = self.weights(at)
        error = softmax(values @ w)
        error[label] -= 1
        gradient = values[:, None] * error
        squared = gradient * gradient
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + squared) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + squared


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The divisor of scores that minimises the cross-entropy of held-out labels (golden section)."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = softmax(scores / np.exp(log_t))
        return -np.log(np.maximum(p[np.arange(len(labels)), labels], 1e-12)).mean()

    a, b = np.log(0.05), np.log(20)
    ratio = (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - ratio * (b - a), a + ratio * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))
