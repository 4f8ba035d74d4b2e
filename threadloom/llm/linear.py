"""Logistic regression on a bounded sample of labelled rows, fitted with numpy on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35.0, 35.0)))


def labelled_sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most rows labelled ids, those of least md5(doc_id): (doc_id, y), one row per id (the larger label of repeated ids)."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("y"))
    return known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(rows)


def fit(product, transposed, y: np.ndarray, n_features: int, l2: float, steps: int = 250, rate: float = 0.3, penalty=None) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise mean log loss + l2 |w|^2 / 2 + penalty (a function w -> gradient), by Adam.
    product(w) = X w, transposed(r) = X^T r."""
    w, b = np.zeros(n_features), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))) if len(y) else 0.0
    m, v, mb, vb = np.zeros(n_features), np.zeros(n_features), 0.0, 0.0
    for t in range(1, steps + 1 if len(y) else 1):
        r = (sigmoid(product(w) + b) - y) / len(y)
        g, gb = transposed(r) + l2 * w + (penalty(w) if penalty else 0.0), float(r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        size = rate * min(1.0, 2.0 * (1 - t / (steps + 1))) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        w, b = w - size * m / (np.sqrt(v) + 1e-9), b - size * mb / (np.sqrt(vb) + 1e-9)
    return w, b


def platt(scores: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities, with Platt's softened targets; slope 1, offset 0 without both classes."""
    pos, neg = float(y.sum()), float(len(y) - y.sum())
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(100):
        p = sigmoid(a * scores + b)
        g = np.array([((p - target) * scores).sum(), (p - target).sum()])
        h = p * (1 - p)
        hess = np.array([[(h * scores * scores).sum() + 1e-6, (h * scores).sum()], [(h * scores).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return a, b
