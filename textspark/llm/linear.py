"""Small linear models trained in numpy on a bounded sample of labelled rows."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def labelled_sample(labels: DataFrame, label: str, rows: int, where: str | None = None) -> DataFrame:
    """At most ``rows`` labelled doc_ids (doc_id, label), those of the smallest hash: fit for a broadcast.

    Null ids and labels are left out; a doc_id labelled twice has its smallest label.
    """
    found = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    found = found.where(where) if where else found
    return found.groupBy("doc_id").agg(F.min(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def chosen_features(rows: list[np.ndarray], y: np.ndarray, size: int, least_z: float, most: int) -> np.ndarray:
    """Features whose share differs between the classes by ``least_z`` standard errors; at most ``most``, strongest first."""
    count = [np.bincount(np.concatenate([r for r, v in zip(rows, y, strict=True) if v == c] or [np.empty(0, np.int64)]).astype(np.int64), minlength=size) for c in (0, 1)]
    n0, n1 = max(1, int((y == 0).sum())), max(1, int((y == 1).sum()))
    share = (count[0] + count[1]) / (n0 + n1)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n0 + 1 / n1))
    z = np.abs(count[1] / n1 - count[0] / n0) / error
    best = np.argsort(-z, kind="stable")[:most]
    return best[z[best] >= least_z]


def fit_dense(x: np.ndarray, y: np.ndarray, l2: float = 1e-3, steps: int = 60, differences=(), penalty: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Logistic regression by Newton steps: means, scales, weights, bias.

    Each row of the blocks of ``differences``, the features of one text less
    those of its counterfactual, adds ``penalty * len(x)``, shared out among
    all these rows, times its squared score to the loss.
    """
    mean, scale = x.mean(0), np.where(x.std(0) < 1e-6, 1.0, x.std(0))
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), l2 * len(z))
    ridge[-1] = 1e-6
    pull = np.diag(ridge)
    n, products = 0, np.zeros_like(pull)
    for block in differences:
        d = np.c_[block / scale, np.zeros(len(block))]
        n, products = n + len(d), products + d.T @ d
    if n:
        pull = pull + 2 * penalty * len(z) / n * products
    for _ in range(steps):
        p = sigmoid(z @ w)
        h = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + pull
        step = np.linalg.solve(h, z.T @ (p - y) + pull @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w[:-1], float(w[-1])
