"""What the learning operators share: the sample of labelled rows, logistic fits, features as arrays."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, learn: Column, per_label: int) -> DataFrame:
    """Texts of at most `per_label` labelled rows of either label, for which `learn` holds.

    Rows are taken by the order of a hash of doc_id, so the choice does not depend on partitioning.
    The chosen ids number 2 * per_label at most, which is what makes their broadcast safe. A doc_id
    with several labels counts as label 1 if any of them is 1.
    """
    rows = labels.where(learn & F.col(column).isin(0, 1)).groupBy("doc_id").agg(F.max(column).cast("int").alias("y"))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = rows.where("y = 1").orderBy(*order).limit(per_label).unionByName(rows.where("y = 0").orderBy(*order).limit(per_label))
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last column of x is the constant 1.

    With rows of one label only, or none, the constant alone is fitted to the smoothed share of 1.
    """
    w = np.zeros(x.shape[1])
    if len(y) == 0 or y.min() == y.max():
        w[-1] = np.log((y.sum() + 1) / (len(y) - y.sum() + 1))
        return w
    ridge = np.full(x.shape[1], l2 * len(y) / 100)
    wide = x.shape[1] > len(y)
    ridge[-1] = 1e-4 if wide else 1e-9
    inner = (x / ridge) @ x.T if wide else None
    for _ in range(rounds):
        p = sigmoid(x @ w)
        grad, bend = x.T @ (p - y) + ridge * w, p * (1 - p)
        if wide:  # fewer rows than columns: the same step by a system of the rows
            part = np.linalg.solve(np.diag(1 / np.maximum(bend, 1e-9)) + inner, x @ (grad / ridge))
            step = (grad - x.T @ part) / ridge
        else:
            step = np.linalg.solve((x * bend[:, None]).T @ x + np.diag(ridge + 1e-9), grad)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w


class Scale:
    """Columns brought to mean 0 and deviation 1, with a constant 1 put last."""

    def __init__(self, x: np.ndarray):
        self.mean = x.mean(0) if len(x) else np.zeros(x.shape[1])
        self.std = np.maximum(x.std(0), 1e-6) if len(x) else np.ones(x.shape[1])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) / self.std, -8, 8), np.ones((len(x), 1))])
