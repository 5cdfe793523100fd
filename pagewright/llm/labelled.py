"""Bounded samples of labelled rows and one-dimensional calibration, for the classifiers of this package."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagewright.llm.shared import fold

#: Labelled rows that a classifier is fitted on at most; chosen by hash, so at any size the same way.
MOST_LABELLED = 20_000


def training_ids(labels: DataFrame, label: str, most: int = MOST_LABELLED) -> DataFrame:
    """(doc_id, label) of at most ``most`` training rows: those whose crc32(doc_id) mod 5 is not 0.

    Ids labelled twice count once (the larger label); null ids and null labels don't train.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (fold("doc_id") != 0))
    return (rows.groupBy("doc_id").agg(F.max(F.col(label).cast("int")).alias("label"))
            .orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))


def labelled_texts(documents: DataFrame, labels: DataFrame, label: str, value: str = "text") -> DataFrame:
    """(value, label) of the training sample, one row an id: of the rows of a repeated id the one of the least hash."""
    sample = training_ids(labels, label)
    rows = documents.select("doc_id", value).join(F.broadcast(sample), "doc_id")
    one = F.min_by(F.col(value), F.xxhash64(value)) if value == "text" else F.min(value)
    return rows.groupBy("doc_id").agg(F.first("label").alias("label"), one.alias(value)).select(value, "label")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights (intercept first) of a ridge logistic regression by Newton steps."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + penalty @ w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + penalty + 1e-9 * np.eye(x.shape[1])
        move = np.linalg.solve(hessian, gradient)
        w -= move
        if np.abs(move).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))
