"""Labelled training rows: the fold rule and the bounded sample that models are fitted on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that a model is fitted on at most; they are those with the smallest hashes of their id.
MAX_TRAIN = 10_000


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """True where crc32 of the id's decimal text is divisible by ``folds``; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, max_train: int = MAX_TRAIN) -> DataFrame:
    """``text, y`` of at most ``max_train`` labelled rows outside the held-out fold.

    Labels that are null are left out, of several for one id the largest counts.
    The sample's ids (at most ``max_train`` longs) are broadcast.
    """
    ids = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
        .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
        .agg((F.max(label) > 0).cast("int").alias("y"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(max_train)
    )
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").select("text", "y")


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights (the last one is the constant) of a ridge logistic model, by Newton's method."""
    z = np.column_stack([x, np.ones(len(x))])
    w, ridge = np.zeros(z.shape[1]), np.full(z.shape[1], l2)
    ridge[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        grad = z.T @ (p - y) + ridge * w
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
