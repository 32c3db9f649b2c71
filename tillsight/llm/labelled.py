"""Labelled training rows: which documents may train, and a bounded sample of them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents


def remainder(modulus: int) -> Column:
    """crc32 of the decimal ``doc_id``, modulo; NULL for a NULL id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def sample(docs: DataFrame, labels: DataFrame, label: str, may_train: Column, rows: int) -> DataFrame:
    """``doc_id, text, label`` of at most ``rows`` labelled training documents, the first by a hash of their id.

    Only the ids and labels of the sample (a bounded number) are broadcast.
    A document labelled more than once counts once, with its largest label; of
    rows that repeat a ``doc_id`` only the one of the smallest text is taken.
    """
    chosen = (labels.where(may_train & F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
              .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    found = documents(docs).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("label").alias("label"))


def logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60, l2: float = 1e-3) -> np.ndarray:
    """Weights (the last is the constant) of a logistic regression, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], l2 * len(x))
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + penalty * w
        h = (x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty + 1e-9)
        w = w - np.linalg.solve(h, g)
    return w


def probability(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
