"""Bounded samples of labelled rows for models that are fitted on the driver."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of each class, and bytes of a text, that a sample may hold.
CLASS_ROWS = 1500
TEXT_BYTES = 32_768


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the decimal id modulo ``divisor``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % divisor


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learned: Column, class_rows: int = CLASS_ROWS, text_bytes: int = TEXT_BYTES) -> pd.DataFrame:
    """Texts, 0/1 labels and weights of at most ``class_rows`` rows of each class that ``learned`` (over doc_id) lets in.

    Rows are chosen by hash of the id, so the choice is the same for any partitioning. Longer texts than
    ``text_bytes`` are left out of the sample. Weights restore the classes' shares among all learned labels. An id
    with several labels or texts counts once, with the smallest; ids or labels that are null are never used.
    """
    known = labels.select("doc_id", F.col(label).alias("y")).filter(learned & F.col("doc_id").isNotNull() & F.col("y").isin(0, 1))
    known = known.groupBy("doc_id").agg(F.min("y").alias("y"))
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    picks = [known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(class_rows) for y in (0, 1)]
    texts = docs.select("doc_id", "text").filter(F.col("text").isNotNull() & (F.octet_length("text") <= text_bytes))
    chosen = texts.join(F.broadcast(picks[0].unionByName(picks[1])), "doc_id")  # at most two classes of class_rows ids
    one = chosen.groupBy("doc_id", "y").agg(F.min("text").alias("text")).select("doc_id", "text", "y")  # an id's rows may be many
    rows = one.toPandas().sort_values("doc_id", kind="stable").reset_index(drop=True)
    taken = rows.y.value_counts()
    rows["weight"] = [counts[y] / taken[y] for y in rows.y] if len(rows) else []
    if len(rows):
        rows["weight"] /= rows.weight.mean()
    return rows


def dealt(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows to train on, and which to set the logits' scale and offset by: every fifth of a class. These are kept out of the
    training, but for classes of fewer than five, that train on all they have."""
    train, aside = np.ones(len(labels), bool), np.zeros(len(labels), bool)
    for y in (0, 1):
        own = np.flatnonzero(labels == y)
        aside[own[::5]] = True
        train[own[::5]] = len(own) < 5
    return train, aside


def leaning(labels: np.ndarray, weights: np.ndarray) -> tuple[float, float]:
    """How much of a model's logit counts, and what of the logit of label 1's share is added: the less rows the smaller class
    has, the nearer is every score to that share; rows of one class alone give it."""
    fewest = min((labels == 0).sum(), (labels == 1).sum())
    share = ((weights * labels).sum() + 0.5) / (weights.sum() + 1)
    kept = fewest / (fewest + 1)
    return float(kept), float((1 - kept) * np.log(share / (1 - share)))


def calibrated(logits: np.ndarray, labels: np.ndarray, weights: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Scale and offset that make ``sigmoid(scale * logit + offset)`` fit weighted labels (ridge towards 1 and 0)."""
    x, beta = np.stack([logits, np.ones_like(logits)], 1), np.array([1.0, 0.0])
    ridge = np.diag([1e-1, 1e-3])
    for _ in range(rounds):
        p = sigmoid(x @ beta)
        grad = x.T @ (weights * (p - labels)) + ridge @ (beta - np.array([1.0, 0.0]))
        bend = (x * (weights * p * (1 - p))[:, None]).T @ x + ridge
        step = np.linalg.solve(bend, grad)
        beta = beta - step * min(1.0, 2.0 / (np.abs(step).max() + 1e-12))
    return float(max(beta[0], 1e-3)), float(beta[1])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))
