"""Bounded, class-wise samples of labelled documents, and logistic regression on them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def sample(docs: DataFrame, labels: DataFrame, *, label: str, learn_from: Column, rows: dict[int, int], id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, dict[int, float]]:
    """Up to rows[c] labelled documents of each class c, in the order of a hash of their ids: (part, label, text), and each class's rows for each sampled row.

    Only rows of `labels` where `learn_from` holds are used. The ids are bounded by `rows` and so broadcast.
    `part` is 0 or 1 by the id's hash. Null ids or labels and labels other than 0 and 1 are not used; of
    contradicting labels for an id each counts.
    """
    usable = labels.where(learn_from & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label"))
    totals = {r["label"]: r["count"] for r in usable.where(F.col("label").isin(0, 1)).groupBy("label").count().collect()}
    order = F.xxhash64("doc_id")
    picked = [usable.where(F.col("label") == c).orderBy(order, "doc_id").limit(n) for c, n in rows.items()]
    ids = picked[0]
    for more in picked[1:]:
        ids = ids.unionByName(more)
    found = F.broadcast(ids).join(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "doc_id")
    part = F.pmod(F.shiftright(F.xxhash64("doc_id"), 7), F.lit(2)).alias("part")
    kept = common.written(found.select(part, "label", F.coalesce("text", F.lit("")).alias("text")), "labelled")
    got = {r["label"]: r["count"] for r in kept.groupBy("label").count().collect()}
    return kept, {c: totals[c] / n for c, n in got.items()}


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights and a last one for the constant, by damped Newton steps. y may hold probabilities."""
    a = np.c_[x, np.ones(len(x))]
    w = np.zeros(a.shape[1])
    scale = weight.sum()

    def loss(v: np.ndarray) -> float:
        z = a @ v
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() / scale + ridge / 2 * (v[:-1] ** 2).sum())

    now = loss(w)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        gradient = a.T @ (weight * (p - y)) / scale + ridge * np.r_[w[:-1], 0]
        curve = (a * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ a / scale + ridge * np.diag(np.r_[np.ones(len(w) - 1), 1e-6])
        step = np.linalg.solve(curve, gradient)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > now:
            size /= 2
        w = w - size * step
        if now - (new := loss(w)) < 1e-12:
            break
        now = new
    return w
