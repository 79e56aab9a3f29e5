"""Bounded labelled samples and calibration, shared by the two classifiers."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches

#: Labelled documents of each class that a model is fitted on, at most. All
#: scoring covers all rows; only the fit is bounded.
SAMPLE_PER_CLASS = 4096


def sample_ids(labels: DataFrame, label: str, per_class: int = SAMPLE_PER_CLASS) -> DataFrame:
    """(doc_id, y): up to ``per_class`` labelled ids of each class, in the order
    of a hash of the id; held-out ids, null ids or labels and ids with
    contradictory labels are left out."""
    clean = (labels.select("doc_id", F.col(label).cast("int").alias("y")).where("doc_id IS NOT NULL AND y IN (0, 1)")
             .where(~held_out()).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y1"))
             .where("y = y1").drop("y1"))
    parts = [clean.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    return parts[0].union(parts[1])


def training_rows(docs: DataFrame, labels: DataFrame, label: str, terms, per_class: int = SAMPLE_PER_CLASS):
    """(y, rows): labels and sorted hashed terms of the sampled documents.

    ``terms`` maps UTF-8 text to an array of uint32. The ids are at most twice
    ``per_class`` rows, so they are broadcast; of documents that share an id one
    is taken before anything leaves the tasks.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("binary")
    def packed(texts: pa.Array) -> pa.Array:
        return pa.array([np.sort(terms(t)).astype("<u4").tobytes() for t in texts.to_pylist()], pa.binary())

    ids = sample_ids(labels, label, per_class)
    picked = (docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
              .select("doc_id", "y", packed("text").alias("t")).groupBy("doc_id").agg(F.min("y").alias("y"), F.min("t").alias("t")).collect())
    picked.sort(key=lambda r: r.doc_id)
    return np.array([r.y for r in picked], np.int8), [np.frombuffer(bytes(r.t), "<u4") for r in picked]


def calibrate(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(slope, offset) of Platt's logistic curve, by Newton steps on smoothed
    targets; classes weigh the same, the slope is never negative."""
    pos, neg = int((y == 1).sum()), int((y == 0).sum())
    if not pos or not neg:
        return 1.0, 0.0
    target = np.where(y == 1, (pos + 1) / (pos + 2), 1 / (neg + 2))
    weight = np.where(y == 1, 0.5 / pos, 0.5 / neg) * len(y)
    x = np.stack([margin, np.ones_like(margin)])
    beta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -35, 35)))
        grad = x @ (weight * (p - target)) + 1e-3 * beta
        hess = (x * (weight * p * (1 - p))) @ x.T + np.eye(2) * 1e-3
        beta = beta - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return max(float(beta[0]), 1e-3), float(beta[1])


def share(margin, curve):
    """Score 0 to 1 of a margin under a calibrated curve."""
    return 1 / (1 + np.exp(-np.clip(curve[0] * margin + curve[1], -35, 35)))


def score_column(score, text: str = "text"):
    """Arrow column of ``score`` (list of whole texts -> array of doubles)."""
    @F.arrow_udf("double")
    def scores(texts: pa.Array) -> pa.Array:
        return pa.array(score(texts.to_pylist()), pa.float64())

    return scores(F.col(text))
