"""Training rows for the two classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled rows that a fit collects, and the longest text among them.
SAMPLE_ROWS, SAMPLE_BYTES = 6000, 32_768


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id falls in no fold."""
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % folds


def training_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, rows: int = SAMPLE_ROWS, longest: int = SAMPLE_BYTES) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most ``rows`` labelled documents outside the held-out fold.

    Rows come in the order of a hash of their id, so the sample is a fixed
    random one at every size. Scoring has no such bounds.
    """
    known = labels.where(F.col(label).isNotNull() & (fold(F.col("doc_id"), folds) != held)).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = known.orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(rows)
    # At most ``rows`` pairs of numbers: safe to broadcast at any scale.
    met = docs.where(F.octet_length("text") <= longest).select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    got = met.groupBy("doc_id").agg(F.min(F.struct("text", "y")).alias("r")).select("doc_id", "r.*").toArrow().sort_by("doc_id")
    return got.column("text").to_pylist(), np.array(got.column("y").to_pylist(), dtype=np.float64)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))
