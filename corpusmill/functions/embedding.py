"""The deterministic hashing embedder, on Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def embed(text: str, dimensions: int) -> np.ndarray:
    """Digest bytes and centred text bytes folded into the dimensions, over the largest magnitude, six digits."""
    digest, data = (np.frombuffer(x, np.uint8) for x in (hashlib.sha256(text.encode()).digest(), text.encode()))
    fold = lambda b, w: np.bincount(np.arange(len(b)) % dimensions, weights=w, minlength=dimensions)
    v = fold(digest, digest / 255.0) + (fold(data, (data.astype(float) % 29 - 14) / 29.0) if len(data) else 0)
    return np.round(v / (np.abs(v).max() or 1.0), 6)


def hash_embed(rows: DataFrame, key: str = "doc_id", text: str = "text", dimensions: int = 8) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [embed(x or "", dimensions).tolist() for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=["k", "v"])

    return rows.select(F.col(key).cast("long").alias("k"), text).mapInArrow(run, "k long, v array<double>").toDF(key, "vector")
