"""A bounded, hashed sample of labelled texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .scratch import materialize

#: Bytes of all texts of one sample at most, so that repeated ids and very long texts stay within the driver's bounds.
SAMPLE_BYTES = 256 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, limit: int, train: Column, most_bytes: int = SAMPLE_BYTES) -> DataFrame:
    """``text, y`` of at most about ``limit`` texts, of about ``most_bytes`` in all, whose id has a label and satisfies ``train`` (on ``doc_id``).

    Null ids and labels teach nothing; repeated labels of an id count once, the largest. Ids
    are chosen by a hash; where their rows still pass a bound (repeated ids, long texts), rows
    are drawn from them. A text of more than a tenth of the bytes teaches nothing.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & train).groupBy("doc_id").agg(F.max(label).cast("double").alias("y"))
    known = materialize(known, "labelled")
    n = known.count()
    if n > limit:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * limit / n))
    # Bounded by ``limit``, so it is broadcast.
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(known), "doc_id").select("text", "y")
    sample = materialize(rows.where(F.octet_length("text") <= most_bytes // 10), "sample")
    n, size = sample.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    share = min(1.0, 1.25 * limit / max(n, 1), most_bytes / max(size, 1))
    return sample if share == 1.0 else materialize(sample.where(F.rand(17) < share), "sample")
