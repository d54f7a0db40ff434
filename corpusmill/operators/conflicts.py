"""Near-duplicate conflicts of new chunks with indexed ones, and their resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .retrieval import knn

#: Similarity of a conflict, and resolutions.
THRESHOLD = 0.92
RESOLUTIONS = ("keep_new", "keep_old", "keep_both", "auto_recency")


def detect(new: DataFrame, indexed: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``new_id, old_id, similarity``: the nearest other indexed chunk of each new one, where it is that near.

    ``new`` and ``indexed``: chunk_id, vector. New chunks are the stated query set, met in blocks.
    """
    near = knn(new.select(F.col("chunk_id").alias("query_id"), "vector"), indexed.select("chunk_id", "vector"), 2, within=1 - threshold + 1e-6).where("chunk_id <> query_id")
    first = near.groupBy("query_id").agg(F.min_by(F.struct("chunk_id", "distance"), F.struct("rank")).alias("b"))
    return first.where(1 - F.col("b.distance") >= threshold).select(F.col("query_id").alias("new_id"), F.col("b.chunk_id").alias("old_id"), F.round(1 - F.col("b.distance"), 6).alias("similarity"))


def outcome(new_at, old_at, wished):
    """The resolution that takes effect: the more recent chunk, of equals the new one, decides ``auto_recency``."""
    newer = F.when(new_at.isNull() | old_at.isNull() | (new_at >= old_at), "keep_new").otherwise("keep_old")
    return F.when(wished == "auto_recency", newer).otherwise(wished)


def resolve(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """``new_id, old_id, similarity, status, resolution, suppressed``: the first valid decision of each conflict takes effect.

    ``conflicts``: new_id, old_id, similarity, new_at, old_at. ``decisions``: new_id, decision_id, at,
    resolution; later ones find the conflict resolved, unknown ones are ignored (``refused`` lists both).
    """
    valid = decisions.where(F.col("resolution").isin(*RESOLUTIONS))
    first = valid.groupBy("new_id").agg(F.min_by("resolution", F.struct("at", "decision_id")).alias("wished"))
    out = conflicts.join(first, "new_id", "left").withColumn("resolution", outcome(F.col("new_at"), F.col("old_at"), F.col("wished")))
    gone = F.when(F.col("resolution") == "keep_new", F.col("old_id")).when(F.col("resolution") == "keep_old", F.col("new_id"))
    status = F.when(F.col("wished").isNull(), "pending").otherwise(F.concat(F.lit("resolved_"), "wished"))
    return out.select("new_id", "old_id", "similarity", status.alias("status"), "resolution", gone.alias("suppressed"))


def refused(conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """``decision_id, reason`` of decisions without effect: ``invalid``, ``not_found`` or ``already_resolved``."""
    valid = F.col("resolution").isin(*RESOLUTIONS) & F.col("resolution").isNotNull()
    first = decisions.where(valid).groupBy("new_id").agg(F.min_by("decision_id", F.struct("at", "decision_id")).alias("first"))
    known = conflicts.select("new_id", F.lit(True).alias("known")).distinct()
    out = decisions.join(known, "new_id", "left").join(first, "new_id", "left")
    reason = F.when(~F.coalesce(valid, F.lit(False)), "invalid").when(F.col("known").isNull(), "not_found").when(F.col("first") != F.col("decision_id"), "already_resolved")
    return out.withColumn("reason", reason).where("reason IS NOT NULL").select("decision_id", "reason")
