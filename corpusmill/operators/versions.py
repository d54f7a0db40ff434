"""Versioned documents: latest rows, numbering, change and delete detection, upserts, retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def latest(versions: DataFrame, key: str = "document_id", order: str = "version_number") -> DataFrame:
    """One row of each key, that of the highest order: an aggregation, so no self-join and map-side combine."""
    rest = [c for c in versions.columns if c != key]
    return versions.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*").select(*versions.columns)


def number(rows: DataFrame, key: str, order: list[str], out: str = "version_number") -> DataFrame:
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long"))


def plan_ingest(known: DataFrame, seen: DataFrame, key: str = "uri", digest: str = "content_hash") -> DataFrame:
    """Each seen row's action: ``new``, ``changed`` or ``unchanged`` against the known digests."""
    old = known.select(key, F.col(digest).alias("__old"))
    action = F.when(F.col("__old").isNull(), "new").when(F.col("__old") == F.col(digest), "unchanged").otherwise("changed")
    return seen.join(old, key, "left").withColumn("action", action).drop("__old")


def deleted(known: DataFrame, seen: DataFrame, key: str = "uri") -> DataFrame:
    return known.join(seen, key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows win; others stay."""
    return new.select(*old.columns).unionByName(old.join(new.select(key), key, "left_anti"))


def purgeable(versions: DataFrame, cutoff: str) -> DataFrame:
    """Versions made before the cutoff that aren't their document's latest."""
    top = F.max("version_number").over(Window.partitionBy("document_id"))
    return versions.withColumn("__top", top).where((F.col("version_number") < F.col("__top")) & (F.col("created_at") < F.lit(cutoff).cast("timestamp"))).drop("__top")
