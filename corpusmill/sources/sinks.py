"""Where rows go: typed exports, bulk actions, signed batches."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.ordered import batches


def export(rows: DataFrame, path: str, kind: str = "parquet", mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    """Parquet or JSON lines, by folder if asked."""
    writer = rows.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).format({"jsonl": "json"}.get(kind, kind)).save(path)


def bulk_actions(rows: DataFrame, index: str, key: str) -> DataFrame:
    """Pairs of lines of a bulk index request, as one string column ``value`` for ``write.text``."""
    action = F.to_json(F.struct(F.struct(F.lit(index).alias("_index"), F.col(key).cast("string").alias("_id")).alias("index")))
    return rows.select(F.concat(action, F.lit("\n"), F.to_json(F.struct(*rows.columns))).alias("value"))


def hmac_sha256(body: Column, secret: str) -> Column:
    """HMAC-SHA256 of a text as lower-case hex, from two digests on the JVM."""
    key = secret.encode()
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    pad = lambda x: F.unhex(F.lit(bytes(b ^ x for b in key).hex()))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), body.cast("binary")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def signed_batches(rows: DataFrame, size: int, secret: str, by: str, order: str) -> DataFrame:
    """``by, batch, n, body, signature``: batches of ``size`` rows of each group, in order, with an HMAC-SHA256 of the body. Rows are numbered by ranges, so a group of any size is spread."""
    held = F.struct(order, *(c for c in rows.columns if c not in (by, order)))
    out = batches(rows, [by], [order], size).groupBy(by, "batch").agg(F.count("*").alias("n"), F.to_json(F.sort_array(F.collect_list(held))).alias("body"))
    return out.withColumn("signature", hmac_sha256(F.col("body"), secret))
