"""Ordered work in groups of any size: numbering, running sums, batches and digests on two levels.

Rows are range-partitioned by group and order, so one source or language of all rows is spread
over many ranges; what a range needs of those before it is one offset, from a table of a row for each
range and group. Rows of equal order stand in one range: give ids as the last order column.
Null groups are groups.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..shared import materialize, small

#: Buckets of a tree digest.
BUCKETS = 4096


def _group(by: list[str]) -> Column:
    return F.struct(*by) if by else F.struct(F.lit(1).alias("all"))


def running(rows: DataFrame, by: list[str], order: list[str], value: Column, out: str, number: str | None = None) -> DataFrame:
    """``rows`` with the sum of ``value`` up to and with each row of its group in the order, and with ``number``, the row's place from 1."""
    width = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tagged = rows.withColumn("__g", _group(by)).withColumn("__v", value).repartitionByRange(width, "__g", *order).withColumn("__range", F.spark_partition_id())
    tagged = materialize(tagged, "ranges")  # so that a range is the same rows for all that read it
    totals = tagged.groupBy("__range", "__g").agg(F.sum("__v").alias("__sum"), F.count("*").alias("__n"))
    before = Window.partitionBy("__g").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__range", "__g", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__sum"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__n"))
    inside = Window.partitionBy("__range", "__g").orderBy(*order)
    result = tagged.join(small(offsets), ["__range", "__g"])
    result = result.withColumn(out, F.sum("__v").over(inside.rowsBetween(Window.unboundedPreceding, 0)) + F.col("__sum"))
    if number:
        result = result.withColumn(number, (F.row_number().over(inside) + F.col("__n")).cast("long"))
    return result.drop("__range", "__g", "__v", "__sum", "__n")


def number(rows: DataFrame, by: list[str], order: list[str], out: str) -> DataFrame:
    """``rows`` with their place from 1 in the order of their group."""
    return running(rows, by, order, F.lit(1).cast("long"), out)


def batches(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """``rows`` with ``batch``, from 0: each of a group's batches holds ``size`` rows, the last may hold fewer."""
    placed = number(rows, by, order, "__place")
    return placed.withColumn("batch", F.floor((F.col("__place") - 1) / size).cast("long")).drop("__place")


def sorted_digest(rows: DataFrame, by: list[str], value: str, out: str = "fingerprint") -> DataFrame:
    """SHA-256 of a group's sorted values joined by line feeds. A digest of one text is made in order: its values stream through one task, a few bytes held; ``tree_digest`` splits them."""
    schema = rows.select(*by).schema

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, told = None, None
        for batch in parts:
            done = []
            for *g, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if told is None or g != group:
                    if told is not None:
                        done.append((*group, told.hexdigest()))
                    group, told = g, hashlib.sha256(v.encode())
                else:
                    told.update(b"\n" + v.encode())
            if done:
                yield pa.record_batch([*(pa.array(x, batch.schema.field(i).type) for i, x in enumerate(list(zip(*done, strict=True))[:-1])), pa.array([d[-1] for d in done])], names=[*by, out])
        if told is not None:
            yield pa.record_batch([*(pa.array([x], batch.schema.field(i).type) for i, x in enumerate(group)), pa.array([told.hexdigest()])], names=[*by, out])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    values = rows.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("string").alias("__value"))
    return values.repartition(*by).sortWithinPartitions(*by, "__value").mapInArrow(run, f"{kinds}, {out} string")


def tree_digest(rows: DataFrame, by: list[str], value: str, out: str = "fingerprint", buckets: int = BUCKETS) -> DataFrame:
    """A digest of a group's values, whatever their order and partitioning: SHA-256 of the digests of ``buckets`` parts by hash, each that of its sorted values."""
    text = F.col(value).cast("string")
    parts = rows.where(F.col(value).isNotNull()).select(*by, text.alias("__value"), F.pmod(F.xxhash64(text), F.lit(buckets)).alias("__bucket"))
    leaf = parts.groupBy(*by, "__bucket").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("__value")), "\n"), 256).alias("__leaf"), F.count("*").alias("__n"))
    line = F.format_string("%d %s", "__bucket", "__leaf")
    return leaf.groupBy(*by).agg(F.sum("__n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias(out))
