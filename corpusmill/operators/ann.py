"""Approximate nearest neighbours by an inverted file: centroids fitted on a bounded sample, every row in a list.

``fit`` takes the ``sample`` vectors whose ids hash lowest (a bound, so centroids and calibration are
driver work of fixed size), clusters their directions, and sets how many lists a query probes:
the fewest with which held-in queries find ``target`` of their true neighbours in the sample. ``build``
assigns every vector in Arrow batches and range-partitions rows by list and id, so a list that a third
of all rows are in is spread over tasks. ``search`` broadcasts blocks of queries (a stated set) with the
lists that each probes; vectors aren't shuffled, and each task gives up its best k a query.

Distances are those of ``retrieval.knn``; exact search stays there. Rows without id, without vector
or of another dimension than the sample's are left out. A zero vector is at distance 1 of all.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .retrieval import LAST, PACK, close, keep_best

SAMPLE, QUERY_BLOCK, ROUNDS = 20_000, 16_384, 12
_FOUND = "query_id long, chunk_id long, distance double"


@dataclass
class Fitted:
    """Unit centroids, and how many lists a query probes."""

    centroids: np.ndarray
    probes: int


def _units(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(n == 0, 1.0, n)


def _matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of lists of ``size`` finite numbers, and which rows these are."""
    lengths = np.asarray(column.value_lengths().fill_null(-1))
    held = np.flatnonzero(lengths == size)
    flat = column.take(pa.array(held)).flatten()
    x = np.asarray(flat.cast(pa.float64()).fill_null(np.nan)).reshape(len(held), size)
    finite = np.isfinite(x).all(axis=1)
    return x[finite], held[finite]


def fit(vectors: DataFrame, k: int = 10, lists: int | None = None, target: float = 0.97, sample: int = SAMPLE) -> Fitted:
    """Centroids of ``vectors(chunk_id, vector)``: about four times the root of the sample's size, unless ``lists`` says how many."""
    rows = vectors.where("chunk_id IS NOT NULL AND vector IS NOT NULL").select("chunk_id", F.col("vector").cast("array<double>").alias("vector"))
    drawn = rows.orderBy(F.xxhash64("chunk_id"), "chunk_id").limit(sample).select("vector").toArrow().column(0).combine_chunks()
    if not len(drawn):
        return Fitted(np.zeros((1, 0)), 1)
    size = int(np.bincount(np.asarray(drawn.value_lengths())).argmax())
    x = _units(_matrix(drawn, size)[0])
    n = max(1, min(lists or round(4 * len(x) ** 0.5), len(x)))
    rng = np.random.default_rng(7)
    c = x[rng.permutation(len(x))[:n]]
    for _ in range(ROUNDS):
        near = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        empty = np.flatnonzero(np.bincount(near, minlength=n) == 0)
        c = _units(sums)
        c[empty] = x[rng.integers(0, len(x), len(empty))]
    near = (x @ c.T).argmax(axis=1)
    asked = rng.permutation(len(x))[: min(300, len(x))]
    likes = x[asked] @ x.T
    true = np.argsort(-likes, axis=1, kind="stable")[:, :k]
    order = np.argsort(-(x[asked] @ c.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(n)[None, :].repeat(len(asked), 0), axis=1)
    needed = np.take_along_axis(place, near[true], axis=1)  # the probe at which each true neighbour's list comes
    for probes in range(1, n + 1):
        if (needed < probes).mean() >= target:
            return Fitted(c, probes)
    return Fitted(c, n)


def build(vectors: DataFrame, fitted: Fitted) -> DataFrame:
    """``chunk_id, list, vector``: every vector with the list it is in."""
    c = vectors.sparkSession.sparkContext.broadcast(fitted.centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, held = _matrix(batch.column(1), c.value.shape[1])
            near = (_units(x) @ c.value.T).argmax(axis=1) if len(x) else np.zeros(0, np.int64)
            kept = pa.array(held)
            yield pa.record_batch([batch.column(0).take(kept), pa.array(near.astype(np.int32)), batch.column(1).take(kept)], names=["chunk_id", "list", "vector"])

    rows = vectors.where("chunk_id IS NOT NULL AND vector IS NOT NULL").select(F.col("chunk_id").cast("long").alias("chunk_id"), F.col("vector").cast("array<double>").alias("vector"))
    width = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.mapInArrow(run, "chunk_id long, list int, vector array<double>").repartitionByRange(width, "list", "chunk_id").sortWithinPartitions("list")


def upsert(index: DataFrame, rows: DataFrame, fitted: Fitted) -> DataFrame:
    """The index with ``rows(chunk_id, vector)`` in place of those with their ids."""
    return delete(index, rows.select("chunk_id")).unionByName(build(rows, fitted))


def delete(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("chunk_id").distinct(), "chunk_id", "left_anti").select("chunk_id", "list", "vector")


def search(queries: DataFrame, index: DataFrame, fitted: Fitted, k: int, probes: int | None = None) -> DataFrame:
    """``query_id, chunk_id, distance, rank`` of the k nearest in the probed lists; ties by chunk id."""
    spark, size = queries.sparkSession, fitted.centroids.shape[1]
    q = queries.where("query_id IS NOT NULL AND vector IS NOT NULL").select(F.col("query_id").cast("long").alias("query_id"), F.col("vector").cast("array<double>").alias("vector"))
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    found = None
    for b in range(blocks):
        part = (q if blocks == 1 else q.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).toArrow()  # a block of the stated query set
        x, held = _matrix(part.column(1).combine_chunks(), size) if part.num_rows else (np.zeros((0, size)), np.zeros(0, np.int64))
        ids, units = np.asarray(part.column(0))[held], _units(x)
        near = np.argsort(-(units @ fitted.centroids.T), axis=1, kind="stable")[:, : probes or fitted.probes]
        asks = np.zeros((len(ids), len(fitted.centroids)), bool)
        np.put_along_axis(asks, near, True, axis=1)
        asks[~units.any(axis=1)] = True
        sent = spark.sparkContext.broadcast((ids, units, asks))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, units, asks = sent.value
            best, found = np.full((len(ids), k), np.inf), np.full((len(ids), k), LAST)
            for batch in batches:
                chunk, lists = np.asarray(batch.column(0)), np.asarray(batch.column(1))
                v = _units(_matrix(batch.column(2), size)[0])
                for one in np.unique(lists):
                    rows, who = np.flatnonzero(lists == one), np.flatnonzero(asks[:, one])
                    for at, row in product(range(0, len(who), PACK), range(0, len(rows), PACK)):
                        some, part = who[at : at + PACK], rows[row : row + PACK]
                        held = best[some], found[some]
                        keep_best(held, chunk[part], *close(units[some], v[part], held[0][:, -1], k))
                        best[some], found[some] = held
            got = ~np.isinf(best)
            yield pa.record_batch([pa.array(np.repeat(ids, got.sum(axis=1))), pa.array(found[got]), pa.array(best[got])], names=["query_id", "chunk_id", "distance"])

        hit = index.mapInArrow(run, _FOUND)
        found = hit if found is None else found.unionByName(hit)
    w = Window.partitionBy("query_id").orderBy("distance", "chunk_id")
    return found.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """``queries, recall``: the share of the exact neighbours that were found."""
    hit = found.select("query_id", "chunk_id").distinct().withColumn("hit", F.lit(1))
    both = exact.join(hit, ["query_id", "chunk_id"], "left")
    return both.agg(F.count_distinct("query_id").alias("queries"), F.round(F.avg(F.coalesce("hit", F.lit(0))), 4).alias("recall"))
