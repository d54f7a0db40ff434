"""A semantic cache of answers: lookup, store, expiry, eviction of the oldest, invalidation.

``Cache`` is the state of one knowledge base and takes its events in order. ``replay`` runs it
over a batch table: rows are sorted by Spark within partitions and streamed through, so a
knowledge base of all rows needs no more memory than its ``most`` entries. The streaming twin
is ``streaming.lifecycle.cache_stream``. A cache's answers hang on what was asked before, so
events of one knowledge base are taken one after the other.

Rules: an entry lives ``ttl`` seconds (to the end of that moment); an ask hits the live entry
of the highest cosine similarity, if that is ``threshold`` or more, of equals the one stored
first; else it is stored, and the oldest entries go until ``most`` are held. A zero vector is
like nothing. An ask without a vector misses and isn't stored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

SCHEMA = "kb string, event_id long, at double, action string, entry_id long, similarity double, hits long"
NAMES = [c.split(" ")[0] for c in SCHEMA.split(", ")]
_KINDS = (pa.string(), pa.int64(), pa.float64(), pa.string(), pa.int64(), pa.float64(), pa.int64())


class Cache:
    """Entries of one knowledge base, oldest first; ``take`` gives what an event does."""

    def __init__(self, threshold: float = 0.95, ttl: float | None = 3600, most: int = 500):
        if not 0 < threshold <= 1 or (ttl is not None and ttl <= 0) or most < 1:
            raise ValueError("threshold must be in (0, 1], ttl above 0, most above 0")
        self.threshold, self.ttl, self.most = threshold, ttl, most
        self.ids: list[int] = []
        self.times: list[float] = []
        self.hits: list[int] = []
        self.units: list[np.ndarray] = []
        # The same units as rows of one matrix, from ``_from`` on, while all are finite and of one dimension.
        self._rows: np.ndarray | None = None
        self._from, self._even = 0, True

    def load(self, entries: list[tuple]) -> Cache:
        for entry_id, at, hits, unit in entries:
            self._append(entry_id, at, hits, np.asarray(unit, np.float64))
        return self

    def entries(self) -> list[tuple]:
        return [(i, t, h, u.tolist()) for i, t, h, u in zip(self.ids, self.times, self.hits, self.units, strict=True)]

    def _append(self, entry_id: int, at: float, hits: int, unit: np.ndarray) -> None:
        self.ids.append(entry_id)
        self.times.append(at)
        self.hits.append(hits)
        self.units.append(unit)
        if not self._even:
            return
        if len(self.units) == 1:
            self._from = 0
            if self._rows is None or self._rows.shape[1] != unit.size:
                self._rows = np.empty((2 * self.most + 1, unit.size))
        at = self._from + len(self.units) - 1
        if self._rows.shape[1] != unit.size or not np.isfinite(unit).all() or len(self.units) > self.most:
            self._even = False
            return
        if at == len(self._rows):
            self._rows[: len(self.units) - 1] = self._rows[self._from : at].copy()
            self._from, at = 0, len(self.units) - 1
        self._rows[at] = unit

    def _nearest(self, unit: np.ndarray) -> tuple[float, int]:
        """The highest similarity, and the first entry that has it."""
        if not self.units:
            return -1.0, 0
        if self._even and self._rows.shape[1] == unit.size:
            likes = self._rows[self._from : self._from + len(self.units)] @ unit
            k = int(likes.argmax())
            return float(likes[k]), k
        best, k = max(((float((unit * u).sum()), -k) for k, u in enumerate(self.units) if u.size == unit.size), default=(-1.0, 0))
        return best, -k

    def _pop(self, k: int) -> int:
        gone = self.ids[k]
        for held in (self.ids, self.times, self.hits, self.units):
            del held[k]
        self._from += 1
        self._even = self._even and k == 0 or not self.ids
        return gone

    def expire(self, now: float) -> list[tuple]:
        """``(event, time, action, entry, similarity, hits)`` of each entry whose time is over."""
        out = []
        while self.ttl is not None and self.ids and self.times[0] + self.ttl < now:
            at, hits = self.times[0] + self.ttl, self.hits[0]
            out.append((None, at, "expire", self._pop(0), None, hits))
        return out

    def take(self, event_id: int, at: float, kind: str, vector: list | None) -> list[tuple]:
        out = self.expire(at)
        if kind == "invalidate":
            out += [(event_id, at, "invalidate", self._pop(0), None, None) for _ in range(len(self.ids))]
            return out
        if vector is None:
            return [*out, (event_id, at, "miss", None, None, None)]
        v = np.asarray(vector, np.float64)
        unit = v / (np.sqrt((v * v).sum()) or 1.0)
        best, k = self._nearest(unit)
        if best >= self.threshold - 1e-12:
            self.hits[k] += 1
            return [*out, (event_id, at, "hit", self.ids[k], round(best, 6), self.hits[k])]
        while len(self.ids) >= self.most:
            out.append((event_id, at, "evict", self._pop(0), None, None))
        # Times don't run backwards, so that the oldest entry is the first; a late ask counts as one of now.
        self._append(event_id, max([at, *self.times[-1:]]), 0, unit)
        return [*out, (event_id, at, "store", event_id, None, 0)]


def replay(events: DataFrame, threshold: float = 0.95, ttl: float | None = 3600, most: int = 500) -> DataFrame:
    """What each of ``events(kb, event_id, ts, kind, vector)`` does, in order of time and id: rows of ``SCHEMA``.

    ``kind`` is ``ask`` or ``invalidate``. Rows without knowledge base, id or time are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kb, cache = None, None
        for batch in batches:
            out = []
            size = np.asarray(batch.column(4).value_lengths().fill_null(-1))
            flat, ends = np.asarray(batch.column(4).flatten().fill_null(np.nan)), np.cumsum(np.maximum(size, 0)).tolist()
            vectors = [flat[end - n : end] if n >= 0 else None for n, end in zip(size.tolist(), ends, strict=True)]
            for name, event_id, at, kind, vector in zip(*(c.to_pylist() for c in batch.columns[:4]), vectors, strict=True):
                if name != kb:
                    kb, cache = name, Cache(threshold, ttl, most)
                out += [(name, *row) for row in cache.take(event_id, at, kind, vector)]
            if out:
                yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), _KINDS, strict=True)], names=NAMES)

    at = (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at")
    rows = events.where("kb IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL").select(F.col("kb").cast("string").alias("kb"), F.col("event_id").cast("long").alias("event_id"), at, F.col("kind").cast("string").alias("kind"), "vector")
    rows = rows.repartition("kb").sortWithinPartitions("kb", "at", "event_id")
    return rows.withColumn("vector", F.col("vector").cast("array<double>")).mapInArrow(run, SCHEMA)


def summary(actions: DataFrame) -> DataFrame:
    """Hits, stores, evictions, expiries and invalidations of each knowledge base, and its share of hits."""
    n = lambda a: F.count_if(F.col("action") == a)
    asked = n("hit") + n("store") + n("miss")
    return actions.groupBy("kb").agg(n("hit").alias("hits"), n("store").alias("stored"), n("evict").alias("evicted"), n("expire").alias("expired"), n("invalidate").alias("invalidated"), F.round(n("hit") / F.nullif(asked, F.lit(0)), 4).alias("hit_rate"))
