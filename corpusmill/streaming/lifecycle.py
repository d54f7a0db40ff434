"""Stateful life cycles over streams with ``transformWithState``: the answer cache and conflict reviews.

State lives in RocksDB (set ``spark.sql.streaming.stateStore.providerClass`` to Spark's
``RocksDBStateStoreProvider``), a key at a time, so it survives lost executors with the
query's checkpoint. Rows of a key are taken in order of time and id within a micro-batch.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.answer_cache import SCHEMA, Cache
from ..operators.conflicts import RESOLUTIONS

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class CacheProcessor(StatefulProcessor):
    """A knowledge base's cache: its entries are a list state, its counts a value state, a timer at the first expiry."""

    def __init__(self, threshold: float, ttl: float | None, most: int):
        self.threshold, self.ttl, self.most = threshold, ttl, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("entries", "entry_id long, at double, hits long, unit array<double>")

    def _cache(self) -> Cache:
        return Cache(self.threshold, self.ttl, self.most).load([tuple(e) for e in self.held.get()])

    def _keep(self, cache: Cache) -> None:
        entries = cache.entries()
        self.held.put(entries) if entries else self.held.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if entries and self.ttl is not None:
            self.handle.registerTimer(int((entries[0][1] + self.ttl) * 1000) + 1)

    @staticmethod
    def _rows(kb: str, taken: list[tuple]) -> Iterator[Row]:
        for event_id, at, action, entry_id, similarity, hits in taken:
            yield Row(kb=kb, event_id=event_id, at=at, action=action, entry_id=entry_id, similarity=similarity, hits=hits)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        cache, taken = self._cache(), []
        for r in sorted(rows, key=lambda r: (r["at"], r["event_id"])):
            taken += cache.take(r["event_id"], r["at"], r["kind"], r["vector"])
        self._keep(cache)
        yield from self._rows(key[0], taken)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        cache = self._cache()
        taken = cache.expire(timerValues.getCurrentWatermarkInMs() / 1000)
        self._keep(cache)
        yield from self._rows(key[0], taken)

    def close(self) -> None:
        pass


def cache_stream(events: DataFrame, threshold: float = 0.95, ttl: float | None = 3600, most: int = 500, late: str = "1 minute") -> DataFrame:
    """``operators.answer_cache.replay`` over a stream: entries of a knowledge base that nobody asks expire by timer as the watermark passes."""
    ts = F.col("ts").cast("timestamp")
    rows = events.where("kb IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL").select(
        F.col("kb").cast("string").alias("kb"), F.col("event_id").cast("long").alias("event_id"), ts.alias("ts"), (F.unix_micros(ts) / 1e6).alias("at"), F.col("kind").cast("string").alias("kind"), F.col("vector").cast("array<double>").alias("vector"))
    return rows.withWatermark("ts", late).groupBy("kb").transformWithState(CacheProcessor(threshold, ttl, most), SCHEMA, "append", "EventTime")


_REVIEW = "new_id long, decision_id long, at double, action string, resolution string, suppressed long"


class ReviewProcessor(StatefulProcessor):
    """A conflict from pending to resolved: the conflict is a value state, decisions that came before it a list state."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.review = handle.getValueState("review", "told string")
        self.early = handle.getListState("early", "decision_id long, at double, resolution string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = self.review.get()
        review = json.loads(held[0]) if held is not None else None
        waiting = [(e[1], e[0], e[2]) for e in self.early.get()]
        for r in rows:
            if r["decision_id"] is not None:
                waiting.append((r["at"], r["decision_id"], r["resolution"]))
            elif review is None:
                review = {"old": r["old_id"], "new_at": r["new_at"], "old_at": r["old_at"], "status": "pending"}
        if review is None:  # decisions wait for their conflict
            self.early.put([(d, at, x) for at, d, x in waiting])
            return
        self.early.clear()
        for at, decision_id, wished in sorted(waiting, key=lambda w: w[:2]):
            action, told, gone = "already_resolved", None, None
            if wished not in RESOLUTIONS:
                action = "invalid"
            elif review["status"] == "pending":
                newer = None in (review["new_at"], review["old_at"]) or review["new_at"] >= review["old_at"]
                told = ("keep_new" if newer else "keep_old") if wished == "auto_recency" else wished
                gone = {"keep_new": review["old"], "keep_old": key[0]}.get(told)
                action = review["status"] = f"resolved_{wished}"
            yield Row(new_id=key[0], decision_id=decision_id, at=at, action=action, resolution=told, suppressed=gone)
        self.review.update((json.dumps(review),))

    def close(self) -> None:
        pass


def review_stream(events: DataFrame) -> DataFrame:
    """Conflicts and decisions in one stream ``new_id, old_id, new_at, old_at, decision_id, at, resolution`` (a decision has an id): what each decision does."""
    rows = events.where("new_id IS NOT NULL").select(*(F.col(c).cast(k).alias(c) for c, k in (("new_id", "long"), ("old_id", "long"), ("new_at", "double"), ("old_at", "double"), ("decision_id", "long"), ("at", "double"), ("resolution", "string"))))
    return rows.groupBy("new_id").transformWithState(ReviewProcessor(), _REVIEW, "append", "None")
