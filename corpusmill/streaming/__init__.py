"""Stateful event processing with Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.versions import plan_ingest

_DECISION = "key long, ts timestamp, admitted boolean, retry_after double"


def admit(times: list[float], held: list[float], limit: int, window: float) -> tuple[list[tuple[bool, float]], list[float]]:
    """Decisions for sorted times given the admitted ones still in the window, with whole seconds to wait; refused events don't count."""
    out = []
    for t in times:
        held = [h for h in held if h > t - window]
        ok = len(held) < limit
        out.append((ok, 0.0 if ok else float(max(1, int(held[0] + window - t) + 1))))
        if ok:
            held.append(t)
    return out, held


def rate_limit(events: DataFrame, per_minute: int, key: str = "user_id", ts: str = "ts", window: float = 60.0) -> DataFrame:
    """Sliding-window limiter of each key over a batch table: ``key, ts, admitted, retry_after``."""
    limit = max(1, int(per_minute * 1.5))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ts", kind="stable")
        done, _ = admit((pdf.ts.astype("int64") / 1e9 if pdf.ts.dtype == "datetime64[ns]" else pdf.ts.map(lambda t: t.timestamp())).tolist(), [], limit, window)
        return pd.DataFrame({"key": pdf.key, "ts": pdf.ts, "admitted": [d[0] for d in done], "retry_after": [round(d[1], 6) for d in done]})

    return events.select(F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("ts")).groupBy("key").applyInPandas(run, _DECISION)


def rate_limit_stream(events: DataFrame, per_minute: int, key: str = "user_id", ts: str = "ts", window: float = 60.0) -> DataFrame:
    """The limiter over a stream: admitted times of the last window are each key's state, and time out."""
    limit = max(1, int(per_minute * 1.5))

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        pdf = pd.concat(batches).sort_values("ts", kind="stable")
        done, held = admit([t.timestamp() for t in pdf.ts], held, limit, window)
        state.update((held,))
        state.setTimeoutDuration(int(window * 2000))
        yield pd.DataFrame({"key": pdf.key, "ts": pdf.ts, "admitted": [d[0] for d in done], "retry_after": [round(d[1], 6) for d in done]})

    rows = events.select(F.col(key).cast("long").alias("key"), F.col(ts).cast("timestamp").alias("ts"))
    return rows.groupBy("key").applyInPandasWithState(run, _DECISION, "held array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)


def windowed_counts(events: DataFrame, size: str = "1 day", late: str = "1 hour", ts: str = "ts", by: str = "event_type") -> DataFrame:
    """Closed event-time windows of a stream, rows later than the watermark left out."""
    rows = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    out = rows.groupBy(F.window(ts, size).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), by, "n")


def incremental_ingest(stream: DataFrame, store: str, checkpoint: str, key: str = "uri", digest: str = "content_hash"):
    """A file stream's rows become new versions where their digest differs from the latest: Parquet, one folder a batch.

    A batch that runs again writes the same folder again, so nothing is stored twice.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(store)
        fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
        rows = batch.dropDuplicates([key])
        if fs.exists(path):
            old = spark.read.option("basePath", store).parquet(f"{store}/batch=*").where(F.col("batch") < number)
            latest = old.groupBy(key).agg(F.max_by(digest, "version_number").alias(digest), F.max("version_number").alias("top"))
            plan = plan_ingest(latest.select(key, digest), rows, key, digest).where("action <> 'unchanged'")
            rows = plan.join(latest.select(key, "top"), key, "left").withColumn("version_number", F.coalesce("top", F.lit(0)) + 1).drop("top", "action")
        else:
            rows = rows.withColumn("version_number", F.lit(1))
        rows.write.mode("overwrite").parquet(f"{store}/batch={number}")

    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
