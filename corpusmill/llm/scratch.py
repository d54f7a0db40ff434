"""Tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: A side of at most this many narrow rows (16 MB of ids) is broadcast; a larger one is shuffled.
BROADCAST_ROWS = 1_000_000
#: Bytes of one Arrow batch to a Python worker.
BATCH_BYTES = 4 << 20


_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary folder and a cluster an error: its executors share no local folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="corpusmill-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A folder not used before in the shared folder, known to ``clear``."""
    _made.append(f"{shared_dir(spark)}/corpusmill/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back; a lost executor costs nothing."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches of ``BATCH_BYTES`` at most (or one row), so that long texts don't fill a worker; a limit that the session sets is kept."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    if conf.get(key, "67108864b") in ("67108864b", "67108864"):
        conf.set(key, BATCH_BYTES)
    return df.mapInArrow(f, schema)


def columns(df: DataFrame) -> list[np.ndarray]:
    """The columns of a table of bounded size, as arrays of 64-bit integers on the driver; no row becomes an object."""
    return [np.asarray(c.to_numpy(), np.int64) for c in df.toArrow().columns]


def mark() -> int:
    """The number of tables written so far, for ``clear``."""
    return len(_made)


def clear(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the tables written since ``mark``, but for the last ``keep`` of them; results that still read one must be written first."""
    gone = _made[since : len(_made) - keep]
    del _made[since : since + len(gone)]
    for name in gone:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (cheap to count) with a broadcast hint if it has at most ``rows`` rows, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """``df``, a table as read, dealt over all cores where fewer of its partitions hold rows (a small table in one row group); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.select(F.spark_partition_id()).distinct().count() < cores else df
