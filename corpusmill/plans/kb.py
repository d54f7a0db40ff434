"""A knowledge base over the given tables: versions, access, chunks, usage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

AS_OF = "2024-02-01"
REQUEST = ["SRC0 ", "group:en"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.selectExpr(
        "doc_id", "doc_id div 3 AS document_id", "doc_id % 3 + 1 AS version_number", "lang AS kb", "source",
        "concat('kb://', source, '/', doc_id div 3, '.txt') AS uri", "text",
        "CASE doc_id % 5 WHEN 0 THEN 'protected' WHEN 1 THEN 'unknown' ELSE 'public' END AS visibility",
        "array(lower(source), concat('group:', lang)) AS allowed",
        "CASE WHEN doc_id % 7 = 0 THEN array(concat('group:', lang)) ELSE CAST(array() AS array<string>) END AS denied",
        "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(CAST(doc_id % 30 AS int)) AS created_at")


#: The same in DuckDB, to be followed by a query.
VERSIONS = """
WITH v AS (
  SELECT doc_id, doc_id // 3 AS document_id, doc_id % 3 + 1 AS version_number, lang AS kb, source,
    'kb://' || source || '/' || (doc_id // 3) || '.txt' AS uri, text,
    CASE doc_id % 5 WHEN 0 THEN 'protected' WHEN 1 THEN 'unknown' ELSE 'public' END AS visibility,
    [lower(source), 'group:' || lang] AS allowed,
    CASE WHEN doc_id % 7 = 0 THEN ['group:' || lang] ELSE CAST([] AS VARCHAR[]) END AS denied,
    TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(doc_id % 30 AS INTEGER)) AS created_at
  FROM documents)
"""


def usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    return e.select("event_id", F.col("ts").alias("created_at"), "user_id", F.col("event_type").alias("operation"), (F.col("value") / 1000).cast("decimal(14,8)").alias("cost"), F.col("value").alias("latency_ms"), k.alias("tokens"), F.when(k % 4 == 3, None).otherwise(F.concat(F.lit("role"), k % 4)).alias("role"))


USAGE = """
WITH u AS (
  SELECT event_id, ts AS created_at, user_id, event_type AS operation, CAST(value / 1000 AS DECIMAL(14,8)) AS cost, value AS latency_ms,
    CAST(json_extract(props, '$.k') AS BIGINT) AS tokens,
    CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) % 4 = 3 THEN NULL ELSE 'role' || (CAST(json_extract(props, '$.k') AS BIGINT) % 4) END AS role
  FROM events)
"""
