"""Queries whose operators run Python on Arrow batches or state; tests hold them against plain versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import embedding, parsing
from ..streaming import rate_limit as _rate_limit
from . import kb

SQL: dict[str, str] = {}


def hash_embed(spark: SparkSession, sf: str) -> DataFrame:
    return embedding.hash_embed(kb.table(spark, sf, "documents"))


def parse_html(spark: SparkSession, sf: str) -> DataFrame:
    return parsing.with_text(kb.table(spark, sf, "pages"), "page_id", F.col("html"), parsing.html_text)


def csv_rows(spark: SparkSession, sf: str) -> DataFrame:
    c = kb.table(spark, sf, "customer")
    raw = F.concat(F.lit("key,name,segment\n"), "c_custkey", F.lit(',"'), "c_name", F.lit('",'), "c_mktsegment", F.lit("\n"))
    return parsing.with_text(c, "c_custkey", raw, parsing.csv_text)


def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    return _rate_limit(kb.table(spark, sf, "events"), 1, window=3600.0)


QUERIES = {f.__name__: f for f in (hash_embed, parse_html, csv_rows, rate_limit)}
