"""Registered queries of the retrieval and analytics operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import analytics, arrow, base, drift, evaluation, exports, graph, lifecycle, nested, search

_MODULES = [base, search, analytics, evaluation, exports, drift, graph, lifecycle, nested, arrow]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in _MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in _MODULES for k, s in m.SQL.items()}
