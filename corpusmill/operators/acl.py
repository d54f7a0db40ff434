"""Access decisions on documents: public passes, unknown fails closed, deny beats allow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import principals


def reason(visibility: Column, allowed: Column, denied: Column, request: list[str]) -> Column:
    """The reason code of every row for the request's principals."""
    asked = principals(F.array(*map(F.lit, request)).cast("array<string>"))
    return (
        F.when(visibility == "public", "public")
        .when(visibility == "unknown", "unknown_visibility")
        .when(F.size(asked) == 0, "no_principals")
        .when(F.arrays_overlap(principals(denied), asked), "explicit_deny")
        .when(F.arrays_overlap(principals(allowed), asked), "principal_match")
        .otherwise("no_matching_principal")
    )


def with_decision(docs: DataFrame, request: list[str]) -> DataFrame:
    """``docs(visibility, allowed, denied)`` with ``reason`` and ``permitted``."""
    out = docs.withColumn("reason", reason(F.col("visibility"), F.col("allowed"), F.col("denied"), request))
    return out.withColumn("permitted", F.col("reason").isin("public", "principal_match"))


def report(docs: DataFrame, request: list[str]) -> DataFrame:
    return with_decision(docs, request).groupBy("reason", "permitted").agg(F.count("*").alias("n"))
