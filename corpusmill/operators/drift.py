"""Drift of parsers between runs over one corpus: redaction counts, degraded fixtures and digests of what comes out.

A run's results are rows ``run, parser_id, fixture_id, text, redacted, status``. Summaries are
aggregations; the digest of a parser's output is that of all its fixtures' texts, split by hash
(``ordered.tree_digest``), so no parser's corpus is gathered. A run is at risk where fewer things
were redacted than before, more fixtures are degraded, or a new parser redacts nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from .ordered import tree_digest

_FIELDS = ("fixtures", "redacted", "degraded", "golden_hash")


def summarize(results: DataFrame) -> DataFrame:
    """``run, parser_id, fixtures, redacted, degraded, golden_hash, status``; a parser is as bad as its worst fixture."""
    counts = results.groupBy("run", "parser_id").agg(F.count("*").alias("fixtures"), F.coalesce(F.sum("redacted"), F.lit(0)).alias("redacted"), F.count_if(F.coalesce("status", F.lit("")) != "success").alias("degraded"))
    line = F.concat_ws(":", F.coalesce(F.col("fixture_id").cast("string"), F.lit("")), F.sha2(F.coalesce("text", F.lit("")), 256))
    told = tree_digest(results.select("run", "parser_id", line.alias("line")), ["run", "parser_id"], "line", "golden_hash").drop("n")
    return counts.join(told, ["run", "parser_id"]).withColumn("status", F.when(F.col("degraded") > 0, "degraded").otherwise("success"))


def diff(base: DataFrame, head: DataFrame) -> DataFrame:
    """``parser_id, change_type, base_*, head_*, redacted_delta, degraded_delta, hash_drift, risk`` of every parser of either summary, unchanged ones too."""
    side = lambda rows, x: rows.select("parser_id", *(F.col(c).alias(f"{x}_{c}") for c in _FIELDS))
    both = side(base, "base").join(side(head, "head"), "parser_id", "full")
    b, h = (lambda c: F.col(f"base_{c}")), (lambda c: F.col(f"head_{c}"))
    same = b("fixtures") == h("fixtures")
    for c in _FIELDS[1:]:
        same = same & (b(c) == h(c))
    kind = F.when(b("fixtures").isNull(), "added").when(h("fixtures").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    delta = lambda c: F.coalesce(h(c), F.lit(0)) - F.coalesce(b(c), F.lit(0))
    worse = F.when(kind == "added", (h("redacted") < 1) | (h("degraded") > 0)).when(kind == "changed", (delta("redacted") < 0) | (delta("degraded") > 0)).otherwise(False)
    return both.select("parser_id", kind.alias("change_type"), *(b(c) for c in _FIELDS), *(h(c) for c in _FIELDS), delta("redacted").alias("redacted_delta"), delta("degraded").alias("degraded_delta"), (~b("golden_hash").eqNullSafe(h("golden_hash"))).alias("hash_drift"), worse.alias("risk"))


def _report(rows: DataFrame, *by: str) -> DataFrame:
    """One report for each group of diff rows: counts of changes, totals, and whether there is a risk."""
    n = lambda kind: F.count_if(F.col("change_type") == kind).alias(kind)
    worse = F.bool_or("risk") | (F.sum("redacted_delta") < 0) | (F.sum("degraded_delta") > 0)
    return rows.groupBy(*by).agg(n("added"), n("removed"), n("changed"), F.sum("redacted_delta").alias("redacted_delta"), F.sum("degraded_delta").alias("degraded_delta"), F.bool_or("hash_drift").alias("hash_drift"), F.when(worse, "degraded").otherwise("unchanged").alias("risk"))


def assess(rows: DataFrame) -> DataFrame:
    """The report of one ``diff``."""
    return _report(rows)


def reports(summaries: DataFrame) -> DataFrame:
    """``run, base_run`` and the report of each run against the one before it, for all runs at once."""
    runs = summaries.select("run").distinct()
    order = runs.withColumn("base_run", F.lag("run").over(Window.orderBy("run"))).where("base_run IS NOT NULL")  # one row a run
    base = summaries.withColumnRenamed("run", "base_run").join(F.broadcast(order), "base_run").withColumn("parser_id", F.struct("run", "parser_id"))
    head = summaries.join(F.broadcast(order), "run").withColumn("parser_id", F.struct("run", "parser_id"))
    rows = diff(base, head).withColumn("run", F.col("parser_id.run"))
    return order.join(_report(rows, "run"), "run")


def history(told: DataFrame) -> DataFrame:
    """One row over all ``reports``: how many there are, how many are degraded, and what the latest says."""
    latest = F.max_by(F.struct("base_run", "risk", "changed"), "run")
    return told.agg(F.count("*").alias("reports"), F.count_if(F.col("risk") == "degraded").alias("degraded_reports"), F.max("run").alias("latest_run"), latest.alias("l")).select(
        "reports", "degraded_reports", "latest_run", F.col("l.risk").alias("latest_risk"), F.col("l.changed").alias("latest_changed"), F.when(F.col("reports") == 0, "unknown").when(F.col("degraded_reports") > 0, "degraded").otherwise("success").alias("status"))
