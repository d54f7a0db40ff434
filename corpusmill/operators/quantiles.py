"""Exact percentiles of groups of any size, by selection instead of one sorted buffer.

A mergeable sketch of bounded size brackets each rank: its error is at most a share ``1 / ACCURACY``
of the rows, so a bracket of twice that on both sides holds the exact order statistics. One more
pass counts the rows below each bracket and the distinct values inside it, whose running
counts (on two levels, see ``ordered``) give the values at the ranks. Brackets that don't hold their
ranks, should a sketch break its promise, are widened to the whole group. Small groups are
bracketed by their ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..shared import materialize, small
from .ordered import running

#: Inverse of the sketch's error; groups up to this size aren't bracketed.
ACCURACY, WHOLE = 10_000, 100_000


def between(a: Column, b: Column, share: Column) -> Column:
    """``a * (1 - share) + b * share`` with the first product and the sum rounded once, so that a value on the edge of a digit stays there."""
    high = lambda x: x * 134217729.0 - (x * 134217729.0 - x)
    rest, last = 1 - share, b * share
    p, ah, rh = a * rest, high(a), high(1 - share)
    lost = ((ah * rh - p) + ah * (rest - rh) + (a - ah) * rh) + (a - ah) * (rest - rh)
    s = p + last
    z = s - p
    exact = s + (((p - (s - z)) + (last - z)) + lost)
    return F.when(share == 0, a).when((F.abs(a) < 1e280) & (F.abs(b) < 1e280), exact).otherwise(p + last)


def percentiles(rows: DataFrame, by: list[str], value: str, shares: dict[str, float], nearest: bool = False) -> DataFrame:
    """``by, n, low, high, mean`` and a column for each of ``shares`` (name to share, 0 to 1). Null values are left out.

    Interpolated between the two ranks around ``share * (n - 1)``; with ``nearest`` the value of rank
    ``share * n`` (from 0, cut to a whole number, the last at most).
    """
    group = F.struct(*by) if by else F.struct(F.lit(1).alias("all"))
    held = rows.where(F.col(value).isNotNull()).select(group.alias("g"), F.col(value).cast("double").alias("v"))
    margin = 2 / ACCURACY
    ends = [e for p in shares.values() for e in (max(0.0, p - margin), min(1.0, p + margin))]
    stats = held.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.avg("v").alias("mean"), F.percentile_approx("v", F.array(*map(F.lit, ends)), ACCURACY).alias("ends"))
    stats = materialize(stats, "groups")

    names = list(shares)
    place = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(float(p)).alias("p"), F.get("ends", F.lit(2 * i)).alias("from"), F.get("ends", F.lit(2 * i + 1)).alias("to")) for i, (name, p) in enumerate(shares.items())))
    targets = stats.select("g", "n", "low", "high", F.explode(place).alias("t")).select("g", "n", "low", "high", "t.*")
    whole = F.col("n") <= WHOLE
    at = F.least(F.col("p") * F.col("n"), F.col("n") - 1.0) if nearest else F.col("p") * (F.col("n") - 1)
    targets = targets.withColumn("from", F.when(whole, F.col("low")).otherwise(F.col("from"))).withColumn("to", F.when(whole, F.col("high")).otherwise(F.col("to")))
    targets = targets.withColumn("rank", F.floor(at)).withColumn("rest", F.lit(0.0) if nearest else at - F.floor(at))
    targets = targets.withColumn("next", F.when(F.col("rest") > 0, F.col("rank") + 1).otherwise(F.col("rank")))
    targets = materialize(targets, "targets")

    def counted(targets: DataFrame) -> tuple[DataFrame, DataFrame]:
        met = held.join(small(targets.select("g", "name", "from", "to")), "g")
        below = met.where(F.col("v") < F.col("from")).groupBy("g", "name").agg(F.count("*").alias("below"))
        inside = met.where((F.col("v") >= F.col("from")) & (F.col("v") <= F.col("to"))).groupBy("g", "name", "v").agg(F.count("*").alias("c"))
        return below, materialize(inside, "inside")

    below, inside = counted(targets)
    held_by = inside.groupBy("g", "name").agg(F.sum("c").alias("inside"))
    known = materialize(targets.join(below, ["g", "name"], "left").join(held_by, ["g", "name"], "left").fillna(0, ["below", "inside"]), "known")
    missed = known.where((F.col("below") > F.col("rank")) | (F.col("below") + F.col("inside") <= F.col("next")))
    if not missed.isEmpty():
        again = materialize(missed.select("g", "n", "low", "high", "name", "p", F.col("low").alias("from"), F.col("high").alias("to"), "rank", "rest", "next"), "missed")
        _, more = counted(again)
        key = again.select("g", "name")
        inside = inside.join(key, ["g", "name"], "left_anti").unionByName(more)
        known = known.join(key, ["g", "name"], "left_anti").unionByName(again.withColumn("below", F.lit(0).cast("long")).withColumn("inside", F.col("n")))

    placed = running(inside, ["g", "name"], ["v"], F.col("c"), "upto").join(small(known.select("g", "name", "below", "rank", "next", "rest")), ["g", "name"])
    last, first = F.col("below") + F.col("upto"), F.col("below") + F.col("upto") - F.col("c")
    value_at = lambda r: F.max(F.when((first <= F.col(r)) & (F.col(r) < last), F.col("v")))
    found = placed.groupBy("g", "name").agg(value_at("rank").alias("a"), value_at("next").alias("b"), F.first("rest").alias("rest"))
    wide = found.withColumn("x", between(F.col("a"), F.col("b"), F.col("rest"))).groupBy("g").pivot("name", names).agg(F.first("x"))
    return stats.select("g", "n", "low", "high", "mean").join(wide, "g").select(*(F.col(f"g.{b}").alias(b) for b in by), "n", "low", "high", "mean", *names)


def compare(current: DataFrame, baseline: DataFrame, by: str, threshold: float = 20.0, drift: int = 0) -> DataFrame:
    """Each group's ``p50`` and ``p95`` against the baseline's in percent, its count against the baseline's, and ``status``.

    More than ``threshold`` percent slower, or a count that differs by more than ``drift``, fails.
    Any time against a baseline of 0 is infinitely slower; a group of one side alone is ``missing``.
    """
    side = lambda rows, x: rows.select(by, *(F.col(c).alias(f"{x}_{c}") for c in ("n", "p50", "p95")))
    both = side(current, "now").join(side(baseline, "then"), by, "full")
    pct = lambda c: F.when(F.col(f"then_{c}") == 0, F.when(F.col(f"now_{c}") == 0, 0.0).otherwise(float("inf"))).otherwise((F.col(f"now_{c}") - F.col(f"then_{c}")) / F.col(f"then_{c}") * 100)
    counts = F.col("now_n") - F.col("then_n")
    status = F.when(counts.isNull(), "missing").when((pct("p50") > threshold) | (pct("p95") > threshold) | (F.abs(counts) > drift), "fail").otherwise("pass")
    return both.select(by, F.round(pct("p50"), 4).alias("p50_pct"), F.round(pct("p95"), 4).alias("p95_pct"), counts.alias("count_delta"), status.alias("status"))
