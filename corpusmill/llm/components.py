"""Connected components of a link table by alternating large-star and small-star joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import materialize


def components(links: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``(node, component)`` for every node of ``links``; the component is its smallest node.

    Null ends and loops are ignored; repeated links do no harm. Each round is two joins on
    a node, with sums before each shuffle; rounds grow with the logarithm of a group's size.
    They end once every node above its component's smallest has one link, to that smallest.
    """
    pair = links.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u <> v")
    pair = materialize(pair.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    while True:
        pair = materialize(_small_star(_large_star(pair)), "star")
        if _is_star(pair):
            break
    star = pair.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return star.unionByName(star.select(F.col("component").alias("node"), "component").distinct())


def _is_star(pair: DataFrame) -> bool:
    """No upper node has two links or is a lower node of another link."""
    ends = pair.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(pair.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").isEmpty()


def _large_star(pair: DataFrame) -> DataFrame:
    both = pair.unionByName(pair.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(pair: DataFrame) -> DataFrame:
    """``pair`` has u > v."""
    least = pair.groupBy("u").agg(F.min("v").alias("m"))
    joined = pair.join(least.withColumnRenamed("u", "w"), F.col("u") == F.col("w"))
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
