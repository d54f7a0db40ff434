"""Interpolation rounded once: before, 0.95 between 150.71 and 152.04 fell below the edge of its third digit."""

import math
import random

from pyspark.sql import functions as F

from corpusmill.operators.quantiles import between, percentiles


def test_equals_a_fused_sum(spark):
    rng = random.Random(4)
    rows = [(150.71, 152.04, 0.75), (1.0, 9.0, 0.0), (1e300, 1e301, 0.5), (0.0, 0.0, 0.5), (-3.3, 7.1, 0.3)]
    rows += [(a, a + round(rng.uniform(0, 20), 2), rng.choice([0.05, 0.25, 0.3, 0.5, 0.95, rng.random()])) for a in (round(rng.uniform(-400, 400), 2) for _ in range(2000))]
    got = spark.createDataFrame(rows, "a double, b double, s double").select("a", "b", "s", between(F.col("a"), F.col("b"), F.col("s")).alias("x")).collect()
    for r in got:
        assert r.x == (math.fma(r.a, 1 - r.s, r.b * r.s) if r.s and r.a < 1e280 else r.a * (1 - r.s) + r.b * r.s)


def test_edge_of_a_digit(spark):
    rows = spark.createDataFrame([(150.71,), (152.04,)], "v double")
    assert percentiles(rows, [], "v", {"p": 0.75}).select(F.round("p", 3)).first()[0] == 151.708
