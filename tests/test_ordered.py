"""Two-level numbering, sums, batches, digests and percentiles against plain versions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import ordered, quantiles


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = [(rng.choice(["hot"] * 8 + ["a", "b", None]), i, rng.choice([1.5, 2.0, rng.random(), -rng.random() * 1e9, 0.0]), "clash") for i in range(3000)]
    return out + [("one", 9000, 7.0, "x"), ("nulls", 9001, None, "x"), (None, 9002, None, "x")]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "g string, id long, v double, n string").repartition(5)


def groups(rows):
    out = {}
    for g, i, v, _ in rows:
        out.setdefault(g, []).append((i, v))
    return out


def test_numbers_and_sums(df, rows):
    got = ordered.running(df.select("g", "id"), ["g"], ["id"], F.col("id"), "total", "place").collect()
    want = set()
    for g, held in groups(rows).items():
        total = 0
        for k, (i, _) in enumerate(sorted(held)):
            total += i
            want.add((g, i, total, k + 1))
    assert {tuple(r) for r in got} == want and len(got) == len(rows)
    assert sorted(r.k for r in ordered.number(df.select("id"), [], ["id"], "k").collect()) == list(range(1, len(rows) + 1))
    assert ordered.number(df.limit(0), ["g"], ["id"], "k").count() == 0


def test_a_hot_group_is_spread(df):
    tagged = df.withColumn("__g", F.struct("g")).repartitionByRange(4, "__g", "id")
    assert tagged.where("g = 'hot'").select(F.spark_partition_id()).distinct().count() > 1


def test_batches(df, rows):
    got = {}
    for r in ordered.batches(df.select("g", "id"), ["g"], ["id"], 64).collect():
        got.setdefault((r.g, r.batch), []).append(r.id)
    for g, held in groups(rows).items():
        ids = sorted(i for i, _ in held)
        assert [sorted(got[g, b]) for b in range(-(-len(ids) // 64))] == [ids[k : k + 64] for k in range(0, len(ids), 64)]


def test_digests(spark, df, rows):
    got = {r.g: r.fingerprint for r in ordered.sorted_digest(df, ["g"], "id").collect()}
    assert got == {g: hashlib.sha256("\n".join(sorted(str(i) for i, _ in held)).encode()).hexdigest() for g, held in groups(rows).items()}
    assert ordered.sorted_digest(df.limit(0), ["g"], "id").count() == 0
    tree = lambda d: {r.g: (r.n, r.fingerprint) for r in ordered.tree_digest(d, ["g"], "id").collect()}
    whole = tree(df)
    assert whole == tree(df.repartition(2).orderBy(F.desc("id"))) and {g: n for g, (n, _) in whole.items()} == {g: len(h) for g, h in groups(rows).items()}
    swapped = tree(df.withColumn("id", F.when(F.col("id") == 1, 4).when(F.col("id") == 4, 1).otherwise(F.col("id"))))
    moved = tree(df.withColumn("id", F.when(F.col("g") == "one", 9003).otherwise(F.col("id"))))
    same = {r[0] for r in rows if r[1] in (1, 4)}
    assert (swapped == whole) == (len(same) == 1) and moved["one"] != whole["one"] and moved["a"] == whole["a"]


@pytest.mark.parametrize("whole", [100_000, 10])
@pytest.mark.parametrize("nearest", [False, True])
def test_percentiles(df, rows, monkeypatch, whole, nearest):
    monkeypatch.setattr(quantiles, "WHOLE", whole)
    shares = {"p0": 0.0, "p50": 0.5, "p95": 0.95, "p100": 1.0}
    got = {r.g: r for r in quantiles.percentiles(df, ["g"], "v", shares, nearest).collect()}
    want = {g: sorted(v for _, v in held if v is not None) for g, held in groups(rows).items()}
    assert set(got) == {g for g, v in want.items() if v}
    for g, r in got.items():
        v = want[g]
        for name, p in shares.items():
            exact = v[min(int(len(v) * p), len(v) - 1)] if nearest else float(np.percentile(v, p * 100))
            assert r[name] == pytest.approx(exact, rel=1e-12, abs=1e-12), (g, name)
        assert (r.n, r.low, r.high) == (len(v), v[0], v[-1])


def test_brackets_hold_and_are_widened(spark, monkeypatch):
    """With a coarse sketch brackets are wide, with one that breaks its promise they are widened."""
    rng = random.Random(12)
    values = [rng.gauss(0, 1) for _ in range(5000)] + [0.25] * 3000
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(4)
    monkeypatch.setattr(quantiles, "WHOLE", 10)
    monkeypatch.setattr(quantiles, "ACCURACY", 50)
    exact = {f"p{p}": float(np.percentile(values, p)) for p in (10, 50, 99)}
    find = lambda: quantiles.percentiles(df, [], "v", {f"p{p}": p / 100 for p in (10, 50, 99)}).first().asDict()
    assert {k: find()[k] for k in exact} == pytest.approx(exact)
    real = F.percentile_approx
    monkeypatch.setattr(quantiles.F, "percentile_approx", lambda c, p, a: F.transform(real(c, p, a), lambda x: x + 0.9))
    assert {k: find()[k] for k in exact} == pytest.approx(exact)


def test_compare(spark):
    s = "mode string, n long, p50 double, p95 double"
    now = spark.createDataFrame([("a", 10, 120.0, 100.0), ("b", 10, 121.0, 100.0), ("c", 9, 1.0, 1.0), ("d", 5, 1.0, 1.0), ("z", 1, 5.0, 5.0)], s)
    then = spark.createDataFrame([("a", 10, 100.0, 100.0), ("b", 10, 100.0, 100.0), ("c", 10, 1.0, 1.0), ("e", 5, 1.0, 1.0), ("z", 1, 0.0, 0.0)], s)
    got = {r.mode: r.status for r in quantiles.compare(now, then, "mode").collect()}
    assert got == {"a": "pass", "b": "fail", "c": "fail", "d": "missing", "e": "missing", "z": "fail"}
