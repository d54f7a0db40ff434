"""Every pair of a label, not those of every twentieth row alone, and no side of them through the driver."""

import numpy as np
import pytest

from corpusmill.operators import retrieval
from corpusmill.plans import base


def test_every_row_is_paired(spark):
    sf = "/root/testdata/sf0.001"
    sizes = [r[1] for r in spark.read.parquet(f"{sf}/embeddings.parquet").groupBy("label").count().collect()]
    got = base.cosine_pairs(spark, sf)
    assert got.count() == sum(n * (n - 1) // 2 for n in sizes) == got.select("a", "b").distinct().count()
    assert got.where("a % 20 <> 0").count() and "%" not in base.SQL["cosine_pairs"]


@pytest.mark.parametrize("share", [7, 30, 1_000])
def test_ranges_of_ids_lose_and_repeat_no_pair(spark, monkeypatch, share):
    monkeypatch.setattr(retrieval, "SHARE", share)
    monkeypatch.setattr(retrieval, "PACK", 4)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 4))
    ids = rng.permutation(120) * 10**14
    label = [0 if i < 80 else i % 3 for i in range(120)]
    more = [(0, 5, [1.0, 2.0]), (None, 6, [1.0] * 4), (0, None, [1.0] * 4), (0, 7, None)]
    rows = spark.createDataFrame([(label[i], int(ids[i]), v.tolist()) for i, v in enumerate(x)] + more, "label int, id long, vector array<double>")
    out = retrieval.pair_distances(rows, rows, "label")
    got = [(r.a, r.b, r.distance) for r in out.collect()]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(int(ids[i]), int(ids[j])): 1 - float(u[i] @ u[j]) for i in range(120) for j in range(120) if ids[i] < ids[j] and label[i] == label[j]}
    none = {(min(a, b), max(a, b)) for a in (5, 7) for b in [5, 7, *(int(ids[i]) for i in range(120) if label[i] == 0)] if a != b}
    assert len(got) == len(want) + len(none) and {(a, b) for a, b, _ in got} == want.keys() | none
    assert all(d is None if (a, b) in none else abs(d - want[a, b]) < 1.5e-6 for a, b, d in got)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
