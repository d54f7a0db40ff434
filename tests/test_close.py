"""Candidates of single precision lose no neighbour of double precision, however near the last places are."""

import numpy as np
import pytest

from corpusmill.operators import ann, retrieval


@pytest.mark.parametrize(("spread", "size"), [(1.0, 64), (1e-3, 64), (1e-7, 900), (0.0, 3)])
def test_close_loses_none(spread, size):
    rng = np.random.default_rng(11)
    x = rng.normal(size=size) + spread * rng.normal(size=(700, size))
    x[50] = 0
    u = x / np.where((n := np.linalg.norm(x, axis=1, keepdims=True)) == 0, 1, n)
    q, k = u[::20], 7
    best, who = np.full((len(q), k), np.inf), np.full((len(q), k), retrieval.LAST)
    for at in range(0, len(u), 128):
        retrieval.keep_best((best, who), np.arange(at, min(at + 128, len(u))), *retrieval.close(q, u[at : at + 128], best[:, -1], k))
    d = np.round(1 - np.clip(q @ u.T, -1, 1), 6)
    order = np.lexsort((np.broadcast_to(np.arange(len(u)), d.shape), d), axis=1)[:, :k]
    assert np.allclose(best, np.take_along_axis(d, order, axis=1), atol=1.1e-6, rtol=0)
    if spread in (0.0, 1.0):
        assert (who == order).all()


def test_inverted_file_gives_a_task_s_best(spark):
    """Each task gave its k best of every batch and list; now of all its rows, so that k rows a query and task are shuffled."""
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rng.normal(size=(400, 8)))], "chunk_id long, vector array<double>")
    fitted = ann.fit(v, 3, lists=10)
    index = ann.build(v, fitted).coalesce(1)
    q = v.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    got = ann.search(q, index, fitted, 3, probes=10)
    want = retrieval.knn(q, v, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_index_is_not_read_for_each_thousand_queries(spark):
    v = spark.range(2_500).selectExpr("id AS chunk_id", "array(cos(double(id)), sin(double(id))) AS vector")
    fitted = ann.fit(v, 2, lists=4)
    index = ann.build(v, fitted)
    plans = [ann.search(v.where(f"chunk_id < {n}").withColumnRenamed("chunk_id", "query_id"), index, fitted, 2)._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") for n in (900, 2_500)]
    assert plans[0] == plans[1]
