"""The inverted file against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import ann, retrieval


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(12, 16)) * 3
    x = centers[rng.integers(0, 12, 1500)] + rng.normal(size=(1500, 16))
    return np.concatenate([x, np.repeat(x[:1], 700, axis=0)])  # one vector of a third of all rows


@pytest.fixture(scope="module")
def vectors(spark, data):
    rows = [(i, v.tolist(), "clash") for i, v in enumerate(data)]
    rows += [(9000, None, ""), (None, data[0].tolist(), ""), (9001, [1.0], ""), (9002, [0.0] * 16, ""), (9003, [float("nan")] * 16, "")]
    return spark.createDataFrame(rows, "chunk_id long, vector array<double>, list string").repartition(4)


def brute(data, ids, k):
    x = np.concatenate([data, np.zeros((1, 16))])
    names = np.array([*range(len(data)), 9002])
    n = np.linalg.norm(x, axis=1, keepdims=True)
    u = x / np.where(n == 0, 1, n)
    out = {}
    for i in ids:
        d = np.round(1 - np.clip(u @ u[i], -1, 1), 6)
        top = np.lexsort((names, d))[:k]
        out[i] = list(zip(names[top].tolist(), d[top].tolist()))
    return out


def test_recall_and_distances(vectors, data):
    fitted = ann.fit(vectors, 5)
    assert 1 <= fitted.probes < len(fitted.centroids)
    index = ann.build(vectors, fitted)
    assert {r.chunk_id for r in index.select("chunk_id").collect()} == {*range(len(data)), 9002}
    q = vectors.where("chunk_id % 20 = 0 AND chunk_id < 9000").withColumnRenamed("chunk_id", "query_id")
    got = ann.search(q, index, fitted, 5).collect()
    want = brute(data, range(0, len(data), 20), 5)
    hit = sum(r.chunk_id in dict(want[r.query_id]) for r in got)
    assert hit / (5 * len(want)) >= 0.95
    u = data / np.linalg.norm(data, axis=1, keepdims=True)
    for r in got:
        if r.chunk_id != 9002:
            assert r.distance == pytest.approx(1 - u[r.query_id] @ u[r.chunk_id], abs=1e-5)
    exact = ann.search(q, index, fitted, 5, probes=len(fitted.centroids))
    assert {(r.query_id, r.chunk_id, r.distance) for r in exact.collect()} == {(i, *c) for i, found in want.items() for c in found}
    told = ann.recall(ann.search(q, index, fitted, 5), retrieval.knn(q, vectors.where("size(vector) = 16 AND chunk_id <> 9003"), 5)).first()
    assert told.queries == len(want) and told.recall >= 0.9


def test_blocks_and_odd_queries(spark, vectors, monkeypatch):
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    fitted = ann.fit(vectors, 5, lists=6)
    index = ann.build(vectors, fitted)
    q = spark.createDataFrame([(i, [float(i), 1.0] * 8) for i in range(30)] + [(100, [0.0] * 16), (101, None), (None, [1.0] * 16), (102, [1.0])], "query_id long, vector array<double>")
    got = ann.search(q, index, fitted, 3, probes=6)
    assert sorted(r.query_id for r in got.where("rank = 1").collect()) == [*range(30), 100]
    assert [(r.chunk_id, r.distance) for r in got.where("query_id = 100").orderBy("rank").collect()] == [(0, 1.0), (1, 1.0), (2, 1.0)]
    assert ann.search(q.limit(0), index, fitted, 3).count() == 0
    none = ann.fit(vectors.limit(0), 5)
    assert ann.search(q, ann.build(vectors.limit(0), none), none, 3).count() == 0


def test_upsert_and_delete(spark, vectors):
    fitted = ann.fit(vectors, 5, lists=8)
    index = ann.build(vectors, fitted)
    new = spark.createDataFrame([(3, [9.0] + [0.0] * 15), (7777, [8.0] + [0.1] * 15)], "chunk_id long, vector array<double>")
    more = ann.upsert(index, new, fitted)
    assert more.count() == index.count() + 1
    q = new.select(F.col("chunk_id").alias("query_id"), "vector")
    assert {(r.query_id, r.chunk_id) for r in ann.search(q, more, fitted, 1).collect()} == {(3, 3), (7777, 7777)}
    assert ann.delete(more, new).where("chunk_id IN (3, 7777)").count() == 0
