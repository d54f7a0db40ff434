"""A search within a distance gives what a search of all gives of that distance, and looks at no farther pair."""

import numpy as np
import pytest

from corpusmill.operators import conflicts, retrieval


@pytest.mark.parametrize("within", [0.0, 0.08, 0.4])
def test_within_is_a_part_of_all(spark, within):
    rng = np.random.default_rng(5)
    x = np.repeat(rng.normal(size=(60, 8)), 5, axis=0) + 0.15 * rng.normal(size=(300, 8))
    x[0:5] = x[0]
    rows = [(i, r.tolist()) for i, r in enumerate(x)] + [(300, [0.0] * 8), (301, None), (302, [1.0]), (303, [float("nan")] * 8), (None, x[20].tolist())]
    v = spark.createDataFrame(rows, "chunk_id long, vector array<double>").repartition(3)
    q = v.where("chunk_id % 20 = 0 OR chunk_id > 298").withColumnRenamed("chunk_id", "query_id")
    got = retrieval.knn(q, v, 4, within=within).collect()
    want = retrieval.knn(q, v, 4).where(f"distance <= {within}").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and want


def test_conflicts_at_the_threshold(spark):
    """A similarity of exactly 0.92 is a conflict, and a chunk is none with itself."""
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.92, (1 - 0.92**2) ** 0.5]), (3, [0.91, (1 - 0.91**2) ** 0.5])], "chunk_id long, vector array<double>")
    got = {(r.new_id, r.old_id, r.similarity) for r in conflicts.detect(v.where("chunk_id = 1"), v.where("chunk_id < 4")).collect()}
    assert got == {(1, 2, 0.92)}


def test_far_pairs_are_not_measured(spark):
    """Of 500 rows far from all queries none is a candidate; before, each product gave ``k`` a query."""
    rng = np.random.default_rng(6)
    q, v = np.eye(40)[:20], np.abs(rng.normal(size=(500, 40)))
    v[:, :20] = 0
    r, _, _ = retrieval.close(q, v / np.linalg.norm(v, axis=1, keepdims=True), np.minimum(np.full(20, np.inf), 0.08), 2)
    assert not len(r)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "chunk_id long, vector array<double>")
    asked = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(q)], "query_id long, vector array<double>")
    assert retrieval.knn(asked, rows, 2, within=0.08).count() == 0
