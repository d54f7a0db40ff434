"""The cache's matrix of entries against its list of them."""

import random

import numpy as np

from corpusmill.operators.answer_cache import Cache


def test_matrix_equals_list():
    rng = np.random.default_rng(2)
    known = [v.tolist() for v in rng.normal(size=(30, 8))] + [[0.0] * 8]
    for odd in ([], [[1.0, 2.0], [float("nan")] * 8, []]):
        one, two, pick = Cache(0.9, 50, 6), Cache(0.9, 50, 6), random.Random(5)
        two._even = False
        for i in range(3000):
            vector = None if pick.random() < 0.02 else pick.choice([*known, *odd])
            kind = "invalidate" if pick.random() < 0.01 else "ask"
            if not two.ids:
                two._even = False
            assert one.take(i, float(i), kind, vector) == two.take(i, float(i), kind, vector)
        assert one.entries()[:0] == [] and one.ids == two.ids
        assert odd or one._even
