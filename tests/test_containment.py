"""Containment joins against brute force."""

import random
import re

import pytest

from corpusmill.operators import containment
from corpusmill.operators.containment import contains_join


def brute(patterns, texts, whole):
    out = {}
    for i, p in patterns:
        for j, t in texts:
            if i is None or j is None or not p or t is None:
                continue
            p, t = p.lower(), t.lower()
            word = r"[^\W]"
            pattern = re.escape(p)
            if whole:
                pattern = (f"(?<!{word})" if re.match(word, p) else "") + pattern + (f"(?!{word})" if re.match(word, p[-1]) else "")
            hits = [m.start() + 1 for m in re.finditer(pattern, t)]
            if hits:
                at, n = out.get((i, j), (10**9, 0))
                out[i, j] = (min(at, hits[0]), n + len(hits))
    return {(i, j, at, n) for (i, j), (at, n) in out.items()}


@pytest.mark.parametrize("whole", [False, True])
@pytest.mark.parametrize("run", [1, 3])
def test_equals_brute_force(spark, monkeypatch, whole, run):
    monkeypatch.setattr(containment, "RUN", run)
    monkeypatch.setattr(containment, "BLOCK", 3)
    rng = random.Random(run)
    vocabulary = ["alpha", "Be", "ta", "über", "x", "1a", "été", "zz_top"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "-", "\n", ""]) for _ in range(n))
    texts = [(i, text(rng.randint(0, 40))) for i in range(80)] + [(80, None), (None, "alpha Be"), (81, ""), (5, "alpha alpha"), (82, text(3000))]
    patterns = [(i, text(rng.randint(1, 5)).strip("\n") or "x") for i in range(60)]
    patterns += [(100, ""), (101, None), (None, "alpha"), (102, "ph"), (103, ","), (104, "(.*)"), (105, r"\E"), (106, "-"), (107, "alpha"), (107, "ta"), (108, "alpha "), (109, "a a"), (110, "nowhere at all"), (111, texts[3][1])]
    p = spark.createDataFrame([(*r, "clash") for r in patterns], "pattern_id long, pattern string, text string")
    t = spark.createDataFrame([(*r, "clash") for r in texts], "text_id long, text string, needle string").repartition(3)
    got = contains_join(p, t, whole)
    # An id with two patterns has a row for each; brute force adds them up, so it is compared without.
    assert {tuple(r) for r in got.where("pattern_id <> 107").collect()} == brute([x for x in patterns if x[0] != 107], texts, whole)
    assert {(r.text_id) for r in got.where("pattern_id = 107").collect()} == {j for _, j, _, _ in brute([(107, "alpha"), (107, "ta")], texts, whole)}


def test_empty_sides(spark):
    p, t = spark.createDataFrame([(1, "a b c")], "pattern_id long, pattern string"), spark.createDataFrame([(1, "x a b c y")], "text_id long, text string")
    assert contains_join(p.limit(0), t).count() == 0
    assert contains_join(p, t.limit(0)).count() == 0
    assert [tuple(r) for r in contains_join(p, t).collect()] == [(1, 1, 3, 1)]
