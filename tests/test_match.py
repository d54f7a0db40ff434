"""Names in queries: the bounded scan and what it leaves open, against every name with every query."""

import random
import re

import pytest

from corpusmill.operators import graph


def plain(queries, names, top=8):
    terms = lambda t: set(re.findall("[a-z0-9_/-]{3,}", t))
    out = set()
    for i, text in queries:
        said = (text or "").lower()
        compact, scores = re.sub("[^a-z0-9]+", "", said), {}
        for n in names:
            parts = n.split(" ")
            aliases = {n, "".join(parts)} | ({"".join(p[0] for p in parts)} if len(parts) > 2 else set())
            if any(a in said or a in compact for a in aliases):
                scores[n] = 1.0
            elif shared := len(terms(n) & terms(said)):
                scores[n] = min(0.95, round(0.55 + 0.15 * shared, 6))
        out |= {(i, n, s) for n, s in sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:top]}
    return out


@pytest.mark.parametrize("head", [0, 5, 40, 20_000])
def test_equals_every_name_with_every_query(spark, head):
    rng = random.Random(8)
    words = ["alpha", "beta", "gam", "delta", "epsilonic", "zeta", "of", "x1", "omega", "internationale", "internationalisation"]
    names = sorted({" ".join(rng.sample(words, rng.choice([1, 2, 2, 3, 4]))) for _ in range(400)})
    queries = [(i, " ".join(rng.choices([*words, "tiny", "A-B", "Zeta_Of"], k=rng.randint(0, 7)))) for i in range(60)] + [(100, None), (101, ""), (102, "日本"), (103, "abgd")]
    q = spark.createDataFrame(queries, "query_id long, query string")
    n = spark.createDataFrame([(x,) for x in names], "name string")
    got = {(r.query_id, r.name, r.score) for r in graph.match(q, n, head=head).collect()}
    assert got == plain(queries, names)


def test_no_query_meets_every_name(spark):
    """Before, all names were crossed with all queries."""
    q = spark.createDataFrame([(1, "alpha beta")], "query_id long, query string")
    n = spark.createDataFrame([("alpha beta",), ("beta gamma",)], "name string")
    plan = graph.match(q, n, head=1)._jdf.queryExecution().toString()
    assert "Join Cross" not in plan and "NestedLoop" not in plan
