"""Nested values against plain walks."""

import json
import random

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import nested


def value(rng, depth=0):
    kind = rng.random()
    if depth < 4 and kind < 0.35:
        return {rng.choice(["a", "b", "my_TOKEN", "note", "dsn2", "é"]): value(rng, depth + 1) for _ in range(rng.randint(0, 4))}
    if depth < 4 and kind < 0.55:
        return [value(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    return rng.choice(["x", "Bearer abc", "-----BEGIN RSA", 1, 2.5, None, True, "é\n\"q\""])


def plain_sanitize(v, keep, most, path="", depth=0):
    """The sanitized value, paths of hidden members, number of degraded ones; by parts put together from below."""
    hidden, degraded, parts = [], 0, []
    items = list(v.items()) if isinstance(v, dict) else [(None, x) for x in v]
    for i, (k, x) in enumerate(items):
        here = f"{path}[{i}]" if k is None else f"{path}.{k}" if path else k
        bad = k is not None and any(p in k.lower() for p in ("api_key", "access_key", "secret", "session_token", "token", "password", "private_key", "credential", "dsn", "service_account"))
        bad = bad or isinstance(x, str) and ("bearer " in x.lower() or "-----begin" in x.lower())
        if bad:
            hidden.append(here)
            if keep:
                parts.append((k, "[REDACTED]"))
        elif isinstance(x, (dict, list)) and depth + 1 >= most:
            degraded += 1
            if keep:
                hidden.append(here)
                parts.append((k, "[DEGRADED: depth limit exceeded]"))
        elif isinstance(x, (dict, list)):
            y, h, d = plain_sanitize(x, keep, most, here, depth + 1)
            hidden, degraded = hidden + h, degraded + d
            parts.append((k, y))
        else:
            parts.append((k, x))
    return (dict(parts) if isinstance(v, dict) else [p for _, p in parts]), hidden, degraded


def nodes(v, path=""):
    yield path, v
    for k, x in v.items() if isinstance(v, dict) else enumerate(v) if isinstance(v, list) else ():
        yield from nodes(x, f"{path}[{k}]" if isinstance(v, list) else f"{path}.{k}" if path else k)


@pytest.fixture(scope="module")
def values():
    rng = random.Random(8)
    return [{"top": value(rng), "b": value(rng)} for _ in range(150)]


@pytest.mark.parametrize("remove", [False, True])
@pytest.mark.parametrize("most", [1, 2, 100])
def test_sanitize_equals_plain_walk(spark, values, remove, most):
    rows = [(i, json.dumps(v), "clash") for i, v in enumerate(values)] + [(900, None, ""), (901, "{broken", ""), (902, "[" * 200_000 + "]" * 200_000, ""), (903, '"text"', ""), (904, "7", "")]
    got = {r.id: r for r in nested.sanitize(spark.createDataFrame(rows, "id long, doc string, status string"), "id", "doc", remove, most).collect()}
    for i, v in enumerate(values):
        want, paths, degraded = plain_sanitize(v, not remove, most)
        assert json.loads(got[i].sanitized) == want and list(json.loads(got[i].sanitized)) == list(want)
        assert got[i].paths == paths and got[i].degraded == degraded and got[i].status == "ok"
        assert got[i].hidden == len(paths) - (0 if remove else degraded)
    assert (got[900].sanitized, got[900].status) == (None, "ok") and got[901].status == got[902].status == "invalid"
    assert got[903].sanitized == '"text"' and got[904].sanitized == "7"


def test_changed_paths_equal_a_walk_over_nodes(spark, values):
    pairs = list(zip(values, values[1:])) + [(v, json.loads(json.dumps(v))) for v in values[:20]] + [({"a": None}, {}), ({"a": [1]}, {"a": {"0": 1}}), ({"a": 1}, {"a": 1.0}), ({"a": True}, {"a": 1})]
    rows = [(i, json.dumps(a), json.dumps(b)) for i, (a, b) in enumerate(pairs)] + [(999, "{", "{}")]
    got = {r.id: r for r in nested.changed_paths(spark.createDataFrame(rows, "id long, old string, new string"), "id", "old", "new").collect()}
    for i, (a, b) in enumerate(pairs):
        left, right = dict(nodes(a)), dict(nodes(b))
        goes_on = lambda p: isinstance(left.get(p), dict) and isinstance(right.get(p), dict) or isinstance(left.get(p), list) and isinstance(right.get(p), list) and len(left[p]) == len(right[p])
        differ = {p for p in left.keys() | right.keys() if p and not goes_on(p) and repr(left.get(p)) != repr(right.get(p)) and not (left.get(p) == right.get(p) and {type(left.get(p)), type(right.get(p))} == {int, float})}
        inner = {p for p in differ if any(p != q and p.startswith(q) and p[len(q)] in ".[" for q in left.keys() | right.keys() if q and not goes_on(q))}
        assert got[i].changed == sorted(differ - inner), (a, b)
    assert got[999].status == "invalid"


def test_leaves_equal_plain_nodes(spark, values):
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(900, None), (901, "{"), (902, "3"), (903, "[]")]
    df = spark.createDataFrame(rows, "id long, doc string")
    got = {(r.id, r.path): json.loads(r.value) for r in nested.leaves(df, "id", "doc").collect()}
    want = {(i, p): x for i, v in enumerate(values) for p, x in nodes(v) if not (isinstance(x, (dict, list)) and x)} | {(902, ""): 3, (903, ""): []}
    assert got == want
    shallow = {(r.id, r.path): json.loads(r.value) for r in nested.leaves(df.where("id < 20"), "id", "doc", 1).collect()}
    assert shallow == {(i, k): x for i, v in enumerate(values[:20]) for k, x in v.items()}


def test_members_of_lists(spark):
    rows = [(1, '{"claims":[{"claim":"a","n":1},{"claim":2},7]}'), (2, '{"claims":{}}'), (3, "{"), (4, None), (5, '{"claims":[]}')]
    got = nested.members(spark.createDataFrame(rows, "id long, doc string"), "id", "doc", "claims", {"claim": "string", "n": "long"})
    assert sorted(map(tuple, got.collect())) == [(1, 0, "a", 1), (1, 1, "2", None), (1, 2, None, None)]
    assert got.where(F.col("id") > 1).count() == 0
