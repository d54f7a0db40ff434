"""Every search mode against a plain version of it."""

import math
import random
import re
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from corpusmill.operators import modes

NAMES = ["alpha", "beta gamma", "delta", "omega one two", "kappa"]


@pytest.fixture(scope="module")
def data():
    rng = random.Random(21)
    words = ["red", "blue", "fast", "slow", "tree", *NAMES]
    chunks = [(i, " ".join(rng.choices(words, k=rng.randint(3, 12))), [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)]
    queries = [(100 + k, " ".join(rng.choices(words, k=4)), [rng.gauss(0, 1) for _ in range(4)]) for k in range(6)] + [(200, "nothing known", [1.0, 0.0, 0.0, 0.0])]
    mentions = [(i, i // 2, n, t.count(n)) for i, t, _ in chunks for n in NAMES if n in t] + [(900, 450, "alpha", 1)]
    return chunks, queries, mentions


def tokens(text):
    return re.findall(r"\w+", text.lower())


def plain_graph(query, mentions, limit):
    names = sorted({m[2] for m in mentions})
    said, compact = query.lower(), re.sub("[^a-z0-9]+", "", query.lower())
    terms = lambda t: set(re.findall(r"[a-z0-9_/-]{3,}", t))
    matched = {}
    for n in names:
        parts = n.split(" ")
        aliases = {n, "".join(parts)} | ({"".join(p[0] for p in parts)} if len(parts) >= 3 else set())
        shared = len(terms(n) & terms(said))
        if any(a in said or a in compact for a in aliases):
            matched[n] = 1.0
        elif shared:
            matched[n] = min(0.95, 0.55 + shared * 0.15)
    matched = dict(sorted(matched.items(), key=lambda x: (-x[1], x[0]))[:8])
    by_chunk = {}
    for c, _, n, _ in mentions:
        by_chunk.setdefault(c, set()).add(n)
    evidence = {}
    for c in sorted(by_chunk):
        for a, b in combinations(sorted(by_chunk[c]), 2):
            evidence.setdefault((a, b), []).append(c)
    scores, expanded = Counter(), set()
    for (a, b), held in evidence.items():
        ends = [matched[x] for x in (a, b) if x in matched]
        if ends:
            expanded |= {a, b}
            s = round(min(1.0, (0.72 + 0.18 * max(ends)) * 0.65 + (0.25 if len(ends) == 2 else 0.08)), 6)
            for c in held[:4]:
                scores[c] = max(scores[c], s)
    for c, _, n, _ in mentions:
        if n in matched:
            scores[c] = max(scores[c], (0.82 + 0.16 * matched[n]) * 0.55)
        elif n in expanded:
            scores[c] = max(scores[c], 0.68 * 0.55)
    return dict(sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:limit])


def plain_search(chunks, query, mode, mentions, top_k=5, candidates=10):
    _, said, q = query
    text = {i: t for i, t, _ in chunks}
    cos = lambda v: float(np.dot(q, v) / (np.linalg.norm(q) * np.linalg.norm(v)))
    near = sorted((round(1 - cos(v), 6), i) for i, _, v in chunks)[: candidates if mode != "dense" else top_k]
    found = {i: round(1 - d, 6) for d, i in near}
    if "graph" in mode:
        for c, g in plain_graph(said, mentions, candidates).items():
            if c in text:
                found[c] = round(max(found[c], 0.65 * found[c] + 0.35 * g, g), 6) if c in found else round(g, 6)
    order = sorted(found, key=lambda c: (-found[c], c))
    score = found
    if "hybrid" in mode:
        held = {c: tokens(text[c]) for c in order}
        mean = sum(map(len, held.values())) / len(held)
        lexical = {}
        for c in order:
            total = 0.0
            for t in set(tokens(said)):
                df, rel = sum(t in h for h in held.values()), held[c].count(t) / len(held[c])
                total += math.log((len(held) - df + 0.5) / (df + 0.5) + 1) * rel * 2.2 / (rel + 1.2 * (0.25 + 0.75 * len(held[c]) / mean)) if rel else 0
            lexical[c] = total
        low, high = min(found.values()), max(found.values())
        score = {c: 0.7 * (found[c] - low) / ((high - low) or 1.0) + 0.3 * min(lexical[c], 1.0) for c in order}
        order = sorted(order, key=lambda c: (-score[c], -found[c], c))
    if "rerank" in mode:
        asked = set(tokens(said))
        score = {c: round(len(asked & set(tokens(text[c]))) / len(asked), 6) for c in order}
        order = sorted(order, key=lambda c: -score[c])
    return [(c, round(score[c], 6)) for c in order[:top_k]]


@pytest.mark.parametrize("mode", modes.MODES)
def test_mode_equals_plain_search(spark, data, mode):
    chunks, queries, mentions = data
    c = spark.createDataFrame([(*r, "clash") for r in chunks], "chunk_id long, text string, vector array<double>, score string")
    q = spark.createDataFrame(queries, "query_id long, query string, vector array<double>")
    m = spark.createDataFrame(mentions, "chunk_id long, document_id long, name string, mentions long")
    got = {}
    for r in modes.search(q, c, mode, m, candidate_k=10).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.chunk_id, round(r.score, 6)))
    for query in queries:
        want = plain_search(chunks, query, mode, mentions)
        assert [x[1] for x in got[query[0]]] == pytest.approx([x[1] for x in want], abs=2e-6)
        assert [x[0] for x in got[query[0]]] == [x[0] for x in want]


def test_modes_are_known(spark, data):
    q = spark.createDataFrame(data[1], "query_id long, query string, vector array<double>")
    with pytest.raises(ValueError, match="mode"):
        modes.search(q, q, "magic")
    with pytest.raises(ValueError, match="mentions"):
        modes.search(q, q, "graph")
