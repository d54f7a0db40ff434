"""Names in chunks against a plain search, and the merge of base and graph scores."""

import re

import pytest

from corpusmill.operators import graph as G

TEXTS = [
    (1, "Alpha Beta met ALPHA  Beta and alpha beta; Alpha Betas, xAlpha Beta, Alpha Beta_ and Alpha Beta."),
    (2, "Übung Alpha über Alphaé, Éalpha ALPHA-alpha/Alpha \u0001Alpha\u0001 Foo-Bar foo-bar foo\u0001-bar"),
    (3, ""), (4, None), (5, "no names here"), (6, "The Then Who"),
    (7, "Gamma " * 200 + "Delta"), (8, "x" * 496 + " Gamma Delta Gamma"), (1, "Alpha repeats an id"),
]


def plain(size, overlap):
    out = []
    for doc, text in TEXTS:
        blotted = re.sub(r"[A-Za-z0-9_]*[À-ÖØ-öø-ÿ]\w*", "·", text or "")
        shown = {}
        for raw in re.findall(r"\b[A-Z][A-Za-z0-9_/-]{2,}(?:[ \t]+[A-Z][A-Za-z0-9_/-]{2,}){0,3}\b", blotted, re.A):
            split = re.sub("([a-z0-9])([A-Z])", r"\1 \2", raw.strip()).lower()
            name = re.sub(" +", " ", re.sub("[^a-z0-9 ]+", " ", split)).strip()
            if name and name not in G.STOPWORDS:
                shown.setdefault(name, re.sub("[ \t]+", " ", raw))
        at, index = 0, 0
        while text:
            chunk = text[at:at + size]
            for name, display in list(shown.items())[:12]:
                n = len(re.findall(rf"(?<!\w){re.escape(display.lower())}(?!\w)", chunk.lower()))
                if n:
                    out.append((doc, index, name, display, n))
            if at + size >= len(text):
                break
            at, index = at + size - overlap, index + 1
    return sorted(out)


@pytest.mark.parametrize("size, overlap", [(500, 50), (40, 10)])
def test_chunk_mentions_equal_a_plain_search(spark, size, overlap):
    texts = spark.createDataFrame(TEXTS, "doc_id long, text string")
    got = sorted(tuple(r) for r in G.chunk_mentions(texts, size, overlap).collect())
    assert got == plain(size, overlap) and got


def test_chunk_mentions_of_no_texts(spark):
    assert G.chunk_mentions(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_merge_keeps_both_sides(spark):
    base = spark.createDataFrame([(1, 0.9), (2, 0.2), (3, 0.5)], "chunk_id long, base double")
    graph = spark.createDataFrame([(2, 0.6), (3, 0.4), (4, 0.637)], "chunk_id long, score double")
    got = {r["chunk_id"]: r["merged"] for r in G.merge(base, graph).collect()}
    assert got == {1: 0.9, 2: 0.6, 3: 0.5, 4: 0.637}
