"""Quality by attention-based multiple-instance learning.

A text is a bag of passages of ``PASSAGE`` words. Each is encoded by measures of its
characters and words and a learned layer; gated attention weighs the passages, and the
weighted representation gives the score. Only labels of whole texts are needed.

The network is trained on at most ``LABELLED`` labelled texts (a documented bound, chosen by
a hash of the id) with all their passages. A null or empty text is one passage of zeros with
a mark of its own. With no label at all every score is 0.5; with one kind of label only, it
leans to that. Rows are independent; other columns are ignored; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from . import bytetext as B
from .labelled import labelled_sample
from .language_id import held_out
from .quality_rules import _groups, _keyed
from .scratch import map_arrow

LABELLED, PASSAGE, HIDDEN, GATE = 8_000, 128, 16, 8
MEASURES = 15
_SENTENCE = np.array([chr(b) in ".,;:?" for b in range(256)])
_SYMBOL = np.array([chr(b) in "#*$%&<>" for b in range(256)])


def passages(c: B.Chunk, size: int = PASSAGE) -> tuple[np.ndarray, np.ndarray]:
    """Measures of every passage and the row cuts; a row without words has one passage."""
    rows, data = c.hi - c.lo, B.LOWER[c.data]
    words = B.runs(B.NOT_SPACE[data], c.offsets)
    row, counts = words.row, words.counts
    per_row = np.maximum(1, -(-counts // size))
    cut = np.concatenate([[0], np.cumsum(per_row)])
    out = np.zeros((cut[-1], MEASURES), np.float32)
    out[cut[:-1][counts == 0], 0] = 1
    if not len(row):
        return out, cut
    place = np.arange(len(row)) - np.repeat(words.cut[:-1], counts)
    which = cut[row] + place // size
    first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
    last = np.append(first[1:], len(row)) - 1
    own, n = which[first], (last - first + 1).astype(float)
    begin, end = words.start[first], words.end[last]
    length = (end - begin).astype(float)

    def share(flags, by):
        total = np.concatenate([[0], np.cumsum(flags)])
        return (total[end] - total[begin]) / by

    h = B.span_hash(data, words.start, words.end)
    many, earlier = _groups(_keyed(h, which))
    twice = np.zeros(len(row))
    twice[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    lines = B.runs(c.data != 10, c.offsets)
    _, seen = _groups(_keyed(B.span_hash(c.data, lines.start, lines.end), lines.row))
    again = seen[np.searchsorted(lines.start, words.start, "right") - 1]
    each = lambda flags: np.add.reduceat(flags.astype(float), first) / n
    raw = c.data
    measures = [share((raw >= 65) & (raw <= 90), length), share(raw >= 128, length), share((raw >= 48) & (raw <= 57), length), share(_SYMBOL[raw], length), share(raw == 124, n), share(raw == 33, n), share(_SENTENCE[raw], n), share(raw == 10, n), length / n / 10, each(earlier), each(twice), each(again), np.log1p(n) / 5, np.sqrt(share(_SYMBOL[raw], n))]
    out[own, 1:] = np.column_stack(measures)
    return out, cut


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in B.chunks(batch.column(0)):
            x, cut = passages(c)
            yield pa.record_batch([pa.ListArray.from_arrays((cut * MEASURES).astype(np.int32), x.ravel()), batch.column(1).slice(c.lo, c.hi - c.lo)], names=["x", "y"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


class Network:
    """Gated attention over bags; ``cut`` gives each bag's passages (one at least)."""

    def __init__(self, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(MEASURES), np.ones(MEASURES)
        shapes = {"w": (MEASURES, HIDDEN), "b": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": (1,)}
        self.p = {k: rng.normal(0, 0.3, s) if len(s) > 1 or k in "ac" else np.zeros(s) for k, s in shapes.items()}

    def forward(self, x: np.ndarray, cut: np.ndarray) -> dict[str, np.ndarray]:
        p, first = self.p, cut[:-1]
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["w"] + p["b"])
        t, g = np.tanh(h @ p["v"]), _sigmoid(h @ p["u"])
        e = (t * g) @ p["a"]
        size = np.diff(cut)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), size))
        a = e / np.repeat(np.add.reduceat(e, first), size)
        z = np.add.reduceat(a[:, None] * h, first, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "a": a, "z": z, "score": _sigmoid(z @ p["c"] + p["d"])}

    def gradient(self, f: dict[str, np.ndarray], cut: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        p, size = self.p, np.diff(cut)
        off = weight * (f["score"] - y) / weight.sum()
        dz = np.repeat(off, size)[:, None] * p["c"]
        da = (dz * f["h"]).sum(axis=1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, cut[:-1]), size))
        dt, dg = de[:, None] * p["a"] * f["g"] * (1 - f["t"] ** 2), de[:, None] * p["a"] * f["t"] * f["g"] * (1 - f["g"])
        dh = (f["a"][:, None] * dz + dt @ p["v"].T + dg @ p["u"].T) * (1 - f["h"] ** 2)
        return {"w": f["x"].T @ dh, "b": dh.sum(axis=0), "v": f["h"].T @ dt, "u": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "c": f["z"].T @ off, "d": off.sum(keepdims=True)}

    def train(self, x: np.ndarray, cut: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.02, decay: float = 1e-4) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        weight = np.ones(len(y))
        m, s = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for t in range(1, steps + 1):
            g = self.gradient(self.forward(x, cut), cut, y, weight)
            for k in self.p:
                own = g[k] + decay * self.p[k]
                m[k], s[k] = 0.9 * m[k] + 0.1 * own, 0.99 * s[k] + 0.01 * own**2
                self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.99**t)) + 1e-8)


def fit(sample: DataFrame) -> Network | None:
    """A network from ``text, y``; none without labels."""
    got = map_arrow(sample, _encode, "x array<float>, y double").toArrow()
    if not got.num_rows:
        return None
    x = got["x"].combine_chunks()
    cut = np.concatenate([[0], np.cumsum(pc.list_value_length(x).to_numpy() // MEASURES)])
    net = Network()
    net.train(x.flatten().to_numpy().reshape(-1, MEASURES).astype(float), cut, got["y"].to_numpy())
    return net


def _score(batches: Iterator[pa.RecordBatch], given) -> Iterator[pa.RecordBatch]:
    net = given.value
    for batch in batches:
        for c in B.chunks(batch.column(1)):
            rows = c.hi - c.lo
            x, cut = passages(c)
            f = net.forward(x.astype(float), cut) if net else None
            score = f["score"] if net else np.full(rows, 0.5)
            top = np.maximum.reduceat(f["a"], cut[:-1]) if net else np.ones(rows)
            yield pa.record_batch([batch.column(0).slice(c.lo, rows), pa.array(score), pa.array(np.diff(cut)), pa.array(top)], names=["doc_id", "score", "n_passages", "top_attention"])


def score(docs: DataFrame, net: Network | None) -> DataFrame:
    """Every row's ``doc_id, score, n_passages, top_attention`` (the largest weight of a passage)."""
    given = docs.sparkSession.sparkContext.broadcast(net)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(texts, lambda it: _score(it, given), "doc_id long, score double, n_passages long, top_attention double")


def score_documents(docs: DataFrame, labels: DataFrame, mod: int = 4, rest: int = 2, limit: int = LABELLED) -> DataFrame:
    """Every row's ``doc_id, held_out, score, predicted, n_passages, top_attention``."""
    out = score(docs, fit(labelled_sample(docs, labels, "quality", limit, ~held_out(F.col("doc_id"), mod, rest))))
    return out.select("doc_id", held_out(F.col("doc_id"), mod, rest).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "n_passages", "top_attention")
