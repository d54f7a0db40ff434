"""Toxicity by weak supervision.

Voters are the entries of an induced lexicon, words and beginnings of words (each votes
toxic where it occurs), and patterns (several listed entries, their density, none at all,
shouting, runs of marks). A generative label model, fitted by EM on the votes of a sample,
estimates each voter's accuracy, the class balance and the correlations of voters, all from
its own posteriors: voters that agree more than the classes explain vote as one. Gold
labels induce the lexicon and start the first round; no round after it sees them. The
posteriors are the labels of a linear classifier over words and beginnings of words, which
scores every text.

At most ``LABELLED`` labelled texts induce the lexicon and give the votes (a documented
bound, chosen by a hash of the id). A null or empty text has no words and gets the score of
the bias. With no toxic label at all nothing is voted and every score is near 0. Rows are
independent; other columns are ignored; an empty table gives an empty result.
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
from .scratch import map_arrow

LABELLED = 8_000
#: Listed words at most, least texts of one, words of the linear classifier.
LISTED, LEAST_TEXTS, FEATURES = 80, 4, 600
#: Bytes of a word's beginning that is a key of its own, so that one stem with many endings is seen.
BEGINNINGS = (4, 5, 6)
#: Conditional correlation from which two voters vote as one.
CORRELATED = 0.35
_LETTERS = np.array([b >= 0x80 or 97 <= b <= 122 for b in range(256)])


def _keys(c: B.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of all words and of their beginnings of 4, 5 and 6 bytes."""
    data = B.LOWER[c.data]
    words = B.runs(_LETTERS[data], c.offsets)
    start, end, row = words.start, words.end, words.row
    found = [(row, B.span_hash(data, start, end))]
    for k in BEGINNINGS:
        long = end - start > k
        found.append((row[long], B.span_hash(data, start[long], start[long] + k) ^ np.uint64(k)))
    return np.concatenate([r for r, _ in found]), np.concatenate([h for _, h in found])


def _distinct(c: B.Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of ``_keys`` once each, by row."""
    row, h = _keys(c)
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return row[new], h[new]


def _marks(c: B.Chunk) -> np.ndarray:
    """By row: share of upper-case letters among ASCII letters, and ``!`` for each 100 bytes."""
    rows = c.hi - c.lo
    at = np.repeat(np.arange(rows), np.diff(c.offsets))
    tally = lambda flags: np.bincount(at[flags], minlength=rows)
    upper, lower = tally((c.data >= 65) & (c.data <= 90)), tally((c.data >= 97) & (c.data <= 122))
    return np.column_stack([upper / np.maximum(1, upper + lower), 100 * tally(c.data == 33) / np.maximum(1, np.diff(c.offsets))])


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for c in B.chunks(batch.column(0)):
            row, h = _distinct(c)
            cut = np.searchsorted(row, np.arange(c.hi - c.lo + 1)).astype(np.int32)
            marks = _marks(c)
            yield pa.record_batch([pa.ListArray.from_arrays(cut, h.view(np.int64)), pa.array(marks[:, 0]), pa.array(marks[:, 1]), batch.column(1).slice(c.lo, c.hi - c.lo)], names=["words", "upper", "bangs", "y"])


def votes(row: np.ndarray, h: np.ndarray, marks: np.ndarray, lexicon: np.ndarray) -> np.ndarray:
    """Votes by row and voter: 1 toxic, -1 clean, 0 abstains. One voter a listed word, then five patterns."""
    n, k = len(marks), len(lexicon)
    out = np.zeros((n, k + 5), np.int8)
    if k and len(h):
        i = np.minimum(np.searchsorted(lexicon, h), k - 1)
        hit = lexicon[i] == h
        out[row[hit], i[hit]] = 1
    listed, size = out[:, :k].sum(axis=1, dtype=np.int64), np.bincount(row, minlength=n)
    out[:, k] = listed >= 2
    out[:, k + 1] = 100 * listed >= np.maximum(1, size)
    out[:, k + 2] = np.where(listed == 0, -1, 0)
    out[:, k + 3] = np.where(marks[:, 0] > 0.6, 1, 0)
    out[:, k + 4] = np.where(marks[:, 1] > 3, 1, 0)
    return out


def label_model(v: np.ndarray, start: np.ndarray, rounds: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posteriors of the votes' rows, each voter's accuracy (chance that a cast vote is right) and its block of correlated voters.

    A block says toxic, clean or nothing (the sign of its members' votes) with odds of its own
    in either class; EM fits these and the class balance from the posteriors ``start``. A
    voter's own vote would explain its correlations away once posteriors follow it, so each
    round estimates them with the mean of all posteriors so far. Rounds are few: on small
    samples with one rare class, likelihood goes on rising as that class fades away.
    """
    post = mean = start.astype(float)
    block = np.arange(v.shape[1])
    for r in range(rounds):
        block = _blocks(v, mean)
        said = np.sign(v.astype(int) @ (block[:, None] == np.unique(block)))
        each = [(said == x).astype(float) for x in (-1, 0, 1)]
        # One case more in either class, spread as in all rows, so that an outcome never seen tells nothing.
        odds = [np.log(x.T @ post + (every := x.mean(axis=0) + 1e-9)) - np.log(x.T @ (1 - post) + every) - np.log((post.sum() + 1) / ((1 - post).sum() + 1)) for x in each]
        prior = float(np.clip(post.mean() if len(v) else 0.1, 0.005, 0.5))
        z = np.log(prior / (1 - prior)) + sum(x @ o for x, o in zip(each, odds, strict=True))
        post = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        mean = mean + (post - mean) / (r + 2)
    accuracy = ((v == 1).T @ post + (v == -1).T @ (1 - post) + 1) / ((v != 0).sum(axis=0) + 2)
    return post, accuracy, block


def _blocks(v: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Each voter's block, named by its first: voters linked by correlation given the class."""
    given = v.astype(float)
    linked = np.eye(v.shape[1], dtype=bool)
    for w in (post, 1 - post):
        total = w.sum()
        if total < 20:
            continue
        x = given - (w @ given) / total
        cov = (x * w[:, None]).T @ x / total
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        linked |= (np.outer(sd, sd) > 1e-4) & (np.abs(cov) > CORRELATED * np.outer(sd, sd))
    for _ in range(len(linked).bit_length()):
        linked = (linked.astype(int) @ linked.astype(int)) > 0
    return linked.argmax(axis=1)


def _logistic(x: np.ndarray, y: np.ndarray, steps: int = 300, rate: float = 0.2, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    w, b = np.zeros(x.shape[1]), float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    m, s = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for t in range(1, steps + 1):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        g = np.append(x.T @ (p - y) / len(y) + decay * w, (p - y).mean())
        m, s = 0.9 * m + 0.1 * g, 0.99 * s + 0.01 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(s / (1 - 0.99**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def fit(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Sorted hashes of the classifier's words, their weights and the bias, from ``text, y``."""
    got = map_arrow(sample, _encode, "words array<long>, upper double, bangs double, y double").toArrow()
    n = got.num_rows
    none = (np.zeros(0, np.uint64), np.zeros(0), -6.0)
    y, marks = got["y"].to_numpy(), np.column_stack([got["upper"].to_numpy(), got["bangs"].to_numpy()])
    if not n or not y.max():
        return none
    words = got["words"].combine_chunks()
    row, h = np.repeat(np.arange(n), pc.list_value_length(words).to_numpy()), words.flatten().to_numpy().view(np.uint64)
    own, place = np.unique(h, return_inverse=True)
    toxic, every = np.bincount(place, weights=y[row], minlength=len(own)), np.bincount(place, minlength=len(own))
    odds = np.log((toxic + 0.5) / (y.sum() + 1)) - np.log((every - toxic + 0.5) / (n - y.sum() + 1))
    able = np.flatnonzero((every >= LEAST_TEXTS) & (odds > 3))
    lexicon = np.sort(own[able[np.argsort(-(odds * np.sqrt(toxic))[able], kind="stable")[:LISTED]]])
    post, _, _ = label_model(votes(row, h, marks, lexicon), y)
    # The words that tell the posteriors apart best.
    mass = np.bincount(place, weights=post[row], minlength=len(own))
    spread = np.abs(mass - every * post.mean()) / np.sqrt(every + 5)
    chosen = np.flatnonzero(every >= LEAST_TEXTS)
    chosen = np.sort(chosen[np.argsort(-spread[chosen], kind="stable")[:FEATURES]])
    at = np.full(len(own), -1)
    at[chosen] = np.arange(len(chosen))
    x = np.zeros((n, len(chosen)), np.float32)
    hit = at[place] >= 0
    x[row[hit], at[place][hit]] = 1
    w, b = _logistic(x, post)
    return own[chosen], w, b


def _score(batches: Iterator[pa.RecordBatch], given) -> Iterator[pa.RecordBatch]:
    keys, weight, bias = given.value
    for batch in batches:
        for c in B.chunks(batch.column(1)):
            rows = c.hi - c.lo
            z = np.full(rows, bias)
            if len(keys) and len(c.data):
                row, h = _keys(c)
                i = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                hit = keys[i] == h
                pair = np.unique(row[hit] * len(keys) + i[hit])
                z += np.bincount(pair // len(keys), weights=weight[pair % len(keys)], minlength=rows)
            yield pa.record_batch([batch.column(0).slice(c.lo, rows), pa.array(1 / (1 + np.exp(-np.clip(z, -50, 50))))], names=["doc_id", "score"])


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float]) -> DataFrame:
    """Every row's ``doc_id, score``."""
    given = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(texts, lambda it: _score(it, given), "doc_id long, score double")


def score_documents(docs: DataFrame, labels: DataFrame, mod: int = 5, rest: int = 0, limit: int = LABELLED) -> DataFrame:
    """Every row's ``doc_id, held_out, score, predicted``."""
    model = fit(labelled_sample(docs, labels, "toxic", limit, ~held_out(F.col("doc_id"), mod, rest)))
    out = score(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), mod, rest).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
