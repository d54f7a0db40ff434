"""Language identification: script ranges, per-word scores and Viterbi with a switching penalty.

A word is a run of letters (and marks on them). Its script leaves only those languages in
which that script was seen; each remaining language, and no other, scores it by the naive
Bayes odds of its byte trigrams and of the word itself. Viterbi over all words of a text, with a penalty for every change
of language, labels spans; the text's language is the one that covers most words and its
score is that share of the words. A text's margin says whether it is in a learned language at
all: the log score of its labels over that of a model in which every bucket is equally likely,
by byte of its letters; below 0, letters at random explain it better.

The model is learned from at most about ``TRAIN_DOCS`` labelled texts, chosen by a hash of
the text (a documented bound; words counts are gathered in the tasks and summed by Spark).
The bound is shared out by language: one with few texts is learned from all of them.
Nulls and blanks: a null text or one without letters is ``und`` with score 0 and no spans.
With no labelled text at all every text is ``und``. Rows are independent, so repeated rows,
null ids and other columns do no harm; an empty table gives an empty result.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import bytetext as B
from .scratch import columns, map_arrow

TRAIN_DOCS = 20_000
#: Distinct languages of one model; more need a finer ``lang`` column.
MAX_LANGS = 256
BUCKETS = 1 << 16
PENALTY = 12.0
_CHUNK = 2 << 20
#: First code point of each script range and the script's number (0: none of these).
_RANGES = [(0x00, 0), (0x41, 1), (0x5B, 0), (0x61, 1), (0x7B, 0), (0xC0, 1), (0x250, 0), (0x370, 2), (0x400, 3), (0x530, 4), (0x590, 5), (0x600, 6), (0x780, 0), (0x900, 7), (0x980, 8), (0xA00, 0), (0xE00, 9), (0xE80, 0), (0x10A0, 10), (0x1100, 11), (0x1200, 0), (0x1E00, 1), (0x1F00, 2), (0x2000, 0), (0x3040, 12), (0x3100, 0), (0x3400, 13), (0xA000, 0), (0xAC00, 11), (0xD7B0, 0), (0x20000, 13), (0x30000, 0)]
_SCRIPTS = 14
_START, _SCRIPT = np.array([r[0] for r in _RANGES]), np.array([r[1] for r in _RANGES])
_LETTER = np.array([b >= 0x80 or 97 <= b <= 122 for b in range(256)])
#: Log score of a word in a language whose texts don't have its script.
_EXCLUDED = -1e4


@cache
def _letters() -> np.ndarray:
    """A flag for every character of the first planes: a letter or a mark."""
    return np.array([unicodedata.category(chr(i))[0] in "LM" for i in range(0x40000)])


def _letter_bytes(data: np.ndarray) -> np.ndarray:
    """Flags of the bytes that belong to letters; ``data`` is lower-cased."""
    flags = _LETTER[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        point = _codepoint(data, lead)
        other = lead[~_letters()[np.minimum(point, 0x3FFFF)]]
        size = 2 + (data[other] >= 0xE0).astype(np.int64) + (data[other] >= 0xF0)
        for i in range(4):
            flags[np.minimum(other[size > i] + i, len(data) - 1)] = False
    return flags


def held_out(doc_id: Column, mod: int, rest: int) -> Column:
    """crc32 of the id as text, modulo ``mod``, is ``rest`` (a null id: false)."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % mod == rest, F.lit(False))


def _codepoint(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The character that begins at each of these bytes."""
    n = len(data)
    b = [data[np.minimum(at + i, n - 1)].astype(np.int32) for i in range(4)]
    two, three, four = (b[0] & 31) << 6 | b[1] & 63, (b[0] & 15) << 12 | (b[1] & 63) << 6 | b[2] & 63, (b[0] & 7) << 18 | (b[1] & 63) << 12 | (b[2] & 63) << 6 | b[3] & 63
    return np.select([b[0] < 0x80, b[0] < 0xE0, b[0] < 0xF0], [b[0], two, three], four)


def _features(chunk: B.Chunk) -> tuple[B.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, each word's script and bucket, each letter's trigram bucket, each word's first letter among them."""
    data = B.LOWER[chunk.data]
    letter = _letter_bytes(data)
    words = B.runs(letter, chunk.offsets)
    script = _SCRIPT[np.searchsorted(_START, _codepoint(data, words.start), "right") - 1]
    whole = ((B.span_hash(data, words.start, words.end) >> np.uint64(48)).astype(np.int64)) + BUCKETS
    at = np.flatnonzero(letter)
    size = words.end - words.start
    first = np.concatenate([[0], np.cumsum(size)[:-1]]).astype(np.int64) if len(size) else size
    before, after = np.zeros(len(at), np.uint32), np.zeros(len(at), np.uint32)
    letters = data[at].astype(np.uint32)
    before[1:], after[:-1] = letters[:-1], letters[1:]
    if len(first):
        before[first] = 32
        after[first + size - 1] = 32
    key = (before << np.uint32(16) | letters << np.uint32(8) | after) * np.uint32(0x9E3779B1) >> np.uint32(16)
    return words, script, whole, key.astype(np.int64), first


def _count(batches: Iterator[pa.RecordBatch], langs: list[str]) -> Iterator[pa.RecordBatch]:
    place = {x: i for i, x in enumerate(langs)}
    size = 2 * BUCKETS + _SCRIPTS
    seen: dict[int, np.ndarray] = {}
    for batch in batches:
        own = np.array([place[x] for x in batch.column(1).to_pylist()], np.int64)
        for c in B.chunks(batch.column(0), _CHUNK):
            words, script, whole, key, first = _features(c)
            if not len(first):
                continue
            lang = own[c.lo : c.hi][words.row]
            by_letter = np.repeat(lang, words.end - words.start)
            for i in np.unique(lang).tolist():
                at = np.concatenate([key[by_letter == i], whole[lang == i], script[lang == i] + 2 * BUCKETS])
                seen[i] = seen.get(i, 0) + np.bincount(at, minlength=size)
    for i, n in seen.items():
        bucket = np.flatnonzero(n)
        yield pa.record_batch([pa.array(np.full(len(bucket), i)), pa.array(bucket), pa.array(n[bucket])], names=["lang", "bucket", "n"])


def sample_rates(counts: dict[str, int], limit: int) -> dict[str, float]:
    """The share of each language's texts to learn from: ``limit`` in equal parts, what a small language leaves goes to the larger ones."""
    out, left = {}, limit
    for i, (lang, n) in enumerate(sorted(counts.items(), key=lambda x: (x[1], x[0]))):
        part = min(n, left / (len(counts) - i))
        out[lang] = part / n
        left -= part
    return out


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS) -> tuple[list[str], np.ndarray]:
    """Languages and log scores (trigram buckets, word buckets, scripts) by language, from texts with a non-null language."""
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = {r[0]: r[1] for r in rows.groupBy("lang").count().orderBy("lang").limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} languages")
    langs, total = sorted(counts), sum(counts.values())
    if total > train_docs:
        rate = F.create_map(*(F.lit(x) for pair in sample_rates(counts, train_docs).items() for x in pair))
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < 1_000_000 * rate[F.col("lang")])
    size = 2 * BUCKETS + _SCRIPTS
    seen = np.zeros((len(langs), size))
    if langs:
        lang, bucket, n = columns(map_arrow(rows, lambda it: _count(it, langs), "lang long, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")))
        seen[lang, bucket] = n
    score = np.zeros((len(langs), size), np.float32)
    for part, weight in ((slice(0, BUCKETS), 0.5), (slice(BUCKETS, 2 * BUCKETS), 0.5)):
        own = seen[:, part] + 0.3
        score[:, part] = weight * np.log(own / own.sum(axis=1, keepdims=True))
    scripts = seen[:, 2 * BUCKETS :]
    allowed = scripts >= 0.002 * scripts.sum(axis=1, keepdims=True)
    allowed[:, ~allowed.any(axis=0)] = True
    score[:, 2 * BUCKETS :] = np.where(allowed, 0, _EXCLUDED)
    return langs, score


def word_scores(chunk: B.Chunk, score: np.ndarray) -> tuple[B.Words, np.ndarray]:
    """Words of a chunk and the log score of each in every language; only the languages of a word's script look at it."""
    words, script, whole, key, first = _features(chunk)
    out = np.full((len(first), len(score)), _EXCLUDED, np.float32)
    size = words.end - words.start
    for i, table in enumerate(score):
        able = table[script + 2 * BUCKETS] == 0
        if able.all() and len(first):
            out[:, i] = np.add.reduceat(table[key], first) + table[whole]
        elif able.any():
            begin = np.concatenate([[0], np.cumsum(size[able])[:-1]]).astype(np.int64)
            out[able, i] = np.add.reduceat(table[key[np.repeat(able, size)]], begin) + table[whole[able]]
    return words, out


def viterbi(emit: np.ndarray, cut: np.ndarray, penalty: float) -> np.ndarray:
    """The best state of every word; row r's words are ``cut[r]`` to ``cut[r+1]``. All rows advance together."""
    n, k = emit.shape
    size = np.diff(cut)
    order = np.argsort(-size, kind="stable")
    base, size = cut[:-1][order], size[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(longest), "left")
    best, stay, top = np.zeros((len(size), k), np.float32), np.ones((n, k), bool), np.zeros(n, np.int16)
    for t in range(longest):
        m = active[t]
        at, s = base[:m] + t, best[:m]
        if t:
            i = s.argmax(axis=1)
            jump = s[np.arange(m), i][:, None] - penalty
            keep = s >= jump
            stay[at], top[at] = keep, i
            s = np.maximum(s, jump)
        s = s + emit[at]
        best[:m] = s - s.max(axis=1, keepdims=True)
    state, path = best.argmax(axis=1).astype(np.int16), np.zeros(n, np.int16)
    for t in range(longest - 1, -1, -1):
        m = active[t]
        at, own = base[:m] + t, state[:m]
        path[at] = own
        state[:m] = np.where(stay[at, own], own, top[at])
    return path


def _label(batches: Iterator[pa.RecordBatch], model, penalty: float) -> Iterator[pa.RecordBatch]:
    langs, score = model.value
    for batch in batches:
        names, shares, margins, spans = [], [], [], []
        texts = batch.column(1)
        for c in B.chunks(texts, _CHUNK):
            rows = c.hi - c.lo
            some = np.array([any(map(str.isalpha, x or "")) for x in texts.slice(c.lo, rows).to_pylist()], bool)
            if not langs or not some.any():
                names += ["und"] * rows
                shares += [0.0] * rows
                margins += [0.0] * rows
                spans += [[]] * rows
                continue
            words, emit = word_scores(c, score)
            path, row = viterbi(emit, words.cut, penalty), words.row
            tally = np.bincount(row * len(langs) + path, minlength=rows * len(langs)).reshape(rows, len(langs))
            lead = tally.argmax(axis=1)
            share = tally.max(axis=1) / np.maximum(1, words.counts)
            size = words.end - words.start
            gain = emit[np.arange(len(path)), path] + 0.5 * (size + 1) * np.log(BUCKETS)
            margin = np.bincount(row, weights=gain, minlength=rows) / np.maximum(1, np.bincount(row, weights=size, minlength=rows))
            turn = np.ones(len(path), bool)
            turn[1:] = (path[1:] != path[:-1]) | (row[1:] != row[:-1])
            begin = np.flatnonzero(turn)
            length = np.diff(np.append(begin, len(path)))
            edge = np.searchsorted(begin, words.cut)
            for r in range(rows):
                ok = some[r] and words.counts[r] > 0
                names.append(langs[lead[r]] if ok else "und")
                shares.append(float(share[r]) if ok else 0.0)
                margins.append(float(margin[r]) if ok else 0.0)
                spans.append([{"first_word": int(begin[j] - words.cut[r]), "n_words": int(length[j]), "lang": langs[path[begin[j]]]} for j in range(edge[r], edge[r + 1])] if ok else [])
        kind = pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("lang", pa.string())]))
        yield pa.record_batch([batch.column(0), pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(margins, pa.float64()), pa.array(spans, kind)], names=["doc_id", "lang_pred", "score", "margin", "spans"])


def identify(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text", penalty: float = PENALTY) -> DataFrame:
    """Every row's ``doc_id, lang_pred, score, margin, spans`` (words counted from 0 among runs of letters)."""
    kept = docs.sparkSession.sparkContext.broadcast(model)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(texts, lambda it: _label(it, kept, penalty), "doc_id long, lang_pred string, score double, margin double, spans array<struct<first_word:long,n_words:long,lang:string>>")


def identify_documents(docs: DataFrame, mod: int = 5, rest: int = 0, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """Learn from the rows that aren't held out (see ``held_out``) and label every row."""
    model = fit(docs.where(~held_out(F.col("doc_id"), mod, rest)), train_docs=train_docs)
    out = identify(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id"), mod, rest).alias("held_out"), "lang_pred", "score", F.size("spans").cast("long").alias("n_spans"), "spans")
