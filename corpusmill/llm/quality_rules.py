"""Quality rules by divergence from language references.

Every text gives two histograms, of character classes and of common words. A language's
reference is their sum over its typical texts; the Jensen-Shannon distance (base 2, 0 to 1)
to the nearest reference decides, each histogram only from a least length on. Some plain
counts come along, and texts that fail on these fail anyway.

Every text with a language counts for a first sum of its characters, and the distances of
all of them to it are counted too: the nearer ``TYPICAL`` share of a language's texts then
makes its reference, so that junk which is labelled with a language doesn't pull it. All
sums are taken by task, then by Spark; counts and verdicts are over whole texts.
A null or wordless text has zero counts and fails. With no labelled text the distances are
0. Rows are independent: repeated rows, null ids and other columns do no harm, and an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import bytetext as B
from .scratch import map_arrow, materialize
from .suffix_tree import _Counter

COMMON = 50
#: Words of all languages that a task holds, before it gives their counts on.
HELD = 3_000_000
#: Least share of a language's words for a word that is common.
LEAST_SHARE = 0.001
#: Least characters and words for a verdict by each histogram, and its largest distance.
LEAST_CHARS, LEAST_WORDS = 200, 60
MOST_CHARS, MOST_WORDS = 0.195, 0.62
#: Share of a language's texts, those nearest to the sum of all, that make its reference; steps of distance in which they are told apart.
TYPICAL, STEPS = 0.75, 1000
_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, js_chars double, js_words double"
_SYMBOL = np.array([chr(b) in "#*$%&|<>" for b in range(256)])
_LETTERS = np.array([b >= 0x80 or 97 <= b <= 122 for b in range(256)])
_LEAD = np.array([b & 0xC0 != 0x80 for b in range(256)])
#: Classes: a-z, A-Z, non-ASCII, digit, blank, sentence mark, symbol, other; 8: the rest of a character.
_CLASS = np.array([0 if 97 <= b <= 122 else 1 if 65 <= b <= 90 else 8 if b & 0xC0 == 0x80 else 2 if b >= 0x80 else 3 if 48 <= b <= 57 else 4 if b in b" \t\n\r\x0b\x0c" else 5 if chr(b) in ".,;:?!'\"-()" else 6 if chr(b) in "#*$%&|<>" else 7 for b in range(256)], np.int64)
_CLASSES = 8


def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each key: how often it occurs, and whether an equal one came before."""
    order = np.argsort(key, kind="stable")
    own = key[order]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    begin = np.flatnonzero(new)
    count = np.diff(np.append(begin, len(own)))
    many, earlier = np.empty(len(own), np.int64), np.empty(len(own), bool)
    many[order], earlier[order] = np.repeat(count, count), ~new
    return many, earlier


def _keyed(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    return B.mix(h ^ (row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))


def base_counts(c: B.Chunk) -> np.ndarray:
    """``_NAMES`` by row."""
    rows, data = c.hi - c.lo, c.data
    words = B.runs(B.NOT_SPACE[data], c.offsets)
    row, at_byte = words.row, np.repeat(np.arange(rows), np.diff(c.offsets))
    out = np.zeros((rows, 5), np.int64)
    out[:, 0] = words.counts
    out[:, 1] = np.bincount(at_byte[B.NOT_SPACE[data] & _LEAD[data]], minlength=rows)
    out[:, 2] = np.bincount(at_byte[_SYMBOL[data]], minlength=rows)
    lines = B.runs(data != 10, c.offsets)
    seen = np.concatenate([[0], np.cumsum(B.NOT_SPACE[data])])
    some = seen[lines.end] > seen[lines.start]
    if some.any():
        line_row = lines.row[some]
        _, earlier = _groups(_keyed(B.span_hash(data, lines.start[some], lines.end[some]), line_row))
        out[:, 3] = np.bincount(line_row[earlier], minlength=rows)
    if len(row):
        h, at = B.window_hash(B.span_hash(data, words.start, words.end), words, 3)
        if len(at):
            many, _ = _groups(_keyed(h, row[at]))
            flag = np.zeros(len(row), bool)
            for j in range(3):
                flag[at[many > 1] + j] = True
            out[:, 4] = np.bincount(row[flag], minlength=rows)
    return out


def _word_hashes(c: B.Chunk) -> tuple[B.Words, np.ndarray]:
    data = B.LOWER[c.data]
    words = B.runs(_LETTERS[data], c.offsets)
    return words, B.span_hash(data, words.start, words.end)


def histograms(c: B.Chunk, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """By row: characters of each class, and letter words equal to each of the sorted hashes ``common`` (last: none)."""
    rows, chars = c.hi - c.lo, _class_counts(c)[:, :_CLASSES]
    words, h = _word_hashes(c)
    place = np.full(len(h), len(common))
    if len(common):
        i = np.minimum(np.searchsorted(common, h), len(common) - 1)
        place = np.where(common[i] == h, i, len(common))
    return chars, np.bincount(words.row * (len(common) + 1) + place, minlength=rows * (len(common) + 1)).reshape(rows, len(common) + 1)


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance of the rows of counts ``p`` to the distribution ``q``; a row without counts has 0."""
    total = p.sum(axis=1, keepdims=True)
    p = p / np.maximum(total, 1)
    m = (p + q) / 2

    def against(a):
        return np.where(a > 0, a * np.log2(np.where(a > 0, a, 1) / np.where(m > 0, m, 1)), 0).sum(axis=1)

    return np.where(total[:, 0] > 0, np.sqrt(np.clip((against(p) + against(np.broadcast_to(q, p.shape))) / 2, 0, 1)), 0)


def _class_counts(c: B.Chunk) -> np.ndarray:
    """By row, characters of each class (8: other bytes of characters)."""
    rows = c.hi - c.lo
    return np.bincount(np.repeat(np.arange(rows), np.diff(c.offsets)) * 9 + _CLASS[c.data], minlength=rows * 9).reshape(rows, 9)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[B.Chunk, np.ndarray, np.ndarray, np.ndarray]]:
    """Chunks of texts with the languages in them, each row's among these, and the rows' class counts."""
    for batch in batches:
        langs = np.array(batch.column(1).to_pylist(), object)
        for c in B.chunks(batch.column(0)):
            own, code = np.unique(langs[c.lo : c.hi], return_inverse=True)
            yield c, own, code, _class_counts(c)[:, :_CLASSES]


def _char_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By language, the characters of each class."""
    chars: dict[str, np.ndarray] = {}
    for _, own, code, counts in _parts(batches):
        for i, lang in enumerate(own):
            chars[lang] = chars.get(lang, 0) + counts[code == i].sum(axis=0)
    for lang, n in chars.items():
        yield pa.record_batch([pa.array([lang] * _CLASSES, pa.string()), pa.array(range(_CLASSES), pa.int64()), pa.array(n)], names=["lang", "at", "n"])


def _steps(counts: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Distances to a language's first sum, in steps; -1 for a text without characters."""
    return np.where(counts.sum(axis=1) > 0, (js_distance(counts, share) * STEPS).astype(np.int64), -1)


def _spread(batches: Iterator[pa.RecordBatch], first) -> Iterator[pa.RecordBatch]:
    """By language, how many texts are at each step of distance."""
    seen: dict[str, np.ndarray] = {}
    for _, own, code, counts in _parts(batches):
        for i, lang in enumerate(own):
            step = _steps(counts[code == i], first[lang])
            seen[lang] = seen.get(lang, 0) + np.bincount(step[step >= 0], minlength=STEPS + 1)
    for lang, n in seen.items():
        at = np.flatnonzero(n)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], names=["lang", "at", "n"])


def _sums(batches: Iterator[pa.RecordBatch], first: dict, most: dict) -> Iterator[pa.RecordBatch]:
    """By language, over its typical texts, the characters of each class (8: all words) and the count of each word, summed over a task; about ``HELD`` words are held before they are given on."""
    chars: dict[str, np.ndarray] = {}
    seen: dict[str, _Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        names = ["lang", "is_class", "word", "n"]
        for lang, n in chars.items():
            yield pa.record_batch([pa.array([lang] * 9, pa.string()), pa.array([True] * 9), pa.array(range(9), pa.int64()), pa.array(n)], names=names)
        for lang, counter in seen.items():
            for part in counter.out():
                yield pa.record_batch([pa.array([lang] * len(part), pa.string()), pa.array([False] * len(part)), part.column(0), part.column(1)], names=names)
        chars.clear()
        seen.clear()

    for c, own, code, counts in _parts(batches):
        words, h = _word_hashes(c)
        for i, lang in enumerate(own):
            typical = (code == i) & (_steps(counts, first[lang]) <= most.get(lang, -1))
            mine = h[typical[words.row]]
            chars[lang] = chars.get(lang, 0) + np.append(counts[typical].sum(axis=0), len(mine))
            seen.setdefault(lang, _Counter()).add(mine)
        if sum(x.size for x in seen.values()) > HELD:
            yield from out()
    yield from out()


def fit_references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", common: int = COMMON) -> dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By language, over its typical texts: class shares, hashes of its ``common`` most frequent words, and their shares (last: all other words)."""
    rows = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    added = lambda f: map_arrow(rows, f, "lang string, at long, n long").groupBy("lang", "at").agg(F.sum("n").alias("n")).collect()
    first: dict[str, np.ndarray] = {}
    for r in added(_char_sums):
        first.setdefault(r.lang, np.zeros(_CLASSES))[r.at] = r.n
    if not first:
        return {}
    first = {k: v / max(v.sum(), 1) for k, v in first.items()}
    spread: dict[str, np.ndarray] = {}
    for r in added(lambda it: _spread(it, first)):
        spread.setdefault(r.lang, np.zeros(STEPS + 1))[r.at] = r.n
    most = {k: int(np.searchsorted(np.cumsum(v), TYPICAL * v.sum())) for k, v in spread.items()}
    sums = materialize(map_arrow(rows, lambda it: _sums(it, first, most), "lang string, is_class boolean, word long, n long").groupBy("lang", "is_class", "word").agg(F.sum("n").alias("n")), "references")
    chars: dict[str, np.ndarray] = {}
    for r in sums.where("is_class").collect():
        chars.setdefault(r.lang, np.zeros(9))[r.word] = r.n
    # A share of LEAST_SHARE bounds what comes to the driver: 1 / LEAST_SHARE words a language.
    least = docs.sparkSession.createDataFrame([(k, float(LEAST_SHARE * v[8])) for k, v in chars.items()], "lang string, least double")
    found: dict[str, list[tuple[int, int]]] = {}
    for r in sums.where("not is_class").join(F.broadcast(least), "lang").where("n >= least").collect():
        found.setdefault(r.lang, []).append((r.n, r.word))
    out = {}
    for lang in sorted(chars):
        best = sorted(found.get(lang, []), reverse=True)[:common]
        words, n = np.array([w for _, w in best], np.int64).view(np.uint64), np.array([x for x, _ in best], float)
        share = np.append(n, max(0.0, chars[lang][8] - n.sum()))
        out[lang] = (chars[lang][:8] / max(chars[lang][:8].sum(), 1), words, share / max(share.sum(), 1))
    return out


def _judge(batches: Iterator[pa.RecordBatch], references) -> Iterator[pa.RecordBatch]:
    refs = references.value
    common = np.unique(np.concatenate([w for _, w, _ in refs.values()])) if refs else np.zeros(0, np.uint64)
    for batch in batches:
        parts = []
        for c in B.chunks(batch.column(1)):
            chars, words = histograms(c, common)
            rows = c.hi - c.lo
            near_c, near_w = np.full(rows, np.inf if refs else 0.0), np.full(rows, np.inf if refs else 0.0)
            for share, own, word_share in refs.values():
                picked = words[:, np.searchsorted(common, own)]
                picked = np.column_stack([picked, words.sum(axis=1) - picked.sum(axis=1)])
                near_c = np.minimum(near_c, js_distance(chars, share))
                near_w = np.minimum(near_w, js_distance(picked, word_share))
            parts.append((base_counts(c), near_c, near_w))
        if parts:
            base = np.concatenate([p[0] for p in parts])
            yield pa.record_batch([batch.column(0), *(pa.array(base[:, i]) for i in range(5)), *(pa.array(np.concatenate([p[i] for p in parts])) for i in (1, 2))], names=[x.split()[0] for x in _SCHEMA.split(", ")])


def judge(docs: DataFrame, references: dict, id_col: str = "doc_id", text_col: str = "text", most_chars: float = MOST_CHARS, most_words: float = MOST_WORDS) -> DataFrame:
    """Every row's counts, distances to the nearest reference, ``base_failed`` and ``kept``."""
    given = docs.sparkSession.sparkContext.broadcast(references)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = map_arrow(texts, lambda it: _judge(it, given), _SCHEMA)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    odd = ((F.col("word_chars") >= LEAST_CHARS) & (F.col("js_chars") > most_chars)) | ((F.col("n_words") >= LEAST_WORDS) & (F.col("js_words") > most_words))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~odd)


def quality_rules(docs: DataFrame) -> DataFrame:
    """References from the rows with a language, verdicts for all rows."""
    return judge(docs, fit_references(docs))
