"""Fill-in-the-middle forms of texts, cut on arrays of code points.

A text becomes a UTF-32 array. Each code point has a class (its place's parity for single
characters, blank / word / other for words, the line for lines); where neighbouring classes
differ a unit begins, and ``flatnonzero`` gives all such places at once. Two ranks drawn from
the row's id choose the ends of prefix and middle among the units; the three slices are
encoded again and put between marks, as prefix-suffix-middle or suffix-prefix-middle.

A text that holds a mark stays plain, so no text can forge one and ``restore`` is exact. Drawn
values hang on seed and id alone: rows with equal ids and texts have equal results, whatever
the partitioning. A null text is empty and stays plain; a null id draws as an empty one. Texts
are cut whole, whatever their length: one text, its array and its classes are held at a time.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .scratch import map_arrow

#: What stands before prefix, suffix and middle. None of them is part of another, and none begins as another ends.
MARKS = ("<P>", "<S>", "<M>")
_SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
#: Bytes of texts in one batch given back.
_OUT_BYTES = 4 << 20


def _char_classes(points: np.ndarray) -> np.ndarray:
    """Each code point differs from its neighbours."""
    return (np.arange(points.size, dtype=np.uint32) & 1).astype(np.uint8)


def _word_classes(points: np.ndarray) -> np.ndarray:
    """0 blank, 1 letter, digit or beyond ASCII, 2 other."""
    table = np.full(128, 2, np.uint8)
    table[[9, 10, 11, 12, 13, 32]] = 0
    table[[c for c in range(128) if chr(c).isalnum()]] = 1
    return np.where(points < 128, table[np.minimum(points, 127)], np.uint8(1))


def _line_classes(points: np.ndarray) -> np.ndarray:
    """The number of the line; its line feed belongs to it."""
    ends = points == 10
    return np.cumsum(ends, dtype=np.int64) - ends


CLASSES = {"char": _char_classes, "word": _word_classes, "line": _line_classes}


def edges(points: np.ndarray, unit: str = "char") -> np.ndarray:
    """Where units begin, and the end: one more than there are units (one, 0, for an empty text)."""
    if not points.size:
        return np.zeros(1, np.int64)
    classes = CLASSES[unit](points)
    return np.concatenate(([0], np.flatnonzero(classes[1:] != classes[:-1]) + 1, [points.size]))


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four numbers below 2 ** 32 of a row."""
    told = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(told[8 * i : 8 * i + 8], 16) for i in range(4)]


def transform(doc_id: int | None, text: str, unit: str = "char", seed: int = 1, percent: int = 90, spm_percent: int = 20) -> tuple:
    """``n, form, prefix_chars, middle_chars, output`` of one text: ``percent`` of rows are cut, ``spm_percent`` of these with the suffix first."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    at = edges(points, unit)
    n, (h1, h2, h3, h4) = at.size - 1, draws(doc_id, seed)
    if not n or h3 % 100 >= percent or any(m in text for m in MARKS):
        return n, "plain", None, None, text
    a, b = (int(at[r]) for r in sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = (p.tobytes().decode("utf-32-le") for p in (points[:a], points[a:b], points[b:]))
    p, s, m = MARKS
    if h4 % 100 < spm_percent:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def fill_in_middle(docs: DataFrame, unit: str = "char", seed: int = 1, percent: int = 90, spm_percent: int = 20) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` from rows ``doc_id, text``; ``unit`` is ``char``, ``word`` or ``line``."""
    if unit not in CLASSES:
        raise ValueError(f"unit must be one of {', '.join(CLASSES)}")
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(*batch.columns, strict=True):
                doc_id, text = doc_id.as_py(), text.as_py() or ""
                rows.append((doc_id, *transform(doc_id, text, unit, seed, percent, spm_percent)))
                held += len(rows[-1][-1])
                if held >= _OUT_BYTES:
                    yield packed(rows)
                    rows, held = [], 0
            if rows:
                yield packed(rows)

    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, _SCHEMA)


def restore(output: Column, form: Column) -> Column:
    """The text, from output and form alone: the three pieces stand between the marks, which no cut text holds."""
    pieces = F.split(output, "<[PSM]>", -1)
    whole = lambda first, second: F.concat(pieces[first], pieces[3], pieces[second])
    return F.when(form == "psm", whole(1, 2)).when(form == "spm", whole(2, 1)).otherwise(output)


def digests(filled: DataFrame) -> DataFrame:
    """The output's digest and that of the text rebuilt from it."""
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return filled.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restore(F.col("output"), F.col("form"))).alias("restored_sha256"))
