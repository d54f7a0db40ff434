"""Chunkers: one text to many spans. Windows are native; the rest run on Arrow batches."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Where a sentence ends, what a heading is, what a token is.
_SENTENCE_END = re.compile(r"(?<=[.!?。！？])(?=\s|[一-鿿぀-ヿ]|$)")
_HEADING = re.compile(r"^#{1,6} .+$", re.M)
_TOKEN = re.compile(r"[A-Za-z0-9_]+|[^\s]")


def char_windows(docs: DataFrame, size: int = 500, overlap: int = 50, text: str = "text") -> DataFrame:
    """``docs`` exploded to ``chunk_index, char_start, char_end, chunk``: windows until one reaches the end."""
    step, n = size - overlap, F.length(text)
    last = F.greatest(F.ceil((n - overlap) / step) - 1, F.lit(0))
    out = docs.where(n > 0).withColumn("chunk_index", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    start = F.col("chunk_index") * step
    out = out.withColumn("char_start", start).withColumn("char_end", F.least(start + size, n.cast("long")))
    return out.withColumn("chunk", F.col(text).substr((F.col("char_start") + 1).cast("int"), F.lit(size)))


def parent_child(docs: DataFrame, parent: int = 2000, size: int = 500, overlap: int = 50, key: str = "doc_id") -> DataFrame:
    """Windows inside windows: ``key, parent_index, child_start, child_end, chunk`` with offsets in the whole text."""
    p = char_windows(docs, parent, 0).select(key, F.col("chunk_index").alias("parent_index"), F.col("char_start").alias("shift"), F.col("chunk").alias("parent_text"))
    c = char_windows(p, size, overlap, "parent_text")
    return c.select(key, "parent_index", (F.col("char_start") + F.col("shift")).alias("child_start"), (F.col("char_end") + F.col("shift")).alias("child_end"), "chunk")


def _windows(text: str, size: int, overlap: int) -> list[tuple[str, int, int]]:
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + size)
        out.append((text[at:end], at, end))
        if end == len(text):
            break
        at += size - overlap
    return out


def _merged(parts: list[str], joint: str, size: int, overlap: int) -> list[tuple[str, int, int]]:
    """Parts joined greedily up to ``size``; a longer one is cut into windows. Offsets count the joined texts alone."""
    out, held, at = [], "", 0

    def flush():
        nonlocal held, at
        if held:
            out.extend((t, at + a, at + b) for t, a, b in (_windows(held, size, overlap) if len(held) > size else [(held, 0, len(held))]))
            at += len(held)
            held = ""

    for part in parts:
        if held and len(held) + len(joint) + len(part) > size:
            flush()
        held = f"{held}{joint}{part}" if held else part
    flush()
    return out


def paragraph_chunks(text: str, size: int = 500, overlap: int = 50) -> list[tuple[str, int, int]]:
    return _merged([p.strip() for p in re.split(r"\n{2,}", text) if p.strip()], "\n\n", size, overlap)


def sentence_chunks(text: str, size: int = 500, overlap: int = 50) -> list[tuple[str, int, int]]:
    return _merged([s.strip() for s in _SENTENCE_END.split(text) if s.strip()], " ", size, overlap)


def heading_chunks(text: str, size: int = 500, overlap: int = 50) -> list[tuple[str, int, int]]:
    """Sections as heading, blank line and stripped body; longer ones in windows. Offsets count the sections alone."""
    heads = [(m.start(), m.end()) for m in _HEADING.finditer(text)]
    stops = [a for a, _ in heads] + [len(text)]
    sections = [text[: stops[0]].strip()]
    sections += [f"{text[a:b]}\n\n{text[b:stop].strip()}".strip() for (a, b), stop in zip(heads, stops[1:])]
    out, at = [], 0
    for section in sections if heads else [text.strip()]:
        out += [(t, at + a, at + b) for t, a, b in _windows(section, size, overlap)]
        at += len(section)
    return out


#: Levels of cuts: a heading begins a part, blank lines and sentence ends close one.
_CUTS = [(_HEADING, re.Match.start), (re.compile(r"\n{2,}"), re.Match.end), (re.compile(r"[.!?。！？](?=\s|[一-鿿぀-ヿ]|\Z)"), re.Match.end)]


def recursive_chunks(text: str, size: int = 500, overlap: int = 50) -> list[tuple[str, int, int]]:
    """Stripped parts that fit, cut at the first level that cuts, each cut going one level down; else windows. Offsets are exact."""
    out: list[tuple[str, int, int]] = []

    def keep(a: int, b: int) -> None:
        part = text[a:b]
        if part.strip():
            a += len(part) - len(part.lstrip())
            out.append((part.strip(), a, a + len(part.strip())))

    todo = [(0, len(text), 0)]
    while todo:
        a, b, level = todo.pop()
        if b - a <= size:
            keep(a, b)
            continue
        for deeper in range(level, len(_CUTS)):
            pattern, side = _CUTS[deeper]
            edges = sorted({a, b, *(a + side(m) for m in pattern.finditer(text[a:b]))})
            parts = [(x, y, deeper + 1) for x, y in zip(edges, edges[1:]) if text[x:y].strip()]
            if len(parts) > 1:
                todo += reversed(parts)
                break
        else:
            for _, x, y in _windows(text[a:b], size, overlap):
                keep(a + x, a + y)
    return out


def token_chunks(text: str, size: int = 128, overlap: int = 16) -> list[tuple[str, int, int]]:
    """Windows of tokens with exact character spans."""
    spans, out, at = [m.span() for m in _TOKEN.finditer(text)], [], 0
    while at < len(spans):
        end = min(len(spans), at + size)
        a, b = spans[at][0], spans[end - 1][1]
        out.append((text[a:b], a, b))
        if end == len(spans):
            break
        at += size - overlap
    return out


def chunk_with(docs: DataFrame, chunker: Callable[..., list[tuple[str, int, int]]], key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``key, chunk_index, char_start, char_end, chunk`` from any chunker above, a batch of texts at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 200):
                part = batch.slice(lo, 200)
                rows = [(k, i, a, b, t) for k, x in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) for i, (t, a, b) in enumerate(chunker(x or "", **options))]
                cols = list(zip(*rows)) or [[]] * 5
                yield pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array(cols[4], pa.string())], names=["k", "i", "a", "b", "t"])

    out = docs.select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, "k long, i long, a long, b long, t string")
    return out.toDF(key, "chunk_index", "char_start", "char_end", "chunk")
