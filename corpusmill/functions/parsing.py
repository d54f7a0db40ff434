"""Parsers of file bytes and markup, run on Arrow batches; each returns text, a status and a reason."""

from __future__ import annotations

import csv
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from email import message_from_bytes, policy
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Elements whose content is dropped, those of them without an end tag, and those that begin a line.
_SKIPPED = {"script", "style", "noscript", "head", "meta", "link", "iframe", "svg"}
_VOID = {"meta", "link"}
_BLOCKS = {"p", "div", "section", "article", "main", "header", "footer", "aside", "nav", "blockquote", "pre", "li", "dt", "dd", "td", "th", "caption", "h1", "h2", "h3", "h4", "h5", "h6", "tr"}


class _Text(HTMLParser):
    """Stripped text nodes; one that opens a block has a line break before it. What follows a dropped element or a comment up to the next tag is dropped with it."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.depth, self.prefix, self.dropped, self.parts = 0, "", False, []

    def handle_starttag(self, tag, attrs):
        self.prefix, self.dropped = "\n" if tag in _BLOCKS else "", tag in _VOID
        self.depth += tag in _SKIPPED - _VOID

    def handle_endtag(self, tag):
        closes = tag in _SKIPPED - _VOID and self.depth > 0
        self.depth -= closes
        self.prefix, self.dropped = "", closes

    def handle_comment(self, data):
        self.prefix, self.dropped = "", True

    def handle_data(self, data):
        if not self.depth and not self.dropped and data.strip():
            self.parts.append(self.prefix + data.strip())
        self.prefix = ""


def html_text(raw: str) -> str:
    """One line for each text node, a blank line before one that opens a block."""
    reader = _Text()
    reader.feed(raw)
    reader.close()
    return re.sub(r"\n{3,}", "\n\n", "\n".join(reader.parts)).strip()


def csv_text(raw: str) -> str:
    """``header: value, ...`` for each row; cells stripped, blank ones dropped, extra cells named ``col<i>``; with no such row the text stays raw."""
    if not raw.strip():
        return ""
    csv.field_size_limit(max(1024 * 1024, len(raw)))
    rows = list(csv.reader(raw.splitlines()))
    if len(rows) < 2:
        return raw
    head = rows[0]
    lines = (", ".join(f"{head[i] if i < len(head) else f'col{i}'}: {v.strip()}" for i, v in enumerate(r) if v.strip()) for r in rows[1:])
    return "\n".join(x for x in lines if x) or raw


def json_text(raw: str) -> str:
    """``a.b[0].c: value`` lines; nulls dropped."""
    out: list[str] = []
    todo = [("", json.loads(raw))]
    while todo:
        path, v = todo.pop()
        if isinstance(v, dict):
            todo += [(f"{path}.{k}" if path else k, x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            todo += [(f"{path}[{i}]", x) for i, x in reversed(list(enumerate(v)))]
        elif v is not None:
            out.append(f"{path}: {v}" if path else str(v))
    return "\n".join(out)


def xml_text(raw: str) -> str:
    return "\n".join(x.strip() for x in ElementTree.fromstring(raw).itertext() if x.strip())


def email_text(data: bytes) -> str:
    message = message_from_bytes(data, policy=policy.default)
    head = [f"{k}: {message[k]}" for k in ("From", "To", "Subject", "Date") if message[k]]
    body = [html_text(p.get_content()) if p.get_content_subtype() == "html" else p.get_content().strip() for p in message.walk() if p.get_content_maintype() == "text"]
    return "\n".join(head) + "\n\n" + "\n\n".join(x for x in body if x)


def epub_text(data: bytes) -> str:
    """Chapters in archive order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return "\n\n".join(html_text(z.read(n).decode("utf-8", "replace")) for n in sorted(z.namelist()) if n.endswith((".xhtml", ".html", ".htm")))


def parse(extension: str, data: bytes) -> tuple[str, str, str | None]:
    """Text, status (``ok``, ``degraded``, ``error``) and reason of one file."""
    try:
        if extension in ("eml",):
            return email_text(data), "ok", None
        if extension in ("epub",):
            return epub_text(data), "ok", None
        raw = data.decode("utf-8")
    except Exception as e:  # a broken file is a row, not a failed job
        return "", "error", type(e).__name__
    by: dict[str, Callable[[str], str]] = {"html": html_text, "htm": html_text, "csv": csv_text, "json": json_text, "xml": xml_text}
    try:
        return by.get(extension, str)(raw), "ok", None
    except Exception as e:
        return ("" if extension == "json" else raw), ("error" if extension == "json" else "degraded"), type(e).__name__


def parse_files(files: DataFrame) -> DataFrame:
    """``uri, text, status, reason`` from ``files(path, content)`` as the ``binaryFile`` source gives them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text, status, reason = parse(path.rsplit(".", 1)[-1].lower(), data or b"")
                yield pa.record_batch([[path], [text], [status], pa.array([reason], pa.string())], names=["uri", "text", "status", "reason"])

    return files.select("path", "content").mapInArrow(run, "uri string, text string, status string, reason string")


def with_text(rows: DataFrame, key: str, raw: Column, parser: Callable[[str], str]) -> DataFrame:
    """``key, text``: one of the parsers above over a string column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array([parser(x or "") for x in batch.column(1).to_pylist()], pa.string())], names=["k", "t"])

    return rows.select(F.col(key).cast("long").alias("k"), raw.alias("t")).mapInArrow(run, "k long, t string").toDF(key, "text")
