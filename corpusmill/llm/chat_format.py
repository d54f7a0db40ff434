"""Chat formatting by incremental black-box rendering.

A template is a function of a list of messages. It is rendered for every prefix of a
conversation; where an output begins with the one before, the rest is the new turn's span.
The text inside a span is found black-box as well: the prefix is rendered once more with a
sentinel for the turn's text, and what surrounds the sentinel bounds the text.
A template that changes what it has written (drops old thoughts, moves the system text) is
detected and the conversation flagged: its turns are then located in the whole output, by a
sentinel each, and one whose text can't be bounded there has null spans. The loss mask
covers the texts of assistant turns, without their marks.

The default template marks turns with ``[INST]``, ``<s>`` or ``[ROLE name]`` and escapes
backslashes, square brackets and ``<`` inside texts and names, so no text can forge a mark
and ``parse`` reads every conversation back.

Turns are ordered by turn, then role and text (so ties have one order); repeated rows are
turns like any other. A null role or text is empty; a row with a null id belongs to no other
row, so it is a conversation of one turn with that id. An empty table gives no rows; other
columns are ignored. A conversation is one output row, as its reader needs it whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scratch import map_arrow

_ESCAPE = re.compile(r"[\\\[\]<]")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_BODY = r"[^\\\[\]<]*(?:\\.[^\\\[\]<]*)*"
_TURN = re.compile(rf"(\[INST\] |<s> |\[ROLE ({_BODY})\] )({_BODY})( \[/INST\]| </s>| \[/ROLE\])", re.S)
_SCHEMA = "conv_id long, formatted string, spans array<struct<role:string,start:long,end:long,text_start:long,text_end:long>>, rewrites_history boolean"


def escape(text: str) -> str:
    return _ESCAPE.sub(r"\\\g<0>", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1", text)


def inst_template(messages: list[tuple[str, str]]) -> str:
    """``(role, text)`` messages with marks around each."""
    out = []
    for role, text in messages:
        if role == "user":
            out.append(f"[INST] {escape(text)} [/INST]")
        elif role == "assistant":
            out.append(f"<s> {escape(text)} </s>")
        else:
            out.append(f"[ROLE {escape(role)}] {escape(text)} [/ROLE]")
    return "".join(out)


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages of ``inst_template``'s output."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at character {at}")
        at = m.end()
        out.append(("user" if m[1] == "[INST] " else "assistant" if m[1] == "<s> " else unescape(m[2]), unescape(m[3])))
    if at != len(formatted):
        raise ValueError(f"no turn at character {at}")
    return out


def _around(messages: list[tuple[str, str]], at: int, out: str, template: Callable[[list[tuple[str, str]]], str]) -> tuple[int, int] | None:
    """Where the text of message ``at`` stands in ``out``, the rendered messages; none if what surrounds it hangs on the text."""
    # Private-use letters, as many as make a word that the output doesn't hold: of n characters it holds n at most of any length.
    k, size = 0, 1
    while (sentinel := "".join(chr(0xE000 + (k >> 12 * i) % 4096) for i in range(size))) in out:
        k += 1
        size = 1 if k < 4096 else 2
    marked = template([*messages[:at], (messages[at][0], sentinel), *messages[at + 1 :]])
    start, size = marked.find(sentinel), len(out) - len(marked) + len(sentinel)
    if start < 0 or size < 0 or marked.count(sentinel) != 1 or out[:start] != marked[:start] or out[start + size :] != marked[start + len(sentinel) :]:
        return None
    return start, start + size


def turn_spans(messages: list[tuple[str, str]], template: Callable[[list[tuple[str, str]]], str]) -> tuple[str, list[tuple[int | None, ...]], bool]:
    """The output, each turn's ``start, end, text start, text end`` in it (None where it has none), and whether the template rewrote history."""
    last, spans, rewrites = "", [], False
    for i in range(len(messages)):
        out = template(messages[: i + 1])
        if not out.startswith(last):
            rewrites = True
            break
        spans.append((len(last), len(out), *(_around(messages[: i + 1], i, out, template) or (None, None))))
        last = out
    if not rewrites:
        return last, spans, False
    # Earlier outputs are no guide to the last one, so every text is sought in that itself; its marks aren't known.
    whole = template(messages)
    found = [_around(messages, i, whole, template) for i in range(len(messages))]
    return whole, [(None, None, *(f or (None, None))) for f in found], True


def _format(batches: Iterator[pa.RecordBatch], template) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("role", pa.string()), *((n, pa.int64()) for n in ("start", "end", "text_start", "text_end"))]))
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            rows = batch.slice(lo, 64).to_pylist()
            done = []
            for row in rows:
                messages = [(t["role"] or "", t["text"] or "") for t in row["turns"]]
                out, spans, rewrites = turn_spans(messages, template)
                done.append((out, [dict(zip(("role", "start", "end", "text_start", "text_end"), (m[0], *s), strict=True)) for m, s in zip(messages, spans, strict=True)], rewrites))
            yield pa.record_batch([pa.array([r["conv_id"] for r in rows], pa.int64()), pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], kind), pa.array([d[2] for d in done], pa.bool_())], names=["conv_id", "formatted", "spans", "rewrites_history"])


def format_conversations(turns: DataFrame, template: Callable[[list[tuple[str, str]]], str] = inst_template) -> DataFrame:
    """``conv_id, formatted, spans, rewrites_history`` from rows ``conv_id, turn, role, text``."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("t"))
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    whole = rows.groupBy("conv_id", alone.alias("alone")).agg(F.sort_array(F.collect_list("t")).alias("turns")).drop("alone")
    return map_arrow(whole, lambda it: _format(it, template), _SCHEMA)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row in batch.to_pylist():
            messages, text = parse(row["formatted"]), row["formatted"]
            loss = "".join(unescape(text[s["text_start"] : s["text_end"]]) for s in row["spans"] if s["role"] == "assistant" and s["text_start"] is not None)
            all_turns = "".join(f"{role}\n{said}\n" for role, said in messages)
            out.append((row["conv_id"], len(messages), hashlib.sha256(all_turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text), row["rewrites_history"]))
        yield pa.record_batch([pa.array(x, k) for x, k in zip(list(zip(*out, strict=True)) or [[]] * 7, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()), strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites_history"])


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted conversations say when they are read back."""
    return map_arrow(formatted, _digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites_history boolean")
