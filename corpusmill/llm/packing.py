"""Token ids packed into fixed-width rows by best-fit decreasing.

Texts are encoded with a public byte-level vocabulary (a path, read once by the driver and
broadcast) and closed by an end token. A document longer than a row is split into full rows
and a rest, losslessly. Each task packs its own documents in blocks of ``BLOCK`` tokens:
pieces go longest first, each into the row with the least room that still fits, found with
a segment tree over room sizes. No row of the table is shuffled.

Each output row has ``row_id, n_tokens, n_segments``, the id matrix row ``input_ids`` and
``position_ids`` (little-endian ``uint16``, or ``int32`` if the vocabulary needs it; unused
places hold the end token and position 0), ``cu_seqlens`` (0 and the end of every segment),
and for each segment its ``doc_ids`` and ``doc_starts`` (first token in the document).

Nulls and blanks: a null or empty text is one end token, so every row of the input is found
in the output; a null id stays null. Repeated rows are packed as often as they come. Other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .scratch import map_arrow

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
WIDTH = 2048
#: Tokens that a task holds at once, beside its longest document.
BLOCK = 4_000_000
#: Fixed value: the public split pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_SCHEMA = "row_id long, n_tokens long, n_segments long, input_ids binary, position_ids binary, cu_seqlens array<int>, doc_ids array<long>, doc_starts array<long>"
#: A run of blanks beyond this is encoded in parts: whole, longer ones exhaust the stack of the split pattern's matcher.
LONG = 100_000
_encoders: dict = {}


def encoder(vocabulary: bytes):
    """A tiktoken encoding without special tokens, made once in each process."""
    key = hash(vocabulary)
    if key not in _encoders:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        _encoders[key] = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[key]


def encode(enc, text: str) -> list[int]:
    """Token ids of a text; they decode to it whatever it holds."""
    if len(text) < LONG:
        return enc.encode_ordinary(text)
    ids, at = [], 0
    for run in re.finditer(rf"\s{{{LONG},}}", text):
        for cut in range(run.start(), run.end(), LONG):
            ids += enc.encode_ordinary(text[at:cut])
            at = cut
    return ids + enc.encode_ordinary(text[at:])


class Rooms:
    """Open rows by the room left in them, with a segment tree that finds the least room of a size at least."""

    def __init__(self, width: int) -> None:
        self.leaves = 1 << width.bit_length()
        self.some = [False] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(width + 1)]

    def put(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = self.leaves + room
        while i and not self.some[i]:
            self.some[i] = True
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The room and number of a row with the least room of at least ``size``; it is taken out."""
        i = self.leaves + size
        while not self.some[i]:
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.some[2 * i] else 2 * i + 1
        room = i - self.leaves
        row = self.rows[room].pop()
        if not self.rows[room]:
            self.some[i] = False
            i >>= 1
            while i and not (self.some[2 * i] or self.some[2 * i + 1]):
                self.some[i] = False
                i >>= 1
        return room, row


def best_fit_decreasing(sizes: np.ndarray, width: int) -> list[list[int]]:
    """Rows of piece numbers; every size is 1 to ``width``."""
    rooms, rows = Rooms(width), []
    for i in np.argsort(-np.asarray(sizes), kind="stable").tolist():
        size = int(sizes[i])
        found = rooms.take(size)
        if found is None:
            rows.append([i])
            room, row = width, len(rows) - 1
        else:
            room, row = found
            rows[row].append(i)
        if room > size:
            rooms.put(room - size, row)
    return rows


def _packed(pieces: list[tuple[int | None, int, np.ndarray]], width: int, end: int, kind: np.dtype, first: int) -> Iterator[pa.RecordBatch]:
    rows = best_fit_decreasing(np.array([len(p[2]) for p in pieces], np.int64), width) if pieces else []
    for lo in range(0, len(rows), 256):
        part = rows[lo : lo + 256]
        ids, places = np.full((len(part), width), end, kind), np.zeros((len(part), width), kind)
        cuts, docs, starts = [], [], []
        for r, own in enumerate(part):
            cut = [0]
            for i in own:
                a, b = cut[-1], cut[-1] + len(pieces[i][2])
                ids[r, a:b], places[r, a:b] = pieces[i][2], np.arange(b - a)
                cut.append(b)
            cuts.append(cut)
            docs.append([pieces[i][0] for i in own])
            starts.append([pieces[i][1] for i in own])
        yield pa.record_batch([pa.array(range(first + lo, first + lo + len(part)), pa.int64()), pa.array([c[-1] for c in cuts], pa.int64()), pa.array([len(d) for d in docs], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([x.tobytes() for x in places], pa.binary()), pa.array(cuts, pa.list_(pa.int32())), pa.array(docs, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64()))], names=[x.split()[0] for x in _SCHEMA.split(", ")])


def _pack(batches: Iterator[pa.RecordBatch], vocabulary, width: int, block: int) -> Iterator[pa.RecordBatch]:
    enc = encoder(vocabulary.value)
    end = enc.max_token_value + 1
    kind = np.dtype("<u2" if max(end, width) < 1 << 16 else "<i4")
    context = TaskContext.get()
    made, held, pieces = (context.partitionId() if context else 0) << 32, 0, []
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
            ids = encode(enc, text.as_py() or "")
            ids.append(end)
            tokens = np.array(ids, kind)
            pieces += [(doc_id.as_py(), at, tokens[at : at + width]) for at in range(0, len(tokens), width)]
            held += len(tokens)
            if held >= block:
                for out in _packed(pieces, width, end, kind, made):
                    made += out.num_rows
                    yield out
                held, pieces = 0, []
    yield from _packed(pieces, width, end, kind, made)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """Packed rows of every document (see the module)."""
    with open(vocabulary, "rb") as f:
        kept = docs.sparkSession.sparkContext.broadcast(f.read())
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(texts, lambda it: _pack(it, kept, width, block), _SCHEMA)
