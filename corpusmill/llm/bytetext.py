"""Words of whole Arrow text columns as numpy arrays over the UTF-8 bytes.

All separators of the word rules used here are ASCII, so a word is a run of bytes and
no text is decoded. Work goes in chunks of about ``CHUNK`` bytes (one text at least),
which bounds memory by that and by the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 20
_U = np.uint64
_odds = np.zeros(0, np.uint64)

#: 256 flags: bytes of a word `[^\x20\x09-\x0D]+`
NOT_SPACE = np.array([not (b == 0x20 or 0x09 <= b <= 0x0D) for b in range(256)])
#: 256 flags: bytes of a word `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z are lower-cased
ALNUM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
#: lower-cases A-Z
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(32)
    return x


def _factors(n: int) -> np.ndarray:
    """At least n pseudo-random odd factors, one for each place in a span."""
    global _odds
    if len(_odds) < n:
        _odds = mix(np.arange(1, max(n, 2 * len(_odds), 4096) + 1, dtype=np.uint64) * _U(0x9E3779B97F4A7C15)) | _U(1)
    return _odds


@dataclass
class Chunk:
    """Rows ``lo`` to ``hi`` of a column: bytes and the offsets of each row in them."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def chunks(column: pa.Array | pa.ChunkedArray, limit: int = CHUNK) -> Iterator[Chunk]:
    """The column's texts (null: empty) in runs of about ``limit`` bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if not n:
        return
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    off = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        hi = min(hi, n)
        yield Chunk(lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


@dataclass
class Words:
    """Words of a chunk: byte spans, and for each row the range of its words (``cut[r]`` to ``cut[r+1]``)."""

    start: np.ndarray
    end: np.ndarray
    cut: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.cut)

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.cut) - 1), self.counts)


def runs(flags: np.ndarray, offsets: np.ndarray) -> Words:
    """Runs of set bytes, none across a row's edge."""
    n = len(flags)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(z, z, np.zeros(len(offsets), np.int64))
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = flags.copy()
    first[1:] &= ~flags[:-1] | edge[1:n]
    last = flags.copy()
    last[:-1] &= ~flags[1:] | edge[1:n]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(start, end, np.searchsorted(start, offsets))


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit fingerprint of each byte span: equal spans, equal hashes.

    Spans may share a start but not overlap otherwise. The hash is multilinear: the sum of a
    byte's value (1 to 256) times a random odd factor of its place in the span. Two given
    spans differ somewhere by less than 2**8, so they clash for at most 2**-56 of all factors,
    whatever their length and pattern.
    """
    n = len(data)
    if not len(start):
        return np.zeros(0, np.uint64)
    origin = np.zeros(n, np.int32)
    origin[start] = start
    place = np.arange(n, dtype=np.int32) - np.maximum.accumulate(origin)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + _U(1)) * _factors(int(place.max()) + 1)[place], out=total[1:])
    return mix(total[end] - total[start])


def window_hash(hashes: np.ndarray, words: Words, k: int, short: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of k consecutive words and the position of each one's first word. short: a row of fewer words is one window."""
    n = len(hashes)
    cut, counts = words.cut, words.counts
    total = np.zeros(n, np.uint64)
    rng = np.random.default_rng(k)
    odd = rng.integers(0, 1 << 62, k, dtype=np.uint64) * _U(2) + _U(1)
    for j in range(min(k, n)):
        total[: n - j] += hashes[j:] * odd[j]
    ok = np.ones(n, bool)
    ends = cut[1:]
    for j in range(1, k):
        at = ends - j
        ok[at[at >= cut[:-1]]] = False
    at = np.flatnonzero(ok)
    out = mix(total[at])
    if short:
        few = np.flatnonzero((counts > 0) & (counts < k))
        if len(few):
            extra = np.array([_short(hashes[cut[r] : cut[r + 1]], odd) for r in few], np.uint64)
            at = np.concatenate([at, cut[few]])
            out = np.concatenate([out, mix(extra)])
            order = np.argsort(at, kind="stable")
            at, out = at[order], out[order]
    return out, at


def _short(hashes: np.ndarray, odd: np.ndarray) -> int:
    return int((hashes * odd[: len(hashes)]).sum(dtype=np.uint64) ^ _U(len(hashes)))
