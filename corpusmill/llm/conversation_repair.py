"""Conversation repair: the cheapest edits that make roles follow ``(system? (user assistant)+)?``.

A forward Viterbi pass over the rows of each conversation keeps, for each of four grammar
states, the least ``(cost, audit string)``. A row is kept (K, 0), given the role the state
asks for (R, 1) or deleted (D, 2; the only edit of blank rows and duplicates); a truncated
row that isn't deleted adds 5. Each row's layer is closed by at most three inserted empty
turns (I, 5): more would pass a state twice. Equal costs go to the smaller audit string.

``plan_repairs`` works on narrow rows (no texts): duplicates are numbered by a window, then
the rows stream through a task, sorted by conversation. Only the last ``BLOCK`` rows of a path
are held as strings; before them a path is the rank of its head among at most four heads,
which are read back through the blocks at the end. So a conversation of any length costs a
few bytes a row and time in proportion; as the audit is one value, its rows pass through one
task, which streams them. ``repaired`` streams the rows once more, behind their audit string, and
gives the repaired turns; it holds the audit string and one batch.

Order of a conversation: turn (nulls first), then role, then SHA-256 of the text, so ties have
one order. Null roles and texts are one space. Rows with a null id are one conversation.
Repeated rows are duplicates. Rows for which ``present`` is false only name their conversation.
An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import map_arrow, materialize

#: Fixed values of the contract: costs of the edits, and blanks.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS = "\x20\t\n\x0b\x0c\r"
#: Rows of a path that are held as a string before its head becomes a rank.
BLOCK = 64
#: State after a kept role initial: 0 nothing yet, 1 after the system turn, 2 after a user, 3 after an assistant.
_KEEP = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
#: State after a turn of the role that each state asks for.
_ASKED = (2, 2, 3, 2)
_FINAL = (0, 3)
_OUT_ROWS, _OUT_BYTES = 5_000, 4 << 20
_PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def damage(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, present`` with the faults of the contract, by ``crc32(conv_id:turn) % 20``; a dropped row stays as one that isn't present."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"))
    rows = rows.withColumn("fate", F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20)
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fate") != 0).alias("present"), "fate")
    copies = F.array_repeat(F.lit(True), F.when(F.col("fate") == 3, 2).otherwise(1))
    return rows.withColumn("copy", F.explode(copies)).drop("fate", "copy")


def _close(layer: list) -> list:
    """The layer, with the states that inserted turns reach."""
    for _ in range(3):
        for q, held in enumerate(list(layer)):
            if held is not None:
                more, to = (held[0] + INSERT, held[1], held[2] + "I"), _ASKED[q]
                if layer[to] is None or more < layer[to]:
                    layer[to] = more
    return layer


class Paths:
    """The best path to each state as ``(cost, rank of its head, tail)``: its audit string is head + tail."""

    def __init__(self):
        self.layer, self.heads, self.rows = _close([(0, 0, ""), None, None, None]), [[(0, "")]], 0

    def step(self, initial: str, fault: str) -> None:
        new: list = [None] * 4
        extra, must_go = TRUNCATED * (fault == "truncated"), fault in ("blank", "duplicate")
        for q, held in enumerate(self.layer):
            if held is None:
                continue
            cost, head, tail = held
            offers = [(q, (cost + DELETE, head, tail + "D"))]
            if not must_go:
                offers.append((_ASKED[q], (cost + REROLE + extra, head, tail + "R")))
                if initial in _KEEP[q]:
                    offers.append((_KEEP[q][initial], (cost + extra, head, tail + "K")))
            for to, offer in offers:
                if new[to] is None or offer < new[to]:
                    new[to] = offer
        self.layer = _close(new)
        self.rows += 1
        if self.rows % BLOCK == 0:
            self._cut()

    def _cut(self) -> None:
        """Heads end with the last row's edit, so none begins another and their order is that of whatever follows them."""
        parts = [held and (held[1], held[2].rstrip("I")) for held in self.layer]
        order = sorted({p for p in parts if p})
        self.heads.append(order)
        self.layer = [held and (held[0], order.index(p), held[2][len(p[1]) :]) for held, p in zip(self.layer, parts, strict=True)]

    def best(self) -> tuple[int, str]:
        """The cost and audit string of the cheapest legal path."""
        cost, rank, tail = min(self.layer[q] for q in _FINAL if self.layer[q] is not None)
        parts = [tail]
        for block in reversed(self.heads):
            rank, part = block[rank]
            parts.append(part)
        return cost, "".join(reversed(parts))


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (*[pa.int64()] * 7, pa.string())
    names = [c.split(" ")[0] for c in _PLAN.split(", ")]
    out: list[tuple] = []
    held = None  # conversation, paths, counts of faults, illegal pairs, last initial, lowest, highest and last turn, turns

    def packed() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        out.clear()
        return batch

    def ended() -> None:
        cost, audit = held["paths"].best()
        gaps = held["last"] - held["first"] + 1 - held["turns"] if held["turns"] else 0
        out.append((held["id"], gaps, held["blank"], held["duplicate"], held["truncated"], held["illegal"], cost, audit))

    for batch in batches:
        for conv, turn, initial, fault, present in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held is None or held["id"] != conv:
                if held is not None:
                    ended()
                held = {"id": conv, "paths": Paths(), "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "initial": None, "first": None, "last": None, "turns": 0}
            if not present:
                continue
            if turn is not None and turn != held["last"]:
                held["first"] = turn if held["first"] is None else held["first"]
                held["last"], held["turns"] = turn, held["turns"] + 1
            if held["initial"] is not None and held["initial"] + initial not in ("su", "ua", "au"):
                held["illegal"] += 1
            held["initial"] = initial
            if fault:
                held[fault] += 1
            held["paths"].step(initial, fault)
        if len(out) >= _OUT_ROWS or sum(len(r[-1]) for r in out) >= _OUT_BYTES:
            yield packed()
    if held is not None:
        ended()
    if out:
        yield packed()


def _numbered(turns: DataFrame, present: Column | None) -> DataFrame:
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"), (F.lit(True) if present is None else F.coalesce(present, F.lit(False))).alias("present"))
    return rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))


def plan_repairs(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit`` of each conversation in rows ``conv_id, turn, role, text``."""
    rows = _numbered(turns, present)
    said = F.rtrim(F.col("text"), F.lit(BLANKS))
    state = F.when(said == "", "blank").when(~F.right(said, F.lit(1)).isin(".", "!", "?"), "truncated")
    rows = rows.select("conv_id", "turn", "role", "present", "digest", state.alias("state"))
    seen = F.row_number().over(Window.partitionBy("conv_id", "present", "role", "digest").orderBy("turn"))
    fault = F.when(F.col("state") == "blank", "blank").when(seen > 1, "duplicate").otherwise(F.coalesce("state", F.lit("")))
    rows = rows.select("conv_id", "turn", "role", "digest", "present", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))
    # Of equal rows the first found is the original, so it comes first here as well.
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "digest", (F.col("fault") == "duplicate").cast("int"))
    return map_arrow(rows.select("conv_id", "turn", "initial", "fault", "present"), _plans, _PLAN)


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
    out: list[tuple] = []
    size = 0
    conv, audit, at, position, state = None, None, 0, 0, 0

    def give(edit: str, role: str, text: str) -> None:
        nonlocal position, state, size
        out.append((conv, position, edit, role, text))
        position, size = position + 1, size + len(text) + 64
        state = _KEEP[state][role[:1]] if edit == "K" else _ASKED[state]

    def asked() -> str:
        return "assistant" if state == 2 else "user"

    def insert() -> None:
        nonlocal at
        while audit is not None and audit[at : at + 1] == "I":
            give("I", asked(), "")
            at += 1

    def packed() -> pa.RecordBatch:
        nonlocal size
        batch = pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "position", "edit", "role", "text"])
        out.clear()
        size = 0
        return batch

    for batch in batches:
        for conv_id, role, text, plan in zip(*batch.columns, strict=True):
            plan = plan.as_py()
            if plan is not None:
                insert()
                conv, audit, at, position, state = conv_id.as_py(), plan, 0, 0, 0
                continue
            insert()
            edit = audit[at]
            at += 1
            if edit == "K":
                give("K", role.as_py(), text.as_py())
            elif edit == "R":
                give("R", asked(), text.as_py())
            if size >= _OUT_BYTES:
                yield packed()
    insert()
    if out:
        yield packed()


def repaired(turns: DataFrame, plans: DataFrame, present: Column | None = None) -> DataFrame:
    """The turns after ``plans``' edits: ``conv_id, position, edit, role, text``, a conversation's in order within one partition."""
    rows = _numbered(turns, present).where("present").select("conv_id", "turn", "role", "digest", "text", F.lit(None).cast("string").alias("audit"), F.lit(1).alias("kind"))
    first = plans.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"), F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("string").alias("text"), "audit", F.lit(0).alias("kind"))
    both = first.unionByName(rows).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return map_arrow(both.select("conv_id", "role", "text", "audit"), _repaired, "conv_id long, position long, edit string, role string, text string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.string())
    out: list[tuple] = []
    conv, told = None, None

    def packed() -> pa.RecordBatch:
        batch = pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["conv_id", "sha"])
        out.clear()
        return batch

    for batch in batches:
        for conv_id, position, role, text in zip(*batch.columns, strict=True):
            if position.as_py() == 0:
                if told is not None:
                    out.append((conv, told.hexdigest()))
                conv, told = conv_id.as_py(), hashlib.sha256()
            else:
                told.update(b"\n")
            told.update(f"{role.as_py()}:{text.as_py()}".encode())
        if len(out) >= _OUT_ROWS:
            yield packed()
    if told is not None:
        out.append((conv, told.hexdigest()))
    if out:
        yield packed()


def repairs(turns: DataFrame, present: Column | None = None) -> DataFrame:
    """The plans (written to the shared folder, as they are used twice) with ``repaired_sha256``, the digest of the repaired turns as ``role:text`` lines."""
    plans = materialize(plan_repairs(turns, present), "repairs")
    told = map_arrow(repaired(turns, plans, present).select("conv_id", "position", "role", "text"), _digests, "conv_id long, sha string").withColumnRenamed("conv_id", "told_id")
    both = plans.join(told, F.col("conv_id").eqNullSafe(F.col("told_id")), "left")
    return both.select(*plans.columns, F.coalesce("sha", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
