"""Nested JSON values: sensitive keys and values at any depth, changed dot paths, leaves, exploded arrays.

``sanitize`` and ``changed_paths`` walk one row's value in Arrow batches and move nothing
between tasks. ``leaves`` and ``members`` use VARIANT: each level of all rows is one lateral
``variant_explode``, so there are as many rounds as levels.

Paths are ``key.key[0].key``. A text that is no JSON, or nested deeper than the parser goes, has
status ``invalid`` and null results; a null text is null.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shared import materialize

#: Parts of sensitive keys, signs of sensitive values, what stands for them, deepest level.
KEY_PARTS = ("api_key", "access_key", "secret", "session_token", "token", "password", "private_key", "credential", "dsn", "service_account")
VALUE_SIGNS = ("bearer ", "-----begin")
REDACTED, DEGRADED, MAX_DEPTH = "[REDACTED]", "[DEGRADED: depth limit exceeded]", 100


def _sensitive(key: str | None, value: object) -> bool:
    if key is not None and any(part in key.lower() for part in KEY_PARTS):
        return True
    return isinstance(value, str) and any(sign in value.lower() for sign in VALUE_SIGNS)


class _Walk:
    """Sanitizes one value; ``keep`` leaves a mark where something was hidden, else it is left out."""

    def __init__(self, keep: bool, most: int):
        self.keep, self.most, self.hidden, self.degraded, self.paths = keep, most, 0, 0, []

    def item(self, out: dict | list, key: str | None, value: object, path: str, depth: int) -> None:
        mark = None
        if _sensitive(key, value):
            mark = REDACTED
            self.hidden += 1
        elif isinstance(value, (dict, list)):
            if depth + 1 >= self.most:
                mark = DEGRADED
                self.degraded += 1
            else:
                value = self.inside(value, path, depth + 1)
        if mark is not None:
            if mark == REDACTED or self.keep:
                self.paths.append(path)
            if not self.keep:
                return
            value = mark
        if isinstance(out, dict):
            out[key] = value
        else:
            out.append(value)

    def inside(self, value: dict | list, path: str, depth: int) -> dict | list:
        out: dict | list = type(value)()
        pairs = value.items() if isinstance(value, dict) else ((None, v) for v in value)
        for i, (key, v) in enumerate(pairs):
            self.item(out, key, v, f"{path}[{i}]" if key is None else f"{path}.{key}" if path else key, depth)
        return out


def _changed(old: object, new: object, path: str, out: list[str]) -> None:
    if isinstance(old, dict) and isinstance(new, dict):
        for key in old.keys() | new.keys():
            _changed(old.get(key), new.get(key), f"{path}.{key}" if path else key, out)
    elif isinstance(old, list) and isinstance(new, list) and len(old) == len(new):
        for i, (a, b) in enumerate(zip(old, new, strict=True)):
            _changed(a, b, f"{path}[{i}]", out)
    elif path and (type(old) is not type(new) and {type(old), type(new)} != {int, float} or old != new):
        out.append(path)


def _rowwise(rows: DataFrame, f: Callable[..., tuple], schema: str, kinds: list[pa.DataType]) -> DataFrame:
    """``rows`` (a key and texts) with ``f`` of the parsed texts; ``None`` from it, or a text that can't be parsed, gives an invalid row."""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for texts in zip(*(c.to_pylist() for c in batch.columns[1:]), strict=True):
                try:
                    out.append(("ok", *f(*(None if t is None else json.loads(t) for t in texts))))
                except (ValueError, RecursionError):
                    out.append(("invalid", *[None] * (len(kinds) - 1)))
            yield pa.record_batch([batch.column(0), *(pa.array(x, k) for x, k in zip(list(zip(*out, strict=True)) or [[]] * len(kinds), kinds, strict=True))], names=names)

    return rows.mapInArrow(run, schema)


def sanitize(rows: DataFrame, key: str, column: str, remove: bool = False, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``key, status, sanitized, hidden, degraded, paths``: sensitive members replaced (or removed), counted and listed in order."""

    def one(value: object) -> tuple:
        walk = _Walk(not remove, max_depth)
        if isinstance(value, (dict, list)):
            if max_depth <= 0:
                return json.dumps({} if remove else {"_root": DEGRADED}), 0, 1, [] if remove else ["_root"]
            value = walk.inside(value, "", 0)
        return None if value is None else json.dumps(value, ensure_ascii=False, separators=(",", ":")), walk.hidden, walk.degraded, walk.paths

    kind = rows.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, status string, sanitized string, hidden long, degraded long, paths array<string>"
    return _rowwise(rows.select(key, F.col(column).cast("string")), one, schema, [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string())])


def changed_paths(rows: DataFrame, key: str, old: str, new: str) -> DataFrame:
    """``key, status, changed``: sorted paths at which two values differ; a missing member is null, lists of unequal length differ as a whole."""

    def one(a: object, b: object) -> tuple:
        out: list[str] = []
        _changed(a, b, "", out)
        return (sorted(out),)

    kind = rows.schema[key].dataType.simpleString()
    return _rowwise(rows.select(key, F.col(old).cast("string"), F.col(new).cast("string")), one, f"{key} {kind}, status string, changed array<string>", [pa.string(), pa.list_(pa.string())])


def _inside(spark, level: DataFrame) -> DataFrame:
    return spark.sql(
        "SELECT id, CASE WHEN is_list THEN concat(path, '[', x.pos, ']') WHEN path = '' THEN x.key ELSE concat(path, '.', x.key) END AS path, x.value AS value "
        "FROM {level}, LATERAL variant_explode({level}.value) AS x", level=level)  # fmt: skip


def leaves(rows: DataFrame, key: str, column: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``key, path, kind, value`` of every member that holds no others; empty objects and lists count as such. Containers below ``max_depth`` levels are given as text."""
    spark = rows.sparkSession
    level = rows.select(F.col(key).alias("id"), F.lit("").alias("path"), F.try_parse_json(F.col(column)).alias("value")).where("value IS NOT NULL")
    out = None
    for depth in range(max_depth + 1):
        kind = F.schema_of_variant("value")
        level = level.withColumn("text", F.to_json("value")).withColumn("is_list", kind.startswith("ARRAY")).withColumn("held", (kind.startswith("ARRAY") | kind.startswith("OBJECT")) & ~F.col("text").isin("[]", "{}"))
        level = materialize(level.withColumn("kind", F.split(kind, "<")[0]), "level")
        done = level.where("NOT held" if depth < max_depth else "true").select("id", "path", F.lower("kind").alias("kind"), F.col("text").alias("value"))
        out = done if out is None else out.unionByName(done)
        level = level.where("held").select("id", "path", "is_list", "value")
        if level.isEmpty():
            break
        level = _inside(spark, level)
    return out.withColumnRenamed("id", key)


def members(rows: DataFrame, key: str, column: str, array: str, fields: dict[str, str]) -> DataFrame:
    """A row for each member of the list ``array`` of a JSON object, with its ``fields`` (name to type); values of another type are null."""
    parsed = rows.select(F.col(key), F.try_variant_get(F.try_parse_json(F.col(column)), f"$.{array}", "variant").alias("items"))
    found = rows.sparkSession.sql(f"SELECT p.{key} AS {key}, x.pos AS pos, x.value AS value FROM {{p}} AS p, LATERAL variant_explode(p.items) AS x", p=parsed)
    return found.select(key, "pos", *(F.try_variant_get("value", f"$.{f}", t).alias(f) for f, t in fields.items()))
