"""Export artifacts: a data source whose write is seen whole or not at all, and runs of typed artifacts.

``rows.write.format("artifact")`` writes part files under fresh names and, when all tasks are done,
one manifest that lists the files of the attempts that counted, with rows, bytes and SHA-256. A task
that is lost and runs again leaves files that no manifest names, so its rows aren't read
twice; an aborted write leaves no manifest. Reading goes by the manifest and checks rows and digests.
Formats: ``jsonl`` (of one string column, a line each) and ``parquet``. Paths are of any file
system that pyarrow opens and driver and executors share.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

MANIFEST = "_manifest.json"
FORMATS = ("jsonl", "parquet")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def read_manifest(path: str) -> dict | None:
    """What a finished write left, or None."""
    system, root = _open(f"{path.rstrip('/')}/{MANIFEST}")
    if system.get_file_info(root).type != fs.FileType.File:
        return None
    with system.open_input_stream(root) as told:
        return json.loads(told.read())


@dataclass
class Written(WriterCommitMessage):
    files: list = field(default_factory=list)


class _Counted:
    """A stream that counts and digests what is written through it."""

    def __init__(self, out):
        self.out, self.size, self.told, self.closed = out, 0, hashlib.sha256(), False

    def write(self, data) -> int:
        self.size += len(data)
        self.told.update(data)
        return self.out.write(data) or len(data)

    def flush(self) -> None:
        self.out.flush()

    def tell(self) -> int:
        return self.size

    def close(self) -> None:
        if not self.closed:
            self.closed = True
            self.out.close()


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.kind, self.made_by = options["path"].rstrip("/"), options.get("kind", "jsonl"), options.get("run", "")
        if self.kind not in FORMATS:
            raise ValueError(f"kind must be one of {', '.join(FORMATS)}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open(self.path)
        out, writer, rows, name = None, None, 0, f"part-{uuid.uuid4().hex}.{self.kind}"
        try:
            for batch in iterator:
                if out is None:
                    system.create_dir(root, recursive=True)
                    out = _Counted(system.open_output_stream(f"{root}/{name}", compression=None))
                rows += batch.num_rows
                if self.kind == "parquet":
                    writer = writer or pq.ParquetWriter(pa.PythonFile(out, "w"), batch.schema, compression="zstd")
                    writer.write_batch(batch)
                else:
                    out.write("".join(f"{line}\n" for line in batch.column(0).to_pylist() if line is not None).encode())
        finally:
            if writer is not None:
                writer.close()
            if out is not None:
                out.close()
        return Written([{"name": name, "rows": rows, "bytes": out.size, "sha256": out.told.hexdigest()}] if out is not None else [])

    def commit(self, messages: list) -> None:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        files = sorted((f for m in messages if m is not None for f in m.files), key=lambda f: f["name"])
        told = {"kind": self.kind, "run": self.made_by, "rows": sum(f["rows"] for f in files), "bytes": sum(f["bytes"] for f in files), "files": files}
        with system.open_output_stream(f"{root}/{MANIFEST}") as out:
            out.write(json.dumps(told).encode())

    def abort(self, messages: list) -> None:
        system, root = _open(self.path)
        for f in [f for m in messages if m is not None for f in m.files]:
            system.delete_file(f"{root}/{f['name']}")


@dataclass
class _Part(InputPartition):
    path: str
    rows: int
    sha256: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema):
        self.path, self.names = path.rstrip("/"), schema.fieldNames()

    def partitions(self) -> list[_Part]:
        told = read_manifest(self.path)
        if told is None:
            raise ValueError(f"no finished artifact in {self.path}")
        self.kind = told["kind"]
        return [_Part(f"{self.path}/{f['name']}", f["rows"], f["sha256"]) for f in told["files"]] or [_Part("", 0, "")]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        system, path = _open(part.path)
        told = hashlib.sha256()
        with system.open_input_stream(path, compression=None) as source:
            while piece := source.read(1 << 20):
                told.update(piece)
        if told.hexdigest() != part.sha256:
            raise ValueError(f"{part.path} isn't what was written")
        if part.path.endswith(".parquet"):
            yield from pq.ParquetFile(system.open_input_file(path)).iter_batches(batch_size=4096, columns=self.names)
            return
        with system.open_input_stream(path, compression=None) as source:
            rest = b""
            while piece := source.read(1 << 20):
                *lines, rest = (rest + piece).split(b"\n")
                if lines:
                    yield pa.record_batch([pa.array([x.decode() for x in lines])], names=["value"])


class Artifact(DataSource):
    """``format("artifact")``; options ``path``, ``kind`` and, kept in the manifest, ``run``. Parquet needs the schema to read."""

    @classmethod
    def name(cls) -> str:
        return "artifact"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], schema)

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options))


def write_artifact(rows: DataFrame, path: str, kind: str = "jsonl", run: str = "") -> dict:
    """``rows`` as one artifact in the folder ``path``, in place of what it held; gives its manifest."""
    rows.sparkSession.dataSource.register(Artifact)
    lines = rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("value")) if kind == "jsonl" else rows
    lines.write.format("artifact").mode("append").options(path=path, kind=kind, run=run).save()
    return read_manifest(path)


def read_artifact(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """An artifact's rows: lines as ``value``, or those of ``schema`` (parsed from lines, read from Parquet)."""
    spark.dataSource.register(Artifact)
    told = read_manifest(path)
    if told is not None and told["kind"] == "jsonl":
        lines = spark.read.format("artifact").options(path=path).load()
        return lines if schema is None else lines.select(F.from_json("value", schema).alias("v")).select("v.*")
    reader = spark.read.format("artifact").options(path=path)
    return (reader if schema is None else reader.schema(schema)).load()


_LOG = "artifact string, kind string, path string, status string, rows long, bytes long, error string"


def export_run(spark: SparkSession, artifacts: dict[str, DataFrame], root: str, run: str, kinds: tuple[str, ...] = FORMATS, overwrite: bool = False, dry_run: bool = False, template: str = "{run}/{artifact}.{kind}") -> DataFrame:
    """A run that writes every artifact in every format below ``root``; its log, one row each, is the result and its last artifact.

    Status: ``uploaded``, ``skipped`` (there already, and not to be overwritten), ``planned`` (dry run), ``failed``
    (with the error; the others go on). A markdown summary is written beside them.
    """
    log: list[Row] = []
    for name, rows in artifacts.items():
        for kind in kinds:
            path = f"{root.rstrip('/')}/{template.format(run=run, artifact=name, kind=kind)}"
            before = read_manifest(path)
            if dry_run:
                log.append(Row(name, kind, path, "planned", None, None, None))
            elif before is not None and not overwrite:
                log.append(Row(name, kind, path, "skipped", before["rows"], before["bytes"], None))
            else:
                try:
                    told = write_artifact(rows, path, kind, run)
                    log.append(Row(name, kind, path, "uploaded", told["rows"], told["bytes"], None))
                except Exception as e:  # noqa: BLE001  one artifact's failure is a row of the log
                    log.append(Row(name, kind, path, "failed", None, None, str(e).split("\n")[0][:500]))
    out = spark.createDataFrame(log, _LOG)
    if not dry_run:
        write_artifact(out.coalesce(1), f"{root.rstrip('/')}/{template.format(run=run, artifact='pipeline_runs', kind='jsonl')}", "jsonl", run)
        system, top = _open(f"{root.rstrip('/')}/{template.format(run=run, artifact='export_summary', kind='md')}")
        lines = [f"# Export {run}", "", "| artifact | format | status | rows |", "|---|---|---|---|", *(f"| {r[0]} | {r[1]} | {r[3]} | {'' if r[4] is None else r[4]} |" for r in log)]
        with system.open_output_stream(top) as md:
            md.write(("\n".join(lines) + "\n").encode())
    return out
