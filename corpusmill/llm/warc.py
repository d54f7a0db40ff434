"""WARC archives: a data source that writes one gzip member per record and reads them back in sequence.

``pages.write.format("warc")`` writes one archive per task, and further ones as each reaches
``roll`` bytes. File names carry a fresh token, and the commit writes a manifest of the files of
successful attempts: a task that is lost and run again leaves files that no manifest names.
Nothing is renamed, so object stores serve as well. Paths are of any file system that pyarrow
opens (``file``, ``hdfs``, ``s3``, ``gs``) and driver and executors share.

The reader (``spark.read.format("warc")``) takes one archive per partition and reads it in
pieces of ``PIECE`` bytes through incremental zlib decompression. Where a gzip member ends the
next begins; inside one, the header block ends with a blank line and ``Content-Length`` frames
the record. One record is held at a time. SHA-256 digests of block and payload are computed
anew and compared; ``status`` is ``ok``, ``digest`` (one differs), ``frame`` (the length or the header
doesn't fit the member) or ``truncated`` (the archive ends or breaks inside a member; what follows in
that file can't be read). A folder without manifest is read by its ``*.warc.gz`` names.

``with_revisits`` decides which records are responses: of equal payloads of ``LEAST`` bytes or
more, those with the smallest page id; the others are revisits that refer to it and hold the HTTP
header alone, whose ``Content-Length`` tells the payload's size. Digests are grouped before
they meet the rows, so a payload that a third of all rows have is no hot group: only digests that
occur twice are kept, and they are broadcast up to a checked size or else joined, where AQE
splits a skewed side. Rows that repeat the smallest id with the same payload are all responses;
a null id is larger than any other. Null payloads are empty, null urls are left out, control
characters and blanks in urls are percent-encoded, so no url can forge a header. An empty table
gives an empty archive; other columns are ignored. Texts are written whole.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .scratch import BATCH_BYTES, small

#: Payloads of fewer bytes are always responses.
LEAST = 100
#: Bytes of one read, and of an archive before the next begins.
PIECE, ROLL = 1 << 20, 128 << 20
MANIFEST = "_manifest.json"
_ID = "urn:x-page:"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_READ = "record_id string, record_type string, target_uri string, refers_to string, payload binary, payload_bytes long, payload_digest string, status string, archive string"
_CONTROL = re.compile(r"[\x00-\x20\x7f]")


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``page_id, url, payload, record_type, refers_to`` from rows ``page_id, url, html``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    # Short payloads have no key: they are never joined.
    rows = rows.withColumn("key", F.when(F.octet_length("payload") >= least, F.unhex(F.sha2("payload", 256))))
    found = rows.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("n"), F.min("page_id").alias("first")).where("n > 1").select("key", "first")
    rows = rows.join(small(found), "key", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return rows.select("page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One uncompressed record."""
    told = hashlib.sha256(payload).hexdigest()
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>"]
    if url is not None:
        head.append("WARC-Target-URI: " + _CONTROL.sub(lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Date: {date}")
    if revisit:
        head += [f"WARC-Profile: {_REVISIT}", f"WARC-Refers-To: <{_ID}{refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{told}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """The archives of one attempt: name, records, bytes."""

    files: list = field(default_factory=list)


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.path, self.date = options["path"].rstrip("/"), options.get("date", "2024-01-01T00:00:00Z")
        self.roll, self.level, self.overwrite = int(options.get("roll", ROLL)), int(options.get("level", 6)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        done, out, name, records, size = Written(), None, "", 0, 0
        try:
            for batch in iterator:
                columns = {n.lower(): batch.column(i) for i, n in enumerate(batch.schema.names)}
                for page_id, url, payload, kind, refers_to in zip(*(columns[c] for c in ("page_id", "url", "payload", "record_type", "refers_to")), strict=True):
                    if out is None:
                        name, records, size = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = system.open_output_stream(f"{root}/{name}", compression=None)
                    data = _member(record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), kind.as_py() == "revisit", self.date), self.level)
                    out.write(data)
                    records, size = records + 1, size + len(data)
                    if size >= self.roll:
                        out.close()
                        done.files.append([name, records, size])
                        out = None
        finally:
            if out is not None:
                out.close()
        if out is not None:
            done.files.append([name, records, size])
        return done

    def commit(self, messages: list) -> None:
        system, root = _open(self.path)
        system.create_dir(root, recursive=True)
        manifest, files = f"{root}/{MANIFEST}", [f for m in messages if m is not None for f in m.files]
        if not self.overwrite and system.get_file_info(manifest).type == fs.FileType.File:
            with system.open_input_stream(manifest) as old:
                files = json.loads(old.read())["files"] + files
        with system.open_output_stream(manifest) as new:
            new.write(json.dumps({"files": sorted(files)}).encode())

    def abort(self, messages: list) -> None:
        system, root = _open(self.path)
        for name, _, _ in [f for m in messages if m is not None for f in m.files]:
            system.delete_file(f"{root}/{name}")


@dataclass
class _Archive(InputPartition):
    uri: str


def _members(source) -> Iterator[tuple[bytes, bool]]:
    """The decompressed bytes of each member, and whether it ended."""
    z, parts, inside = zlib.decompressobj(31), [], False
    while piece := source.read(PIECE):
        while piece:
            inside = True
            try:
                parts.append(z.decompress(piece))
            except zlib.error:
                yield b"".join(parts), False
                return
            piece = b""
            if z.eof:
                yield b"".join(parts), True
                piece, z, parts, inside = z.unused_data, zlib.decompressobj(31), [], False
    if inside:
        yield b"".join(parts), False


def _headers(block: bytes) -> dict[str, str]:
    lines = block.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parse_record(data: bytes, ended: bool = True) -> tuple:
    """``record_id, record_type, target_uri, refers_to, payload, payload_bytes, payload_digest, status`` of one member."""
    if not ended:
        return None, None, None, None, None, None, None, "truncated"
    stop = data.find(b"\r\n\r\n")
    head = _headers(data[:stop]) if stop >= 0 and data.startswith(b"WARC/1.") else {}
    size = head.get("content-length", "")
    if not size.isdigit() or len(data) != stop + 8 + int(size) or not data.endswith(b"\r\n\r\n"):
        return head.get("warc-record-id", "").strip("<>") or None, head.get("warc-type"), head.get("warc-target-uri"), None, None, None, None, "frame"
    block = data[stop + 4 : -4]
    cut = block.find(b"\r\n\r\n") + 4 if head.get("content-type", "").startswith("application/http") else 0
    payload, revisit = block[cut:], head.get("warc-type") == "revisit"
    told = head.get("warc-payload-digest", "").removeprefix("sha256:")
    sound = head.get("warc-block-digest", "sha256:").removeprefix("sha256:") in ("", hashlib.sha256(block).hexdigest())
    if revisit:
        count = _headers(block[:cut]).get("content-length", "")
        length, digest, payload = int(count) if count.isdigit() else None, told or None, None
    else:
        length, digest = len(payload), hashlib.sha256(payload).hexdigest()
        sound = sound and told in ("", digest)
    return head.get("warc-record-id", "").strip("<>") or None, head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-refers-to", "").strip("<>") or None, payload, length, digest, "ok" if sound else "digest"


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].rstrip("/")

    def partitions(self) -> list[_Archive]:
        system, root = _open(self.path)
        if system.get_file_info(root).type == fs.FileType.File:
            return [_Archive(self.path)]
        if system.get_file_info(f"{root}/{MANIFEST}").type == fs.FileType.File:
            with system.open_input_stream(f"{root}/{MANIFEST}") as told:
                names = [f[0] for f in json.loads(told.read())["files"]]
        else:
            names = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(root)) if i.base_name.endswith(".warc.gz"))
        return [_Archive(f"{self.path}/{n}") for n in names] or [_Archive("")]

    def read(self, partition: _Archive) -> Iterator[pa.RecordBatch]:
        if not partition.uri:
            return
        names, kinds = zip(*(c.split(" ") for c in _READ.split(", ")), strict=True)
        kinds = [{"string": pa.string(), "binary": pa.binary(), "long": pa.int64()}[k] for k in kinds]
        rows, held = [], 0

        def packed() -> pa.RecordBatch:
            return pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=list(names))

        system, path = _open(partition.uri)
        with system.open_input_stream(path, compression=None) as source:
            for data, ended in _members(source):
                rows.append((*parse_record(data, ended), partition.uri.rsplit("/", 1)[-1]))
                held += len(rows[-1][4] or b"") + 200
                if held >= BATCH_BYTES:
                    yield packed()
                    rows, held = [], 0
        if rows:
            yield packed()


class Warc(DataSource):
    """``format("warc")``; options ``path``, and for writing ``date``, ``roll`` (bytes of an archive) and ``level`` (of compression)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _READ

    def reader(self, schema) -> _Reader:
        return _Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(dict(self.options), overwrite)


def write_warc(pages: DataFrame, path: str, mode: str = "append", **options) -> None:
    """``pages(page_id, url, html)`` as archives in the folder ``path``."""
    pages.sparkSession.dataSource.register(Warc)
    with_revisits(pages).write.format("warc").mode(mode).options(**{k: str(v) for k, v in options.items()}).save(path)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of an archive or a folder of them: ``record_id, record_type, target_uri, refers_to, payload, payload_bytes, payload_digest, status, archive``."""
    spark.dataSource.register(Warc)
    return spark.read.format("warc").load(path)


def page_records(records: DataFrame) -> DataFrame:
    """A row for each page of archives that ``write_warc`` made; raises where a record is broken."""
    page = lambda c: F.when(F.col(c).startswith(_ID), F.expr(f"try_cast(substring({c}, {len(_ID) + 1}) AS bigint)"))
    sound = F.when(F.col("status") == "ok", page("record_id")).otherwise(F.raise_error(F.concat(F.lit("broken record in "), "archive", F.lit(": "), "status")).cast("long"))
    return records.select(sound.alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))
