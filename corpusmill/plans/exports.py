"""Queries of exports: a run of typed artifacts written and read back, bulk actions, signed batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import chunking, versions as V
from ..shared import fresh_path
from ..sources import artifacts as A, sinks
from . import base, kb

QUERIES, SQL = {}, {}
SECRET = "webhook-secret"


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def _artifacts(spark, sf):
    """The latest version of every document, its chunks, and the state of retrieval."""
    v = V.latest(kb.versions(spark, sf).select("document_id", "version_number", "doc_id", "kb", "source", "uri", "text"))
    digest = F.sha2("text", 256)
    c = chunking.char_windows(v.select("doc_id", "uri", "text"))
    return {
        "chunks": c.select(F.concat_ws("-", "doc_id", "chunk_index").alias("chunk_id"), F.col("doc_id").alias("document_version_id"), F.col("uri").alias("document_uri"), "chunk_index", F.col("chunk").alias("text"), "char_start", "char_end", F.lit(None).cast("string").alias("heading")),
        "document_versions": v.select(F.col("doc_id").alias("document_version_id"), "document_id", "version_number", digest.alias("content_hash"), F.lit("plaintext").alias("parser_name"), F.col("uri").alias("document_uri"), F.col("source").alias("source_uri")),
        "documents": v.select("document_id", F.col("kb").alias("knowledge_base_id"), F.col("source").alias("source_id"), F.col("uri").alias("document_uri"), digest.alias("content_hash"), F.lit("text/plain").alias("mime_type")),
        "retrieval_status": spark.createDataFrame([("unsupported", "retrieval reports are not exported")], "status string, reason string"),
    }


_COUNTS = base._LATEST + """, c AS (SELECT doc_id, i, substr(text, CAST(i * 450 + 1 AS INTEGER), 500) AS text FROM (SELECT *, unnest(range(0, greatest(CAST(ceil((length(text) - 50) / 450.0) AS BIGINT), 1))) AS i FROM l WHERE length(text) > 0)),
t AS (SELECT 'chunks' AS artifact, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM c UNION ALL SELECT 'document_versions', count(*), CAST(sum(length(uri)) AS BIGINT) FROM l UNION ALL SELECT 'documents', count(*), CAST(sum(length(uri)) AS BIGINT) FROM l UNION ALL SELECT 'retrieval_status', 1, length('unsupported'))"""


@query(_COUNTS + " SELECT artifact, kind, 'uploaded' AS status, n AS rows_told, n AS rows_read, chars FROM t, (SELECT unnest(['jsonl', 'parquet']) AS kind)")
def export_artifacts(spark: SparkSession, sf: str) -> DataFrame:
    """Four artifacts in two formats: what the run's log tells of each, and what its files hold when they are read back."""
    made, root = _artifacts(spark, sf), fresh_path(spark, "export")
    log = A.export_run(spark, made, root, "run-1")
    measured = {"chunks": "text", "document_versions": "document_uri", "documents": "document_uri", "retrieval_status": "status"}
    out = None
    for name, rows in made.items():
        for kind in A.FORMATS:
            held = A.read_artifact(spark, f"{root}/run-1/{name}.{kind}", rows.schema)
            one = held.agg(F.count("*").alias("rows_read"), F.sum(F.length(measured[name])).cast("long").alias("chars")).select(F.lit(name).alias("artifact"), F.lit(kind).alias("kind"), "rows_read", "chars")
            out = one if out is None else out.unionByName(one)
    return out.join(F.broadcast(log.select("artifact", "kind", "status", F.col("rows").alias("rows_told"))), ["artifact", "kind"])


@query(_COUNTS + " SELECT artifact, kind, CASE kind WHEN 'jsonl' THEN 'skipped' ELSE 'uploaded' END AS again, n AS rows FROM t, (SELECT unnest(['jsonl', 'parquet']) AS kind)")
def export_again(spark: SparkSession, sf: str) -> DataFrame:
    """A second run into the same keys skips what is there; here the first wrote lines alone."""
    made, root = _artifacts(spark, sf), fresh_path(spark, "export")
    A.export_run(spark, made, root, "run-1", ("jsonl",))
    return A.export_run(spark, made, root, "run-1").select("artifact", "kind", F.col("status").alias("again"), "rows")


@query(kb.VERSIONS + """SELECT doc_id, sha256(json_object('index', json_object('_index', 'kb-' || kb, '_id', CAST(doc_id AS VARCHAR)))::VARCHAR || chr(10) || json_object('doc_id', doc_id, 'uri', uri, 'n_chars', length(text))::VARCHAR) AS lines_sha256 FROM v""")
def export_bulk(spark: SparkSession, sf: str) -> DataFrame:
    """The two lines of each version's bulk action; the index is its knowledge base's."""
    v = kb.versions(spark, sf)
    action = F.to_json(F.struct(F.struct(F.concat(F.lit("kb-"), "kb").alias("_index"), F.col("doc_id").cast("string").alias("_id")).alias("index")))
    document = F.to_json(F.struct("doc_id", "uri", F.length("text").alias("n_chars")))
    return v.select("doc_id", F.sha2(F.concat(action, F.lit("\n"), document), 256).alias("lines_sha256"))


def _pad(x: int) -> str:
    return "".join(f"\\x{b ^ x:02X}" for b in SECRET.encode().ljust(64, b"\0"))


@query(f"""WITH b AS (SELECT lang AS kb, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 100 AS batch, doc_id, source FROM documents),
j AS (SELECT kb, batch, count(*) AS n, '[' || string_agg(json_object('doc_id', doc_id, 'source', source)::VARCHAR, ',' ORDER BY doc_id) || ']' AS body FROM b GROUP BY 1, 2)
SELECT kb, batch, n, sha256(body) AS body_sha256, sha256('{_pad(0x5C)}'::BLOB || unhex(sha256('{_pad(0x36)}'::BLOB || encode(body)))) AS signature FROM j""")
def webhook_batches(spark: SparkSession, sf: str) -> DataFrame:
    d = kb.table(spark, sf, "documents").select(F.col("lang").alias("kb"), "doc_id", "source")
    return sinks.signed_batches(d, 100, SECRET, "kb", "doc_id").select("kb", "batch", "n", F.sha2("body", 256).alias("body_sha256"), "signature")
