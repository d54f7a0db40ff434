"""Queries on versions, access, text functions, chunks, sources and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..functions.vectors import blend
from ..operators import acl, chunking, crawl, ordered, retrieval as R, versions as V
from . import kb

QUERIES, SQL = {}, {}
_ACL_SQL = """CASE WHEN visibility = 'public' THEN 'public' WHEN visibility = 'unknown' THEN 'unknown_visibility'
  WHEN list_has_any(denied, ['src0', 'group:en']) THEN 'explicit_deny' WHEN list_has_any(allowed, ['src0', 'group:en']) THEN 'principal_match' ELSE 'no_matching_principal' END"""
_LATEST = kb.VERSIONS + ", l AS (SELECT v.* FROM v JOIN (SELECT document_id, max(version_number) AS version_number FROM v GROUP BY 1) USING (document_id, version_number)) "


def query(sql: str | None = None):
    """Register a function as a query, with its DuckDB SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(_LATEST + "SELECT document_id, doc_id, version_number, kb, uri FROM l")
def latest_versions(spark: SparkSession, sf: str) -> DataFrame:
    return V.latest(kb.versions(spark, sf).select("document_id", "doc_id", "version_number", "kb", "uri")).select("document_id", "doc_id", "version_number", "kb", "uri")


@query("SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS version_number FROM documents")
def version_numbering(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers by ranges, so that a source of all rows is spread over tasks."""
    return ordered.number(kb.table(spark, sf, "documents").select("source", "doc_id"), ["source"], ["doc_id"], "version_number")


@query(kb.VERSIONS + f"SELECT doc_id, {_ACL_SQL} AS reason FROM v")
def acl_reason(spark: SparkSession, sf: str) -> DataFrame:
    return acl.with_decision(kb.versions(spark, sf), kb.REQUEST).select("doc_id", "reason")


@query(kb.VERSIONS + f"SELECT doc_id, uri FROM v WHERE {_ACL_SQL} IN ('public', 'principal_match')")
def acl_filter(spark: SparkSession, sf: str) -> DataFrame:
    return acl.with_decision(kb.versions(spark, sf), kb.REQUEST).where("permitted").select("doc_id", "uri")


@query(kb.VERSIONS + f", r AS (SELECT {_ACL_SQL} AS reason FROM v) SELECT reason, reason IN ('public', 'principal_match') AS permitted, count(*) AS n FROM r GROUP BY 1, 2")
def acl_report(spark: SparkSession, sf: str) -> DataFrame:
    return acl.report(kb.versions(spark, sf), kb.REQUEST)


@query(_LATEST + f", r AS (SELECT kb, {_ACL_SQL} AS reason FROM l) SELECT kb, count(*) AS total, count(*) FILTER (reason IN ('public', 'principal_match')) AS visible, count(*) FILTER (reason NOT IN ('public', 'principal_match')) AS filtered FROM r GROUP BY kb")
def permission_preview(spark: SparkSession, sf: str) -> DataFrame:
    rows = acl.with_decision(V.latest(kb.versions(spark, sf).drop("text")), kb.REQUEST)
    return rows.groupBy("kb").agg(F.count("*").alias("total"), F.count_if("permitted").alias("visible"), F.count_if(~F.col("permitted")).alias("filtered"))


@query(kb.VERSIONS + ", c AS (SELECT doc_id, visibility, allowed, text, unnest(range(0, greatest(CAST(ceil((length(text) - 50) / 450.0) AS BIGINT), 1))) AS chunk_index FROM v WHERE length(text) > 0) SELECT doc_id, chunk_index, visibility, array_to_string(allowed, ',') AS allowed, 'propagated' AS inheritance FROM c")
def acl_propagate(spark: SparkSession, sf: str) -> DataFrame:
    c = chunking.char_windows(kb.versions(spark, sf))
    return c.select("doc_id", "chunk_index", "visibility", F.array_join("allowed", ",").alias("allowed"), F.lit("propagated").alias("inheritance"))


@query("SELECT c_custkey, coalesce(CASE WHEN c_custkey % 4 = 0 THEN 'none' WHEN c_custkey % 4 = 1 THEN 'editor' END, 'viewer') AS role FROM customer")
def effective_role(spark: SparkSession, sf: str) -> DataFrame:
    c = kb.table(spark, sf, "customer").select("c_custkey")
    own = c.where("c_custkey % 4 < 2").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "none").otherwise("editor").alias("own"))
    return c.join(own, "c_custkey", "left").select("c_custkey", F.coalesce("own", F.lit("viewer")).alias("role"))


@query("SELECT doc_id, CASE WHEN lower(source) = 'group:' || lang THEN lower(source) ELSE lower(source) || ',group:' || lang END AS principals FROM documents")
def principals(spark: SparkSession, sf: str) -> DataFrame:
    p = T.principals(F.array(F.concat(F.lit(" "), F.upper("source")), "source", F.concat(F.lit("group:"), "lang"), F.lit(" ")))
    return kb.table(spark, sf, "documents").select("doc_id", F.array_join(p, ",").alias("principals"))


@query("SELECT doc_id, CAST(len(w) AS BIGINT) AS n_tokens, CAST(len(list_distinct(w)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS w FROM documents)")
def tokenize(spark: SparkSession, sf: str) -> DataFrame:
    w = kb.table(spark, sf, "documents").select("doc_id", T.tokens(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query("SELECT doc_id, sha256(text) AS content_hash, CAST(length(text) AS BIGINT) AS n_chars, CAST(strlen(text) AS BIGINT) AS n_bytes, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines FROM documents")
def parse_text_stats(spark: SparkSession, sf: str) -> DataFrame:
    return kb.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("content_hash"), F.length("text").cast("long").alias("n_chars"), F.octet_length("text").cast("long").alias("n_bytes"), F.size(F.split("text", "\n")).cast("long").alias("n_lines"))


@query("SELECT doc_id, sha256('p1:local:m1:' || text) AS input_hash FROM documents")
def content_hash(spark: SparkSession, sf: str) -> DataFrame:
    return kb.table(spark, sf, "documents").select("doc_id", F.sha2(F.concat(F.lit("p1:local:m1:"), "text"), 256).alias("input_hash"))


_PII_SQL = "SELECT doc_id, " + ", ".join(f"CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS n_{n}" for n, p in [(x[5:-1].lower(), y) for x, y in T.PII if x in ("[PII_EMAIL]", "[PII_CC]", "[PII_IP]", "[PII_NI]")]) + " FROM documents"


@query(_PII_SQL)
def pii_scan(spark: SparkSession, sf: str) -> DataFrame:
    named = [(n[5:-1].lower(), p) for n, p in T.PII if n in ("[PII_EMAIL]", "[PII_CC]", "[PII_IP]", "[PII_NI]")]
    return kb.table(spark, sf, "documents").select("doc_id", *(F.regexp_count("text", F.lit(p)).cast("long").alias(f"n_{n}") for n, p in named))


@query()
def pii_redact(spark: SparkSession, sf: str) -> DataFrame:
    text, hits = T.redact(F.col("text"))
    return kb.table(spark, sf, "documents").select("doc_id", F.sha2(text, 256).alias("redacted_sha256"), hits.alias("n_hits"))


def _secret_sql() -> str:
    """Each pattern counts and replaces in the text that the one before left."""
    step, steps = "s0 AS (SELECT doc_id, text AS t, 0 AS h FROM documents)", []
    for i, (pattern, replacement) in enumerate(T.SECRETS):
        p, r = pattern.replace("'", "''"), replacement.replace("$1", "\\1")
        steps.append(f"s{i + 1} AS (SELECT doc_id, regexp_replace(t, '{p}', '{r}', 'g') AS t, h + len(regexp_extract_all(t, '{p}')) AS h FROM s{i})")
    return f"WITH {step}, {', '.join(steps)} SELECT doc_id, CASE WHEN length(t) > 80 THEN substr(t, 1, 80) || '…' ELSE t END AS summary, CAST(h AS BIGINT) AS n_hits FROM s{len(T.SECRETS)}"


@query(_secret_sql())
def secret_summary(spark: SparkSession, sf: str) -> DataFrame:
    text, hits = T.secret_summary(F.col("text"))
    return kb.table(spark, sf, "documents").select("doc_id", text.alias("summary"), hits.alias("n_hits"))


@query("SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS basename, sha256(url) AS sha256, regexp_extract(url, '^([a-z]+):', 1) AS scheme FROM pages")
def safe_locator(spark: SparkSession, sf: str) -> DataFrame:
    return kb.table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "([^/]*)$", 1).alias("basename"), F.sha2("url", 256).alias("sha256"), F.regexp_extract("url", "^([a-z]+):", 1).alias("scheme"))


_COLLAPSED = "trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g'))"


@query(f"SELECT doc_id, CASE WHEN length({_COLLAPSED}) > 220 THEN substr({_COLLAPSED}, 1, 217) || '...' ELSE {_COLLAPSED} END AS preview, substr(text, 1, 160) AS head FROM documents")
def preview(spark: SparkSession, sf: str) -> DataFrame:
    return kb.table(spark, sf, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"), F.substring("text", 1, 160).alias("head"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) END AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf: str) -> DataFrame:
    return kb.table(spark, sf, "documents").select("doc_id", T.token_estimate(F.col("text")).alias("tokens"))


@query("""WITH t AS (SELECT doc_id, lang, source, greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) AS tokens FROM documents),
r(provider, model, rate) AS (VALUES ('en', 'src1', 0.03), ('en', '*', 0.01), ('de', '*', 0.02))
SELECT doc_id, tokens, round(tokens / 1000.0 * coalesce(a.rate, b.rate), 8) AS cost, coalesce(a.rate, b.rate) IS NULL AS rate_missing
FROM t LEFT JOIN r a ON a.provider = lang AND a.model = source LEFT JOIN r b ON b.provider = lang AND b.model = '*'""")
def cost_estimate(spark: SparkSession, sf: str) -> DataFrame:
    card = spark.createDataFrame([("en", "src1", 0.03), ("en", "*", 0.01), ("de", "*", 0.02)], "provider string, model string, rate double")
    t = kb.table(spark, sf, "documents").select("doc_id", "lang", "source", T.token_estimate(F.col("text")).alias("tokens"))
    a = F.broadcast(card.where("model <> '*'").select(F.col("provider").alias("lang"), F.col("model").alias("source"), F.col("rate").alias("own")))
    b = F.broadcast(card.where("model = '*'").select(F.col("provider").alias("lang"), F.col("rate").alias("any")))
    rate = F.coalesce("own", "any")
    return t.join(a, ["lang", "source"], "left").join(b, "lang", "left").select("doc_id", "tokens", F.round(F.col("tokens") / 1000 * rate, 8).alias("cost"), rate.isNull().alias("rate_missing"))


@query("""SELECT DISTINCT name, trim(regexp_replace(regexp_replace(lower(regexp_replace(trim(name), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS canonical, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') AS compact
FROM (SELECT 'Node' || replace(p_name, ' ', '_') || p_brand AS name FROM part)""")
def entity_canonical(spark: SparkSession, sf: str) -> DataFrame:
    n = kb.table(spark, sf, "part").select(F.concat(F.lit("Node"), F.regexp_replace("p_name", " ", "_"), "p_brand").alias("name")).distinct()
    return n.select("name", T.canonical_name(F.col("name")).alias("canonical"), F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "").alias("compact"))


@query("SELECT DISTINCT lang, source, 'kb_' || trim(regexp_replace(lower(lang), '[^a-z0-9]+', '_', 'g'), '_') || '_' || trim(regexp_replace(lower(source), '[^a-z0-9]+', '_', 'g'), '_') || '_64d_' || substr(sha1(lang || '|' || source || '|64'), 1, 8) AS collection FROM documents")
def collection_name(spark: SparkSession, sf: str) -> DataFrame:
    d = kb.table(spark, sf, "documents").select("lang", "source").distinct()
    return d.select("lang", "source", F.concat(F.lit("kb_"), T.slug(F.col("lang")), F.lit("_"), T.slug(F.col("source")), F.lit("_64d_"), F.substring(F.sha1(F.concat_ws("|", "lang", "source", F.lit("64"))), 1, 8)).alias("collection"))


_WINDOWS = "SELECT doc_id, i AS chunk_index, i * {step} AS char_start, least(i * {step} + {size}, length(text)) AS char_end, sha256(substr(text, CAST(i * {step} + 1 AS INTEGER), {size})) AS chunk_hash FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - {overlap}) / {step}.0) AS BIGINT), 1))) AS i FROM documents WHERE length(text) > 0)"


def _windows(spark, sf, size, overlap):
    c = chunking.char_windows(kb.table(spark, sf, "documents"), size, overlap)
    return c.select("doc_id", "chunk_index", "char_start", "char_end", F.sha2("chunk", 256).alias("chunk_hash"))


@query(_WINDOWS.format(step=450, size=500, overlap=50))
def chunk_char_window(spark: SparkSession, sf: str) -> DataFrame:
    return _windows(spark, sf, 500, 50)


@query(_WINDOWS.format(step=12, size=12, overlap=0))
def sse_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = chunking.char_windows(kb.table(spark, sf, "documents").select("doc_id", "text"), 12, 0)
    return c.select("doc_id", "chunk_index", "char_start", "char_end", F.sha2("chunk", 256).alias("chunk_hash"))


@query("""WITH p AS (SELECT doc_id, j AS parent_index, j * 2000 AS shift, substr(text, CAST(j * 2000 + 1 AS INTEGER), 2000) AS t FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil(length(text) / 2000.0) AS BIGINT), 1))) AS j FROM documents WHERE length(text) > 0))
SELECT doc_id, parent_index, i * 450 + shift AS child_start, least(i * 450 + 500, length(t)) + shift AS child_end, sha256(substr(t, CAST(i * 450 + 1 AS INTEGER), 500)) AS chunk_hash
FROM (SELECT *, unnest(range(0, greatest(CAST(ceil((length(t) - 50) / 450.0) AS BIGINT), 1))) AS i FROM p)""")
def chunk_parent_child(spark: SparkSession, sf: str) -> DataFrame:
    c = chunking.parent_child(kb.table(spark, sf, "documents"))
    return c.select("doc_id", "parent_index", "child_start", "child_end", F.sha2("chunk", 256).alias("chunk_hash"))


def _chunked(spark, sf, chunker, text, **options):
    d = kb.table(spark, sf, "documents").select("doc_id", text.alias("text"))
    c = chunking.chunk_with(d, chunker, **options)
    return c.select("doc_id", "chunk_index", "char_start", "char_end", F.sha2("chunk", 256).alias("chunk_hash"))


@query()
def chunk_paragraph(spark: SparkSession, sf: str) -> DataFrame:
    return _chunked(spark, sf, chunking.paragraph_chunks, F.regexp_replace("text", "\n", "\n\n"))


@query()
def chunk_heading(spark: SparkSession, sf: str) -> DataFrame:
    return _chunked(spark, sf, chunking.heading_chunks, F.regexp_replace(F.concat(F.lit("# "), "text"), "\n", "\n## "))


@query()
def chunk_sentence(spark: SparkSession, sf: str) -> DataFrame:
    return _chunked(spark, sf, chunking.sentence_chunks, F.col("text"))


@query()
def chunk_recursive(spark: SparkSession, sf: str) -> DataFrame:
    return _chunked(spark, sf, chunking.recursive_chunks, F.regexp_replace("text", "\n", "\n\n"))


@query()
def chunk_token_aware(spark: SparkSession, sf: str) -> DataFrame:
    return _chunked(spark, sf, chunking.token_chunks, F.col("text"))


_OVERRIDE = """WITH o AS (SELECT doc_id, text, [0, 100, 200] AS starts, [100, 200, length(text)] AS ends FROM documents WHERE doc_id % 10 = 0 AND length(text) > 200),
c AS (SELECT doc_id, unnest([0, 1, 2]) AS chunk_index, text, starts, ends FROM o),
n AS (SELECT doc_id, unnest(range(0, greatest(CAST(ceil((length(text) - 50) / 450.0) AS BIGINT), 1))) AS chunk_index, text FROM documents WHERE length(text) > 0 AND doc_id NOT IN (SELECT doc_id FROM o))
SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, 'override' AS origin, sha256(substr(text, CAST(starts[chunk_index + 1] + 1 AS INTEGER), CAST(ends[chunk_index + 1] - starts[chunk_index + 1] AS INTEGER))) AS chunk_hash FROM c
UNION ALL SELECT doc_id, chunk_index, 'window', sha256(substr(text, CAST(chunk_index * 450 + 1 AS INTEGER), 500)) FROM n"""


@query(_OVERRIDE)
def chunk_override(spark: SparkSession, sf: str) -> DataFrame:
    """Ranges given by hand (here for every tenth longer document, in three parts that cover it) win over the windows that all others get."""
    d = kb.table(spark, sf, "documents").select("doc_id", "text")
    ranges = d.where("doc_id % 10 = 0 AND length(text) > 200").select("doc_id", F.to_json(F.array(*(F.struct(F.lit(a).alias("start"), (F.lit(b) if b else F.length("text")).alias("end")) for a, b in ((0, 100), (100, 200), (200, None))))).alias("ranges"))
    both = d.join(ranges, "doc_id", "left")
    own = both.where("ranges IS NOT NULL").select("doc_id", "text", F.posexplode(F.from_json("ranges", "array<struct<start:int,end:int>>")).alias("chunk_index", "s"))
    own = own.select("doc_id", F.col("chunk_index").cast("long"), F.lit("override").alias("origin"), F.sha2(F.col("text").substr(F.col("s.start") + 1, F.col("s.end") - F.col("s.start")), 256).alias("chunk_hash"))
    rest = chunking.char_windows(both.where("ranges IS NULL").select("doc_id", "text"))
    return own.unionByName(rest.select("doc_id", "chunk_index", F.lit("window").alias("origin"), F.sha2("chunk", 256).alias("chunk_hash")))


@query(_LATEST + "SELECT document_id, doc_id, uri, kb, sha256(text) AS content_hash FROM l")
def export_documents(spark: SparkSession, sf: str) -> DataFrame:
    return V.latest(kb.versions(spark, sf).select("document_id", "version_number", "doc_id", "uri", "kb", F.sha2("text", 256).alias("content_hash"))).drop("version_number")


@query(_LATEST + ", c AS (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 50) / 450.0) AS BIGINT), 1))) AS chunk_index FROM l WHERE length(text) > 0) SELECT doc_id, chunk_index, sha256(substr(text, CAST(chunk_index * 450 + 1 AS INTEGER), 500)) AS chunk_hash FROM c")
def export_chunks(spark: SparkSession, sf: str) -> DataFrame:
    v = kb.versions(spark, sf).select("document_id", "version_number", "doc_id", "text")
    # Only ids go through the aggregation; the texts are joined back by it.
    top = v.groupBy("document_id").agg(F.max("doc_id").alias("doc_id"))
    c = chunking.char_windows(v.join(top.select("doc_id"), "doc_id", "left_semi"))
    return c.select("doc_id", "chunk_index", F.sha2("chunk", 256).alias("chunk_hash"))


@query(kb.VERSIONS + "SELECT document_id, version_number, uri, created_at, CAST(length(text) AS BIGINT) AS n_chars FROM v")
def export_versions(spark: SparkSession, sf: str) -> DataFrame:
    return kb.versions(spark, sf).select("document_id", "version_number", "uri", "created_at", F.length("text").cast("long").alias("n_chars"))


@query("SELECT kb, batch, count(*) AS n, sha256(string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id)) AS digest FROM (SELECT lang AS kb, doc_id, (row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // 64 AS batch FROM documents) GROUP BY kb, batch")
def export_batches(spark: SparkSession, sf: str) -> DataFrame:
    d = ordered.batches(kb.table(spark, sf, "documents").select(F.col("lang").alias("kb"), "doc_id"), ["kb"], ["doc_id"], 64)
    ids = F.transform(F.array_sort(F.collect_list("doc_id")), lambda x: x.cast("string"))
    return d.groupBy("kb", "batch").agg(F.count("*").alias("n"), F.sha2(F.array_join(ids, ","), 256).alias("digest"))


@query("SELECT p_partkey, p_name, p_retailprice * 2 AS p_retailprice FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_partkey % 3 = 1")
def upsert_merge(spark: SparkSession, sf: str) -> DataFrame:
    p = kb.table(spark, sf, "part").select("p_partkey", "p_name", "p_retailprice")
    return V.upsert(p.where("p_partkey % 3 < 2"), p.where("p_partkey % 3 = 0").withColumn("p_retailprice", F.col("p_retailprice") * 2), "p_partkey")


@query(kb.VERSIONS + "SELECT n.document_id, CASE WHEN o.text IS NULL THEN 'new' WHEN sha256(o.text) = sha256(n.text) THEN 'unchanged' ELSE 'changed' END AS action FROM (SELECT * FROM v WHERE version_number = 2) n LEFT JOIN (SELECT * FROM v WHERE version_number = 1 AND document_id % 4 <> 0) o USING (document_id)")
def ingest_change_detect(spark: SparkSession, sf: str) -> DataFrame:
    v = kb.versions(spark, sf).select("document_id", "version_number", F.sha2("text", 256).alias("content_hash"))
    known, seen = v.where("version_number = 1 AND document_id % 4 <> 0"), v.where("version_number = 2")
    return V.plan_ingest(known, seen, "document_id").select("document_id", "action")


@query(kb.VERSIONS + "SELECT DISTINCT uri FROM v WHERE version_number = 1 AND uri NOT IN (SELECT uri FROM v WHERE version_number = 2)")
def delete_detect(spark: SparkSession, sf: str) -> DataFrame:
    v = kb.versions(spark, sf)
    return V.deleted(v.where("version_number = 1").select("uri").distinct(), v.where("version_number = 2").select("uri"))


@query("""SELECT s_suppkey, perm, CASE WHEN substr(perm, 1, 1) = 'r' AND substr(perm, 7, 1) = 'r' THEN 'public' WHEN substr(perm, 1, 1) <> 'r' THEN 'unknown' ELSE 'protected' END AS visibility
FROM (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'rw-r--r--' WHEN 1 THEN 'rw-------' ELSE '-wxr-xr-x' END AS perm FROM supplier)""")
def perm_to_acl(spark: SparkSession, sf: str) -> DataFrame:
    s = kb.table(spark, sf, "supplier").selectExpr("s_suppkey", "CASE s_suppkey % 3 WHEN 0 THEN 'rw-r--r--' WHEN 1 THEN 'rw-------' ELSE '-wxr-xr-x' END AS perm")
    own, other = F.substring("perm", 1, 1) == "r", F.substring("perm", 7, 1) == "r"
    return s.select("s_suppkey", "perm", F.when(own & other, "public").when(~own, "unknown").otherwise("protected").alias("visibility"))


@query("WITH q AS (SELECT c_custkey FROM customer WHERE c_acctbal > 0 ORDER BY c_custkey LIMIT 51) SELECT c_custkey, (SELECT count(*) > 50 FROM q) AS truncated FROM q ORDER BY c_custkey LIMIT 50")
def db_source_truncate(spark: SparkSession, sf: str) -> DataFrame:
    """The source reads one row over its limit to see whether it cuts: here the limit is the feature."""
    q = kb.table(spark, sf, "customer").where("c_acctbal > 0").select("c_custkey").orderBy("c_custkey").limit(51)
    n = q.agg((F.count("*") > 50).alias("truncated"))
    return q.orderBy("c_custkey").limit(50).crossJoin(F.broadcast(n))


@query("SELECT c_custkey, substr(sha256('{\"c_custkey\":' || c_custkey || '}'), 1, 24) AS identity, '# ' || c_name || chr(10) || chr(10) || '## c_mktsegment' || chr(10) || chr(10) || c_mktsegment || chr(10) AS markdown FROM customer")
def row_to_markdown(spark: SparkSession, sf: str) -> DataFrame:
    c = kb.table(spark, sf, "customer")
    return c.select("c_custkey", F.substring(F.sha2(F.to_json(F.struct("c_custkey")), 256), 1, 24).alias("identity"), F.concat(F.lit("# "), "c_name", F.lit("\n\n## c_mktsegment\n\n"), "c_mktsegment", F.lit("\n")).alias("markdown"))


@query("SELECT conv_id, turn, 'conv' || conv_id || ' [' || turn || ']: ' || coalesce(role, 'unknown') || ': ' || text AS line FROM conversations")
def conversation_transcript(spark: SparkSession, sf: str) -> DataFrame:
    return kb.table(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.lit("conv"), "conv_id", F.lit(" ["), "turn", F.lit("]: "), F.coalesce("role", F.lit("unknown")), F.lit(": "), "text").alias("line"))


@query("""WITH q AS (SELECT conv_id, turn, text AS q, lead(text) OVER w AS a, role, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
p AS (SELECT conv_id, turn, q, 'Q: ' || substr(q, 1, 240) || chr(10) || 'A: ' || substr(a, 1, 240) AS said FROM q WHERE role = 'user' AND next = 'assistant')
SELECT conv_id, turn, concat_ws(chr(10), array_to_string(list(said) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING), chr(10)), q) AS context FROM p""")
def contextual_query(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    q = kb.table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("q"), "role", F.lead("text").over(w).alias("a"), F.lead("role").over(w).alias("next")).where("role = 'user' AND next = 'assistant'")
    said = F.concat(F.lit("Q: "), F.substring("q", 1, 240), F.lit("\nA: "), F.substring("a", 1, 240))
    before = F.collect_list(said).over(w.rowsBetween(-2, -1))
    return q.select("conv_id", "turn", F.when(F.size(before) > 0, F.concat_ws("\n", F.concat_ws("\n", before), "q")).otherwise(F.col("q")).alias("context"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '<[^>]+>', ' ', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS body FROM pages")
def web_extract(spark: SparkSession, sf: str) -> DataFrame:
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<script[^>]*>.*?</script>", ""), r"(?is)<style[^>]*>.*?</style>", "")
    return kb.table(spark, sf, "pages").select("page_id", F.trim(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), F.trim(F.regexp_replace(F.regexp_replace(bare, "<[^>]+>", " "), r"\s+", " ")).alias("body"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS body FROM pages")
def html_regex_text(spark: SparkSession, sf: str) -> DataFrame:
    return kb.table(spark, sf, "pages").select("page_id", F.trim(F.regexp_replace(F.regexp_replace("html", "<[^>]+>", ""), r"\s+", " ")).alias("body"))


@query("""SELECT DISTINCT page_id, link FROM (SELECT page_id, url, regexp_extract(url, '^(https?://[^/?#]+)', 1) AS site, unnest(regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"'']+)["'']', 1)) AS href FROM pages),
LATERAL (SELECT regexp_replace(CASE WHEN href LIKE 'http%' THEN href WHEN href LIKE '/%' THEN site || href ELSE regexp_extract(url, '^(https?://[^?#]*/)', 1) || href END, '#.*$', '') AS link) WHERE NOT (href LIKE '#%' OR href LIKE 'mailto:%' OR href LIKE 'javascript:%') AND regexp_extract(link, '^(https?://[^/?#]+)', 1) = site""")
def web_links(spark: SparkSession, sf: str) -> DataFrame:
    """Links of every page that stay at its origin, relative ones after its folder."""
    return crawl.written_links(kb.table(spark, sf, "pages").select("page_id", "url", "html"), "page_id")


_CRAWL = """WITH RECURSIVE p AS (SELECT url, any_value(html) AS html, split_part(url, '/', 3) AS host, split_part(url, '/', 1) || '//' || split_part(url, '/', 3) AS site FROM pages GROUP BY url),
h AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY url) - 1 AS k, count(*) OVER (PARTITION BY host) AS n, row_number() OVER (PARTITION BY host ORDER BY url) = 1 AS seed FROM p),
e AS (SELECT DISTINCT url, site || href AS link FROM (SELECT url, site, unnest(regexp_extract_all(html, '(?i)<a[^>]+href=["'']([^"'']+)["'']', 1)) AS href FROM p)),
r AS (SELECT DISTINCT link, t.url AS page FROM e JOIN h t ON t.host = split_part(link, '/', 3) AND t.k = length(link) % t.n),
v(url, page, depth) AS (
  SELECT url, url, 1 FROM h WHERE seed
  UNION SELECT e.link, r.page, depth + 1 FROM v JOIN p ON p.url = v.page JOIN LATERAL (SELECT DISTINCT split_part(v.url, '/', 1) || '//' || split_part(v.url, '/', 3) || x.href AS link FROM (SELECT unnest(regexp_extract_all(p.html, '(?i)<a[^>]+href=["'']([^"'']+)["'']', 1)) AS href) x) e ON TRUE
    LEFT JOIN r ON r.link = e.link WHERE depth < 4 AND NOT contains(v.url, 'los'))
SELECT url, min(depth) AS depth, CASE WHEN contains(url, 'los') THEN 'excluded' WHEN any_value(page) IS NOT NULL THEN 'fetched' ELSE 'missing' END AS status FROM v GROUP BY url"""


@query(_CRAWL)
def crawl_pages(spark: SparkSession, sf: str) -> DataFrame:
    """A crawl of four steps from the first page of every host. The pages' links name no page, so a site's router, by the link's length, redirects them to one of its own."""
    p = kb.table(spark, sf, "pages").groupBy("url").agg(F.any_value("html").alias("html"))
    host = F.split_part("url", F.lit("/"), F.lit(3))
    site = F.concat(F.split_part("url", F.lit("/"), F.lit(1)), F.lit("//"), host)
    own = Window.partitionBy("host")
    h = p.select("url", host.alias("host")).withColumn("k", F.row_number().over(own.orderBy("url")) - 1).withColumn("n", F.count("*").over(own))
    linked = crawl.hrefs(p).select(F.col("page").alias("url"), "href").select(F.concat(site, "href").alias("url")).distinct().withColumn("host", host)
    to = linked.join(h.select("host", F.col("n")).distinct(), "host").withColumn("k", F.length("url") % F.col("n")).join(h.select("host", "k", F.col("url").alias("to")), ["host", "k"]).select("url", "to")
    return crawl.crawl(p, h.where("k = 0").select("url"), 4, exclude=["*los*"], redirects=to)


@query("SELECT event_id, 'k: ' || json_extract_string(props, '$.k') AS line FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_flatten(spark: SparkSession, sf: str) -> DataFrame:
    e = kb.table(spark, sf, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("k", "v"))
    return e.where("v IS NOT NULL").select("event_id", F.concat("k", F.lit(": "), "v").alias("line"))


@query(kb.VERSIONS + ", m AS (SELECT *, max(version_number) OVER (PARTITION BY document_id) AS top FROM v) SELECT doc_id, document_id, version_number FROM m WHERE version_number < top AND created_at < TIMESTAMP '2024-01-15'")
def retention_purge(spark: SparkSession, sf: str) -> DataFrame:
    return V.purgeable(kb.versions(spark, sf), "2024-01-15").select("doc_id", "document_id", "version_number")


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(1 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id")
def cosine_pairs(spark: SparkSession, sf: str) -> DataFrame:
    e = kb.table(spark, sf, "embeddings").select("label", F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return R.pair_distances(e, e, "label")


@query("""WITH m AS (SELECT a.vec_id, list_transform(list_zip(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), lambda p: p[1] * 0.5 + p[2] * 0.5) AS v FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)
SELECT vec_id, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first, round(list_sum(v) / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS total FROM m""")
def hyde_blend(spark: SparkSession, sf: str) -> DataFrame:
    e = kb.table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("next"))
    v = e.join(n, "vec_id").select("vec_id", blend(F.col("embedding"), F.col("next"), 0.5).alias("v"))
    return v.select("vec_id", F.round(F.get("v", F.lit(0)), 6).alias("first"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT DISTINCT 'p' || label AS profile, CAST(len(embedding) AS BIGINT) AS dimensions FROM embeddings")
def embedding_profiles(spark: SparkSession, sf: str) -> DataFrame:
    return kb.table(spark, sf, "embeddings").select(F.concat(F.lit("p"), "label").alias("profile"), F.size("embedding").cast("long").alias("dimensions")).distinct()


@query("SELECT lang AS kb, 'p' || label AS profile, count(*) AS n FROM embeddings JOIN documents ON doc_id = vec_id GROUP BY 1, 2")
def profile_counts(spark: SparkSession, sf: str) -> DataFrame:
    e, d = kb.table(spark, sf, "embeddings"), kb.table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.col("lang").alias("kb"))
    return e.select("vec_id", F.concat(F.lit("p"), "label").alias("profile")).join(d, "vec_id").groupBy("kb", "profile").agg(F.count("*").alias("n"))


@query(_LATEST + "SELECT vec_id AS chunk_id, document_id, uri, 'p' || label AS profile FROM embeddings JOIN l ON l.doc_id = vec_id")
def embedding_base(spark: SparkSession, sf: str) -> DataFrame:
    top = V.latest(kb.versions(spark, sf).select("document_id", "version_number", "doc_id", "uri"))
    return kb.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.concat(F.lit("p"), "label").alias("profile"), F.col("vec_id").alias("doc_id")).join(top, "doc_id").select("chunk_id", "document_id", "uri", "profile")


_CHUNKED = "SELECT doc_id, source, kb, i AS chunk_index, substr(text, CAST(i * 450 + 1 AS INTEGER), 500) AS chunk FROM (SELECT *, unnest(range(0, greatest(CAST(ceil((length(text) - 50) / 450.0) AS BIGINT), 1))) AS i FROM v WHERE length(text) > 0)"


@query(kb.VERSIONS + f"SELECT doc_id, chunk_index, sha256(CASE WHEN doc_id % 3 = 0 THEN 'In ' || source || ': ' || chunk WHEN doc_id % 3 = 1 THEN kb || chr(10) || chunk ELSE chunk END) AS embed_sha256 FROM ({_CHUNKED})")
def embed_text(spark: SparkSession, sf: str) -> DataFrame:
    """What is embedded of every whole chunk: a prefix and the chunk, a description and the chunk, or the chunk alone."""
    c = chunking.char_windows(kb.versions(spark, sf).select("doc_id", "source", "kb", "text"))
    prefix, description = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("In "), "source", F.lit(": "))), F.when(F.col("doc_id") % 3 == 1, F.concat("kb", F.lit("\n")))
    return c.select("doc_id", "chunk_index", F.sha2(F.concat(F.coalesce(prefix, description, F.lit("")), "chunk"), 256).alias("embed_sha256"))


@query(kb.VERSIONS + "SELECT kb, sha256(string_agg(CAST(doc_id AS VARCHAR), chr(10) ORDER BY CAST(doc_id AS VARCHAR))) AS fingerprint FROM v GROUP BY kb")
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return ordered.sorted_digest(kb.versions(spark, sf), ["kb"], "doc_id")


@query(_LATEST + ", s AS (SELECT kb, count(DISTINCT source) AS sources, count(DISTINCT document_id) AS documents FROM l GROUP BY kb), c AS (SELECT kb, sum(greatest(CAST(ceil((length(text) - 50) / 450.0) AS BIGINT), 1)) AS chunks FROM l WHERE length(text) > 0 GROUP BY kb) SELECT kb, sources, documents, CAST(coalesce(chunks, 0) AS BIGINT) AS chunks FROM s LEFT JOIN c USING (kb)")
def kb_inventory(spark: SparkSession, sf: str) -> DataFrame:
    n = F.length("text")
    v = kb.versions(spark, sf).select("document_id", "version_number", "kb", "source", F.when(n > 0, F.greatest(F.ceil((n - 50) / 450), F.lit(1))).otherwise(0).cast("long").alias("n_chunks"))
    return V.latest(v).groupBy("kb").agg(F.count_distinct("source").alias("sources"), F.count_distinct("document_id").alias("documents"), F.sum("n_chunks").alias("chunks"))
