"""Queries of payload sanitising, throttles, expiry, staleness, layered settings and dry runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..operators import ordered
from . import kb

QUERIES, SQL = {}, {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


@query("SELECT doc_id, CASE WHEN length(text) > 240 THEN substr(text, 1, 237) || '...' ELSE text END AS note, '[REDACTED]' AS prompt, source, '[REDACTED]' AS token FROM documents")
def audit_clip(spark: SparkSession, sf: str) -> DataFrame:
    """Payloads of four keys, two of them forbidden whatever their case; long strings are clipped."""
    payload = F.create_map(F.lit("note"), "text", F.lit("Prompt"), "text", F.lit("source"), "source", F.lit("token"), F.concat("source", "lang"))
    d = kb.table(spark, sf, "documents").select("doc_id", T.clip_payload(payload).alias("p"))
    return d.select("doc_id", F.col("p")["note"].alias("note"), F.col("p")["Prompt"].alias("prompt"), F.col("p")["source"].alias("source"), F.col("p")["token"].alias("token"))


@query("SELECT page_id, regexp_replace(url, '[/\\\\:*?\"<>|]', '_', 'g') AS name FROM pages")
def safe_filename(spark: SparkSession, sf: str) -> DataFrame:
    return kb.table(spark, sf, "pages").select("page_id", T.safe_filename(F.col("url")).alias("name"))


@query("""WITH t AS (SELECT doc_id, text, lower(text) AS l FROM documents)
SELECT doc_id, CASE WHEN (contains(l, 'secret') OR contains(l, 'password') OR contains(l, 'token') OR contains(l, 'credential')) AND (contains(l, '://') OR contains(l, '=') OR length(text) > 80) THEN '[REDACTED]' ELSE sha256(text) END AS value FROM t""")
def report_values(spark: SparkSession, sf: str) -> DataFrame:
    """Report values that name a credential and look like one are redacted; digests of the others."""
    return kb.table(spark, sf, "documents").select("doc_id", F.when(T.credential(F.col("text")), "[REDACTED]").otherwise(F.sha2("text", 256)).alias("value"))


@query("SELECT DISTINCT p_type AS predicate, trim(regexp_replace(lower(trim(p_type)), '[^a-z0-9]+', '_', 'g'), '_') AS normal FROM part UNION SELECT x, y FROM (VALUES ('Depends', 'depends_on'), (' routes ', 'routes_to'), ('--', 'related_to')) v(x, y)")
def predicate_normal(spark: SparkSession, sf: str) -> DataFrame:
    odd = spark.createDataFrame([("Depends",), (" routes ",), ("--",)], "predicate string")
    return kb.table(spark, sf, "part").select(F.col("p_type").alias("predicate")).unionByName(odd).distinct().select("predicate", T.predicate(F.col("predicate")).alias("normal"))


_FAILS = "WITH e AS (SELECT event_id, user_id, ts, event_type = (SELECT min(event_type) FROM events) AS ok FROM events), g AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM e)"


@query(_FAILS + " SELECT event_id, user_id, count(*) OVER w >= 5 AS locked FROM g WHERE NOT ok WINDOW w AS (PARTITION BY user_id, run ORDER BY ts RANGE BETWEEN INTERVAL 3 DAYS PRECEDING AND CURRENT ROW)")
def login_throttle(spark: SparkSession, sf: str) -> DataFrame:
    """Failures of a user since the last success (here the first event type) within three days: the fifth locks."""
    e = kb.table(spark, sf, "events").select("event_id", "user_id", "ts", "event_type")
    e = e.crossJoin(F.broadcast(e.agg(F.min("event_type").alias("good")))).withColumn("ok", F.col("event_type") == F.col("good"))
    run = F.sum(F.col("ok").cast("int")).over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    failed = e.withColumn("run", run).where("NOT ok").withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))
    w = Window.partitionBy("user_id", "run").orderBy("us").rangeBetween(-3 * 86_400_000_000, 0)
    return failed.select("event_id", "user_id", (F.count("*").over(w) >= 5).alias("locked"))


@query(kb.VERSIONS + "SELECT kb, count(*) FILTER (created_at + INTERVAL 14 DAY <= TIMESTAMP '2024-02-01') AS expired, count(*) FILTER (NOT created_at + INTERVAL 14 DAY <= TIMESTAMP '2024-02-01') AS live FROM v GROUP BY kb")
def ttl_expiry(spark: SparkSession, sf: str) -> DataFrame:
    gone = F.col("created_at") + F.expr("INTERVAL 14 DAYS") <= F.expr(f"timestamp_ntz'{kb.AS_OF} 00:00:00'")
    return kb.versions(spark, sf).groupBy("kb").agg(F.count_if(gone).alias("expired"), F.count_if(~gone).alias("live"))


@query(kb.VERSIONS + """, n AS (SELECT kb, list(doc_id ORDER BY doc_id) AS now FROM v GROUP BY kb),
b AS (SELECT kb, list(doc_id ORDER BY doc_id) AS built FROM (SELECT kb, CASE WHEN kb = 'de' AND doc_id = (SELECT min(doc_id) FROM v WHERE kb = 'de') THEN -1 ELSE doc_id END AS doc_id FROM v WHERE kb <> 'fr' AND (kb <> 'es' OR created_at < TIMESTAMP '2024-01-25')) GROUP BY kb)
SELECT kb, CASE WHEN built IS NULL THEN 'missing' WHEN now <> built THEN 'stale' ELSE 'fresh' END AS state FROM n LEFT JOIN b USING (kb)""")
def graph_staleness(spark: SparkSession, sf: str) -> DataFrame:
    """A graph is stale when the rows it was built from aren't those of today, by digest: one swapped id is enough."""
    v = kb.versions(spark, sf).select("kb", "doc_id", "created_at")
    first = v.where("kb = 'de'").agg(F.min("doc_id").alias("first"))
    built = v.where("kb <> 'fr' AND (kb <> 'es' OR created_at < timestamp_ntz'2024-01-25 00:00:00')").crossJoin(F.broadcast(first))
    built = built.withColumn("doc_id", F.when((F.col("kb") == "de") & (F.col("doc_id") == F.col("first")), -1).otherwise(F.col("doc_id")))
    now, then = ordered.tree_digest(v, ["kb"], "doc_id"), ordered.tree_digest(built, ["kb"], "doc_id", "built").select("kb", "built")
    state = F.when(F.col("built").isNull(), "missing").when(F.col("built") != F.col("fingerprint"), "stale").otherwise("fresh")
    return now.join(then, "kb", "left").select("kb", state.alias("state"))


@query("SELECT doc_id, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(CAST(ceil((length(text) - 50) / 450.0) AS BIGINT), 1) END AS n_chunks FROM documents")
def chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of each version, from its length alone."""
    n = F.length("text")
    return kb.table(spark, sf, "documents").select("doc_id", F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.ceil((n - 50) / 450), F.lit(1))).cast("long").alias("n_chunks"))


@query("SELECT 'documents' AS sink, count(*) AS rows FROM documents UNION ALL SELECT 'chunks', CAST(sum(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(CAST(ceil((length(text) - 50) / 450.0) AS BIGINT), 1) END) AS BIGINT) FROM documents UNION ALL SELECT 'embeddings', count(*) FROM embeddings UNION ALL SELECT 'usage', count(*) FROM events")
def dry_run(spark: SparkSession, sf: str) -> DataFrame:
    """What each sink would be sent, without sending it."""
    rows = lambda name, df, n=F.count("*"): df.agg(n.cast("long").alias("rows")).select(F.lit(name).alias("sink"), "rows")
    out = rows("documents", kb.table(spark, sf, "documents")).unionByName(rows("chunks", chunk_counts(spark, sf), F.sum("n_chunks")))
    return out.unionByName(rows("embeddings", kb.table(spark, sf, "embeddings"))).unionByName(rows("usage", kb.table(spark, sf, "events")))


@query("""WITH u AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN 'req-' || o_orderkey % 3 END AS request, 'role' || o_custkey % 5 AS role, o_orderpriority AS stage FROM orders),
r(role, model) AS (VALUES ('role0', 'm-large'), ('role1', 'm-small'), ('default', 'm-role')), s(stage, model) AS (VALUES ('1-URGENT', 'm-fast'))
SELECT o_orderkey, coalesce(request, r.model, d.model, s.model, 'm-base') AS model, CASE WHEN request IS NOT NULL THEN 'request' WHEN r.model IS NOT NULL THEN 'role' WHEN d.model IS NOT NULL THEN 'role_default' WHEN s.model IS NOT NULL THEN 'stage' ELSE 'default' END AS origin
FROM u LEFT JOIN r ON r.role = u.role LEFT JOIN r d ON d.role = 'default' AND u.stage <> '5-LOW' LEFT JOIN s ON s.stage = u.stage""")
def stage_model(spark: SparkSession, sf: str) -> DataFrame:
    """Layers of settings: a request beats its role, that the role named default (for all stages but one here), that the stage, that the base."""
    u = kb.table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 11 == 0, F.concat(F.lit("req-"), F.col("o_orderkey") % 3)).alias("request"), F.concat(F.lit("role"), F.col("o_custkey") % 5).alias("role"), F.col("o_orderpriority").alias("stage"))
    roles = spark.createDataFrame([("role0", "m-large"), ("role1", "m-small")], "role string, role_model string")
    stages = spark.createDataFrame([("1-URGENT", "m-fast")], "stage string, stage_model string")
    u = u.join(roles, "role", "left").join(stages, "stage", "left").withColumn("any_role", F.when(F.col("stage") != "5-LOW", "m-role"))
    layers = [("request", "request"), ("role_model", "role"), ("any_role", "role_default"), ("stage_model", "stage")]
    origin = F.coalesce(*(F.when(F.col(c).isNotNull(), name) for c, name in layers), F.lit("default"))
    return u.select("o_orderkey", F.coalesce(*(c for c, _ in layers), F.lit("m-base")).alias("model"), origin.alias("origin"))


@query("SELECT conv_id, turn, CASE WHEN turn % 4 - 1 <= 0 THEN 'invalid_top_k' WHEN trim(coalesce(text, '')) = '' THEN 'empty_query' WHEN lang IS NULL THEN 'unknown_kb' ELSE 'ok' END AS guard FROM conversations LEFT JOIN (SELECT DISTINCT lang FROM documents) ON lang = ['en', 'de', 'xx'][1 + CAST(conv_id % 3 AS INTEGER)] WHERE role = 'user'")
def input_guards(spark: SparkSession, sf: str) -> DataFrame:
    """The first guard that a search request fails: its top_k, its text, its knowledge base."""
    asked = kb.table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", "text", F.element_at(F.array(*map(F.lit, ("en", "de", "xx"))), (F.col("conv_id") % 3 + 1).cast("int")).alias("kb"), (F.col("turn") % 4 - 1).alias("top_k"))
    known = kb.table(spark, sf, "documents").select(F.col("lang").alias("known")).distinct()
    asked = asked.join(known, F.col("kb") == F.col("known"), "left")
    guard = F.when(F.col("top_k") <= 0, "invalid_top_k").when(F.trim(F.coalesce("text", F.lit(""))) == "", "empty_query").when(F.col("known").isNull(), "unknown_kb").otherwise("ok")
    return asked.select("conv_id", "turn", guard.alias("guard"))


@query("SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS similarity, 0.0::DOUBLE AS to_zero FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cache_similarity(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of a vector to the next one and to a zero vector, which is 0."""
    from ..functions.vectors import similarity

    e = kb.table(spark, sf, "embeddings").select("vec_id", "embedding")
    both = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other")), "vec_id")
    zero = F.transform("other", lambda x: x * 0)
    return both.select("vec_id", F.round(similarity(F.col("embedding"), F.col("other")), 6).alias("similarity"), similarity(F.col("embedding"), zero).alias("to_zero"))
