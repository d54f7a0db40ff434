"""Queries on nested values: every document's metadata as JSON with secrets at several depths, its changes, and exploded lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..operators import graph as G, nested as N
from . import graph as graph_plans, kb

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _text(value: Column) -> Column:
    """A string as JSON."""
    return F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'^\{"v":(.*)\}$', 1)


def _metadata(spark, sf):
    d = kb.table(spark, sf, "documents").select("doc_id", "source", "lang", "n_chars")
    note = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("BEARER "), "lang")).otherwise("plain")
    auth = F.struct(F.col("source").alias("user"), note.alias("note"), F.array("lang").alias("old_session_tokens"))
    hook = F.to_json(F.struct(F.col("source").alias("url"), F.col("lang").alias("clientSecret")))
    hooks = F.concat(F.lit("["), hook, F.lit(',"see -----BEGIN KEY",'), F.col("doc_id").cast("string"), F.lit(",[]]"))
    deep = F.struct(F.struct(F.struct(F.col("lang").alias("password"), F.col("n_chars").alias("n")).alias("b")).alias("a"))
    whole = F.concat(F.lit('{"source":'), _text(F.col("source")), F.lit(',"Api_Key":'), _text(F.col("lang")), F.lit(',"auth":'), F.to_json(auth), F.lit(',"hooks":'), hooks, F.lit(',"deep":'), F.to_json(deep), F.lit("}"))
    return d.select("*", whole.alias("metadata"))


@query("""SELECT doc_id, sha256(json_object('source', source, 'Api_Key', '[REDACTED]', 'auth', json_object('user', source, 'note', CASE WHEN doc_id % 3 = 0 THEN '[REDACTED]' ELSE 'plain' END, 'old_session_tokens', '[REDACTED]'),
  'hooks', json_array(json_object('url', source, 'clientSecret', '[REDACTED]'), '[REDACTED]', doc_id, json_array()), 'deep', json_object('a', json_object('b', json_object('password', '[REDACTED]', 'n', n_chars))))::VARCHAR) AS sanitized_sha256,
  CASE WHEN doc_id % 3 = 0 THEN 6 ELSE 5 END AS hidden, CASE WHEN doc_id % 3 = 0 THEN 'Api_Key,auth.note,auth.old_session_tokens,hooks[0].clientSecret,hooks[1],deep.a.b.password' ELSE 'Api_Key,auth.old_session_tokens,hooks[0].clientSecret,hooks[1],deep.a.b.password' END AS paths FROM documents""")
def metadata_redact(spark: SparkSession, sf: str) -> DataFrame:
    s = N.sanitize(_metadata(spark, sf), "doc_id", "metadata")
    return s.select("doc_id", F.sha2("sanitized", 256).alias("sanitized_sha256"), "hidden", F.array_join("paths", ",").alias("paths"))


@query("""SELECT doc_id, CAST(json_object('source', source, 'auth', CASE WHEN doc_id % 3 = 0 THEN json_object('user', source) ELSE json_object('user', source, 'note', 'plain') END, 'hooks', json_array(json_object('url', source), doc_id, json_array()), 'deep', json_object('a', json_object('b', json_object('n', n_chars)))) AS VARCHAR) AS sanitized,
  CASE WHEN doc_id % 3 = 0 THEN 6 ELSE 5 END AS hidden FROM documents""")
def metadata_remove(spark: SparkSession, sf: str) -> DataFrame:
    return N.sanitize(_metadata(spark, sf), "doc_id", "metadata", remove=True).select("doc_id", "sanitized", "hidden")


@query("""SELECT doc_id, CAST(json_object('source', source, 'Api_Key', '[REDACTED]', 'auth', json_object('user', source, 'note', CASE WHEN doc_id % 3 = 0 THEN '[REDACTED]' ELSE 'plain' END, 'old_session_tokens', '[REDACTED]'),
  'hooks', json_array('[DEGRADED: depth limit exceeded]', '[REDACTED]', doc_id, '[DEGRADED: depth limit exceeded]'), 'deep', json_object('a', '[DEGRADED: depth limit exceeded]')) AS VARCHAR) AS sanitized, 3 AS degraded FROM documents""")
def metadata_shallow(spark: SparkSession, sf: str) -> DataFrame:
    """Nothing below two levels is looked into."""
    return N.sanitize(_metadata(spark, sf), "doc_id", "metadata", max_depth=2).select("doc_id", "sanitized", "degraded")


@query("""SELECT doc_id, array_to_string(list_sort(list_filter(['source', CASE WHEN doc_id % 2 = 0 THEN 'deep.a.b.n' END, CASE WHEN doc_id % 5 = 0 THEN 'hooks' WHEN doc_id % 7 = 0 THEN 'hooks[2]' END, CASE WHEN doc_id % 11 = 0 THEN 'auth' END, CASE WHEN doc_id % 11 <> 0 AND doc_id % 3 = 0 THEN 'auth.note' END, 'added'], lambda x: x IS NOT NULL)), ',') AS changed FROM documents""")
def state_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Dot paths at which a document's metadata differs from an edited version of it."""
    m = _metadata(spark, sf)
    edit = lambda c, when, pattern, to: F.when(when, F.regexp_replace(c, pattern, to)).otherwise(c)
    i, new = F.col("doc_id"), F.regexp_replace("metadata", r'^\{"source":"[^"]*"', '{"added":1,"source":"elsewhere"')
    new = edit(new, i % 2 == 0, r'"n":\d+', '"n":-1')
    new = F.when(i % 5 == 0, F.regexp_replace(new, r'"see -----BEGIN KEY",', "")).otherwise(edit(new, i % 7 == 0, r'KEY",\d+', 'KEY","other"'))
    new = edit(new, i % 3 == 0, '"note":"BEARER ', '"note":"bearer ')
    new = edit(new, i % 11 == 0, r'"auth":\{[^}]*\}', '"auth":[]')
    return N.changed_paths(m.withColumn("edited", new), "doc_id", "metadata", "edited").select("doc_id", F.array_join("changed", ",").alias("changed"))


@query("""SELECT doc_id, p AS path, v AS value FROM (SELECT doc_id, unnest(['source', 'Api_Key', 'auth.user', 'auth.note', 'auth.old_session_tokens[0]', 'hooks[0].url', 'hooks[0].clientSecret', 'hooks[1]', 'hooks[2]', 'hooks[3]', 'deep.a.b.password', 'deep.a.b.n']) AS p,
  unnest([to_json(source)::VARCHAR, to_json(lang)::VARCHAR, to_json(source)::VARCHAR, CASE WHEN doc_id % 3 = 0 THEN '"BEARER ' || lang || '"' ELSE '"plain"' END, to_json(lang)::VARCHAR, to_json(source)::VARCHAR, to_json(lang)::VARCHAR, '"see -----BEGIN KEY"', CAST(doc_id AS VARCHAR), '[]', to_json(lang)::VARCHAR, CAST(n_chars AS VARCHAR)]) AS v FROM documents)""")
def metadata_leaves(spark: SparkSession, sf: str) -> DataFrame:
    return N.leaves(_metadata(spark, sf), "doc_id", "metadata").select("doc_id", "path", "value")


_CLAIMS = r"""WITH s AS (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: len(list_filter(regexp_split_to_array(x, '[ \t\n\r\f\v]+'), lambda w: w <> '')) >= 5)[1:8]) AS claim, generate_subscripts(list_filter(list_transform(string_split(text, '.'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: len(list_filter(regexp_split_to_array(x, '[ \t\n\r\f\v]+'), lambda w: w <> '')) >= 5)[1:8], 1) AS k FROM documents)"""


def _results(spark, sf):
    """Understanding results of all documents, as JSON: entities of the first names, claims of the first sentences of five words or more."""
    d = kb.table(spark, sf, "documents").select("doc_id", "text")
    words = lambda s: F.size(F.array_remove(F.split(s, r"\s+"), ""))
    claims = F.slice(F.filter(F.transform(F.split("text", r"\."), lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: words(s) >= 5), 1, 8)
    d = d.select("doc_id", claims.alias("claims"), G.candidates(F.col("text")).alias("names"))
    entities = F.transform(F.slice(F.array_distinct("names"), 1, G.CANDIDATES), lambda x: F.struct(x.alias("name"), F.lit("TERM").alias("type"), F.size(F.filter("names", lambda y: y == x)).alias("mentions")))
    told = F.transform("claims", lambda c, i: F.struct(c.alias("claim"), F.when(i == 0, "high").otherwise("medium").alias("confidence")))
    return d.select("doc_id", F.to_json(F.struct(entities.alias("entities"), told.alias("key_claims"))).alias("result"))


@query(graph_plans._M + " SELECT chunk_id AS doc_id, name, 'TERM' AS type, mentions FROM m")
def understood_entities(spark: SparkSession, sf: str) -> DataFrame:
    return N.members(_results(spark, sf), "doc_id", "result", "entities", {"name": "string", "type": "string", "mentions": "long"}).drop("pos")


@query(_CLAIMS + " SELECT doc_id, CAST(k - 1 AS INTEGER) AS pos, claim, CASE WHEN k = 1 THEN 'high' ELSE 'medium' END AS confidence FROM s")
def understood_claims(spark: SparkSession, sf: str) -> DataFrame:
    return N.members(_results(spark, sf), "doc_id", "result", "key_claims", {"claim": "string", "confidence": "string"})
