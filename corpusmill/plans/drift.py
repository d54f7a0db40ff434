"""Queries of parser drift: three parsers over documents, pages and events, as three versions of them redact."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T
from ..operators import drift as D
from . import kb

QUERIES, SQL = {}, {}
_PII = dict(T.PII)
_EMAIL, _IP = "[PII_EMAIL]", "[PII_IP]"
#: What each run's parsers redact; a parser that isn't named doesn't run.
RUNS = {1: {"plaintext": [_EMAIL, _IP], "html": [_EMAIL], "markup": [_EMAIL]}, 2: {"plaintext": [_EMAIL], "html": [_EMAIL], "json": [_EMAIL]}, 3: {"plaintext": [_EMAIL, _IP], "html": [_EMAIL, _IP], "json": [_EMAIL]}}
#: The same patterns in SQL, written out there.
_SQL_EMAIL, _SQL_IP = r"(?i)\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}\b", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"
_RESULTS = f"""WITH raw AS (SELECT 'plaintext' AS parser_id, doc_id AS fixture_id, text FROM documents UNION ALL SELECT 'html', page_id, html FROM pages UNION ALL SELECT 'markup', item_id, text FROM benchmark UNION ALL SELECT 'json', event_id, props FROM events),
r(run, parser_id, email, ip) AS (VALUES (1, 'plaintext', true, true), (1, 'html', true, false), (1, 'markup', true, false), (2, 'plaintext', true, false), (2, 'html', true, false), (2, 'json', true, false), (3, 'plaintext', true, true), (3, 'html', true, true), (3, 'json', true, false)),
a AS (SELECT run, parser_id, fixture_id, ip, regexp_replace(text, '{_SQL_EMAIL}', '[PII_EMAIL]', 'g') AS text, len(regexp_extract_all(text, '{_SQL_EMAIL}')) AS n FROM raw JOIN r USING (parser_id)),
x AS (SELECT run, parser_id, fixture_id, CASE WHEN ip THEN regexp_replace(text, '{_SQL_IP}', '[PII_IP]', 'g') ELSE text END AS text, n + CASE WHEN ip THEN len(regexp_extract_all(text, '{_SQL_IP}')) ELSE 0 END AS redacted, CASE WHEN length(trim(text)) = 0 THEN 'degraded' ELSE 'success' END AS status FROM a),
s AS (SELECT run, parser_id, count(*) AS fixtures, CAST(sum(redacted) AS BIGINT) AS redacted, count(*) FILTER (status <> 'success') AS degraded, md5(string_agg(fixture_id || ':' || md5(text), ',' ORDER BY fixture_id)) AS golden_hash FROM x GROUP BY 1, 2),
p AS (SELECT coalesce(b.run + 1, h.run) AS run, coalesce(b.parser_id, h.parser_id) AS parser_id, b.redacted AS base_redacted, h.redacted AS head_redacted, coalesce(h.redacted, 0) - coalesce(b.redacted, 0) AS redacted_delta, coalesce(h.degraded, 0) - coalesce(b.degraded, 0) AS degraded_delta,
  b.golden_hash IS DISTINCT FROM h.golden_hash AS hash_drift, b.run IS NULL AS added, h.run IS NULL AS removed, h.degraded AS head_degraded FROM (SELECT * FROM s WHERE run < 3) b FULL JOIN (SELECT * FROM s WHERE run > 1) h ON h.run = b.run + 1 AND h.parser_id = b.parser_id),
d AS (SELECT *, CASE WHEN added THEN 'added' WHEN removed THEN 'removed' WHEN hash_drift OR redacted_delta <> 0 OR degraded_delta <> 0 THEN 'changed' ELSE 'unchanged' END AS change_type FROM p),
k AS (SELECT *, CASE change_type WHEN 'added' THEN head_redacted < 1 OR head_degraded > 0 WHEN 'changed' THEN redacted_delta < 0 OR degraded_delta > 0 ELSE false END AS risk FROM d),
t AS (SELECT run, run - 1 AS base_run, count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'removed') AS removed, count(*) FILTER (change_type = 'changed') AS changed, CAST(sum(redacted_delta) AS BIGINT) AS redacted_delta, CAST(sum(degraded_delta) AS BIGINT) AS degraded_delta, bool_or(hash_drift) AS hash_drift,
  CASE WHEN bool_or(risk) OR sum(redacted_delta) < 0 OR sum(degraded_delta) > 0 THEN 'degraded' ELSE 'unchanged' END AS risk FROM k GROUP BY run)"""


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


def _results(spark, sf, runs=(1, 2, 3)):
    source = {"plaintext": ("documents", "doc_id", "text"), "html": ("pages", "page_id", "html"), "markup": ("benchmark", "item_id", "text"), "json": ("events", "event_id", "props")}
    out = []
    for run in runs:
        for parser, labels in RUNS[run].items():
            table, key, column = source[parser]
            text, hits = T.redact(F.col(column), [(label, _PII[label]) for label in labels])
            status = F.when(F.length(F.trim(column)) == 0, "degraded").otherwise("success")
            out.append(kb.table(spark, sf, table).select(F.lit(run).alias("run"), F.lit(parser).alias("parser_id"), F.col(key).alias("fixture_id"), text.alias("text"), hits.alias("redacted"), status.alias("status")))
    return reduce(DataFrame.unionByName, out)


@query(_RESULTS + " SELECT run, parser_id, fixtures, redacted, degraded FROM s")
def parser_summary(spark: SparkSession, sf: str) -> DataFrame:
    return D.summarize(_results(spark, sf)).select("run", "parser_id", "fixtures", "redacted", "degraded")


@query(_RESULTS + " SELECT parser_id, change_type, base_redacted, head_redacted, redacted_delta, degraded_delta, hash_drift, risk FROM k WHERE run = 2")
def parser_drift(spark: SparkSession, sf: str) -> DataFrame:
    s = D.summarize(_results(spark, sf, (1, 2)))
    return D.diff(s.where("run = 1"), s.where("run = 2")).select("parser_id", "change_type", "base_redacted", "head_redacted", "redacted_delta", "degraded_delta", "hash_drift", "risk")


@query(_RESULTS + " SELECT run, base_run, added, removed, changed, redacted_delta, degraded_delta, hash_drift, risk FROM t")
def drift_reports(spark: SparkSession, sf: str) -> DataFrame:
    return D.reports(D.summarize(_results(spark, sf)))


@query(_RESULTS + " SELECT count(*) AS reports, count(*) FILTER (risk = 'degraded') AS degraded_reports, max(run) AS latest_run, max_by(risk, run) AS latest_risk, max_by(changed, run) AS latest_changed, CASE WHEN count(*) FILTER (risk = 'degraded') > 0 THEN 'degraded' ELSE 'success' END AS status FROM t")
def drift_history(spark: SparkSession, sf: str) -> DataFrame:
    return D.history(D.reports(D.summarize(_results(spark, sf))))
