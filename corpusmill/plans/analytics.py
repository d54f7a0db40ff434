"""Queries of usage, cost, evaluation, coverage, diffs and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators import quantiles
from ..shared import materialize
from . import kb

QUERIES, SQL = {}, {}
#: Rows of a side that one task of a chain's join sorts.
_ROWS = 1_000_000


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


_TOTALS = "count(*) AS n, CAST(coalesce(sum(tokens), 0) AS BIGINT) AS tokens, CAST(round(coalesce(sum(cost), 0), 8) AS DOUBLE) AS cost, round(avg(latency_ms), 4) AS mean_latency"


def _totals():
    return [F.count("*").alias("n"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.round(F.coalesce(F.sum("cost"), F.lit(0)), 8).cast("double").alias("cost"), F.round(F.avg("latency_ms"), 4).alias("mean_latency")]


@query(kb.USAGE + f"SELECT {_TOTALS} FROM u WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-20'")
def usage_totals(spark: SparkSession, sf: str) -> DataFrame:
    return kb.usage(spark, sf).where("created_at >= timestamp_ntz'2024-01-05 00:00:00' AND created_at < timestamp_ntz'2024-01-20 00:00:00'").agg(*_totals())


@query(kb.USAGE + f"SELECT operation, {_TOTALS} FROM u GROUP BY operation")
def usage_by_operation(spark: SparkSession, sf: str) -> DataFrame:
    return kb.usage(spark, sf).groupBy("operation").agg(*_totals())


@query(kb.USAGE + f"SELECT user_id, {_TOTALS} FROM u GROUP BY user_id")
def usage_by_user(spark: SparkSession, sf: str) -> DataFrame:
    return kb.usage(spark, sf).groupBy("user_id").agg(*_totals())


@query(kb.USAGE + f"SELECT role, {_TOTALS} FROM u GROUP BY role")
def usage_by_role(spark: SparkSession, sf: str) -> DataFrame:
    return kb.usage(spark, sf).groupBy("role").agg(*_totals())


@query(kb.USAGE + f"SELECT CAST(created_at AS DATE) AS day, {_TOTALS} FROM u GROUP BY 1")
def usage_daily(spark: SparkSession, sf: str) -> DataFrame:
    return kb.usage(spark, sf).groupBy(F.to_date("created_at").alias("day")).agg(*_totals())


_BUDGET = "(VALUES (0, 5.0, 50, true), (1, 50.0, 80, true), (2, 0.0, 80, false))"


@query(kb.USAGE + f"""SELECT workspace, spend, limit_usd, CASE WHEN limit_usd > 0 THEN round(spend / limit_usd * 100, 2) ELSE 0 END AS pct_used,
CASE WHEN limit_usd > 0 THEN spend / limit_usd * 100 ELSE 0 END >= threshold AS over_threshold, limit_usd > 0 AND spend >= limit_usd AS over_limit, hard_cap AND limit_usd > 0 AND spend >= limit_usd AS hard_cap_breached
FROM (SELECT user_id % 3 AS workspace, CAST(sum(cost) AS DOUBLE) AS spend FROM u WHERE created_at >= TIMESTAMP '2024-01-01' AND created_at < TIMESTAMP '2024-02-01' GROUP BY 1) JOIN (SELECT col0 AS workspace, CAST(col1 AS DOUBLE) AS limit_usd, col2 AS threshold, col3 AS hard_cap FROM {_BUDGET}) USING (workspace)""")
def budget_eval(spark: SparkSession, sf: str) -> DataFrame:
    budget = spark.createDataFrame([(0, 5.0, 50, True), (1, 50.0, 80, True), (2, 0.0, 80, False)], "workspace long, limit_usd double, threshold int, hard_cap boolean")
    u = kb.usage(spark, sf).where("created_at >= timestamp_ntz'2024-01-01 00:00:00' AND created_at < timestamp_ntz'2024-02-01 00:00:00'")
    s = u.groupBy((F.col("user_id") % 3).alias("workspace")).agg(F.sum("cost").cast("double").alias("spend")).join(F.broadcast(budget), "workspace")
    pct = F.when(F.col("limit_usd") > 0, F.col("spend") / F.col("limit_usd") * 100).otherwise(F.lit(0.0))
    over = (F.col("limit_usd") > 0) & (F.col("spend") >= F.col("limit_usd"))
    return s.select("workspace", "spend", "limit_usd", F.round(pct, 2).alias("pct_used"), (pct >= F.col("threshold")).alias("over_threshold"), over.alias("over_limit"), (F.col("hard_cap") & over).alias("hard_cap_breached"))


@query(kb.USAGE + ", d AS (SELECT user_id, CAST(created_at AS DATE) AS day, sum(cost) AS c FROM u GROUP BY 1, 2), r AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY day) AS spent FROM d) SELECT user_id, min(day) AS alert_day FROM r WHERE spent >= 0.5 GROUP BY user_id")
def budget_latch(spark: SparkSession, sf: str) -> DataFrame:
    """The first day on which a user's month passes the threshold; days are summed before the running window."""
    d = kb.usage(spark, sf).groupBy("user_id", F.to_date("created_at").alias("day")).agg(F.sum("cost").alias("c"))
    r = d.withColumn("spent", F.sum("c").over(Window.partitionBy("user_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)))
    return r.where("spent >= 0.5").groupBy("user_id").agg(F.min("day").alias("alert_day"))


_LATENCY = "count(*) AS n, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(round(sum(cost), 8) AS DOUBLE) AS cost, round(sum(latency_ms), 3) AS latency_ms, round(quantile_cont(latency_ms, 0.5), 3) AS p50, round(quantile_cont(latency_ms, 0.95), 3) AS p95"


@query(kb.USAGE + f"SELECT 'all' AS side, 'all' AS name, {_LATENCY} FROM u UNION ALL SELECT 'operation', operation, {_LATENCY} FROM u GROUP BY operation UNION ALL SELECT 'model', coalesce(role, 'unknown'), {_LATENCY} FROM u GROUP BY role")
def cost_latency(spark: SparkSession, sf: str) -> DataFrame:
    """Sums and exact interpolated percentiles of all usage, by operation and by model (here the role)."""
    u = kb.usage(spark, sf)
    sides = F.array(*(F.struct(F.lit(side).alias("side"), name.alias("name")) for side, name in (("all", F.lit("all")), ("operation", F.col("operation")), ("model", F.coalesce("role", F.lit("unknown"))))))
    rows = u.select(F.explode(sides).alias("s"), "tokens", "cost", "latency_ms").select("s.*", "tokens", "cost", "latency_ms")
    sums = rows.groupBy("side", "name").agg(F.sum("tokens").alias("tokens"), F.round(F.sum("cost"), 8).cast("double").alias("cost"), F.round(F.sum("latency_ms"), 3).alias("latency_ms"))
    at = quantiles.percentiles(rows, ["side", "name"], "latency_ms", {"p50": 0.5, "p95": 0.95})
    return sums.join(at.select("side", "name", "n", F.round("p50", 3).alias("p50"), F.round("p95", 3).alias("p95")), ["side", "name"])


@query("SELECT o_orderkey AS run_id, o_orderstatus AS status, c_name AS source FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_mktsegment = 'BUILDING'")
def pipeline_runs(spark: SparkSession, sf: str) -> DataFrame:
    c = kb.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.col("c_name").alias("source"))
    return kb.table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderstatus").alias("status"), "o_custkey").join(c, "o_custkey", "left").drop("o_custkey")


@query("WITH r AS (SELECT o_orderkey FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 100) SELECT l_returnflag AS operation, count(*) AS n, round(sum(l_extendedprice), 2) AS cost FROM lineitem JOIN r ON l_orderkey = o_orderkey GROUP BY 1")
def pipeline_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Over the hundred latest runs, which is the report's range."""
    r = kb.table(spark, sf, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(100).select(F.col("o_orderkey").alias("l_orderkey"))
    return kb.table(spark, sf, "lineitem").join(F.broadcast(r), "l_orderkey").groupBy(F.col("l_returnflag").alias("operation")).agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("cost"))


@query("SELECT l_orderkey AS run_id, count(*) AS total, count(*) FILTER (l_returnflag = 'R') AS failed, CASE WHEN count(*) FILTER (l_returnflag = 'R') = 0 THEN 'success' WHEN count(*) FILTER (l_returnflag = 'R') = count(*) THEN 'all_failure' ELSE 'partial_failure' END AS status FROM lineitem GROUP BY 1")
def run_status(spark: SparkSession, sf: str) -> DataFrame:
    r = kb.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(F.count("*").alias("total"), F.count_if(F.col("l_returnflag") == "R").alias("failed"))
    return r.withColumn("status", F.when(F.col("failed") == 0, "success").when(F.col("failed") == F.col("total"), "all_failure").otherwise("partial_failure"))


_STATE = """WITH s AS (SELECT lang AS kb, CASE WHEN quality IS NULL THEN 'missing' WHEN toxic = 1 THEN 'failed' WHEN d.doc_id % 4 = 0 THEN 'stale' ELSE 'completed' END AS state FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _state(spark, sf):
    d, l = kb.table(spark, sf, "documents").select("doc_id", F.col("lang").alias("kb")), kb.table(spark, sf, "labels")
    state = F.when(F.col("quality").isNull(), "missing").when(F.col("toxic") == 1, "failed").when(F.col("doc_id") % 4 == 0, "stale").otherwise("completed")
    return d.join(l, "doc_id", "left").select("doc_id", "kb", state.alias("state"))


@query(_STATE + " SELECT kb, count(*) AS total, count(*) FILTER (state = 'completed') AS completed, count(*) FILTER (state = 'missing') AS missing, count(*) FILTER (state = 'stale') AS stale, count(*) FILTER (state = 'failed') AS failed, round(count(*) FILTER (state = 'completed') / count(*), 4) AS score FROM s GROUP BY kb")
def coverage(spark: SparkSession, sf: str) -> DataFrame:
    n = lambda x: F.count_if(F.col("state") == x)
    return _state(spark, sf).groupBy("kb").agg(F.count("*").alias("total"), *(n(x).alias(x) for x in ("completed", "missing", "stale", "failed")), F.round(n("completed") / F.count("*"), 4).alias("score"))


@query(_STATE.replace("lang AS kb,", "d.doc_id,") + " SELECT doc_id, CASE state WHEN 'completed' THEN 'skip' WHEN 'missing' THEN 'create' ELSE 'regenerate' END AS action FROM s")
def understand_plan(spark: SparkSession, sf: str) -> DataFrame:
    return _state(spark, sf).select("doc_id", F.when(F.col("state") == "completed", "skip").when(F.col("state") == "missing", "create").otherwise("regenerate").alias("action"))


@query("SELECT doc_id, CASE WHEN length(trim(text)) = 0 THEN 'skip_empty' WHEN doc_id % 3 = 0 THEN 'skip_indexed' ELSE 'index' END AS action FROM documents")
def index_plan(spark: SparkSession, sf: str) -> DataFrame:
    return kb.table(spark, sf, "documents").select("doc_id", F.when(F.length(F.trim("text")) == 0, "skip_empty").when(F.col("doc_id") % 3 == 0, "skip_indexed").otherwise("index").alias("action"))


@query("WITH r AS (SELECT o_orderkey AS run_id, o_orderkey % 50 = 0 AS protected, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS pos FROM orders) SELECT run_id FROM r WHERE NOT protected AND pos > 3")
def eval_retention(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey"))
    r = kb.table(spark, sf, "orders").select(F.col("o_orderkey").alias("run_id"), (F.col("o_orderkey") % 50 == 0).alias("protected"), F.row_number().over(w).alias("pos"))
    return r.where("NOT protected AND pos > 3").select("run_id")


_FEEDBACK = "WITH f AS (SELECT doc_id % 20 AS relation, CASE WHEN toxic = 1 THEN 'incorrect' WHEN quality = 1 AND doc_id % 6 = 0 THEN 'correct' WHEN quality = 0 THEN 'needs_review' END AS verdict FROM labels), s AS (SELECT relation, count(*) FILTER (verdict = 'incorrect') AS incorrect, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'needs_review') AS needs_review FROM f GROUP BY 1)"


def _feedback(spark, sf):
    v = F.when(F.col("toxic") == 1, "incorrect").when((F.col("quality") == 1) & (F.col("doc_id") % 6 == 0), "correct").when(F.col("quality") == 0, "needs_review")
    f = kb.table(spark, sf, "labels").select((F.col("doc_id") % 20).alias("relation"), v.alias("verdict"))
    return f.groupBy("relation").agg(*(F.count_if(F.coalesce(F.col("verdict") == x, F.lit(False))).alias(x) for x in ("incorrect", "correct", "needs_review")))


@query(_FEEDBACK + " SELECT relation, incorrect, correct, needs_review, CAST(CASE WHEN incorrect >= 1 AND correct = 0 THEN 0 WHEN incorrect > correct THEN 0.35 WHEN needs_review > 0 AND correct = 0 THEN 0.7 WHEN correct > incorrect THEN least(1.12, 1 + correct * 0.04) ELSE 1 END AS DOUBLE) AS weight FROM s")
def feedback_weight(spark: SparkSession, sf: str) -> DataFrame:
    i, c, n = F.col("incorrect"), F.col("correct"), F.col("needs_review")
    w = F.when((i >= 1) & (c == 0), 0.0).when(i > c, 0.35).when((n > 0) & (c == 0), 0.7).when(c > i, F.least(F.lit(1.12), 1 + c * 0.04)).otherwise(1.0)
    return _feedback(spark, sf).withColumn("weight", w.cast("double"))


@query("SELECT quality - toxic AS rating, count(*) AS n FROM labels GROUP BY 1")
def feedback_rollup(spark: SparkSession, sf: str) -> DataFrame:
    return kb.table(spark, sf, "labels").groupBy((F.col("quality") - F.col("toxic")).alias("rating")).agg(F.count("*").alias("n"))


_NEAREST = "count(*) AS n, min(value) AS low, max(value) AS high, avg(value) AS mean, list(value ORDER BY value)[count(*) // 2 + 1] AS p50, list(value ORDER BY value)[least(CAST(floor(count(*) * 0.95::DOUBLE) AS BIGINT), count(*) - 1) + 1] AS p95"


def _bench(events):
    return quantiles.percentiles(events.select(F.col("event_type").alias("mode"), "value"), ["mode"], "value", {"p50": 0.5, "p95": 0.95}, nearest=True)


@query(f"SELECT mode, n, round(low, 3) AS low, round(high, 3) AS high, round(mean, 3) AS mean, round(p50, 3) AS p50, round(p95, 3) AS p95 FROM (SELECT event_type AS mode, {_NEAREST} FROM events GROUP BY 1)")
def bench_stats(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-rank percentiles by selection, so no group is gathered in one row."""
    return _bench(kb.table(spark, sf, "events")).select("mode", "n", *(F.round(c, 3).alias(c) for c in ("low", "high", "mean", "p50", "p95")))


@query(f"""WITH s AS (SELECT event_type AS mode, ts >= TIMESTAMP '2024-01-16' AS late, {_NEAREST} FROM events GROUP BY 1, 2),
c AS (SELECT a.mode, (a.p50 - b.p50) / b.p50 * 100 AS p50, (a.p95 - b.p95) / b.p95 * 100 AS p95, a.n - b.n AS d FROM s a JOIN s b ON a.mode = b.mode AND a.late AND NOT b.late)
SELECT mode, round(p50, 4) AS p50_pct, round(p95, 4) AS p95_pct, d AS count_delta, CASE WHEN p50 > 20 OR p95 > 20 OR abs(d) > 50 THEN 'fail' ELSE 'pass' END AS status FROM c""")
def bench_compare(spark: SparkSession, sf: str) -> DataFrame:
    """The second half of the month against the first."""
    e = kb.table(spark, sf, "events")
    late = F.col("ts") >= F.expr("timestamp_ntz'2024-01-16 00:00:00'")
    return quantiles.compare(_bench(e.where(late)), _bench(e.where(~late)), "mode", drift=50)


@query("SELECT event_id, user_id FROM events WHERE event_type = (SELECT min(event_type) FROM events) AND ts >= TIMESTAMP '2024-01-03' AND ts <= TIMESTAMP '2024-01-25' ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 40")
def audit_page(spark: SparkSession, sf: str) -> DataFrame:
    """One page of a listing: limit and offset are the feature."""
    e = kb.table(spark, sf, "events")
    kind = e.agg(F.min("event_type").alias("event_type"))
    e = e.join(F.broadcast(kind), "event_type").where("ts >= timestamp_ntz'2024-01-03 00:00:00' AND ts <= timestamp_ntz'2024-01-25 00:00:00'")
    return e.orderBy(F.desc("ts"), F.desc("event_id")).offset(40).limit(20).select("event_id", "user_id")


@query("WITH l AS (SELECT l_linenumber AS k, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-01-01' GROUP BY 1), r AS (SELECT l_linenumber AS k, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' GROUP BY 1) SELECT k, field, a, b, a IS NOT DISTINCT FROM b AS same FROM (SELECT k, unnest(['n', 'q']) AS field, unnest([CAST(l.n AS DOUBLE), l.q]) AS a, unnest([CAST(r.n AS DOUBLE), r.q]) AS b FROM l FULL JOIN r USING (k))")
def run_compare(spark: SparkSession, sf: str) -> DataFrame:
    l = kb.table(spark, sf, "lineitem")
    cut = F.col("l_shipdate") < F.expr("timestamp_ntz'1995-01-01 00:00:00'")
    side = lambda rows, x: rows.groupBy(F.col("l_linenumber").alias("k")).agg(F.count("*").cast("double").alias("n"), F.round(F.sum("l_quantity"), 2).alias("q")).selectExpr("k", f"stack(2, 'n', n, 'q', q) AS (field, {x})")
    both = side(l.where(cut), "a").join(side(l.where(~cut), "b"), ["k", "field"], "full")
    return both.withColumn("same", F.col("a").eqNullSafe(F.col("b")))


@query("WITH m(ext, task) AS (SELECT * FROM (VALUES ('md'), ('pdf'), ('csv')) e(ext), (VALUES ('clean'), ('chunk'), ('embed')) t(task)) SELECT ext, task, CASE WHEN ext = 'pdf' AND task = 'clean' THEN 'pdf.clean.custom' WHEN task <> 'embed' THEN '*.' || task || '.default' ELSE 'fallback' END AS profile FROM m")
def profile_matrix(spark: SparkSession, sf: str) -> DataFrame:
    exts, tasks = spark.createDataFrame([("md",), ("pdf",), ("csv",)], "ext string"), spark.createDataFrame([("clean",), ("chunk",), ("embed",)], "task string")
    own = spark.createDataFrame([("pdf", "clean", "pdf.clean.custom", False), ("csv", "chunk", "csv.chunk.off", True)], "ext string, task string, own string, disabled boolean").where("NOT disabled").drop("disabled")
    default = spark.createDataFrame([("clean", "*.clean.default"), ("chunk", "*.chunk.default")], "task string, any string")
    m = exts.crossJoin(tasks).join(own, ["ext", "task"], "left").join(default, "task", "left")
    return m.select("ext", "task", F.coalesce("own", "any", F.lit("fallback")).alias("profile"))


@query("WITH RECURSIVE t AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderkey - 1 END AS prev FROM orders), c AS (SELECT id, id AS root, 0 AS attempt FROM t WHERE prev IS NULL OR prev NOT IN (SELECT id FROM t) UNION ALL SELECT t.id, c.root, c.attempt + 1 FROM t JOIN c ON t.prev = c.id) SELECT id, root, CAST(attempt AS BIGINT) AS attempt FROM c")
def retry_chain(spark: SparkSession, sf: str) -> DataFrame:
    """Chains have at most three retries here, the engine's own bound, so three joins close them.

    Every join is shuffled and merged, ``_ROWS`` rows a task: file sizes would say that ids are few enough to send to all.
    """
    t = kb.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_orderkey") - 1).alias("prev"))
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-t.count() // _ROWS))
    by = lambda rows, key: rows.repartition(width, key).hint("merge")
    retries = t.where("prev IS NOT NULL")
    lost = by(retries, "prev").join(by(t.select(F.col("id").alias("prev")), "prev"), "prev", "left_anti")
    begun = t.where("prev IS NULL").select("id").unionByName(lost.select("id"))
    out = last = materialize(begun.select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("attempt")), "attempts")
    for _ in range(3):
        before = last.select(F.col("id").alias("prev"), "root", "attempt")
        last = materialize(by(retries, "prev").join(by(before, "prev"), "prev").select("id", "root", (F.col("attempt") + 1).alias("attempt")), "attempts")
        out = out.unionByName(last)
    return out


@query("SELECT time_bucket(INTERVAL '6 hours', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_events(spark: SparkSession, sf: str) -> DataFrame:
    e = kb.table(spark, sf, "events").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n", "total")


@query("SELECT b - to_hours(6 * k) AS start, event_type, count(*) AS n FROM (SELECT time_bucket(INTERVAL '6 hours', ts) AS b, event_type, unnest([0, 1]) AS k FROM events) GROUP BY 1, 2")
def sliding_events(spark: SparkSession, sf: str) -> DataFrame:
    e = kb.table(spark, sf, "events").groupBy(F.window("ts", "12 hours", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return e.select(F.col("w.start").alias("start"), "event_type", "n")


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '2 hours' THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_events(spark: SparkSession, sf: str) -> DataFrame:
    e = kb.table(spark, sf, "events").groupBy(F.session_window("ts", "2 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return e.select("user_id", F.col("w.start").alias("start"), "n")
