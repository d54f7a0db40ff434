"""Metrics on the edge of a digit, and runs that find nothing, against the SQL of the same items."""

import duckdb
import pytest

from corpusmill.operators import evaluation as E
from corpusmill.plans import evaluation as plan


@pytest.mark.parametrize("parts", [1, 7])
def test_edges_of_digits(spark, parts):
    n = 200  # a mean rank of 1.005, means of thirds that end in 5
    rows = [("m", i, 10, 1 + (i == 0), 1 / (1 + i % 3), 0.0313 if i % 2 else 0.25, (i % 7) / 10, (i % 4) / 3) for i in range(n)]
    items = spark.createDataFrame(rows, "mode string, item_id long, results int, rank long, mrr double, coverage double, precision double, recall double").repartition(parts)
    con = duckdb.connect()
    con.execute("CREATE TABLE e (mode TEXT, item_id BIGINT, results BIGINT, rank BIGINT, mrr DOUBLE, coverage DOUBLE, precision DOUBLE, recall DOUBLE)")
    con.executemany("INSERT INTO e VALUES (?, ?, ?, ?, ?, ?, ?, ?)", rows)
    rel = con.execute(f"SELECT mode, {plan._METRICS} FROM e GROUP BY mode")
    want = dict(zip([c[0] for c in rel.description], rel.fetchone()))
    assert E.metrics(items, "mode").collect()[0].asDict() == want


@pytest.mark.parametrize("wanted", [3, 6, 7])
def test_sums_do_not_depend_on_order(spark, wanted):
    rows = [("m", 0, None, 0.0, 0.0, 0.0, (i * 5 % (wanted + 1)) / wanted) for i in range(997)]
    schema = "mode string, results int, rank long, mrr double, coverage double, precision double, recall double"
    one = spark.createDataFrame(rows, schema)
    sums = {o.agg(E.exact_sum(o.recall).alias("s")).collect()[0].s for o in (one, one.repartition(5), one.orderBy("recall").coalesce(1), one.orderBy(one.recall.desc()).coalesce(1))}
    assert len(sums) == 1
    assert abs(sums.pop() - sum(i * 5 % (wanted + 1) for i in range(997)) / wanted) < 1e-9


def test_metric_without_a_value_has_no_delta(spark, tmp_path):
    """No item is found: the SQL gives no row of the mean rank."""
    spark.createDataFrame([(1, "zebra quilt"), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([(1, "zebra here and a quilt there"), (2, "nothing else")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    for t in ("benchmark", "documents"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    rel = con.execute(plan.SQL["eval_deltas"])
    names = [c[0] for c in rel.description]
    got = sorted(tuple(r[c] for c in names) for r in plan.eval_deltas(spark, str(tmp_path)).collect())
    assert got == sorted(rel.fetchall())
