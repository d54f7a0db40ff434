"""Retry chains with gaps, copies and negative keys against the SQL; no table of ids is sent to all tasks."""

import duckdb

from corpusmill.plans import analytics


def test_odd_keys(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(analytics, "_ROWS", 3, raising=False)
    keys = [0, 1, 2, 3, 5, 6, 8, 9, 11, 13, 13, 14, -4, -3, -1, 20, 21, 21, 22, 23, 40]
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    plan = analytics.retry_chain(spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert sorted(map(tuple, plan.collect())) == sorted(con.execute(analytics.SQL["retry_chain"]).fetchall())
    assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString()
