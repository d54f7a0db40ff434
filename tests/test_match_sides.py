"""Keys cut from a few queries are many more rows than Spark takes them for; they were broadcast through the driver."""

import pytest

from corpusmill import shared
from corpusmill.operators import graph


@pytest.fixture
def sides(spark):
    queries = spark.createDataFrame([(i, i, f"{'x' * 300}name{i}q", [f"term{j}" for j in range(i, i + 40)]) for i in range(3)], "no long, query_id long, compact string, asked array<string>")
    known = spark.range(4_000).selectExpr("concat('name', id, 'q') AS name", "array(concat('name', id, 'q')) AS sought", "array(concat('term', id), concat('name', id)) AS terms")
    return shared.materialize(queries, "queries"), shared.materialize(known, "known")


def test_keys_of_letters_stay_where_they_are(spark, sides, monkeypatch):
    out = graph._by_letters(*sides, 8)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BuildLeft" not in plan and {(r.no, r.name) for r in out.collect()} == {(i, f"name{i}q") for i in range(3)}
    monkeypatch.setattr(graph, "small", lambda df: shared.small(df, 10))
    out = graph._by_letters(*sides, 8)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.no, r.name) for r in out.collect()} == {(i, f"name{i}q") for i in range(3)}


def test_keys_of_terms_are_not_broadcast(spark, sides):
    out = graph._by_terms(*sides, 8)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.no, r.name) for r in out.collect()} == {(i, f"name{j}q") for i in range(3) for j in range(i, i + 40)}


def test_a_table_of_many_rows_is_not_broadcast(spark):
    """20 000 equal rows are a few hundred bytes of Parquet."""
    rows = shared.materialize(spark.range(20_000).selectExpr("0 AS k", "'a' AS name"))
    asked = spark.range(300_000).selectExpr("id AS k")
    assert "Broadcast" not in asked.join(shared.small(rows, 100), "k")._jdf.queryExecution().executedPlan().toString()
