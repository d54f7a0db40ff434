"""The time of a new chunk is that of the id it revises; ``10**12 % 30`` is not 0, so the new id's own remainder told another."""

import duckdb

from corpusmill.plans import search


def test_more_recent_chunk_is_told_as_in_sql(spark, tmp_path):
    """Chunk 180 becomes its mean with 181, which is longer and so the nearer one; its time is 0, that of 181 is 7."""
    rows = [(180, [1.0, 0.0, 0.0], 0), (181, [1.6, 0.9, 0.0], 0), (300, [0.0, 0.0, 1.0], 0)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(search.SQL["conflict_review"])
    names = [c[0] for c in want.description]
    want = sorted(map(str, want.fetchall()))
    assert any("'resolved_auto_recency', 'keep_old'" in row for row in want)
    assert sorted(str(tuple(r)) for r in search.conflict_review(spark, str(tmp_path)).select(*names).collect()) == want
