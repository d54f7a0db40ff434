"""Artifacts: written whole or not at all, read by manifest, runs and their logs."""

import hashlib
import hmac
import json
import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from corpusmill.sources import artifacts as A, sinks

SCHEMA = "id long, text string, tags array<string>"


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(i, f'té\n"{i}"', ["a"] if i % 2 else None) for i in range(50)] + [(None, None, [])], SCHEMA).repartition(4)


@pytest.mark.parametrize("kind", A.FORMATS)
def test_comes_back(spark, rows, tmp_path, kind):
    told = A.write_artifact(rows, f"{tmp_path}/x", kind, "r1")
    assert told["rows"] == 51 and told["run"] == "r1" and told["bytes"] == sum(f.stat().st_size for f in Path(tmp_path, "x").glob("part-*"))
    got = A.read_artifact(spark, f"{tmp_path}/x", SCHEMA)
    assert sorted(map(str, got.collect())) == sorted(map(str, rows.collect()))
    # Another write takes its place.
    A.write_artifact(rows.where("id < 3"), f"{tmp_path}/x", kind)
    assert A.read_artifact(spark, f"{tmp_path}/x", SCHEMA).count() == 3
    A.write_artifact(rows.limit(0), f"{tmp_path}/none", kind)
    assert A.read_artifact(spark, f"{tmp_path}/none", SCHEMA).count() == 0


def test_a_lost_task_leaves_no_double_rows(spark, rows, tmp_path):
    flag = f"{tmp_path}/died"

    def once(batches):
        yield from batches
        if not os.path.exists(flag):
            open(flag, "w").close()
            raise RuntimeError("lost")

    failing = rows.coalesce(1).mapInArrow(once, SCHEMA)
    with pytest.raises(Exception, match="lost"):
        A.write_artifact(failing, f"{tmp_path}/x", "parquet")
    assert A.read_manifest(f"{tmp_path}/x") is None
    with pytest.raises(Exception, match="no finished artifact"):
        A.read_artifact(spark, f"{tmp_path}/x", SCHEMA).count()
    A.write_artifact(failing, f"{tmp_path}/x", "parquet")
    assert A.read_artifact(spark, f"{tmp_path}/x", SCHEMA).count() == 51


def test_attempts_that_do_not_count(spark, rows, tmp_path):
    """Two attempts of a task wrote files; the manifest has those of one, and an aborted write deletes its own."""
    w = A._Writer({"path": f"{tmp_path}/x", "kind": "jsonl"})
    batches = rows.select(F.to_json(F.struct("id")).alias("value")).toArrow().to_batches()
    first, second = w.write(iter(batches)), w.write(iter(batches))
    w.commit([second, None])
    assert len(list(Path(tmp_path, "x").glob("part-*"))) == 2 and A.read_artifact(spark, f"{tmp_path}/x").count() == 51
    w.abort([first])
    assert len(list(Path(tmp_path, "x").glob("part-*"))) == 1
    part = next(Path(tmp_path, "x").glob("part-*"))
    part.write_bytes(part.read_bytes()[:-5])
    with pytest.raises(Exception, match="isn't what was written"):
        A.read_artifact(spark, f"{tmp_path}/x").count()
    with pytest.raises(ValueError, match="kind"):
        A._Writer({"path": "x", "kind": "csv"})


def test_runs(spark, rows, tmp_path):
    bad = rows.select(F.raise_error(F.lit("broken source")).alias("x"))
    made = {"good": rows, "bad": bad}
    status = lambda log: {(r.artifact, r.kind): r.status for r in log.collect()}
    plan = A.export_run(spark, made, str(tmp_path), "r", dry_run=True)
    assert set(status(plan).values()) == {"planned"} and not os.listdir(tmp_path)
    assert status(A.export_run(spark, made, str(tmp_path), "r", ("jsonl",))) == {("good", "jsonl"): "uploaded", ("bad", "jsonl"): "failed"}
    assert status(A.export_run(spark, made, str(tmp_path), "r")) == {("good", "jsonl"): "skipped", ("good", "parquet"): "uploaded", ("bad", "jsonl"): "failed", ("bad", "parquet"): "failed"}
    assert status(A.export_run(spark, {"good": rows.limit(5)}, str(tmp_path), "r", ("jsonl",), overwrite=True)) == {("good", "jsonl"): "uploaded"}
    assert A.read_artifact(spark, f"{tmp_path}/r/good.jsonl", SCHEMA).count() == 5
    log = [json.loads(r.value) for r in A.read_artifact(spark, f"{tmp_path}/r/pipeline_runs.jsonl").collect()]
    assert [(r["artifact"], r["status"], r["rows"]) for r in log] == [("good", "uploaded", 5)]
    assert "| good | jsonl | uploaded | 5 |" in Path(tmp_path, "r", "export_summary.md").read_text()


@pytest.mark.parametrize("secret", ["s", "a long secret " * 10])
def test_signatures(spark, secret):
    rows = spark.createDataFrame([(g, i, f"é{i}") for g in ("a", "b", None) for i in range(23)], "g string, i long, t string")
    got = sinks.signed_batches(rows, 10, secret, "g", "i").collect()
    assert sorted((str(r.g), r.batch, r.n) for r in got) == sorted((str(g), b, n) for g in ("a", "b", None) for b, n in enumerate((10, 10, 3)))
    for r in got:
        assert r.signature == hmac.new(secret.encode(), r.body.encode(), hashlib.sha256).hexdigest()
        assert [x["i"] for x in json.loads(r.body)] == list(range(r.batch * 10, r.batch * 10 + r.n))
