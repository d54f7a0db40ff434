"""The pipeline's stages on a small folder of tables."""

import random

import pytest

from test_llm_operators import SCHEMA, corpus  # noqa: F401


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(r[0], r[1], r[2], r[3], r[4]) for r in corpus() if r[0] is not None]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(rows[11][1].split()[:12]))], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, folder):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, ids = docs.columns, []
    for name, stage in pipeline.STAGES:
        docs = pipeline.materialize(stage(spark, docs, folder))
        if name != "packing":
            assert docs.columns == columns
            ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    assert not {3000, 3001, 3002, 3003} & ids[0]
    assert 2000 not in ids[1] and 0 in ids[1]
    assert 11 not in ids[2]
    assert len(ids[3]) >= 0.97 * len(ids[2])
    packed = {d for r in docs.collect() for d in r.doc_ids}
    assert packed == ids[3]
    assert pipeline.run(spark, folder).count() == docs.count()


def test_language_id_drops_noise_with_letters(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = random.Random(8)
    kinds = {"xa": ["ka", "lo", "mi", "tu", "ren"], "xb": ["öst", "gra", "üm", "pel", "dor"], "xc": ["shi", "wen", "quo"], "xd": ["éba", "jif", "zev", "yco"]}
    say = lambda g, n: " ".join("".join(rng.choices(kinds[g], k=2)) for _ in range(n))
    clean = [(i, say(g, rng.randint(1, 60)), g) for i in range(400) for g in [sorted(kinds)[i % 4]]]
    noise = [(1000 + i, " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(4, 9))) for _ in range(30)), None) for i in range(20)]
    foreign = [(2000 + i, " ".join("".join(rng.choices(["nugh", "psov", "hrab"], k=2)) for _ in range(30)), None) for i in range(20)]
    mixed = [(3000 + i, " ".join(say(g, 20) for g in sorted(kinds)), None) for i in range(20)]
    docs = spark.createDataFrame(clean + noise + foreign + mixed, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in pipeline.language_id(spark, docs, "").collect()}
    assert kept == {r[0] for r in clean}


def test_near_duplicates_keep_one_row_of_each_group(spark):
    """Ids that repeat with other texts, equal rows and null ids."""
    pipeline = pytest.importorskip("corpus_pipeline")
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(0, a), (1, a), (1, b), (5, c), (5, c), (None, d), (None, d), (None, a)]
    got = pipeline.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), "").collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == [("0", a), ("1", b), ("5", c), ("None", d)]


def test_stages_take_any_rows(spark, folder):
    """Null and repeated ids with other texts, equal rows, an extra column named like an operator's own, an empty table."""
    pipeline = pytest.importorskip("corpus_pipeline")
    texts = [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 60").orderBy("doc_id").collect()]
    leak = spark.read.parquet(f"{folder}/benchmark.parquet").first().text
    rows = [(i, t, "xa" if i % 3 else "xb", "s", len(t), i) for i, t in enumerate(texts) if i != 11]
    odd = [(None, None), (None, "1234 !!"), (None, texts[20]), (7, "..."), (7, texts[21] + " ka"), (20, texts[20]), (20, texts[20]), (None, leak), (5, leak)]
    docs = spark.createDataFrame(rows + [(i, t, None, None, None, 1) for i, t in odd], "doc_id long, text string, lang string, source string, n_chars long, class_id long")
    for name, stage in pipeline.STAGES:
        empty = stage(spark, docs.limit(0), folder)
        assert empty.count() == 0
        before = sorted((str(r.doc_id), r.text or "") for r in docs.collect())
        out = pipeline.materialize(stage(spark, docs, folder))
        if name == "packing":
            break
        assert out.columns == docs.columns == empty.columns
        after = sorted((str(r.doc_id), r.text or "") for r in out.collect())
        gone = list(before)
        for r in after:
            gone.remove(r)
        if name == "language_id":
            assert {("None", ""), ("None", "1234 !!"), ("7", "...")} <= set(gone) and ("7", texts[7]) in after
        elif name == "near_duplicates":
            assert [r for r in after if r[1] == texts[20]] == [("20", texts[20])] and [r for r in after if r[1] == leak] == [("5", leak)]
        elif name == "decontamination":
            assert ("5", leak) in gone and ("5", texts[5]) in after
        docs = out
