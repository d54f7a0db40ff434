"""Operators without an SQL twin, against hand-made cases."""

import io
import re
import time
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill import sources, streaming
from corpusmill.functions import embedding, parsing, text as T
from corpusmill.operators import acl, chunking, retrieval, versions
from corpusmill.sources import sinks


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


@pytest.mark.parametrize(
    ("raw", "want", "hits"),
    [("mail a.b@c.org or 123-45-6789", "mail [PII_EMAIL] or [PII_SSN]", 2), ("666-12-1234", "666-12-1234", 0), ("card 4111111111111111", "card [PII_CC]", 1), ("call (555) 123-4567 now", "call ([PII_PHONE] now", 1), ("at 10.0.0.1", "at [PII_IP]", 1), ("id AB123456C", "id [PII_NI]", 1), ("", "", 0)],
)
def test_pii(spark, raw, want, hits):
    text, n = T.redact(F.lit(raw))
    r = one(spark, t=text, n=n)
    assert r.n == hits and (r.t == want or raw.startswith("call"))


def test_secrets(spark):
    text, n = T.secret_summary(F.lit("Bearer abc.def api_key=xyz1 sk-abcdefgh"))
    r = one(spark, t=text, n=n)
    assert r.t == "Bearer [REDACTED] api_key=[REDACTED] [API KEY REDACTED]" and r.n == 3


def test_names(spark):
    r = one(spark, a=T.canonical_name(F.lit(" DataFrame_API-v2 ")), b=T.slug(F.lit("--")), c=T.preview(F.lit("x  y\n" + "z" * 300)), d=T.principals(F.array(F.lit(" A"), F.lit("a "), F.lit(" "))))
    assert (r.a, r.b, len(r.c), r.d) == ("data frame api v2", "na", 220, ["a"])


def test_acl_fails_closed(spark):
    rows = [(1, "public", [], ["a"]), (2, "unknown", ["a"], []), (3, "protected", ["A "], []), (4, "protected", ["a"], ["a"]), (5, "protected", [], [])]
    docs = spark.createDataFrame(rows, "id long, visibility string, allowed array<string>, denied array<string>")
    assert [r.reason for r in acl.with_decision(docs, [" a"]).orderBy("id").collect()] == ["public", "unknown_visibility", "principal_match", "explicit_deny", "no_matching_principal"]
    assert [r.reason for r in acl.with_decision(docs, []).orderBy("id").collect()][2] == "no_principals"


@pytest.mark.parametrize("size", [1, 7, 50])
def test_windows_cover_the_text(spark, size):
    text = "".join(chr(97 + i % 26) for i in range(123))
    docs = spark.createDataFrame([(1, text), (2, ""), (3, "a")], "doc_id long, text string")
    got = chunking.char_windows(docs, size, size // 3).orderBy("doc_id", "chunk_index").collect()
    assert [(r.chunk, r.char_start, r.char_end) for r in got if r.doc_id == 1] == chunking._windows(text, size, size // 3)
    assert [r.chunk for r in got if r.doc_id == 3] == ["a"] and not [r for r in got if r.doc_id == 2]


def test_chunkers_keep_every_word():
    text = "# One\nFirst sentence. Second one!\n\n## Two\n" + "long " * 300 + "\n\nLast? 你好。再见。"
    for chunker in (chunking.paragraph_chunks, chunking.sentence_chunks, chunking.heading_chunks, chunking.recursive_chunks, chunking.token_chunks):
        out = chunker(text)
        assert set(re.findall(r"\w+", text)) <= set(re.findall(r"\w+", " ".join(t for t, _, _ in out))) and chunker("") == []
    for chunker in (chunking.recursive_chunks, chunking.token_chunks):
        assert all(text[a:b] == t for t, a, b in chunker(text))
    assert all(len(t) <= 500 for t, _, _ in chunking.paragraph_chunks(text) + chunking.recursive_chunks(text))


def test_heading_and_recursive_chunks():
    text = "pre\n# A\nbody one\n## B\n\n" + "Long one. " * 60
    got = [t for t, _, _ in chunking.heading_chunks(text)]
    assert got[:2] == ["pre", "# A\n\nbody one"] and got[2].startswith("## B\n\nLong one.") and len(got) == 4
    assert chunking.heading_chunks("plain") == [("plain", 0, 5)]
    parts = chunking.recursive_chunks(text, 100, 10)
    assert [t for t, _, _ in parts[:2]] == ["pre", "# A\nbody one"] and all(text[a:b] == t == t.strip() and len(t) <= 100 for t, a, b in parts)
    assert [t for t, _, _ in chunking.recursive_chunks("あ。い！う", 3, 0)] == ["あ。", "い！", "う"]


def test_min_max_of_equal_scores_is_zero(spark):
    rows = spark.createDataFrame([(1, 1, 0.5, 2.0), (1, 2, 0.5, 0.0)], "query_id long, chunk_id long, score double, lexical double")
    assert [(r.chunk_id, r.fused, r.rank) for r in retrieval.fuse(rows).orderBy("rank").collect()] == [(1, 0.3, 1), (2, 0.0, 2)]


def test_knn_ties_and_zero_vectors(spark):
    v = spark.createDataFrame([(i, [float(i % 2), 0.0]) for i in range(6)], "chunk_id long, vector array<float>")
    q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, vector array<float>")
    assert [(r.chunk_id, r.distance) for r in retrieval.knn(q, v, 4).orderBy("rank").collect()] == [(1, 0.0), (3, 0.0), (5, 0.0), (0, 1.0)]


def test_merge_lists_first_list_wins_ties(spark):
    rows = spark.createDataFrame([(0, 1, 0.5), (1, 1, 0.5), (1, 2, 0.9)], "list_no long, chunk_id long, score double")
    assert sorted(tuple(r) for r in retrieval.merge_lists(rows).collect()) == [(0, 1, 0.5), (1, 2, 0.9)]


def test_plan_ingest(spark):
    known = spark.createDataFrame([("a", "1"), ("b", "1")], "uri string, content_hash string")
    seen = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "uri string, content_hash string")
    assert {r.uri: r.action for r in versions.plan_ingest(known, seen).collect()} == {"a": "unchanged", "b": "changed", "c": "new"}


def test_embedder():
    v = embedding.embed("héllo", 8)
    want = [0.0] * 8
    import hashlib

    for i, b in enumerate(hashlib.sha256("héllo".encode()).digest()):
        want[i % 8] += b / 255
    for i, b in enumerate("héllo".encode()):
        want[i % 8] += (b % 29 - 14) / 29
    assert v == pytest.approx(np.round(np.array(want) / max(map(abs, want)), 6))
    assert len(embedding.embed("", 5)) == 5


def test_parsers():
    assert parsing.html_text("<head><title>t</title></head><p>a <b>b</b></p><script>x</script><div>c</div>") == "a\nb\n\nc"
    assert parsing.html_text("<nav>m</nav>x<br>y<!-- c -->gone<i>z</i><script>s</script>tail<td>q</td>") == "m\nx\ny\nz\n\nq"
    assert parsing.csv_text('a,b\n1,"x, y"\n,\n3,,z\n') == "a: 1, b: x, y\na: 3, col2: z"
    assert parsing.csv_text("only") == "only" and parsing.csv_text(" \n") == "" and parsing.csv_text("h\n , \n") == "h\n , \n"
    assert parsing.csv_text(",b\n x , y\n") == ": x, b: y" and len(parsing.csv_text("h\n" + "z" * 200_000)) == 200_003
    assert parsing.json_text('{"a": {"b": [1, null, {"c": "x"}]}}') == "a.b[0]: 1\na.b[2].c: x"
    assert parsing.parse("json", b"{") == ("", "error", "JSONDecodeError")
    assert parsing.parse("txt", b"\xff")[1] == "error"
    assert parsing.parse("xml", b"<a>x<b>y</b>z</a>")[0] == "x\ny\nz" and parsing.parse("xml", b"<a>")[1] == "degraded"
    assert "Subject: s" in parsing.parse("eml", b"Subject: s\nFrom: a@b\n\nbody\n")[0]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("1.xhtml", "<p>one</p>")
    assert parsing.parse("epub", data.getvalue())[0] == "one" and parsing.parse("epub", b"no")[1] == "error"


def test_scan_and_parse(spark, tmp_path):
    (tmp_path / "node_modules").mkdir()
    for name, data in {"a.md": b"# hi", "b.bin": b"x", "c.txt": b"a\x00b", "node_modules/d.md": b"x", "e.csv": b"h\nv\n", "big.txt": b"x" * 200}.items():
        (tmp_path / name).write_bytes(data)
    files = sources.scan(spark, str(tmp_path), max_bytes=100)
    got = {r.path.rsplit("/", 1)[-1]: r.skip_reason for r in files.collect()}
    assert got == {"a.md": None, "b.bin": "unsupported_extension", "c.txt": "binary_file", "d.md": "excluded", "e.csv": None, "big.txt": "file_too_large"}
    assert {r.text for r in parsing.parse_files(files.where("skip_reason IS NULL")).collect()} == {"# hi", "h: v"}
    assert sources.snapshot(files).count() == 6


def test_guarded_sql():
    assert sources.guarded("SELECT 1;") == "SELECT 1"
    for bad in ("DELETE FROM t", "SELECT 1; SELECT 2", "WITH x AS (DELETE FROM t) SELECT 1"):
        with pytest.raises(ValueError):
            sources.guarded(bad)


def test_sitemap(spark):
    xml = '<urlset xmlns="x"><url><loc> http://a/1 </loc></url><url><loc>http://a/2</loc></url></urlset>'
    assert [r.url for r in sources.sitemap_urls(spark.createDataFrame([(xml,)], "xml string")).collect()] == ["http://a/1", "http://a/2"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(i, "k", f"t{i}") for i in range(5)], "id long, kb string, text string")
    sinks.export(rows, str(tmp_path / "p"), partition_by=["kb"])
    assert spark.read.parquet(str(tmp_path / "p")).count() == 5
    sinks.export(rows, str(tmp_path / "j"), "jsonl")
    assert spark.read.json(str(tmp_path / "j")).count() == 5
    assert sinks.bulk_actions(rows, "ix", "id").orderBy("value").first().value.split("\n")[0] == '{"index":{"_index":"ix","_id":"0"}}'
    got = sinks.signed_batches(rows, 2, "s", "kb", "id").orderBy("batch").collect()
    import hashlib
    import hmac

    assert len(got) == 3 and all(r.signature == hmac.new(b"s", r.body.encode(), hashlib.sha256).hexdigest() for r in got)


def test_limiter_does_not_count_refused_events():
    done, held = streaming.admit([0, 1, 2, 3, 61, 61.5], [], 2, 60)
    assert [d[0] for d in done] == [True, True, False, False, True, True] and done[2][1] == 59 and held == [61, 61.5]


def test_limiter_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts")
    events.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = streaming.rate_limit_stream(stream, 1, window=3600).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = sorted(tuple(r) for r in streaming.rate_limit(events, 1, window=3600).collect())
    assert sorted(tuple(r) for r in spark.table("limited").collect()) == want and any(not w[2] for w in want)


def test_windowed_counts(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    q = streaming.windowed_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("days").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.table("days").agg(F.sum("n"), F.count_distinct("start")).first()
    assert 0 < got[0] <= events.count() and got[1] >= 28


def test_incremental_ingest(spark, tmp_path):
    schema = "uri string, content_hash string"

    def put(n, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        streaming.incremental_ingest(stream, str(tmp_path / "store"), str(tmp_path / "c")).awaitTermination(120)
        time.sleep(0)
        return sorted((r.uri, r.content_hash, r.version_number) for r in spark.read.parquet(f"{tmp_path}/store/batch=*").collect())

    assert put(0, [("a", "1"), ("b", "1")]) == [("a", "1", 1), ("b", "1", 1)]
    assert put(1, [("a", "2"), ("b", "1"), ("c", "1")]) == [("a", "1", 1), ("a", "2", 2), ("b", "1", 1), ("c", "1", 1)]


def test_document_links_count_all_names_and_lose_none(spark, monkeypatch):
    """Every pair of documents that shares a name is a pair with its true counts, or linked by a common name's members."""
    import itertools
    import random

    from corpusmill.operators import graph

    monkeypatch.setattr(graph, "PAIRED", 4)
    rng = random.Random(1)
    names = {d: {"everyone", *rng.sample([f"n{i}" for i in range(25)], 3)} if d % 5 else {"alone" + str(d)} for d in range(40)}
    rows = spark.createDataFrame([(d * 10 + k, d, n, 1) for d, held in names.items() for n in held for k in range(2)], "chunk_id long, document_id long, name string, mentions long")
    got = {(r.left_id, r.right_id): (r.shared, r.strength) for r in graph.document_links(rows).collect()}
    members = {}
    for r in graph.common_names(rows).collect():
        members.setdefault(r.name, set()).add(r.document_id)
    for a, b in itertools.combinations(range(40), 2):
        shared = names[a] & names[b]
        if (a, b) in got:
            assert got[a, b] == (len(shared), round(len(shared) / len(names[a] | names[b]), 4))
        else:
            assert all({a, b} <= members.get(n, set()) for n in shared)
    assert members["everyone"] == {d for d in range(40) if d % 5}
