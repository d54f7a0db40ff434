"""WARC archives, fill-in-the-middle and conversation repair against plain versions."""

import gzip
import hashlib
import itertools
import random
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import conversation_repair as repair, fill_middle as fim, queries, warc

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("name", ["op11_warc", "op12_fill_middle"])
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    got = queries.queries()[name](spark, SF).select(columns)
    assert sorted_rows(got.collect()) == sorted_rows(rel.fetchall())


# Fill in the middle


@pytest.mark.parametrize(("unit", "pattern"), [("char", r"(?s)."), ("word", r"[ \t\n\r\x0b\x0c]+|(?:[A-Za-z0-9]|[^\x00-\x7f])+|[^ \t\n\r\x0b\x0cA-Za-z0-9\x80-\U0010ffff]+"), ("line", r"[^\n]*\n|[^\n]+")])
def test_units_are_those_of_a_pattern(unit, pattern):
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choices("ab1 \n\t.,é😀字", k=rng.randint(0, 30)))
        at = fim.edges(np.frombuffer(text.encode("utf-32-le"), "<u4"), unit)
        assert [text[a:b] for a, b in zip(at[:-1], at[1:])] == re.findall(pattern, text)


def test_fill_in_middle_of_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, "".join(rng.choices("ab <>PSM\né😀", k=rng.randint(0, 40))), "clash") for i in range(400)]
    rows += [(None, "null id", "x"), (7, None, "x"), (8, "", "x"), (9, "has <M> inside", "x"), (10, "<P", "x"), (11, "é😀" * 1_500_000, "x"), rows[3], rows[3]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string")
    for unit in ("char", "word", "line"):
        got = fim.fill_in_middle(docs, unit)
        back = got.select("doc_id", "form", fim.restore(F.col("output"), F.col("form")).alias("text"), "output", "prefix_chars", "middle_chars", "n").collect()
        assert sorted_rows((r.doc_id, r.text) for r in back) == sorted_rows((i, t or "") for i, t, _ in rows)
        for r in back:
            if r.form == "plain":
                assert r.output == r.text and r.prefix_chars is None and r.middle_chars is None
                continue
            p, m, s = r.text[: r.prefix_chars], r.text[r.prefix_chars :][: r.middle_chars], r.text[r.prefix_chars + r.middle_chars :]
            assert r.output == (f"<P>{p}<S>{s}<M>{m}" if r.form == "psm" else f"<S>{s}<P>{p}<M>{m}")
            if unit == "char":
                h = [int(sha(f"1:{'' if r.doc_id is None else r.doc_id}")[k : k + 8], 16) for k in (0, 8, 16, 24)]
                assert r.n == len(r.text) and sorted(x % (r.n + 1) for x in h[:2]) == [r.prefix_chars, r.prefix_chars + r.middle_chars]
                assert h[2] % 100 < 90 and r.form == ("spm" if h[3] % 100 < 20 else "psm")
        assert {r.form for r in back} == {"plain", "psm", "spm"}
        assert fim.fill_in_middle(docs.limit(0), unit).count() == 0
    with pytest.raises(ValueError, match="unit"):
        fim.fill_in_middle(docs, "page")


# Conversation repair


def plain_repair(turns):
    """Every choice of edits with up to two inserted turns in each gap, tried one by one. ``turns``: (role, text) in order."""
    seen, faults = set(), []
    for role, text in turns:
        end = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    best = None
    gap = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    options = [["D"] if f in ("blank", "duplicate") else ["K", "Ru", "Ra", "D"] for f in faults]
    for edits in itertools.product(*options):
        for gaps in itertools.product(gap, repeat=len(turns) + 1):
            cost, audit, out = 0, "", []
            for i, added in enumerate(gaps):
                cost, audit, out = cost + 5 * len(added), audit + "I" * len(added), out + [(r, "") for r in added]
                if i < len(turns):
                    edit, (role, text) = edits[i], turns[i]
                    cost += {"K": 0, "R": 1, "D": 2}[edit[0]] + 5 * (faults[i] == "truncated" and edit != "D")
                    audit += edit[0]
                    if edit != "D":
                        out.append(({"Ru": "user", "Ra": "assistant"}.get(edit, role), text))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, sha("\n".join(f"{r}:{t}" for r, t in out)))
    count = lambda f: sum(x == f for x in faults)
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    return (count("blank"), count("duplicate"), count("truncated"), illegal, *best)


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        role, text = said(role), said(text)
        fate = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        out += [(conv, turn, "user" if fate == 4 else role, text)] * (0 if fate == 0 else 2 if fate == 3 else 1)
    return out


def plain_conversations(rows):
    damaged, out = plain_damage(rows), []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in damaged if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.sha256(r[3].encode()).digest()))
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv, gaps, *plain_repair([r[2:] for r in own])))
    return out


def test_repair_equals_every_choice(spark):
    rng = random.Random(6)
    rows = []
    for conv in range(60):
        for turn in sorted(rng.sample(range(6), rng.randint(1, 3))):
            rows.append((conv, turn, rng.choice(["system", "user", "assistant", "tool", None, ""]), rng.choice(["Yes.", "No!", "cut", " ", None, "Why?\n", "Yes."])))
    rows += [(None, 1, "user", "Null id."), (None, None, "assistant", "No turn."), (61, None, "user", "a."), (61, None, "user", "a."), (62, 5, "user", "x?"), (62, 5, "assistant", "x?")]
    rows += [(c, t, "user", "Gone.") for c in range(100, 140) for t in [next(t for t in range(999) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0)]][:2]
    turns = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, audit string")
    got = repair.repairs(repair.damage(turns), F.col("present"))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted_rows(got.collect()) == sorted_rows(plain_conversations(rows))
    assert sum(r.audit == "" and r.repaired_sha256 == sha("") for r in got.collect()) >= 2
    assert repair.repairs(turns.limit(0)).count() == 0


def plain_paths(steps):
    """Cost and audit with whole strings for each state."""
    layer = repair._close([(0, 0, ""), None, None, None])
    for initial, fault in steps:
        new = [None] * 4
        for q, held in enumerate(layer):
            if held:
                cost, extra = held[0], 5 * (fault == "truncated")
                offers = [(q, (cost + 2, 0, held[2] + "D"))]
                if fault not in ("blank", "duplicate"):
                    offers.append(((2, 2, 3, 2)[q], (cost + 1 + extra, 0, held[2] + "R")))
                    to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((q, initial))
                    if to:
                        offers.append((to, (cost + extra, 0, held[2] + "K")))
                for to, offer in offers:
                    new[to] = offer if new[to] is None else min(new[to], offer)
        layer = repair._close(new)
    cost, _, audit = min(x for x in (layer[0], layer[3]) if x)
    return cost, audit


@pytest.mark.parametrize("block", [1, 2, 7])
def test_paths_cut_into_blocks_equal_whole_strings(monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rng = random.Random(block)
    for _ in range(200):
        steps = [(rng.choice("suaax "), rng.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randint(0, 40))]
        paths = repair.Paths()
        for step in steps:
            paths.step(*step)
        assert paths.best() == plain_paths(steps)


def test_long_conversation_is_read_in_proportion(spark):
    paths = repair.Paths()
    for _ in range(200_001):  # no two paths meet: an odd number of turns of an unknown role
        paths.step("x", "")
    assert paths.best() == (200_002, "D" + "R" * 200_000)
    n = 30_001
    turns = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("tool").alias("role"), F.concat(F.lit("Turn "), "id", F.lit(".")).alias("text"))
    row = repair.repairs(turns).first()
    lines = [f"{'user' if i % 2 else 'assistant'}:Turn {i}." for i in range(1, n)]
    assert (row.cost, row.audit, row.illegal) == (n + 1, "D" + "R" * (n - 1), n - 1) and row.repaired_sha256 == sha("\n".join(lines))


def test_repaired_turns_are_given(spark):
    turns = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "assistant", "Again!"), (1, 2, "assistant", ""), (2, 0, "assistant", "Only.")], "conv_id long, turn long, role string, text string")
    plans = repair.plan_repairs(turns)
    got = repair.repaired(turns, plans).orderBy("conv_id", "position").collect()
    assert [tuple(r) for r in got] == [(1, 0, "R", "user", "Hi."), (1, 1, "K", "assistant", "Again!")]
    assert {r.conv_id: r.audit for r in plans.collect()} == {1: "RKD", 2: "D"}


# WARC


def page_rows():
    long, other = "<p>" + "é" * 80 + "</p>", "x" * 100
    rows = [(5, "http://a/5", long), (3, "http://a/3 b\r\nWARC-Type: forged", long), (9, None, long), (None, "http://a/n", long), (1, "u", other), (2, "u", other), (4, "u", "short"), (6, "u", "short")]
    return rows + [(7, "u", None), (8, "u", ""), (10, "u", "a\r\n\r\nb" * 50), (11, "u", "z" * 3_000_000), (12, "u", "x" * 99), (13, "u", "x" * 99), (1, "u", other), (None, "u", "only null ids " * 20), (None, "u", "only null ids " * 20)]


def plain_pages(rows):
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        ids = [p for p, _, h in rows if (h or "").encode() == payload and p is not None] if len(payload) >= 100 else []
        revisit = bool(ids) and page_id != min(ids)
        out.append((page_id, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", min(ids) if revisit else None))
    return out


def test_pages_come_back(spark, tmp_path):
    rows = page_rows()
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string").repartition(3)
    warc.write_warc(pages, f"file://{tmp_path}/w", roll=200)
    records = warc.read_warc(spark, f"file://{tmp_path}/w")
    got = warc.page_records(records)
    assert sorted_rows(got.collect()) == sorted_rows(plain_pages(rows))
    assert {r.status for r in records.select("status").collect()} == {"ok"}
    payloads = {r.record_id: bytes(r.payload).decode() for r in records.where("record_type = 'response' AND record_id <> 'urn:x-page:'").collect()}
    assert all(payloads[f"urn:x-page:{p}"] == (h or "") for p, _, h in rows if p in (3, 1, 4, 7, 10, 11))
    assert records.where("target_uri LIKE '%forged%'").first().target_uri == "http://a/3%20b%0D%0AWARC-Type:%20forged"
    assert len(list(Path(tmp_path, "w").glob("*.warc.gz"))) > 3
    # Each member is a gzip file of its own, and the whole file one too.
    for f in Path(tmp_path, "w").glob("*.warc.gz"):
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n")
    warc.write_warc(pages.limit(0), f"{tmp_path}/none")
    assert warc.page_records(warc.read_warc(spark, f"{tmp_path}/none")).count() == 0


def test_appends_and_overwrites_and_ignores_other_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "one"), (2, "u", "two")], "page_id long, url string, html string").coalesce(1)
    path = f"{tmp_path}/w"
    ids = lambda: sorted(r.record_id[-1] for r in warc.read_warc(spark, path).collect())
    warc.write_warc(pages, path)
    warc.write_warc(pages.where("page_id = 2"), path)
    assert ids() == ["1", "2", "2"]
    # What an attempt left that was not committed isn't read.
    lost = warc._Writer({"path": path}, False)
    batch = warc.with_revisits(pages).toArrow().to_batches()[0]
    written = lost.write(iter([batch]))
    assert len(written.files) == 1 and ids() == ["1", "2", "2"]
    lost.abort([written, None])
    assert not Path(path, written.files[0][0]).exists()
    warc.write_warc(pages.where("page_id = 1"), path, mode="overwrite")
    assert ids() == ["1"]


def test_failed_attempts_leave_no_double_rows(spark, tmp_path):
    """A task that dies after it wrote an archive, and is run again, is read once."""
    pages = spark.createDataFrame([(i, "u", f"text {i}") for i in range(20)], "page_id long, url string, html string").coalesce(1)
    flag = str(tmp_path / "died")

    def once(batches):
        import os

        for batch in batches:
            yield batch
        if not os.path.exists(flag):
            open(flag, "w").close()
            raise RuntimeError("lost")

    failing = warc.with_revisits(pages).mapInArrow(once, "page_id long, url string, payload binary, record_type string, refers_to long")
    spark.dataSource.register(warc.Warc)
    with pytest.raises(Exception, match="lost"):  # a local session runs each task once, so the job fails
        failing.write.format("warc").mode("append").save(f"{tmp_path}/w")
    failing.write.format("warc").mode("append").save(f"{tmp_path}/w")
    assert warc.page_records(warc.read_warc(spark, f"{tmp_path}/w")).count() == 20


def test_broken_records_are_told(spark, tmp_path):
    good = warc._member(warc.record(1, "u", b"payload", None, False, "d"), 6)
    bad = warc.record(2, "u", b"payload", None, False, "d").replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n")
    short = warc.record(3, "u", b"payload", None, False, "d")[:-6]
    data = {"a": [good, warc._member(bad, 6), warc._member(short, 1), warc._member(b"junk", 6), good], "b": [good, good[:-9]], "c": [good, b"not gzip"], "d": []}
    for name, members in data.items():
        (tmp_path / f"{name}.warc.gz").write_bytes(b"".join(members))
    records = warc.read_warc(spark, str(tmp_path)).orderBy("archive").collect()
    found = {n: [r.status for r in records if r.archive == f"{n}.warc.gz"] for n in data}
    assert found == {"a": ["ok", "digest", "frame", "frame", "ok"], "b": ["ok", "truncated"], "c": ["ok", "truncated"], "d": []}
    with pytest.raises(Exception, match="broken record"):
        warc.page_records(warc.read_warc(spark, str(tmp_path))).collect()


@pytest.mark.parametrize("piece", [1, 3, 64])
def test_members_are_found_in_pieces_of_any_size(monkeypatch, piece):
    import io

    monkeypatch.setattr(warc, "PIECE", piece)
    data = [warc.record(i, f"http://{i}", b"x" * i, None, False, "d") for i in range(5)]
    assert list(warc._members(io.BytesIO(b"".join(warc._member(d, 6) for d in data)))) == [(d, True) for d in data]


def test_query_over_conversations(spark):
    con = duckdb.connect()
    rows = con.execute(f"SELECT conv_id, turn, role, text FROM '{SF}/conversations.parquet'").fetchall()
    got = {r.conv_id: r for r in queries.op13_conversation_repair(spark, SF).collect()}
    assert set(got) == {r[0] for r in rows}
    damaged = plain_damage(rows)
    for conv, r in got.items():
        own = sorted((x for x in damaged if x[0] == conv), key=lambda x: x[1])
        seen, faults = set(), []
        for _, _, role, text in own:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
            seen.add((role, text))
        assert (r.cost, r.audit) == plain_paths([(x[2][:1], f) for x, f in zip(own, faults)])
        out, rest = [], [*own]
        for edit in r.audit:
            asked = "assistant" if out and out[-1][0][0] == "u" else "user"
            if edit == "I":
                out.append((asked, ""))
                continue
            _, _, role, text = rest.pop(0)
            out += [] if edit == "D" else [(role if edit == "K" else asked, text)]
        assert r.repaired_sha256 == sha("\n".join(f"{a}:{b}" for a, b in out)) and (r.blank, r.duplicate, r.truncated) == tuple(map(faults.count, ("blank", "duplicate", "truncated")))


# Texts that earlier operators failed on


def test_packing_takes_any_run_of_blanks(spark):
    from corpusmill.llm import packing

    with open(packing.VOCABULARY, "rb") as f:
        enc = packing.encoder(f.read())
    texts = [" " * 1_000_000, "a" + "\n \t" * 400_000 + "b", "word " * 2_000_000, " " * 250_000 + "x", "x" * 300_000]
    for text in texts:
        assert enc.decode(packing.encode(enc, text)) == text
    assert packing.encode(enc, "a b\n\n c" * 20_000) == enc.encode_ordinary("a b\n\n c" * 20_000)
    got = packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {d for r in got.select("doc_ids").collect() for d in r.doc_ids} == set(range(len(texts)))


def test_spans_where_every_private_letter_is_used(spark):
    from corpusmill.llm import chat_format

    private = "".join(map(chr, range(0xE000, 0xF900)))
    rows = [(1, 0, "user", private), (1, 1, "assistant", "Fine." + private[::-1]), (2, 0, "user", ""), (2, 1, "assistant", "")]
    got = {r.conv_id: r for r in chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    for conv in (1, 2):
        want = [t for c, _, _, t in rows if c == conv]
        assert [chat_format.unescape(got[conv].formatted[s.text_start : s.text_end]) for s in got[conv].spans] == want
