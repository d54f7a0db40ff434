"""Each operator against a plain version on small tables with nulls, blanks, ties, repeats and odd columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from corpusmill.llm import bytetext, chat_format, decontaminate, language_id, minhash_dedup, mixing, packing, passage_quality, quality_rules, suffix_tree, toxicity
from corpusmill.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, class_id string, n long"
LOWER = {c: c + 32 for c in range(65, 91)}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def corpus(n=120, seed=3):
    """Invented words in two languages, with edits, copies, nulls, blanks and one long text."""
    rng = random.Random(seed)
    kinds = {"xa": ["ka", "lo", "mi", "tu", "ren"], "xb": ["öst", "gra", "üm", "pel", "dor"]}
    out = []
    for i in range(n):
        lang = "xa" if i % 3 else "xb"
        text = " ".join("".join(rng.choices(kinds[lang], k=rng.randint(1, 3))) for _ in range(rng.randint(3, 90)))
        out.append([i, text, lang])
    for i in range(0, 30, 3):
        w = out[i][1].split()
        w[len(w) // 2] = "changed"
        out.append([1000 + i, " ".join(w), out[i][2]])
        out.append([2000 + i, out[i][1].upper() if i % 2 else out[i][1], None])
    out += [[3000, None, None], [3001, "", "xa"], [3002, " \n\t ", "xa"], [3003, "1234 !!", None], [3004, " ".join(out[7][1] for _ in range(400)), "xa"], [None, "ka lo mi tu ren ka", "xa"], out[5], out[5]]
    return [(i, t, g, "s", len(t or ""), "clash", 1) for i, t, g in out]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_groups(rows, percent=85):
    sets = {}
    for r in rows:
        w = words((r[1] or "").translate(LOWER))
        if r[0] is not None:
            sets[r[0]] = frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()
    least = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]) and least[a] != least[b]:
                    least[a] = least[b] = min(least[a], least[b])
                    changed = True
    return {i: (len(s), least[i]) for i, s in sets.items()}


def test_minhash_dedup(spark, docs, rows):
    want = brute_groups(rows)
    got = minhash_dedup.minhash_dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert minhash_dedup.minhash_dedup(empty(spark)).count() == 0


@pytest.mark.parametrize("percent", [50, 85, 95])
def test_minhash_thresholds_and_repeated_rows(spark, percent):
    """Pairs about the threshold in many groups, each row three times; bands and code filter follow the threshold."""
    rng = random.Random(percent)
    rows = []
    for i in range(60):
        base = [f"g{i}w{j}" for j in range(60)]
        for k in range(4):
            own = list(base)
            for j in rng.sample(range(60), rng.randint(0, 4)):
                own[j] = f"x{i}{k}{j}"
            rows += [(10 * i + k, " ".join(own), None, None, 0, "", 0)] * 3
    got = minhash_dedup.minhash_dedup(spark.createDataFrame(rows, SCHEMA), percent=percent).collect()
    assert len(got) == len(rows) and {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_groups(rows, percent)


def test_banding_misses_few():
    for percent in (30, 50, 80, 85, 95, 99):
        bands, n = minhash_dedup.banding(percent)
        assert (1 - (percent / 100) ** n) ** bands <= 1e-6
    assert minhash_dedup.banding(85) == (24, 5)


def test_minhash_chain_in_one_large_bucket(spark, monkeypatch):
    """A chain of edits whose ends are unlike, compared by rare shingles as well."""
    monkeypatch.setattr(minhash_dedup, "LIGHT", 0)
    rng = random.Random(1)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(16):
        rows.append((i, " ".join(base), None, None, 0, "", 0))
        base = list(base)
        base[rng.randrange(60)] = f"x{i}"
    got = minhash_dedup.minhash_dedup(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute_groups(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_components(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 101), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 100, 101: 100}


def test_decontaminate(spark, docs, rows):
    long = words(next(r[1] for r in rows if r[0] == 7))
    items = [(1, " ".join(long[3:16]).upper()), (2, "ka lo"), (3, None), (4, "!!"), (None, "changed")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = norm(t)
        for j in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[j : j + 10]), set()).add(i)
    want = Counter()
    for r in rows:
        w, hit, ids = norm(r[1]), set(), set()
        for win, who in windows.items():
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j : j + len(win)]) == win:
                    hit |= set(range(j, j + len(win)))
                    ids |= who - {None}
        want[(r[0], len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(map(str, ids))).encode()).hexdigest(), bool(hit))] += 1
    assert Counter(tuple(r) for r in decontaminate.contamination(docs, bench).collect()) == want
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and kept.count() == sum(n for k, n in want.items() if not k[-1])
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, "spans").collect()}
    assert "changed" not in cut[1000] and len(norm(cut[1000])) < len(norm(next(r[1] for r in rows if r[0] == 1000)))
    assert decontaminate.contamination(empty(spark), bench).count() == 0
    assert decontaminate.contamination(docs, bench.limit(0)).where("contaminated").count() == 0


def test_decontaminate_any_item_id(spark, docs):
    """String ids, a common word shared by many items, and blocks of keys."""
    items = [(f"q-{i}", f"ka lo mi w{i} tu ren ka lo mi tu x{i} ka") for i in range(12)] + [("z", "tu")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    target = spark.createDataFrame([(1, "so " + items[3][1] + " and " + items[10][1]), (2, "tu tu"), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in decontaminate.contamination(target, bench).collect()}
    assert got[1].items_sha256 == hashlib.sha256(b"q-10,q-3,z").hexdigest() and got[1].n_hit == 24
    assert (got[2].n_hit, got[2].n_items, got[3].n_words) == (2, 1, 0)


def brute_viterbi(emit, penalty):
    best, back = emit[0].astype(float), []
    for e in emit[1:]:
        step = best[:, None] - penalty * (1 - np.eye(len(e)))
        back.append(step.argmax(0))
        best = step.max(0) + e
    path = [int(best.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return path[::-1]


def test_viterbi_is_optimal():
    rng = np.random.default_rng(0)
    sizes = [0, 1, 7, 30, 0, 12]
    cut = np.concatenate([[0], np.cumsum(sizes)])
    emit = rng.normal(0, 3, (cut[-1], 3)).astype(np.float32)
    path = language_id.viterbi(emit, cut, 2.5)

    def value(p, e):
        return sum(e[i, s] for i, s in enumerate(p)) - 2.5 * sum(a != b for a, b in zip(p, p[1:]))

    for a, b in zip(cut[:-1], cut[1:]):
        if b > a:
            assert value(path[a:b], emit[a:b]) == pytest.approx(value(brute_viterbi(emit[a:b], 2.5), emit[a:b]), abs=1e-3)


def test_language_id(spark, docs, rows):
    got = language_id.identify_documents(docs).collect()
    assert len(got) == len(rows)
    want = {r[0]: r[2] for r in rows if r[2] and words(r[1]) and re.search(r"[^\W\d_]", r[1])}
    right = [r.lang_pred == want[r.doc_id] for r in got if r.doc_id in want]
    assert sum(right) > 0.97 * len(right)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (3000, 3001, 3002, 3003))
    assert by[1].held_out == (zlib.crc32(b"1") % 5 == 0)
    mixed = spark.createDataFrame([(1, "ka lo mi tu ren kalo mitu " * 3 + "öst gra üm pel dor östgra " * 3)], "doc_id long, text string")
    spans = language_id.identify(mixed, language_id.fit(docs)).first().spans
    assert [(s.lang, s.n_words) for s in spans] == [("xa", 21), ("xb", 18)]
    assert language_id.identify_documents(empty(spark)).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs, ([], np.zeros((0, 1)))).collect()} == {"und"}


def test_language_id_letters(spark):
    """Numbers, marks and pictures without a letter are ``und``; a letter of any script is not."""
    model = (["xa", "xb"], language_id.fit(spark.createDataFrame([("ka lo", "xa"), ("öst", "xb")], "text string, lang string"))[1])
    texts = ["½ ² ①", "— … 😀", "٣٤", "́", "a", "½ é", "ਕ", "ꓐ"]
    got = {r.doc_id: r.lang_pred for r in language_id.identify(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).collect()}
    assert [got[i] == "und" for i in range(8)] == [True] * 4 + [False] * 4
    chunk = next(bytetext.chunks(pa.array(["ka—lo 😀 öst½"])))
    found = language_id.word_scores(chunk, model[1])[0]
    assert [bytes(chunk.data[a:b]).decode() for a, b in zip(found.start, found.end)] == ["ka", "lo", "öst"]


def test_languages_of_another_script_are_left_out(spark):
    model = language_id.fit(spark.createDataFrame([("ka lo mi", "xa"), ("где это", "xc")], "text string, lang string"))
    _, emit = language_id.word_scores(next(bytetext.chunks(pa.array(["ka где lo"]))), model[1])
    assert (emit[:, 0] == language_id._EXCLUDED).tolist() == [False, True, False] and (emit[:, 1] == language_id._EXCLUDED).tolist() == [True, False, True]
    one = language_id.word_scores(next(bytetext.chunks(pa.array(["где"]))), model[1])[1]
    assert emit[1, 1] == one[0, 1]


def test_suffix_tree(spark, docs, rows):
    got = suffix_tree.score_documents(docs, head=20).collect()
    assert len(got) == len(rows)
    tokens = [(r[0], words((r[1] or "").translate(LOWER)) + [None]) for r in rows]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    count = Counter(w for i, t in tokens if not held(i) for w in t)
    total = sum(count.values())
    want = sorted((str(i), held(i), len(t), sum(count[w] > 0 for w in t), total, round(sum(math.log10((count[w] + 1) / (total + len(count) + 1)) for w in t), 4)) for i, t in tokens)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    assert sum(r.score for r in got if not r.held_out) > sum(r.base_score for r in got if not r.held_out)
    assert suffix_tree.score_documents(empty(spark)).count() == 0


def test_suffix_tree_states_are_distributions(spark, docs):
    texts = docs.selectExpr("coalesce(text, '') text", "false held_out")
    tree, *_ = suffix_tree.fit(texts, suffix_tree.count_words(texts))
    assert np.allclose((10.0 ** tree.one.astype(float)).sum(axis=1), 1, atol=1e-3)
    assert (10.0**tree.root).sum() == pytest.approx(1)
    assert len(tree.states)
    for s in tree.states.tolist():
        every = np.array([s >> 11, s & 2047, 0]).repeat(tree.alphabet.size).reshape(3, -1).T.copy()
        every[:, 2] = np.arange(tree.alphabet.size)
        cut = np.arange(len(every) + 1) * 3
        assert (10.0 ** suffix_tree._symbol_scores(tree, every.ravel(), cut)[2::3]).sum() == pytest.approx(1, abs=1e-3)


def test_deep_states_are_distributions():
    """Whatever the contexts, probabilities of all words add up to 1."""
    rng = np.random.default_rng(2)
    n, v = 400, 12
    key, one, two = rng.integers(0, 3, n), rng.integers(0, 3, n), rng.integers(0, 2, n)
    before, after = one << 32 | two, np.where(rng.random(n) < 0.7, (4 * key + 2 * one + two) % v, rng.integers(0, v, n))
    share = rng.dirichlet(np.ones(v))
    grid = [(k, b << 32 | c, w) for k in range(3) for b in range(4) for c in range(3) for w in range(v)]
    asked = np.array(grid)
    k, b, w = (np.concatenate(x).astype(np.int64) for x in zip((key, before, after), asked.T, strict=True))
    seen, left = suffix_tree.deep_states(k, b, w, share[w], np.arange(len(k)) < n)
    p = (seen + left * share[w])[n:].reshape(-1, v)
    assert np.allclose(p.sum(axis=1), 1) and len(np.unique(np.round(p, 6), axis=0)) > 4


def brute_score(tree, top, least, total, vocabulary, tokens, held):
    """Every text's score by dictionaries, the bounded part of the tree given."""
    denominator = total + vocabulary + 1
    count = Counter(w for t, h in zip(tokens, held, strict=True) for w in t if not h)
    spots, out = [], []
    for t, h in zip(tokens, held, strict=True):
        column = pa.array([" ".join(x for x in t if x is not None)])
        hashes, suffix, cut = suffix_tree._tokens(next(bytetext.chunks(column)))
        s = suffix_tree._symbols(tree.alphabet, hashes, suffix)
        shift = suffix_tree._symbol_scores(tree, s, cut) - tree.root[s]
        base = [math.log10((count[w] + 1) / denominator) for w in t]
        out.append(sum(base) + shift.sum())
        known = [int(x) in top for x in hashes]
        for i, w in enumerate(t):
            if not known[i]:
                back = (t[i - 1] if i > 0 else "", t[i - 2] if i > 1 else "")
                guess = shift[i + 1] + (base[i + 1] if known[i + 1] else math.log10(least / denominator))
                spots.append([len(out) - 1, not h, [(w,), (w, back[0]), (w, *back)], t[i + 1], 10 ** min(guess, 0), 10 ** (shift[i + 1] + base[i + 1])])
    seen, left = [0.0] * len(spots), [1.0] * len(spots)
    for depth in range(3):
        by = {}
        for i, x in enumerate(spots):
            by.setdefault(x[2][depth], []).append(i)
        for members in by.values():
            nexts = Counter(spots[i][3] for i in members if spots[i][1])
            c = sum(nexts.values())
            if c < suffix_tree.LEAST:
                continue
            rest = 0.5 * len(nexts) / c
            parent = {}
            for i in sorted(members, key=lambda i: spots[i][2][2]):
                parent.setdefault(spots[i][3], seen[i] + left[i] * spots[i][4])
            if sum(n * math.log(((n - 0.5) / c + rest * parent[w]) / parent[w]) + math.log(parent[w]) for w, n in nexts.items()) > 0:
                for i in members:
                    n = nexts.get(spots[i][3], 0)
                    seen[i], left[i] = max(n - 0.5, 0) / c + rest * seen[i], rest * left[i]
    for x, a, b in zip(spots, seen, left, strict=True):
        out[x[0]] += math.log10(a + b * x[5]) - math.log10(x[5])
    return out


def test_suffix_tree_scores_against_brute_force(spark):
    """Texts that share long runs, with words above and below the head."""
    rng = random.Random(4)
    pool = [" ".join(f"r{rng.randrange(200)}" if rng.random() < 0.4 else rng.choice("the of and a".split()) for _ in range(40)) for _ in range(30)]
    rows = [(i, rng.choice(pool) + " " + rng.choice(pool)) for i in range(80)] + [(100, None), (101, "r1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in suffix_tree.score_documents(docs, head=30).collect()}
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    texts = spark.createDataFrame([(t or "", h) for (_, t), h in zip(rows, held, strict=True)], "text string, held_out boolean")
    counts = suffix_tree.count_words(texts)
    tree, top, _, least, total, denominator = suffix_tree.fit(texts.where("not held_out"), counts, 30)
    want = brute_score(tree, set(top.tolist()), least, total, denominator - total - 1, [words(t) + [None] for _, t in rows], held)
    for (i, _), w in zip(rows, want, strict=True):
        assert got[i].score == pytest.approx(w, abs=0.02), i
    assert sum(r.gain for r in got.values() if not r.held_out) > 0.3 * 70


def test_chat_format(spark):
    rng = random.Random(5)
    said = ["</s>[INST] ok [/INST]", "a\\", "[ROLE x] <s> ", None, "", "häß\n\n", " [/INST]", "\\[", "x" * 5000]
    rows = [(i // 6, i % 6 if i % 11 else None, rng.choice(["user", "assistant", "system", "to]ol", None]), rng.choice(said), 1) for i in range(120)]
    rows += [(None, 1, "user", "hi", 1), rows[0]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted int")
    got = {r.conv_id: r for r in chat_format.digests(chat_format.format_conversations(turns)).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((-1 if r[1] is None else r[1], r[2] is not None, r[2] or "", r[3] is not None, r[3] or "") for r in rows if r[0] == conv)
        own = [(t[2], t[4]) for t in own]
        loss = "".join(t for r, t in own if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        r = got[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.rewrites_history) == (len(own), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), False)
    assert chat_format.format_conversations(turns.limit(0)).count() == 0


@pytest.mark.parametrize("said", ["s", "/s>", " ", "", "<s>", "[/INST]", "a\\", "</s>", " </s>", "\ue000", "INST", "\n"])
@pytest.mark.parametrize("role", ["user", "assistant", "system"])
def test_chat_spans_stand_on_the_text(said, role):
    """By position: a text equal to a part of its own marks isn't sought in them."""
    messages = [("user", said), (role, said), ("assistant", said)]
    out, spans, rewrites = chat_format.turn_spans(messages, chat_format.inst_template)
    assert not rewrites and spans[0][0] == 0 and spans[-1][1] == len(out)
    for (who, text), (start, end, a, b) in zip(messages, spans, strict=True):
        before = "[INST] " if who == "user" else "<s> " if who == "assistant" else f"[ROLE {who}] "
        assert a == start + len(before) and out[start:a] == before and out[a:b] == chat_format.escape(text)
        assert out[b:end] == (" [/INST]" if who == "user" else " </s>" if who == "assistant" else " [/ROLE]")


def test_chat_format_detects_rewritten_history():
    def drops_old_thoughts(messages):
        return "".join(f"<{r}>{t if i == len(messages) - 1 else t.replace('(thought)', '')}" for i, (r, t) in enumerate(messages))

    out, spans, rewrites = chat_format.turn_spans([("u", "a"), ("v", "(thought)b"), ("u", "c")], drops_old_thoughts)
    assert rewrites and [out[a:b] for _, _, a, b in spans] == ["a", "b", "c"]
    assert not chat_format.turn_spans([("u", "a"), ("v", "b")], drops_old_thoughts)[2]
    # The number of turns leads the output, and each text hangs on its own length: no span.
    counted = lambda messages: f"{len(messages)}:" + "".join(f"{len(t)}{t}" for _, t in messages)
    out, spans, rewrites = chat_format.turn_spans([("u", "abc"), ("v", "d")], counted)
    assert rewrites and spans[0] == (None,) * 4 and out[spans[1][2] : spans[1][3]] == "d"


def test_rows_without_conversation_stand_alone(spark):
    rows = [(None, 1, "user", "hi"), (None, 1, "user", "hi"), (None, 2, "assistant", "yo"), (4, 1, "user", "hi")]
    got = chat_format.digests(chat_format.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert sorted((str(r.conv_id), r.n_turns) for r in got) == [("4", 1), ("None", 1), ("None", 1), ("None", 1)]


def test_span_hash_tells_structured_words_apart():
    """Words of two letters by the parity of set bits, and their complements, cancel in polynomials modulo 2**64."""
    words = [bytes(97 + (bin(i).count("1") + f) % 2 for i in range(n)) for n in (1024, 2048, 4096) for f in (0, 1)] + [b"ab", b"abc", b"ab"]
    data = np.frombuffer(b" ".join(words), np.uint8)
    spans = bytetext.runs(bytetext.NOT_SPACE[data], np.array([0, len(data)]))
    h = bytetext.span_hash(data, spans.start, spans.end).tolist()
    assert len(set(h)) == len(set(words)) and h[-1] == h[-3]
    assert bytetext.span_hash(data, spans.start, spans.start + 2).tolist()[-2:] == [h[-1]] * 2


def test_quality_rules(spark, docs, rows):
    extra = [(5000, "a b c a b c\nx\n\n x\nx\n# & é", "xa", "s", 0, "", 0), (5001, " ".join(f"k{i}%%%" for i in range(300)), None, "s", 0, "", 0)]
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs.unionByName(spark.createDataFrame(extra, SCHEMA))).collect()}
    for r in rows + extra:
        w, lines = words(r[1]), [x for x in (r[1] or "").split("\n") if words(x)]
        three = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        flag = {i + j for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1 for j in range(3)}
        q = got[r[0]]
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r[1] or ""), len(lines) - len(set(lines)), len(flag))
        assert q.base_failed == (len(w) < 50 or 100 * len(flag) > 50 * len(w))
    assert not got[5001].kept and not got[5001].base_failed
    clean = [q for i, q in got.items() if i is not None and i < 120 and not q.base_failed]
    assert sum(q.kept for q in clean) > 0.97 * len(clean)
    assert quality_rules.quality_rules(empty(spark)).count() == 0


def test_junk_does_not_move_the_reference(spark):
    """A fifth of a language's texts are words between bars: its reference stays that of the others and they go."""
    rng = random.Random(6)
    say = lambda n, between: between.join("".join(rng.choices(["ka", "lo", "mi", "tu", "ren"], k=rng.randint(1, 3))) for _ in range(n)) + "."
    rows = [(i, say(rng.randint(60, 200), " | " if i % 5 == 0 else " "), "xa") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    shares = quality_rules.fit_references(docs)["xa"][0]
    assert shares[6] == 0
    assert {r.doc_id for r in quality_rules.quality_rules(docs).where("kept").collect()} == {i for i in range(200) if i % 5}


def test_references_cover_every_text_and_language(spark):
    """Above 20000 texts, a language of one text has its reference and shares are over all texts."""
    many = spark.range(40_000).selectExpr("id doc_id", "concat('ka lo', if(id % 3 = 0, ' mi', ''), '  ', id) text", "'xa' lang")
    few = spark.createDataFrame([(i, f"rare r{i} word", f"y{i}") for i in range(40)], "doc_id long, text string, lang string")
    got = quality_rules.fit_references(many.unionByName(few))
    assert got.keys() == {"xa", *(f"y{i}" for i in range(40))}
    # The texts nearest to the mean of characters, here those without the third word, are the reference.
    assert sorted(got["xa"][2])[-2:] == pytest.approx([0.5, 0.5], abs=0.1)
    assert all(sorted(got[f"y{i}"][2]) == pytest.approx([0, 1 / 3, 1 / 3, 1 / 3]) for i in range(40))


def test_language_sample_keeps_small_languages(spark):
    rows = [(f"ka lo mi {i}", "xa") for i in range(3000)] + [(f"gra pel {'dor' * i}", f"y{i}") for i in range(20)]
    langs, score = language_id.fit(spark.createDataFrame(rows, "text string, lang string"), train_docs=300)
    assert langs == sorted({g for _, g in rows})
    assert all(len(set(s[: language_id.BUCKETS])) > 1 for s in score)
    rates = language_id.sample_rates({"a": 1_000_000, "b": 30, "c": 500}, 1000)
    assert rates == pytest.approx({"a": 485e-6, "b": 1, "c": 0.97})


def test_js_distance():
    p, q = np.array([[2.0, 2.0, 0.0], [0, 0, 5], [0, 0, 0]]), np.array([0.5, 0.5, 0.0])
    assert quality_rules.js_distance(p, q) == pytest.approx([0, 1, 0])


def test_packing(spark, docs, rows):
    packed = packing.pack(docs, width=64, block=700).collect()
    enc = packing.encoder(open(packing.VOCABULARY, "rb").read())
    pieces = {}
    for r in packed:
        ids, places = np.frombuffer(r.input_ids, "<u2"), np.frombuffer(r.position_ids, "<u2")
        assert len(ids) == 64 and r.cu_seqlens[-1] == r.n_tokens <= 64 and r.n_segments == len(r.doc_ids) == len(r.cu_seqlens) - 1
        for i, (d, s) in enumerate(zip(r.doc_ids, r.doc_starts)):
            a, b = r.cu_seqlens[i : i + 2]
            assert places[a:b].tolist() == list(range(b - a))
            pieces.setdefault(d, []).append((s, ids[a:b].tolist()))
    want = {}
    for r in rows:
        want.setdefault(r[0], []).append(r[1] or "")
    assert pieces.keys() == want.keys()
    for d, texts in want.items():
        got = sum((x for _, x in sorted(pieces[d], key=lambda x: x[0])), []) if len(texts) == 1 else None
        if got is not None:
            assert got[-1] == 50256 and enc.decode(got[:-1]) == texts[0]
    assert len({r.row_id for r in packed}) == len(packed)
    assert packing.pack(empty(spark)).count() == 0


def test_best_fit_decreasing():
    rng = np.random.default_rng(2)
    sizes, rows = rng.integers(1, 65, 500), []
    for i in np.argsort(-sizes, kind="stable"):
        fits = [(64 - sum(sizes[r]) - sizes[i], n) for n, r in enumerate(rows) if 64 - sum(sizes[r]) >= sizes[i]]
        if fits:
            rows[min(fits)[1]].append(i)
        else:
            rows.append([i])
    got = packing.best_fit_decreasing(sizes, 64)
    assert sorted(i for r in got for i in r) == list(range(500)) and all(sizes[r].sum() <= 64 for r in got) and len(got) == len(rows)


def labelled(spark, n=300, seed=4):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = ["".join(rng.choices(["ka", "lo", "mi", "tu", "ren"], k=2)) for _ in range(rng.randint(20, 200))]
        quality, toxic = int(i % 5 != 0), int(i % 7 == 0)
        w = [f"{x}%%%" for x in w] if not quality else w
        for _ in range(4 * toxic):
            w[rng.randrange(len(w))] = rng.choice(["vileka", "vilelo", "rotten"])
        docs.append((i, " ".join(w), "xa", "s", 0, "", 0))
        labels.append((i, quality, toxic))
    docs += [(9000, None, None, None, None, None, None), (None, "ka", None, None, None, None, None), (9001, "", None, None, None, None, None)]
    labels += [(None, 1, 1), (3, None, None), labels[0], (8888, 1, 0)]
    return spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_passage_quality_and_toxicity(spark):
    docs, labels = labelled(spark)
    for module, want in ((passage_quality, lambda i: int(i % 5 != 0)), (toxicity, lambda i: int(i % 7 == 0))):
        got = module.score_documents(docs, labels).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
        own = [r.predicted == want(r.doc_id) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 9000]
        assert sum(own) >= 0.95 * len(own)
        assert len(module.score_documents(docs, labels.limit(0)).collect()) == docs.count()
        assert module.score_documents(empty(spark), labels).count() == 0


def test_network_gradient():
    rng = np.random.default_rng(1)
    x, cut, y, w = rng.normal(0, 1, (9, passage_quality.MEASURES)), np.array([0, 1, 4, 9]), np.array([1.0, 0, 1]), np.ones(3)
    net = passage_quality.Network()
    loss = lambda: -np.mean(y * np.log(net.forward(x, cut)["score"]) + (1 - y) * np.log(1 - net.forward(x, cut)["score"]))
    g = net.gradient(net.forward(x, cut), cut, y, w)
    for k, v in net.p.items():
        i = tuple(rng.integers(0, n) for n in v.shape)
        keep = v[i]
        v[i] = keep + 1e-5
        up = loss()
        v[i] = keep - 1e-5
        down = loss()
        v[i] = keep
        assert g[k][i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_label_model_joins_the_votes_of_copies():
    rng = np.random.default_rng(3)
    y = (rng.random(2000) < 0.2).astype(float)
    cast = lambda right: np.where(rng.random(2000) < right, 2 * y - 1, 1 - 2 * y)
    one = cast(0.8)
    v = np.column_stack([one, one, one, cast(0.9), cast(0.6)]).astype(np.int8)
    # Started from the labels, which it doesn't see again.
    post, accuracy, block = toxicity.label_model(v, y)
    assert block.tolist() == [0, 0, 0, 3, 4] and ((post > 0.5) == (y > 0.5)).mean() > 0.88
    assert accuracy[3] == pytest.approx(0.9, abs=0.05) and accuracy[4] == pytest.approx(0.6, abs=0.07)


def test_mixing(spark):
    docs, labels = labelled(spark)
    got = mixing.mixing_rates(docs, labels, {"clean": 0.5, "junk": 0.3, "toxic": 0.2}).toPandas()
    assert len(got) == docs.count() and (got.rate >= 0).all()
    weighed = got.n_tokens * got.rate
    total = got.n_tokens.sum()
    for d, share in (("clean", 0.5), ("junk", 0.3), ("toxic", 0.2)):
        assert (weighed * got[f"p_{d}"]).sum() == pytest.approx(share * total, rel=0.05)
    thin = mixing.mix(docs, labels, {"clean": 0.95, "junk": 0.03, "toxic": 0.02})
    assert thin.columns == docs.columns
    kept = {r.doc_id for r in thin.collect()}
    clean = [i for i in range(300) if i % 5 and i % 7]
    assert sum(i in kept for i in clean) > 0.97 * len(clean) and sum(i in kept for i in range(0, 300, 5)) < 45
    assert mixing.mixing_rates(docs, labels.limit(0)).count() == docs.count()
    assert mixing.mixing_rates(empty(spark), labels).count() == 0 and mixing.mix(empty(spark), labels).count() == 0


def test_mixing_rates_reach_far_targets_or_say_so(spark):
    """A domain of 0.3% of the tokens is raised tenfold; overlapping posteriors get the steps they need; a domain without tokens is told."""
    post = lambda rows: spark.createDataFrame(rows, "__tokens long, __p array<double>")
    totals = lambda df: [df.selectExpr(f"sum(__rate * __tokens * __p[{i}]) x").first().x for i in range(3)]
    far = [(9000, [1.0, 0.0, 0.0]), (970, [0.0, 1.0, 0.0]), (30, [0.0, 0.0, 1.0])]
    near = [(500, [0.7, 0.2, 0.1]), (300, [0.3, 0.5, 0.2]), (200, [0.3, 0.2, 0.5])]
    for rows, want, share in ((far, [9000, 700, 300], {"clean": 0.9, "junk": 0.07, "toxic": 0.03}), (near, [450, 330, 220], {"clean": 0.45, "junk": 0.33, "toxic": 0.22})):
        rated, met = mixing.fit_rates(post(rows), share, math.inf, 1.0)
        assert met and totals(rated) == pytest.approx(want, abs=1e-4 * sum(want))
    rated, met = mixing.fit_rates(post([(9000, [1.0, 0.0, 0.0]), (1000, [0.0, 1.0, 0.0])]), mixing.TARGETS, math.inf, 1.0)
    assert not met
    docs, labels = labelled(spark)
    got = mixing.mixing_rates(docs, labels, {"clean": 0.1, "junk": 0.85, "toxic": 0.05}).selectExpr("max(rate) rate", "every(targets_met) met").first()
    assert got.rate > 4 and got.met
