"""Parser drift against plain counts."""

import random

from corpusmill.operators import drift

SCHEMA = "run int, parser_id string, fixture_id long, text string, redacted long, status string"


def results(seed=7):
    rng = random.Random(seed)
    out, texts = [], {}
    for run in (1, 2, 4):
        for parser in ("a", "b", "c", "d"):
            if parser == "d" and run == 1 or parser == "c" and run == 4:
                continue
            for f in range(20):
                if run == 1 or parser not in "a" or rng.random() < 0.1:
                    texts[parser, f] = (f"text {rng.random()}", rng.randint(0, 3) if parser != "d" else 0, rng.choice(["success"] * 9 + ["degraded", None]))
                out.append((run, parser, f, *texts[parser, f]))
    return out + [(1, "b", None, None, None, None)]


def plain(rows):
    out = {}
    for run, parser, f, text, redacted, status in rows:
        s = out.setdefault((run, parser), [0, 0, 0, set()])
        s[0] += 1
        s[1] += redacted or 0
        s[2] += status != "success"
        s[3].add((f, text or ""))
    return out


def test_reports_equal_plain_counts(spark):
    rows = results()
    want = plain(rows)
    s = drift.summarize(spark.createDataFrame([(*r, "clash") for r in rows], f"{SCHEMA}, fixtures string").repartition(3))
    assert {(r.run, r.parser_id): [r.fixtures, r.redacted, r.degraded] for r in s.collect()} == {k: v[:3] for k, v in want.items()}
    told = {r.run: r for r in drift.reports(s).collect()}
    assert set(told) == {2, 4} and told[4].base_run == 2
    degraded = 0
    for base, head in ((1, 2), (2, 4)):
        b, h = ({p: v for (r, p), v in want.items() if r == run} for run in (base, head))
        diff = {r.parser_id: r for r in drift.diff(s.where(f"run = {base}"), s.where(f"run = {head}")).collect()}
        assert set(diff) == set(b) | set(h)
        for p, r in diff.items():
            kind = "added" if p not in b else "removed" if p not in h else "unchanged" if b[p] == h[p] else "changed"
            risk = {"added": lambda: h[p][1] < 1 or h[p][2] > 0, "changed": lambda: h[p][1] < b[p][1] or h[p][2] > b[p][2]}.get(kind, lambda: False)()  # noqa: B023
            assert (r.change_type, r.risk, r.hash_drift) == (kind, risk, b.get(p, [0] * 4)[3] != h.get(p, [0] * 4)[3])
        total = lambda x, i: sum(v[i] for v in x.values())
        bad = any(r.risk for r in diff.values()) or total(h, 1) < total(b, 1) or total(h, 2) > total(b, 2)
        degraded += bad
        assert told[head].risk == ("degraded" if bad else "unchanged") and told[head].redacted_delta == total(h, 1) - total(b, 1)
        assert told[head].changed == sum(r.change_type == "changed" for r in diff.values())
        one = drift.assess(drift.diff(s.where(f"run = {base}"), s.where(f"run = {head}"))).first()
        assert one.risk == told[head].risk and one.added == told[head].added
    h = drift.history(drift.reports(s)).first()
    assert (h.reports, h.degraded_reports, h.latest_run, h.latest_risk, h.status) == (2, degraded, 4, told[4].risk, "degraded" if degraded else "success")
    assert drift.history(drift.reports(s.limit(0))).first().status == "unknown"
