"""Soft-membership mixing to target weights (DataFrame functions only).

A labelled table teaches a naive Bayes classifier over binned text measures and over words
that a domain's labelled texts favour; every text gets posteriors ``p[k]`` of the domains.
Rates ``r >= 0`` then make the expected tokens of each domain, the sum of
``r * tokens * p[k]``, match the targets: least squares weighted by the domains' sizes,
solved by projected gradient. The gradient is scaled by the inverse of the domains' overlap
(the sums of ``tokens * p[i] * p[k]`` over texts that aren't out), so a few steps do; one
that doesn't bring the targets nearer is halved. A step needs only these sums, so each is one
aggregation over the tokens by distinct posteriors, and a text's rate is a fold over the steps taken. Rates
have no upper bound (``mix`` only thins: 1). Steps end when every target is met within
``TOLERANCE`` of all tokens, when none brings them ``STILL`` nearer, or after ``STEPS``; if
targets are unmet then (a domain without tokens, domains that no text tells apart, more
tokens wanted than there are), ``mixing_rates`` says so in ``targets_met``.

At most about ``LABELLED`` labelled texts are learned from, chosen by a hash of the id (a
documented bound); posteriors, totals and rates cover every text. Rows whose label is null
teach nothing, repeated labels of an id count once (toxic wins, then the higher quality).
A null or blank text has no tokens and is judged by its measures like any other. With no
label at all each domain is equally likely. Repeated rows and null ids get the rate of
their own text. Other columns are ignored by the fit and kept by ``mix``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from .decontaminate import words
from .scratch import materialize, small

LABELLED = 20_000
#: Words of one domain's list and the least labelled texts one must occur in.
LISTED, LEAST_TEXTS = 32, 5
DOMAINS = ("clean", "junk", "toxic")
#: Shares of the mixed corpus.
TARGETS = {"clean": 0.90, "junk": 0.07, "toxic": 0.03}
#: Steps at most.
STEPS = 40
#: A target's largest miss, as a share of all tokens; the least share of the squared misses that a step must take off.
TOLERANCE, STILL = 1e-4, 0.02


@dataclass
class Classifier:
    """Fitted by ``fit_classifier``: word lists, bin edges of each measure, log odds by measure, bin and domain."""

    domains: tuple[str, ...]
    lists: list[list[str]]
    edges: list[list[float]]
    odds: list[list[list[float]]]
    prior: list[float]


def _measures(text: Column, lists: list[list[str]]) -> list[Column]:
    """Numbers of a text that the classifier bins: needs the words as column ``__w``."""
    n = F.size("__w")
    per = lambda c: c / F.greatest(n, F.lit(1))
    marks = lambda cls: F.size(F.split(F.coalesce(text, F.lit("")), cls)) - 1
    out = [F.least(n, F.lit(400)).cast("double"), per(F.size(F.array_distinct("__w"))), per(marks(r"[#*$%&|<>!]")), per(marks("[A-Z]")), per(marks(r"\n"))]
    return out + [F.size(F.array_intersect("__w", F.array(*map(F.lit, own)))).cast("double") if own else F.lit(0.0) for own in lists]


def _bin(x: Column, edges: list[float]) -> Column:
    return sum(((x > e).cast("int") for e in edges), F.lit(0))


def domain_labels(labels: DataFrame, limit: int = LABELLED) -> DataFrame:
    """``doc_id, domain`` (an index of ``DOMAINS``) of at most about ``limit`` labelled ids."""
    known = labels.where("doc_id is not null and (toxic is not null or quality is not null)").groupBy("doc_id").agg(F.max("toxic").alias("t"), F.max("quality").alias("q")).where("t = 1 or q is not null")
    known = materialize(known.select("doc_id", F.expr("case when t = 1 then 2 when q = 1 then 0 else 1 end").alias("domain")), "labelled")
    n = known.count()
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * limit / n)) if n > limit else known


def fit_classifier(docs: DataFrame, labels: DataFrame, limit: int = LABELLED) -> Classifier:
    """From ``docs(doc_id, text)`` and ``labels(doc_id, quality, toxic)``."""
    chosen = F.broadcast(domain_labels(labels, limit))
    text = F.col("text").cast("string")
    sample = materialize(docs.select("doc_id", text.alias("text")).join(chosen, "doc_id").select("text", "domain", words(F.col("text")).alias("__w")), "sample")
    size = {r[0]: r[1] for r in sample.groupBy("domain").count().collect()}
    k, total = len(DOMAINS), sum(size.values())
    lists: list[list[str]] = [[] for _ in DOMAINS]
    if total:
        seen = materialize(sample.select("domain", F.explode(F.array_distinct("__w")).alias("word")).groupBy("word").agg(F.count("*").alias("n"), *(F.count(F.when(F.col("domain") == i, 1)).alias(f"n{i}") for i in range(k))).where(F.col("n") >= LEAST_TEXTS), "seen")
        for i in range(1, k):
            own, other = size.get(i, 0), total - size.get(i, 0)
            odds = F.log((F.col(f"n{i}") + 0.5) / (own + 1)) - F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (other + 1))
            best = seen.where(odds > 3).orderBy((odds * F.sqrt(F.col(f"n{i}"))).desc(), "word").limit(LISTED)
            lists[i] = sorted(r.word for r in best.select("word").collect())
    measured = materialize(sample.select("domain", F.array(*_measures(F.col("text"), lists)).alias("x")), "measured")
    n = 5 + k
    cuts = measured.agg(*(F.percentile(F.col("x")[j], [i / 12 for i in range(1, 12)]) for j in range(n))).first()
    edges = [sorted(set(cuts[j] or [])) if j < 5 else [0.5, 1.5, 2.5] for j in range(n)]
    binned = measured.select("domain", F.posexplode(F.array(*(_bin(F.col("x")[j], edges[j]) for j in range(n)))).alias("j", "b")).groupBy("j", "b", "domain").count().collect()
    got = {(r.j, r.b, r.domain): r["count"] for r in binned}
    odds = [[[math.log((got.get((j, b, i), 0) + 0.5) / (size.get(i, 0) + 0.5 * (len(edges[j]) + 1))) for i in range(k)] for b in range(len(edges[j]) + 1)] for j in range(n)]
    return Classifier(DOMAINS, lists, edges, odds, [math.log((size.get(i, 0) + 1) / (total + k)) for i in range(k)])


def with_posteriors(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """``docs`` with ``__tokens`` (words, long) and ``__p`` (posteriors by domain)."""
    text = F.col(text_col).cast("string")
    out = docs.withColumn("__w", words(text))
    out = out.withColumn("__x", F.array(*_measures(text, model.lists))).withColumn("__tokens", F.size("__w").cast("long")).drop("__w")
    at = [_bin(F.col("__x")[j], e) for j, e in enumerate(model.edges)]
    table = [F.get(F.array(*(F.array(*map(F.lit, row)) for row in rows)), b) for rows, b in zip(model.odds, at, strict=True)]
    raw = [sum((t[i] for t in table), F.lit(p)) for i, p in enumerate(model.prior)]
    out = out.withColumn("__s", F.array(*raw)).drop("__x")
    e = F.transform("__s", lambda s: F.exp(s - F.array_max("__s")))
    out = out.withColumn("__s", e)
    total = F.aggregate("__s", F.lit(0.0), lambda a, b: a + b)
    return out.withColumn("__p", F.transform("__s", lambda s: s / total)).drop("__s")


def _rate(steps: list[list[float]], most: float) -> Column:
    """The rate after these steps, from ``__rate``: each takes the gradient off and projects onto 0 to ``most``."""
    if not steps:
        return F.col("__rate")
    k = len(steps[0])
    all_steps = F.array(*(F.array(*map(F.lit, g)) for g in steps))
    return F.aggregate(all_steps, F.col("__rate"), lambda r, g: F.least(F.greatest(r - sum((F.col("__p")[i] * g[i] for i in range(k)), F.lit(0.0)), F.lit(0.0)), F.lit(most)))


def fit_rates(posteriors: DataFrame, targets: dict[str, float], most: float, budget: float | str, domains: tuple[str, ...] = DOMAINS, steps: int = STEPS) -> tuple[DataFrame, bool]:
    """``posteriors(__tokens, __p)`` with ``__rate`` from 0 to ``most`` by projected gradient, and whether every target is met. budget: tokens as a multiple of all, or a domain whose tokens stay as they are."""
    k = len(domains)
    start = posteriors.withColumn("__rate", F.lit(min(1.0, most)))
    # A rate hangs on the posteriors alone, and binned measures leave a bounded number of these: steps sum over them, not over texts.
    cells = materialize(posteriors.groupBy("__p").agg(F.sum("__tokens").alias("__tokens")).withColumn("__rate", F.lit(min(1.0, most))), "cells")
    p = [F.col("__p")[i] for i in range(k)]

    def sums(taken: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
        rated = cells.withColumn("__r", _rate(taken, most))
        overlap = [F.sum(F.when(F.col("__r") > 0, F.col("__tokens") * p[i] * p[j])) for i in range(k) for j in range(k)]
        got = np.array([float(x or 0) for x in rated.agg(*(F.sum(F.col("__r") * F.col("__tokens") * x) for x in p), *overlap).first()])
        return got[:k], got[k:].reshape(k, k)

    taken: list[list[float]] = []
    now, overlap = sums(taken)
    mass = now / min(1.0, most)
    if not mass.sum():
        return start, True
    weight = np.array([targets.get(d, 0.0) for d in domains]) / sum(targets.values())
    at = domains.index(budget) if isinstance(budget, str) else None
    total = mass.sum() * budget if at is None else mass[at] / max(weight[at], 1e-9)
    want = weight * total
    miss = lambda x: float(((x - want) ** 2 / np.maximum(mass, 1)).sum())
    met = lambda x: bool(np.abs(x - want).max() <= TOLERANCE * total)
    scale = 1.0
    for _ in range(steps):
        if met(now) or scale < 1 / 8:
            break
        step = scale * np.linalg.lstsq(overlap + 1e-9 * mass.sum() * np.eye(k), now - want, rcond=None)[0]
        then, overlap_then = sums([*taken, step.tolist()])
        if miss(then) > (1 - STILL) * miss(now):
            scale /= 2
            continue
        taken.append(step.tolist())
        now, overlap = then, overlap_then
    return start.withColumn("__rate", _rate(taken, most)), met(now)


def _draw(id_col: str) -> Column:
    """A number from 0 to 1 that hangs on the id alone."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1_000_000)) / 1_000_000.0


def mixing_rates(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, most: float = math.inf, budget: float | str = 1.0) -> DataFrame:
    """Every row's ``doc_id, n_tokens, p_clean, p_junk, p_toxic, rate, copies, targets_met``."""
    model = fit_classifier(docs, labels)
    post = materialize(with_posteriors(docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text")), model).drop("text"), "posteriors")
    rated, met = fit_rates(post, targets or TARGETS, most, budget)
    out = rated.withColumnRenamed("__rate", "rate")
    return out.select("doc_id", F.col("__tokens").alias("n_tokens"), *(F.col("__p")[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)), "rate", F.floor(F.col("rate") + _draw("doc_id")).cast("long").alias("copies"), F.lit(met).alias("targets_met"))


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, budget: float | str = "clean") -> DataFrame:
    """``docs`` thinned to the targets, columns as they were: the budget keeps one domain whole and no row is repeated."""
    model = fit_classifier(docs, labels)
    text = F.col("text").cast("string")
    post = materialize(with_posteriors(docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_key")), model).drop("text"), "posteriors")
    rated, _ = fit_rates(post, targets or TARGETS, 1.0, budget)
    # A repeated row shares its id, text and so its fate: rows to drop are named by both.
    gone = materialize(rated.where(_draw("doc_id") >= F.col("__rate")).select(F.col("doc_id").alias("gone_id"), "text_key").distinct(), "gone")
    same = F.xxhash64(text).eqNullSafe(F.col("text_key")) & F.col("doc_id").eqNullSafe(F.col("gone_id"))
    return docs.join(small(gone), same, "left_anti")
