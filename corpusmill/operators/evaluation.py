"""Evaluation of retrieval runs against golden items: ranks of what was expected, metrics, deltas, winners.

A golden item asks for a citation and any number of relevant ones. A result is right where its
text holds one of them, whole and whatever its case. Containment is one join for all items and
runs (``contains_join``), over the retrieved texts only; ranks, precision and recall are then
aggregations of ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..shared import materialize, small
from .containment import contains_join

#: Metrics of which more is better, and of which less is.
HIGHER = ("hit_at_1", "hit_at_3", "hit_at_5", "mrr", "citation_coverage_mean", "context_precision_mean", "context_recall_mean")
LOWER = ("mean_rank_of_expected", "zero_result_rate")
#: What a rank that appears or vanishes counts, and the weights of a configuration's score.
APPEARED, WEIGHTS = 99, {"hit_at_5": 0.4, "mrr": 0.3, "context_precision_mean": 0.2, "answer_correctness_mean": 0.1}


def rounded(value: Column, digits: int) -> Column:
    """``value`` to so many digits as SQL engines round doubles: the scaled value goes to the nearest whole number, halves away from zero."""
    return F.round(value * 10.0**digits, 0) / 10.0**digits


def exact_sum(value: Column) -> Column:
    """The sum of shares (0 to 1) in a group, whatever the order of rows: a sum of up to nine digits is exact."""
    return F.round(F.sum(value.cast("decimal(28,18)")), 9).cast("double")


def _split(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"\s+"), "")


def evaluate(golden: DataFrame, results: DataFrame, texts: DataFrame, top_k: int = 5) -> DataFrame:
    """A row for each run and item: ``mode, item_id, tags, results, rank, hit, mrr, coverage, precision, recall``.

    ``golden``: item_id, citation, relevant (array; if empty, the citation alone), tags (array).
    ``results``: mode, item_id, rank, doc_id. ``texts``: doc_id, text. Coverage is 1 where a
    retrieved text holds the citation, else the share of its words that the retrieved texts have.
    """
    results = materialize(results.where(F.col("rank") <= top_k).select("mode", "item_id", "rank", "doc_id"), "results")
    seen = materialize(texts.join(small(results.select("doc_id").distinct()), "doc_id", "left_semi").select("doc_id", "text"), "seen")
    golden = golden.select("item_id", "citation", F.array_distinct(F.coalesce(F.when(F.size("relevant") > 0, F.col("relevant")), F.array("citation"))).alias("relevant"), "tags")
    asked = golden.select("item_id", F.posexplode(F.concat(F.array("citation"), "relevant")).alias("k", "pattern")).select(F.struct("item_id", "k").alias("pattern_id"), "pattern")
    found = contains_join(asked, seen.select(F.col("doc_id").alias("text_id"), "text")).select("pattern_id.item_id", "pattern_id.k", F.col("text_id").alias("doc_id"))

    pairs = results.join(found.groupBy("item_id", "doc_id").agg(F.collect_set("k").alias("ks")), ["item_id", "doc_id"], "left")  # at most one k a citation
    relevant = lambda ks: F.filter(ks, lambda k: k > 0)
    own = pairs.groupBy("mode", "item_id").agg(
        F.count("*").alias("results"), F.min(F.when(F.size("ks") > 0, F.col("rank"))).alias("rank"), F.coalesce(F.bool_or(F.array_contains("ks", 0)), F.lit(False)).alias("whole"),
        F.count_if(F.size(relevant(F.col("ks"))) > 0).alias("right"), F.size(F.array_distinct(F.flatten(F.collect_list(relevant(F.coalesce("ks", F.array().cast("array<int>"))))))).alias("covered"))
    words = results.join(golden.select("item_id", F.array_distinct(_split(F.col("citation"))).alias("target")), "item_id").join(seen, "doc_id")
    words = words.select("mode", "item_id", F.size("target").alias("n"), F.explode(F.array_intersect("target", _split(F.col("text")))).alias("word")).groupBy("mode", "item_id").agg(rounded(F.count_distinct("word") / F.first("n"), 4).alias("overlap"))

    every = golden.select("item_id", "tags", F.size("relevant").alias("wanted")).crossJoin(F.broadcast(results.select("mode").distinct()))  # a run has a handful of modes
    out = every.join(own, ["mode", "item_id"], "left").join(words, ["mode", "item_id"], "left")
    share = lambda a, b: F.coalesce(a / b, F.lit(0.0))
    return out.select(
        "mode", "item_id", "tags", F.coalesce("results", F.lit(0)).alias("results"), F.col("rank").cast("long").alias("rank"), F.col("rank").isNotNull().alias("hit"), F.coalesce(1.0 / F.col("rank"), F.lit(0.0)).alias("mrr"),
        F.when(F.col("whole"), 1.0).otherwise(F.coalesce("overlap", F.lit(0.0))).alias("coverage"), share(F.col("right"), F.col("results")).alias("precision"), share(F.col("covered"), F.col("wanted")).alias("recall"))


def metrics(items: DataFrame, *by: str) -> DataFrame:
    """Summary of each group of items; every item counts, also one without results."""
    n, rank = F.count("*"), F.col("rank")
    mean = lambda c: rounded(exact_sum(F.col(c)) / n, 4)
    return items.groupBy(*by).agg(
        n.alias("total"), *(rounded(F.count_if(rank <= k) / n, 4).alias(f"hit_at_{k}") for k in (1, 3, 5)), mean("mrr").alias("mrr"), rounded(F.avg("rank"), 2).alias("mean_rank_of_expected"),
        mean("coverage").alias("citation_coverage_mean"), mean("precision").alias("context_precision_mean"), mean("recall").alias("context_recall_mean"),
        F.count_if(F.col("results") == 0).alias("zero_result_count"), rounded(F.count_if(F.col("results") == 0) / n, 4).alias("zero_result_rate"))


def per_tag(items: DataFrame) -> DataFrame:
    return metrics(items.withColumn("tag", F.explode(F.array_distinct("tags"))), "mode", "tag")


def deltas(summary: DataFrame, baseline: str) -> DataFrame:
    """``mode, metric, before, after, delta, status`` of every run against the baseline's; without a value on a side there is none."""
    names = [*HIGHER, *LOWER]
    long = summary.unpivot(["mode"], names, "metric", "after").withColumn("after", F.col("after").cast("double"))
    before = long.where(F.col("mode") == baseline).select("metric", F.col("after").alias("before"))
    delta = F.round(F.col("after") - F.col("before"), 4)
    gain = F.when(F.col("metric").isin(*LOWER), -delta).otherwise(delta)
    status = F.when(delta.isNull(), "no_data").when(gain == 0, "unchanged").when(gain > 0, "improved").otherwise("regressed")
    return long.where(F.col("mode") != baseline).join(F.broadcast(before), "metric").select("mode", "metric", "before", "after", delta.alias("delta"), status.alias("status"))


def item_diffs(items: DataFrame, baseline: str) -> DataFrame:
    """Each run's items against the baseline's: hit, then rank, then the reciprocal rank decide; an item of one side alone is ``failure``."""
    side = lambda rows, x: rows.select("item_id", F.lit(True).alias(f"{x}_has"), F.col("hit").alias(f"{x}_hit"), F.col("rank").alias(f"{x}_rank"))
    others = items.where(F.col("mode") != baseline).select("mode").distinct()
    before = side(items.where(F.col("mode") == baseline), "before").crossJoin(F.broadcast(others))
    after = items.where(F.col("mode") != baseline).select("mode", "item_id", F.lit(True).alias("after_has"), F.col("hit").alias("after_hit"), F.col("rank").alias("after_rank"))
    a, b = F.col("after_rank"), F.col("before_rank")
    status = (
        F.when(F.col("before_has").isNull() | F.col("after_has").isNull(), "failure").when(F.col("before_hit") & ~F.col("after_hit"), "regressed").when(~F.col("before_hit") & F.col("after_hit"), "improved")
        .when(a > b, "regressed").when(a < b, "improved").otherwise("unchanged")
    )
    moved = F.when(a.isNotNull() & b.isNotNull(), b - a).when(a.isNotNull(), APPEARED).when(b.isNotNull(), -APPEARED)
    return before.join(after, ["mode", "item_id"], "full").select("mode", "item_id", b.alias("before_rank"), a.alias("after_rank"), moved.alias("rank_delta"), status.alias("status"))


def value_summary(diffs: DataFrame) -> DataFrame:
    """Counts of each run: items that gained, that lost, hits that appeared, that vanished."""
    d = F.col("rank_delta")
    return diffs.groupBy("mode").agg(F.count_if(d > 0).alias("improved"), F.count_if(d < 0).alias("regressed"), F.count_if(d == APPEARED).alias("new_hits"), F.count_if(d == -APPEARED).alias("lost_hits"))


def mode_winner(summary: DataFrame) -> DataFrame:
    """The best run by hits in five, reciprocal rank, recall and fewer empty results; of equals the first name."""
    w = Window.orderBy(F.desc("hit_at_5"), F.desc("mrr"), F.desc("context_recall_mean"), "zero_result_rate", "mode")  # one row a run
    return summary.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def config_score() -> Column:
    parts = [F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in WEIGHTS.items() if c != "answer_correctness_mean"]  # no answers are judged here
    return F.round(parts[0] + parts[1] + parts[2], 6)
