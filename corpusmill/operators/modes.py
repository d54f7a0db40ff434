"""One search for all modes, over a batch of queries: dense candidates, graph expansion, lexical fusion, rerank.

Every mode begins with the nearest chunks. ``graph`` ones add what the evidence graph finds and
raise what both find; ``hybrid`` ones fuse the scores with lexical ones, the candidates of a query
being its corpus; ``rerank`` ones order by shared words. Stages keep that order.

Graph: names that a query matches, relations that touch one, and the chunks that are evidence of
either. Evidence of relations beats mentions of matched names, and these beat mentions of their
neighbours, which are sought only for queries whose lists have room.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..shared import materialize, small
from . import graph as G, retrieval as R

MODES = ("dense", "hybrid", "rerank", "hybrid_rerank", "graph", "hybrid_graph", "graph_rerank", "hybrid_graph_rerank")
#: Confidence of a name found by pattern, of a co-mention and the weight of that predicate; evidence rows of a relation; a neighbour's mention.
NAME, CO_MENTION, WEIGHT, EVIDENCE, NEIGHBOUR = 0.55, 0.65, 1.0, 4, 0.68


def graph_scores(queries: DataFrame, mentions: DataFrame, limit: int = 20) -> DataFrame:
    """``query_id, chunk_id, score``: the ``limit`` best chunks of each of ``queries(query_id, query)``; ties by chunk id.

    What a matched name gives is one score for all its chunks, so its ``limit`` smallest chunk ids say
    all that can reach a query's list: names, not queries, meet their chunks, however common they are.
    """
    mentions = materialize(mentions.select("chunk_id", "document_id", "name", "mentions"), "mentions")
    matched = materialize(G.match(queries, G.entities(mentions).select("name")), "matched")  # at most eight names a query
    asked = small(matched.select("name").distinct())
    pairs = G.pairs(mentions.select("chunk_id", "name"), "chunk_id")
    near = pairs.join(asked.withColumnRenamed("name", "subject"), "subject", "left_semi").unionByName(pairs.join(asked.withColumnRenamed("name", "object"), "object", "left_semi")).distinct()
    evidence = materialize(_first(near, ["subject", "object"], EVIDENCE), "evidence")
    ends = evidence.select("chunk_id", F.explode(F.array("subject", "object")).alias("name")).join(asked, "name", "left_semi")

    relation = lambda path, bonus: F.round(F.least(F.lit(1.0), ((0.72 + 0.18 * path) * CO_MENTION + bonus) * WEIGHT), 6)
    one = small(matched).join(_first(ends.distinct(), ["name"], limit), "name").select("query_id", "chunk_id", relation(F.col("score"), 0.08).alias("score"))
    a, b = matched.select("query_id", F.col("name").alias("subject"), F.col("score").alias("a")), matched.select("query_id", F.col("name").alias("object"), F.col("score").alias("b"))
    both = a.join(small(b), "query_id").where("subject < object").hint("merge").join(evidence.hint("merge"), ["subject", "object"]).select("query_id", "chunk_id", relation(F.greatest("a", "b"), 0.25).alias("score"))
    own = _first(mentions.join(asked, "name", "left_semi").select("name", "chunk_id").distinct(), ["name"], limit)
    by_name = small(matched).join(own, "name").select("query_id", "chunk_id", ((0.82 + 0.16 * F.col("score")) * NAME).alias("score"))
    strong = materialize(_best(one.unionByName(both).unionByName(by_name), limit), "strong")

    full = strong.groupBy("query_id").count().where(F.col("count") >= limit).select("query_id")
    open_names = materialize(matched.join(full, "query_id", "left_anti").select("query_id", "name"), "open")
    if open_names.isEmpty():
        return strong
    some = small(open_names.select("name").distinct())
    related = evidence.select("subject", "object").distinct()
    related = related.select(F.col("subject").alias("name"), F.col("object").alias("other")).unionByName(related.select(F.col("object").alias("name"), F.col("subject").alias("other"))).join(some, "name", "left_semi")
    held = _first(mentions.select(F.col("name").alias("other"), "chunk_id").distinct(), ["other"], limit)
    around = _first(related.join(held, "other").select("name", "chunk_id").distinct(), ["name"], limit)
    neighbours = small(open_names).join(around, "name").select("query_id", "chunk_id", F.lit(NEIGHBOUR * NAME).alias("score"))
    return _best(strong.unionByName(neighbours), limit)


def _first(rows: DataFrame, by: list[str], n: int) -> DataFrame:
    """The ``n`` rows of the smallest chunk ids of each group."""
    w = Window.partitionBy(*by).orderBy("chunk_id")
    return rows.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= n).drop("__r")


def _best(rows: DataFrame, limit: int) -> DataFrame:
    best = rows.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    return best.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= limit).drop("__r")


def search(queries: DataFrame, chunks: DataFrame, mode: str, mentions: DataFrame | None = None, top_k: int = 5, candidate_k: int = 20, lexical_weight: float = 0.3, graph_weight: float = 0.35) -> DataFrame:
    """``query_id, chunk_id, score, rank``: the ``top_k`` of ``chunks(chunk_id, text, vector)`` for each of ``queries(query_id, query, vector)``.

    ``mentions(chunk_id, document_id, name, mentions)`` are asked by the graph modes.
    """
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    if "graph" in mode and mentions is None:
        raise ValueError("graph modes need mentions")
    near = R.knn(queries.select("query_id", "vector"), chunks.select("chunk_id", "vector"), candidate_k if mode != "dense" else top_k)
    found = near.select("query_id", "chunk_id", F.round(1 - F.col("distance"), 6).alias("score"))
    if "graph" in mode:
        graph = graph_scores(queries.select("query_id", "query"), mentions, max(candidate_k, top_k)).join(chunks.select("chunk_id").hint("merge"), "chunk_id", "left_semi")
        both = found.withColumnRenamed("score", "base").join(graph, ["query_id", "chunk_id"], "full")
        weight = max(0.0, min(graph_weight, 1.0))
        blend = F.greatest("base", (1 - weight) * F.col("base") + weight * F.col("score"), "score")  # greatest leaves nulls out
        found = both.select("query_id", "chunk_id", F.round(F.coalesce(blend, "base", "score"), 6).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id")
    found = found.withColumn("rank", F.row_number().over(order).cast("long"))
    if "hybrid" in mode or "rerank" in mode:
        found = materialize(found, "found")
        said = found.join(small(queries.select("query_id", "query"), 10_000), "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")
        if "hybrid" in mode:
            fused = R.fuse(R.candidate_bm25(said).drop("rank"), lexical_weight)
            found = materialize(fused.select("query_id", "chunk_id", F.col("fused").alias("score"), "rank"), "fused")
        if "rerank" in mode:
            lap = said.select("query_id", "chunk_id", R.overlap(F.col("query"), F.col("text")).alias("lap"))
            found = found.drop("score").join(lap.hint("merge"), ["query_id", "chunk_id"]).select("query_id", "chunk_id", F.col("lap").alias("score"), F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("lap"), "rank")).cast("long").alias("rank"))
    return found.where(F.col("rank") <= top_k).select("query_id", "chunk_id", "score", "rank")
