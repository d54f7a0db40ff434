"""Queries of the retrieval algebra: every row whose id is divisible by 20 asks, all rows answer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions.text import tokens
from ..operators import acl, ann, answer_cache, chunking, conflicts as C, retrieval as R
from ..shared import materialize, small
from . import kb

QUERIES, SQL = {}, {}
_TOK = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
_DIST = "CASE WHEN sqrt(list_sum(list_transform({a}::DOUBLE[], lambda x: x * x))) = 0 THEN 1 ELSE round(1 - list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 6) END"
_KNN = f"""WITH h AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, {_DIST.format(a='q.embedding', b='v.embedding')} AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) AS rank FROM h)"""
_CAND = _KNN + f""", qt AS (SELECT doc_id AS query_id, text AS query FROM documents WHERE doc_id % 20 = 0),
c AS (SELECT query_id, query, chunk_id, text, rank, round(1 - distance, 6) AS score FROM r JOIN qt USING (query_id) JOIN documents ON doc_id = chunk_id WHERE rank <= 20)"""
_LEX = _CAND + f""", w AS (SELECT query_id, chunk_id, list_distinct({_TOK.format('query')}) AS q, {_TOK.format('text')} AS w FROM c),
st AS (SELECT query_id, count(*) AS n, avg(len(w)) AS mean FROM w GROUP BY 1),
tf AS (SELECT query_id, chunk_id, l, term, count(*) AS c FROM (SELECT query_id, chunk_id, len(w) AS l, unnest(list_filter(w, lambda x: list_contains(q, x))) AS term FROM w) GROUP BY ALL),
df AS (SELECT query_id, term, count(*) AS df FROM tf GROUP BY 1, 2),
lx AS (SELECT query_id, chunk_id, sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (c / l) * 2.2 / ((c / l) + 1.2 * (0.25 + 0.75 * l / mean))) AS lexical FROM tf JOIN df USING (query_id, term) JOIN st USING (query_id) GROUP BY 1, 2),
cl AS (SELECT c.*, coalesce(lexical, 0) AS lexical FROM c LEFT JOIN lx USING (query_id, chunk_id)),
fz AS (SELECT *, 0.7 * (score - min(score) OVER p) / CASE WHEN max(score) OVER p = min(score) OVER p THEN 1 ELSE max(score) OVER p - min(score) OVER p END + 0.3 * least(lexical, 1.0) AS raw FROM cl WINDOW p AS (PARTITION BY query_id)),
fu AS (SELECT *, round(raw, 6) AS fused, row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 9) DESC, score DESC, chunk_id) AS frank FROM fz)"""
_RERANK = f"CASE WHEN len({_TOK.format('query')}) = 0 THEN 0 ELSE round(len(list_intersect(list_distinct({_TOK.format('query')}), {_TOK.format('text')})) / len(list_distinct({_TOK.format('query')})), 6) END"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


#: So many ids of candidates (16 MB) are broadcast; more are shuffled.
_IDS = 1_000_000


def _vectors(spark, sf):
    return kb.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))


def _nearest(spark, sf, k):
    v = _vectors(spark, sf)
    return R.knn(v.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), v, k)


def _candidates(spark, sf, k=20, text=None):
    """The ``k`` nearest with texts (or what ``text`` makes of them), queries and the tokens these ask for.

    Only texts of candidates are moved, and a query's text or tokens meet them where its candidates already are.
    """
    d = kb.table(spark, sf, "documents").select("doc_id", "text")
    q = d.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"), F.array_distinct(tokens(F.col("text"))).alias("asked"))
    near = materialize(_nearest(spark, sf, k).withColumn("score", F.round(1 - F.col("distance"), 6)).drop("distance"), "near")
    ids = small(near.select("chunk_id").distinct(), _IDS)
    held = d.select(F.col("doc_id").alias("chunk_id"), (F.col("text") if text is None else text).alias("text")).join(ids, "chunk_id", "left_semi")
    return near.join(held, "chunk_id").join(q, "query_id")


def _fused(spark, sf):
    return R.fuse(R.candidate_bm25(_candidates(spark, sf).withColumnRenamed("rank", "dense_rank")))


@query(_KNN + " SELECT query_id, chunk_id, distance, rank FROM r WHERE rank <= 5")
def knn_dense(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf, 5)


@query(_KNN + " SELECT query_id, 'cit-' || rank AS citation, chunk_id, round(1 - distance, 6) AS score FROM r WHERE rank <= 5")
def rank_trace(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf, 5).select("query_id", F.concat(F.lit("cit-"), "rank").alias("citation"), "chunk_id", F.round(1 - F.col("distance"), 6).alias("score"))


@query(_LEX + " SELECT query_id, chunk_id, round(lexical, 6) AS lexical, fused FROM fu")
def hybrid_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf).select("query_id", "chunk_id", F.round("lexical", 6).alias("lexical"), "fused")


@query(_CAND + f", s AS (SELECT *, {_RERANK} AS rerank_score FROM c) SELECT query_id, chunk_id, rerank_score, rank AS rank_before, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS rank_after FROM s")
def rerank(spark: SparkSession, sf: str) -> DataFrame:
    return R.rerank(_candidates(spark, sf), F.col("asked")).select("query_id", "chunk_id", "rerank_score", "rank_before", "rank_after")


@query(_CAND + f", s AS (SELECT *, {_RERANK} AS rerank_score FROM c), m AS (SELECT query_id, chunk_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, rank) AS after FROM s) SELECT query_id, chunk_id, rank - after AS moved, CASE WHEN rank > after THEN 'up' WHEN rank < after THEN 'down' ELSE 'same' END AS direction FROM m")
def rank_movement(spark: SparkSession, sf: str) -> DataFrame:
    moved = F.col("rank_before") - F.col("rank_after")
    return R.rerank(_candidates(spark, sf), F.col("asked")).select("query_id", "chunk_id", moved.alias("moved"), F.when(moved > 0, "up").when(moved < 0, "down").otherwise("same").alias("direction"))


_ACL = "doc_id % 5 NOT IN (0, 1) OR (doc_id % 5 = 0 AND NOT (doc_id % 7 = 0 AND lang = 'en') AND (lower(source) = 'src0' OR lang = 'en'))"


@query(_LEX + f", p AS (SELECT fu.query_id, fu.query, fu.chunk_id, fu.text, fu.frank FROM fu JOIN documents d ON d.doc_id = fu.chunk_id WHERE {_ACL.replace('doc_id', 'd.doc_id').replace('lang', 'd.lang').replace('source', 'd.source')}), s AS (SELECT *, {_RERANK} AS rerank_score FROM p), o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, frank) AS rank FROM s) SELECT query_id, chunk_id, rerank_score, rank FROM o WHERE rank <= 5")
def search_hybrid_rerank(spark: SparkSession, sf: str) -> DataFrame:
    allowed = acl.with_decision(kb.versions(spark, sf), kb.REQUEST).where("permitted").select(F.col("doc_id").alias("chunk_id"))
    fused = _fused(spark, sf).join(allowed, "chunk_id", "left_semi")
    return R.rerank(fused, F.col("asked")).where("rank_after <= 5").select("query_id", "chunk_id", "rerank_score", F.col("rank_after").alias("rank"))


@query(f"""WITH q AS (SELECT item_id AS query_id, text AS query FROM benchmark), d AS (SELECT doc_id, {_TOK.format('text')} AS w FROM documents),
t AS (SELECT query_id, unnest(list_distinct({_TOK.format('query')})) AS term FROM q), s AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM d),
tf AS (SELECT doc_id, l, term, count(*) AS c FROM (SELECT doc_id, len(w) AS l, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM t) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
h AS (SELECT query_id, doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (c / l) * 2.2 / ((c / l) + 1.2 * (0.25 + 0.75 * l / mean))), 4) AS score FROM tf JOIN df USING (term) JOIN t USING (term), s GROUP BY 1, 2)
SELECT query_id, doc_id, score FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 20""")
def bm25(spark: SparkSession, sf: str) -> DataFrame:
    """The twenty best documents, of every language, for the whole text of each benchmark item."""
    q = kb.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return R.bm25(q, kb.table(spark, sf, "documents"), 20, digits=4).select("query_id", "doc_id", "score")


@query(f"SELECT doc_id, round(len(list_intersect(['the', 'that', 'of', 'and'], {_TOK.format('text')})) / 4, 6) AS overlap FROM documents")
def token_overlap(spark: SparkSession, sf: str) -> DataFrame:
    return kb.table(spark, sf, "documents").select("doc_id", R.overlap(F.lit("the that of and"), F.col("text")).alias("overlap"))


@query(_KNN + ", m AS (SELECT query_id AS list_no, chunk_id, round(1 - distance, 6) AS score FROM r WHERE rank <= 20), o AS (SELECT *, row_number() OVER (PARTITION BY chunk_id ORDER BY score DESC, list_no) AS k FROM m) SELECT chunk_id, list_no, score FROM o WHERE k = 1")
def subquery_merge(spark: SparkSession, sf: str) -> DataFrame:
    lists = _nearest(spark, sf, 20).select(F.col("query_id").alias("list_no"), "chunk_id", F.round(1 - F.col("distance"), 6).alias("score"))
    return R.merge_lists(lists).select("chunk_id", "list_no", "score")


#: New versions of every chunk whose id is divisible by 20: its vector with a share of the next one's.
_SHARES = [0.0, 0.1, 0.2, 0.4, 0.5]
_REVISED = f"""WITH q AS (SELECT a.vec_id AS query_id, list_transform(list_zip(a.embedding::DOUBLE[], coalesce(b.embedding, a.embedding)::DOUBLE[]), lambda p: p[1] * (1 - {_SHARES}[a.vec_id // 20 % 5 + 1]) + p[2] * {_SHARES}[a.vec_id // 20 % 5 + 1]) AS vector
  FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 20 = 0),
h AS (SELECT query_id, v.vec_id AS chunk_id, {_DIST.format(a='q.vector', b='v.embedding')} AS distance FROM q, embeddings v),
n AS (SELECT query_id, chunk_id, round(1 - distance, 6) AS similarity FROM h QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) = 1)"""


def _revised(spark, sf):
    v = _vectors(spark, sf)
    share = F.element_at(F.array(*map(F.lit, _SHARES)), (F.floor(F.col("chunk_id") / 20) % 5 + 1).cast("int"))
    rows = v.where("chunk_id % 20 = 0").join(v.select((F.col("chunk_id") - 1).alias("chunk_id"), F.col("vector").alias("next")), "chunk_id", "left").withColumn("share", share)
    mixed = F.zip_with("vector", F.coalesce("next", "vector"), lambda x, y: x.cast("double") * (1 - F.col("share")) + y.cast("double") * F.col("share"))
    return rows.select(F.col("chunk_id").alias("query_id"), mixed.alias("vector"))


def _conflicts(spark, sf):
    new = _revised(spark, sf).select((F.col("query_id") + _NEW).alias("chunk_id"), "vector")
    return C.detect(new, _vectors(spark, sf))


@query(_REVISED + " SELECT query_id, chunk_id, similarity FROM n WHERE similarity >= 0.92")
def near_dup(spark: SparkSession, sf: str) -> DataFrame:
    """Conflicts of the new versions with what is indexed."""
    return _conflicts(spark, sf).select((F.col("new_id") - _NEW).alias("query_id"), F.col("old_id").alias("chunk_id"), "similarity")


#: Ids of new chunks.
_NEW = 10**12
_REVIEWED = _REVISED + f""", c AS (SELECT query_id + {_NEW} AS new_id, chunk_id AS old_id, similarity, query_id % 30 AS new_at, chunk_id * 7 % 30 AS old_at, query_id // 20 % 6 AS k FROM n WHERE similarity >= 0.92),
w AS (SELECT *, CASE k WHEN 0 THEN 'keep_new' WHEN 1 THEN 'keep_old' WHEN 2 THEN 'keep_both' WHEN 3 THEN 'auto_recency' WHEN 5 THEN 'keep_new' END AS wished FROM c),
x AS (SELECT *, CASE WHEN wished = 'auto_recency' THEN CASE WHEN new_at >= old_at THEN 'keep_new' ELSE 'keep_old' END ELSE wished END AS resolution FROM w)"""


def _review(spark, sf):
    """Conflicts with their times, and decisions: every sixth has none, every sixth two, the later one first in the table."""
    found = _conflicts(spark, sf)
    found = found.withColumn("new_at", (F.col("new_id") - _NEW) % 30).withColumn("old_at", F.col("old_id") * 7 % 30)
    k = F.floor((F.col("new_id") - _NEW) / 20) % 6
    one = lambda r, at: F.struct(F.lit(at).alias("at"), F.lit(r).alias("resolution"))
    wished = F.when(k == 0, F.array(one("keep_new", 1))).when(k == 1, F.array(one("keep_old", 1))).when(k == 2, F.array(one("keep_both", 1))).when(k == 3, F.array(one("auto_recency", 1), one("drop_all", 0))).when(k == 5, F.array(one("keep_old", 2), one("keep_new", 1)))
    decisions = found.select("new_id", F.posexplode(wished).alias("pos", "d")).select("new_id", (F.col("new_id") * 10 + F.col("pos")).alias("decision_id"), "d.at", "d.resolution")
    return found, decisions


@query(_REVIEWED + " SELECT new_id, old_id, similarity, CASE WHEN wished IS NULL THEN 'pending' ELSE 'resolved_' || wished END AS status, resolution, CASE resolution WHEN 'keep_new' THEN old_id WHEN 'keep_old' THEN new_id END AS suppressed FROM x")
def conflict_review(spark: SparkSession, sf: str) -> DataFrame:
    return C.resolve(*_review(spark, sf))


@query(_REVIEWED + " SELECT new_id * 10 + 1 AS decision_id, 'invalid' AS reason FROM c WHERE k = 3 UNION ALL SELECT new_id * 10, 'already_resolved' FROM c WHERE k = 5")
def conflict_refused(spark: SparkSession, sf: str) -> DataFrame:
    return C.refused(*_review(spark, sf))


@query(_REVISED + " SELECT query_id, chunk_id AS entry_id, similarity FROM n WHERE similarity >= 0.95")
def cache_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The best entry of 0.95 or more for every revised vector; ``cache_actions`` has the whole life of a cache."""
    hit = R.knn(_revised(spark, sf), _vectors(spark, sf), 1, within=0.05 + 1e-6)
    return hit.where("1 - distance >= 0.95").select("query_id", F.col("chunk_id").alias("entry_id"), F.round(1 - F.col("distance"), 6).alias("similarity"))


def _cache(spark, sf):
    """Events ask with one of a hundred vectors; some say that the index was built anew. Entries live three days, a knowledge base holds fifty."""
    e = kb.table(spark, sf, "events").select("event_id", "ts", "user_id", F.col("event_type").alias("kb"), F.get_json_object("props", "$.k").cast("long").alias("chunk_id"))
    kind = F.when((F.col("chunk_id") == 0) & (F.col("user_id") % 10 == 0), "invalidate").otherwise("ask")
    asked = e.join(_vectors(spark, sf), "chunk_id", "left").select("kb", "event_id", "ts", kind.alias("kind"), "vector")
    return answer_cache.replay(asked, 0.95, 3 * 86_400, 50)


@query()
def cache_actions(spark: SparkSession, sf: str) -> DataFrame:
    """What every event does to its knowledge base's cache: state that SQL can't carry, so a plain replay is the test."""
    return _cache(spark, sf)


@query()
def cache_summary(spark: SparkSession, sf: str) -> DataFrame:
    return answer_cache.summary(_cache(spark, sf))


@query("SELECT vec_id FROM embeddings ORDER BY vec_id DESC OFFSET 100")
def cache_evict(spark: SparkSession, sf: str) -> DataFrame:
    """All but the newest hundred entries go: the cap is the cache's."""
    v = kb.table(spark, sf, "embeddings").select("vec_id")
    newest = v.orderBy(F.desc("vec_id")).limit(100)
    return v.join(F.broadcast(newest), "vec_id", "left_anti")


@query(kb.VERSIONS + "SELECT doc_id, round(0.8 * (1 - 0.2 - 0.1) + exp(-0.05 * date_diff('day', CAST(created_at AS DATE), DATE '2024-02-01')) * 0.2 + 0.1 * 0.5, 6) AS score FROM v")
def time_decay(spark: SparkSession, sf: str) -> DataFrame:
    return kb.versions(spark, sf).select("doc_id", R.decayed(F.lit(0.8), F.col("created_at"), kb.AS_OF, 0.05, 0.2, 0.1, F.lit(0.5)).alias("score"))


@query(_CAND + ", u AS (SELECT *, sum(length(text)) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS used FROM c) SELECT query_id, chunk_id, CAST(used AS BIGINT) AS used FROM u WHERE used <= 6000")
def context_pack(spark: SparkSession, sf: str) -> DataFrame:
    return R.within_budget(_candidates(spark, sf), 6000).select("query_id", "chunk_id", "used")


@query(_CAND + """, e AS (SELECT query_id, query, rank, 'Source [cit-' || rank || ']: ' || trim(substr(text, 1, 120)) || CASE WHEN length(text) > 120 THEN '...' ELSE '' END AS line FROM c WHERE rank <= 5)
SELECT query_id, 'Answer to ''' || any_value(query) || ''':' || chr(10) || chr(10) || string_agg(line, chr(10) ORDER BY rank) AS answer, count(*) AS n_evidence FROM e GROUP BY query_id""")
def answer_deterministic(spark: SparkSession, sf: str) -> DataFrame:
    cited = F.concat(F.trim(F.substring("text", 1, 120)), F.when(F.length("text") > 120, "...").otherwise(""))
    c = _candidates(spark, sf, 5, cited)
    line = F.concat(F.lit("Source [cit-"), "rank", F.lit("]: "), "text")
    said = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n")
    return c.groupBy("query_id").agg(F.concat(F.lit("Answer to '"), F.first("query"), F.lit("':\n\n"), said).alias("answer"), F.count("*").alias("n_evidence"))


@query("SELECT conv_id, turn, part, trim(q) AS question FROM (SELECT conv_id, turn, unnest(range(1, least(len(s), 5) + 1)) AS part, s FROM (SELECT conv_id, turn, list_filter(string_split(text, '.'), lambda x: trim(x) <> '') AS s FROM conversations WHERE role = 'user')), LATERAL (SELECT s[part] AS q)")
def query_split(spark: SparkSession, sf: str) -> DataFrame:
    c = kb.table(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.slice(F.filter(F.split("text", r"\."), lambda x: F.trim(x) != ""), 1, 5).alias("s"))
    return c.select("conv_id", "turn", F.posexplode("s").alias("part", "q")).select("conv_id", "turn", (F.col("part") + 1).cast("long").alias("part"), F.trim("q").alias("question"))


@query("SELECT doc_id, i AS child_index, (i * 450) // 2000 AS parent_index, CAST(length(substr(text, CAST((i * 450) // 2000 * 2000 + 1 AS INTEGER), 2000)) AS BIGINT) AS parent_chars FROM (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 50) / 450.0) AS BIGINT), 1))) AS i FROM documents WHERE length(text) > 0)")
def parent_hydrate(spark: SparkSession, sf: str) -> DataFrame:
    d = kb.table(spark, sf, "documents").select("doc_id", "text")
    child = chunking.char_windows(d).select("doc_id", F.col("chunk_index").alias("child_index"), F.expr("(chunk_index * 450) div 2000").alias("parent_index"))
    parent = chunking.char_windows(d, 2000, 0).select("doc_id", F.col("chunk_index").alias("parent_index"), F.length("chunk").cast("long").alias("parent_chars"))
    return child.join(parent, ["doc_id", "parent_index"], "left").select("doc_id", "child_index", "parent_index", "parent_chars")


_SUMMARY = f"""WITH d AS (SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, {_DIST.format(a='q.embedding', b='v.embedding')} AS distance FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0),
c AS (SELECT DISTINCT query_id, chunk_id // 3 AS document_id FROM (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) <= 5)),
s AS (SELECT query_id, chunk_id // 3 AS document_id FROM (SELECT * FROM d WHERE chunk_id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, chunk_id) <= 5))
SELECT query_id, document_id, 'chunk' AS kind FROM c UNION ALL SELECT query_id, document_id, 'summary' AS kind FROM s ANTI JOIN c USING (query_id, document_id)"""


@query(_SUMMARY)
def summary_search(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of the five nearest chunks, and of the five nearest summaries (a document's first vector) where no chunk was found."""
    v = _vectors(spark, sf)
    q = v.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id")
    document = F.expr("chunk_id div 3").alias("document_id")
    hits = R.knn(q, v, 5).select("query_id", document).distinct()
    summaries = R.knn(q, v.where("chunk_id % 3 = 0"), 5).select("query_id", document)
    more = summaries.join(hits, ["query_id", "document_id"], "left_anti")
    return hits.withColumn("kind", F.lit("chunk")).unionByName(more.withColumn("kind", F.lit("summary")))


def _inverted(spark, sf, k):
    v = _vectors(spark, sf)
    fitted = ann.fit(v, k)
    return ann.search(v.where("chunk_id % 20 = 0").withColumnRenamed("chunk_id", "query_id"), materialize(ann.build(v, fitted), "index"), fitted, k)


@query()
def knn_ivf(spark: SparkSession, sf: str) -> DataFrame:
    """``knn_dense`` by the inverted file: approximate, so its test is its recall."""
    return _inverted(spark, sf, 5).select("query_id", "chunk_id", "distance", "rank")


@query("SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def knn_ivf_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the inverted file finds nine of ten exact neighbours of every row whose id is divisible by 20."""
    return ann.recall(_inverted(spark, sf, 5), _nearest(spark, sf, 5)).select("queries", (F.col("recall") >= 0.9).alias("enough"))
