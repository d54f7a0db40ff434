"""Queries of the evidence graph and the knowledge map over all documents: a row is a chunk, three rows are a document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import graph as G, modes, retrieval as R
from ..shared import materialize
from . import kb

QUERIES, SQL = {}, {}
_STOP = ", ".join(f"'{x}'" for x in G.STOPWORDS)
_CANON = "trim(regexp_replace(regexp_replace(lower(regexp_replace(trim({}), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"
_M = f"""WITH c AS (SELECT doc_id AS chunk_id, doc_id // 3 AS document_id, list_filter(list_transform(regexp_extract_all(regexp_replace(text, '{G.FOREIGN}', '·', 'g'), '{G.ENTITY}'), lambda x: {_CANON.format('x')}), lambda x: x <> '' AND x NOT IN ({_STOP})) AS l FROM documents),
o AS (SELECT chunk_id, document_id, l, unnest(list_filter(l, lambda x, i: list_position(l, x) = i)[1:{G.CANDIDATES}]) AS name FROM c),
m AS (SELECT chunk_id, document_id, name, CAST(len(list_filter(l, lambda x: x = name)) AS BIGINT) AS mentions FROM o)"""
_E = _M + ", e AS (SELECT name, CAST(sum(mentions) AS BIGINT) AS mentions, count(DISTINCT document_id) AS documents FROM m GROUP BY 1)"
_R = _E + ", r AS (SELECT a.name AS subject, b.name AS object, count(*) AS chunks, 0.65 AS confidence FROM m a JOIN m b ON a.chunk_id = b.chunk_id AND a.name < b.name GROUP BY 1, 2)"
_Q = ", q AS (SELECT name FROM e ORDER BY mentions DESC, name LIMIT 3)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _mentions(spark, sf):
    return G.mentions(kb.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.expr("doc_id div 3").alias("document_id"), "text"))


def _asked(entities):
    """The three most mentioned names, as a query."""
    return F.broadcast(entities.orderBy(F.desc("mentions"), "name").limit(3).select("name"))


@query(_M + " SELECT chunk_id, document_id, name, mentions FROM m")
def entity_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return _mentions(spark, sf)


@query(_E + " SELECT name, mentions, documents FROM e")
def kg_entities(spark: SparkSession, sf: str) -> DataFrame:
    return G.entities(_mentions(spark, sf))


@query(_R + " SELECT subject, object, chunks FROM r")
def co_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return G.relations(_mentions(spark, sf)).select("subject", "object", "chunks")


@query(_R + " SELECT subject, object, CAST(confidence AS DOUBLE) AS confidence FROM r WHERE chunks >= 1")
def kg_relations(spark: SparkSession, sf: str) -> DataFrame:
    return G.relations(_mentions(spark, sf)).select("subject", "object", "confidence")


@query(_R + " SELECT (SELECT count(*) FROM e) AS entities, (SELECT count(*) FROM m) AS mentions, (SELECT count(*) FROM r) AS relations, (SELECT count(DISTINCT chunk_id) FROM m) AS chunks")
def kg_stats(spark: SparkSession, sf: str) -> DataFrame:
    m = _mentions(spark, sf)
    count = lambda rows, name, c=F.count("*"): rows.agg(c.alias(name))
    return count(G.entities(m), "entities").crossJoin(count(m, "mentions")).crossJoin(count(G.relations(m), "relations")).crossJoin(count(m, "chunks", F.count_distinct("chunk_id")))


_TERMS = "list_distinct(regexp_extract_all({}, '[a-z0-9_/-]{{3,}}'))"
_MATCH = _E + f""", q AS (SELECT item_id AS query_id, lower(text) AS said, regexp_replace(lower(text), '[^a-z0-9]+', '', 'g') AS compact, {_TERMS.format('lower(text)')} AS asked FROM benchmark),
n AS (SELECT name, replace(name, ' ', '') AS whole, string_split(name, ' ') AS parts, {_TERMS.format('name')} AS terms FROM e),
a AS (SELECT *, array_to_string(list_transform(parts, lambda x: x[1]), '') AS initials FROM n),
h AS (SELECT query_id, name, CASE WHEN contains(said, name) OR contains(compact, name) OR contains(said, whole) OR contains(compact, whole) OR (len(parts) >= 3 AND (contains(said, initials) OR contains(compact, initials))) THEN 1.0
  WHEN len(list_intersect(terms, asked)) > 0 THEN least(0.95, 0.55 + len(list_intersect(terms, asked)) * 0.15) END AS score FROM q, a)"""


@query(_MATCH + " SELECT query_id, name, round(score, 6)::DOUBLE AS score FROM h WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, name) <= 8")
def graph_match(spark: SparkSession, sf: str) -> DataFrame:
    """The eight best entities of every benchmark item, by alias or by shared terms."""
    asked = kb.table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return G.match(asked, G.entities(_mentions(spark, sf)))


_REL = _R + _Q + ", x AS (SELECT subject, object, (subject IN (SELECT name FROM q))::INT + (object IN (SELECT name FROM q))::INT AS ends FROM r), s AS (SELECT *, round(greatest(0, least(((0.72 + 0.18) * 0.65 + CASE ends WHEN 2 THEN 0.25 WHEN 1 THEN 0.08 ELSE 0 END) * 0.55, 1)), 6)::DOUBLE AS score FROM x WHERE ends > 0)"


@query(_REL + " SELECT subject, object, score FROM s")
def graph_relations(spark: SparkSession, sf: str) -> DataFrame:
    m = materialize(_mentions(spark, sf), "mentions")
    asked = _asked(G.entities(m))
    return G.expand(G.relations(m, asked), asked).select("subject", "object", "score")


_CHUNKS = _REL + ", b AS (SELECT chunk_id, round(least((0.82 + 0.16) * 0.65, 1), 6)::DOUBLE AS score FROM m WHERE name IN (SELECT name FROM q) UNION ALL SELECT a.chunk_id, s.score FROM s JOIN m a ON a.name = s.subject JOIN m b ON b.name = s.object AND a.chunk_id = b.chunk_id), best AS (SELECT chunk_id, max(score) AS score FROM b GROUP BY 1)"


@query(_CHUNKS + " SELECT chunk_id, score FROM best")
def graph_chunks(spark: SparkSession, sf: str) -> DataFrame:
    m = materialize(_mentions(spark, sf), "mentions")
    return _boosts(m, F.broadcast(materialize(_asked(G.entities(m)), "asked")))


def _boosts(m, asked):
    return G.chunk_scores(m, asked, materialize(G.expand(G.relations(m, asked), asked), "expanded"))


_DISTANCE = "CASE WHEN list_sum(list_transform(a.embedding::DOUBLE[], lambda x: x * x)) = 0 OR list_sum(list_transform(v.embedding::DOUBLE[], lambda x: x * x)) = 0 THEN 1 ELSE round(1 - list_cosine_similarity(a.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) END"
_MERGE = _CHUNKS + f""", h AS (SELECT chunk_id, count(*) AS n FROM m JOIN embeddings ON vec_id = chunk_id WHERE name IN (SELECT name FROM q) GROUP BY 1), t AS (SELECT chunk_id FROM h ORDER BY n DESC, chunk_id LIMIT 1),
d AS (SELECT v.vec_id AS chunk_id, {_DISTANCE} AS distance FROM t JOIN embeddings a ON a.vec_id = t.chunk_id, embeddings v), k AS (SELECT chunk_id, round(1 - distance, 6) AS base FROM d ORDER BY distance, chunk_id LIMIT 20)"""


@query(_MERGE + " SELECT chunk_id, round(CASE WHEN base IS NULL THEN score WHEN score IS NULL THEN base ELSE greatest(base, 0.65 * base + 0.35 * score, score) END, 6)::DOUBLE AS merged FROM k FULL JOIN best USING (chunk_id)")
def graph_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The graph's chunks for the three names, merged with the 20 nearest of the chunk that has most of them."""
    m = materialize(_mentions(spark, sf), "mentions")
    asked = F.broadcast(materialize(_asked(G.entities(m)), "asked"))
    v = kb.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    held = m.join(asked, "name", "left_semi").groupBy("chunk_id").agg(F.count("*").alias("n"))
    asker = held.join(v.select("chunk_id"), "chunk_id").orderBy(F.desc("n"), "chunk_id").limit(1).select("chunk_id")
    asker = materialize(v.join(F.broadcast(asker), "chunk_id", "left_semi").withColumnRenamed("chunk_id", "query_id"), "asker")
    base = R.knn(asker, v, 20).select("chunk_id", F.round(1 - F.col("distance"), 6).alias("base"))
    return G.merge(base, _boosts(m, asked)).select("chunk_id", "merged")


#: Names in more than twenty documents pair each with the first alone.
_DOCS = _M + """, de AS (SELECT DISTINCT document_id, name FROM m), dn AS (SELECT document_id, count(*) AS n FROM de GROUP BY 1), z AS (SELECT name, count(*) AS df, min(document_id) AS first FROM de GROUP BY 1), sz AS (SELECT * FROM de JOIN z USING (name)),
pn AS (SELECT a.document_id AS left_id, b.document_id AS right_id FROM sz a JOIN sz b ON a.name = b.name AND a.document_id < b.document_id WHERE a.df <= 20 UNION SELECT first, document_id FROM sz WHERE df > 20 AND document_id > first),
p AS (SELECT left_id, right_id, count(*) AS shared FROM pn JOIN de a ON a.document_id = left_id JOIN de b ON b.document_id = right_id AND b.name = a.name GROUP BY 1, 2)"""


@query(_DOCS + " SELECT left_id, right_id, shared FROM p")
def doc_shared_entities(spark: SparkSession, sf: str) -> DataFrame:
    return G.document_links(_mentions(spark, sf)).select("left_id", "right_id", "shared")


@query(_DOCS + " SELECT name, document_id, df FROM sz WHERE df > 20")
def doc_common_names(spark: SparkSession, sf: str) -> DataFrame:
    """The other half of the document links: who is linked by a common name."""
    return G.common_names(_mentions(spark, sf))


@query(_DOCS + " SELECT left_id, right_id, round(shared / (a.n + b.n - shared), 4) AS strength FROM p JOIN dn a ON a.document_id = left_id JOIN dn b ON b.document_id = right_id")
def kmap_doc_edges(spark: SparkSession, sf: str) -> DataFrame:
    return G.document_links(_mentions(spark, sf)).select("left_id", "right_id", "strength")


@query(_M + ", d AS (SELECT document_id, name, sum(mentions) AS n FROM m GROUP BY 1, 2) SELECT document_id, name, round(least(1.0, n / (SELECT max(n) FROM d)), 4) AS strength FROM d")
def kmap_mentions(spark: SparkSession, sf: str) -> DataFrame:
    d = _mentions(spark, sf).groupBy("document_id", "name").agg(F.sum("mentions").alias("n"))
    return d.crossJoin(F.broadcast(d.agg(F.max("n").alias("most")))).select("document_id", "name", F.round(F.least(F.lit(1.0), F.col("n") / F.col("most")), 4).alias("strength"))


@query(_DOCS + " SELECT a.name AS subject, b.name AS object, round(count(*) / (SELECT count(*) FROM dn), 4) AS strength FROM de a JOIN de b ON a.document_id = b.document_id AND a.name < b.name GROUP BY 1, 2")
def kmap_comentions(spark: SparkSession, sf: str) -> DataFrame:
    d = _mentions(spark, sf).select("document_id", "name").distinct()
    n = d.agg(F.count_distinct("document_id").alias("all"))
    pair = G.pairs(d, "document_id").groupBy("subject", "object").agg(F.count("*").alias("n"))
    return pair.crossJoin(F.broadcast(n)).select("subject", "object", F.round(F.col("n") / F.col("all"), 4).alias("strength"))


@query(_E + " SELECT name AS topic, documents, round(documents / (SELECT count(DISTINCT document_id) FROM m) * 100, 2) AS pct FROM e ORDER BY documents DESC, name LIMIT 20")
def topic_coverage(spark: SparkSession, sf: str) -> DataFrame:
    m = _mentions(spark, sf)
    n = m.agg(F.count_distinct("document_id").alias("all"))
    return G.entities(m).orderBy(F.desc("documents"), "name").limit(20).crossJoin(F.broadcast(n)).select(F.col("name").alias("topic"), "documents", F.round(F.col("documents") / F.col("all") * 100, 2).alias("pct"))


@query("SELECT doc_id, 'Deterministic summary: ' || len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) || ' words, ' || len(string_split(rtrim(text, chr(10)), chr(10))) || ' lines.' AS summary, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda x: x <> '')) < 20 AS is_short FROM documents WHERE length(trim(text)) > 0")
def understand(spark: SparkSession, sf: str) -> DataFrame:
    n = F.size(F.array_remove(F.split("text", r"\s+"), ""))
    lines = F.size(F.split(F.regexp_replace("text", "\n+$", ""), "\n"))
    return kb.table(spark, sf, "documents").where("length(trim(text)) > 0").select("doc_id", F.concat(F.lit("Deterministic summary: "), n, F.lit(" words, "), lines, F.lit(" lines.")).alias("summary"), (n < 20).alias("is_short"))


#: Written out once more, without the operators' constants. Words stand between marks, so a name's characters are found as whole words only.
_CHUNK_MENTIONS = r"""WITH t AS (SELECT doc_id, text, regexp_extract_all(regexp_replace(text, '[A-Za-z0-9_]*[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{1FFF}\x{2C00}-\x{2DFF}\x{3040}-\x{D7FF}][\p{L}\p{N}_]*', '·', 'g'), '\b[A-Z][A-Za-z0-9_/-]{2,}(?:[ \t]+[A-Z][A-Za-z0-9_/-]{2,}){0,3}\b') AS l FROM documents),
c AS (SELECT doc_id, text, unnest(l) AS raw, generate_subscripts(l, 1) AS k FROM t),
n AS (SELECT doc_id, text, k, regexp_replace(raw, '[ \t]+', ' ', 'g') AS display, trim(regexp_replace(regexp_replace(lower(regexp_replace(trim(raw), '([a-z0-9])([A-Z])', '\1 \2', 'g')), '[^a-z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS name FROM c),
f AS (SELECT doc_id, any_value(text) AS text, name, min(k) AS k, arg_min(display, k) AS display FROM n WHERE name <> '' AND name NOT IN ('a', 'an', 'and', 'does', 'for', 'how', 'should', 'that', 'the', 'then', 'this', 'what', 'when', 'where', 'which', 'who', 'why') GROUP BY doc_id, name QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY min(k)) <= 12),
x AS (SELECT doc_id, any_value(text) AS text FROM f GROUP BY doc_id),
u AS (SELECT doc_id, text, unnest(range(0, greatest(CAST(ceil((length(text) - 50) / 450.0) AS BIGINT), 1))) AS chunk_index FROM x),
v AS (SELECT doc_id, chunk_index, lower(regexp_replace(substr(text, CAST(chunk_index * 450 + 1 AS INTEGER), 500), '([\p{L}\p{N}_]+)', chr(1) || '\1' || chr(1), 'g')) AS said FROM u),
h AS (SELECT v.doc_id, v.chunk_index, f.name, f.display, v.said, lower(regexp_replace(f.display, '([\p{L}\p{N}_]+)', chr(1) || '\1' || chr(1), 'g')) AS sought FROM v JOIN f USING (doc_id)),
m AS (SELECT doc_id, chunk_index, name, display, CAST((length(said) - length(replace(said, sought, ''))) // length(sought) AS BIGINT) AS mentions FROM h WHERE contains(said, sought))"""


def _in_chunks(spark, sf):
    return G.chunk_mentions(kb.table(spark, sf, "documents").select("doc_id", "text"))


@query(_CHUNK_MENTIONS + " SELECT doc_id, chunk_index, name, display, mentions FROM m")
def chunk_mentions(spark: SparkSession, sf: str) -> DataFrame:
    return _in_chunks(spark, sf)


@query(_CHUNK_MENTIONS + ", r AS (SELECT a.name AS subject, b.name AS object, count(*) AS chunks, min({'d': a.doc_id, 'c': a.chunk_index}) AS first FROM m a JOIN m b ON a.doc_id = b.doc_id AND a.chunk_index = b.chunk_index AND a.name < b.name GROUP BY 1, 2) SELECT subject, object, chunks, 0.65::DOUBLE AS confidence, first.d AS evidence_doc, first.c AS evidence_chunk FROM r")
def chunk_relations(spark: SparkSession, sf: str) -> DataFrame:
    return G.chunk_relations(_in_chunks(spark, sf))


def _search(spark, sf, mode):
    """Every row whose id is divisible by 20 asks with its text and vector; all rows that have a vector answer."""
    d = kb.table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    c = d.join(kb.table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector")), "chunk_id")
    q = c.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.col("text").alias("query"), "vector")
    return modes.search(q, c, mode, _mentions(spark, sf))


@query()
def search_graph(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, "graph")


@query()
def search_hybrid_graph_rerank(spark: SparkSession, sf: str) -> DataFrame:
    return _search(spark, sf, "hybrid_graph_rerank")
