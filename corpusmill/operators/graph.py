"""Evidence graph as tables: mentions, entities, co-mention relations, one-hop expansion, scores."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, combinations, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import canonical_name
from ..shared import materialize, small
from .chunking import char_windows

#: An entity candidate (one to four capitalised words), names that are none, candidates of one text.
ENTITY = r"\b[A-Z][A-Za-z0-9_/-]{2,}(?:[ \t]+[A-Z][A-Za-z0-9_/-]{2,}){0,3}\b"
STOPWORDS = ["a", "an", "and", "does", "for", "how", "should", "that", "the", "then", "this", "what", "when", "where", "which", "who", "why"]
CANDIDATES = 12
#: Words with a letter beyond ASCII: no candidate begins or ends in one, so they are blotted out and ``\b`` means the same in every engine.
FOREIGN = r"[A-Za-z0-9_]*[\x{AA}\x{B5}\x{BA}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{1FFF}\x{2C00}-\x{2DFF}\x{3040}-\x{D7FF}][\p{L}\p{N}_]*"
#: Confidence of a co-mention, weight of its predicate.
CONFIDENCE, PREDICATE = 0.65, 0.55
#: A name in more documents than this links them to its first document instead of all to all.
PAIRED = 20
#: Names that a query is searched for in order, and letters by which it finds the others.
HEAD, LETTERS = 20_000, 12


def candidates(text: Column) -> Column:
    """Canonical names of a text, in order, repeats included, stop words left out."""
    plain = F.regexp_replace(text, FOREIGN, "·")
    names = F.transform(F.regexp_extract_all(plain, F.lit(ENTITY), F.lit(0)), canonical_name)
    return F.filter(names, lambda x: (x != "") & ~x.isin(STOPWORDS))


def mentions(chunks: DataFrame) -> DataFrame:
    """``chunk_id, document_id, name, mentions`` from ``chunks(chunk_id, document_id, text)``: the first ``CANDIDATES`` names of a text, and how often it has each."""
    found = chunks.select("chunk_id", "document_id", candidates(F.col("text")).alias("all"))
    found = found.select("chunk_id", "document_id", "all", F.explode(F.slice(F.array_distinct("all"), 1, CANDIDATES)).alias("name"))
    return found.select("chunk_id", "document_id", "name", F.size(F.filter("all", lambda x: x == F.col("name"))).cast("long").alias("mentions"))


def chunk_mentions(texts: DataFrame, size: int = 500, overlap: int = 50) -> DataFrame:
    """``doc_id, chunk_index, name, display, mentions`` from ``texts(doc_id, text)``: where a text's own candidates stand in its chunks.

    The first ``CANDIDATES`` names of a text, as they are first written, are sought in each of its chunks as
    whole words, whatever their case; a name that a chunk's edge cuts isn't in it.
    """
    plain = F.regexp_replace("text", FOREIGN, "·")
    found = F.transform(F.regexp_extract_all(plain, F.lit(ENTITY), F.lit(0)), lambda x: F.struct(canonical_name(x).alias("name"), F.regexp_replace(x, "[ \t]+", " ").alias("display")))
    found = F.filter(found, lambda x: (x["name"] != "") & ~x["name"].isin(STOPWORDS))
    held = texts.where("doc_id IS NOT NULL").select("doc_id", "text", found.alias("found")).select("doc_id", "text", F.col("found.name").alias("names"), F.col("found.display").alias("shown"))
    own = F.slice(F.array_distinct("names"), 1, CANDIDATES)
    held = held.select("doc_id", "text", "names", "shown", own.alias("own"))
    first = F.transform("own", lambda x: F.struct(x.alias("name"), F.get("shown", (F.array_position("names", x) - 1).cast("int")).alias("display")))
    first = F.transform(first, lambda x: F.struct(x["name"].alias("name"), x["display"].alias("display"), _told_apart(x["display"]).alias("sought")))
    chunks = char_windows(held.select("doc_id", "text", first.alias("first")), size, overlap).select("doc_id", "chunk_index", "first", _told_apart(F.col("chunk")).alias("said"))
    chunks = chunks.select("doc_id", "chunk_index", "said", F.explode_outer("first").alias("c"))  # outer: no filter is inferred that would find the names anew for each
    without = F.length(F.replace("said", F.col("c.sought"), F.lit("")))
    counted = ((F.length("said") - without) / F.length("c.sought")).cast("long")
    return chunks.where(F.contains("said", F.col("c.sought"))).select("doc_id", "chunk_index", "c.name", "c.display", counted.alias("mentions"))


def _told_apart(text: Column) -> Column:
    """The text in lower case, every word between two marks, so that whole words are found by their characters alone."""
    return F.lower(F.regexp_replace(text, r"[\p{L}\p{N}_]+", "\u0001$0\u0001"))


def chunk_relations(mentions: DataFrame) -> DataFrame:
    """``subject, object, chunks, confidence``, and the first chunk as evidence, of names that stand in one chunk."""
    both = pairs(mentions.select(F.struct("doc_id", "chunk_index").alias("chunk"), "name"), "chunk")
    told = both.groupBy("subject", "object").agg(F.count("*").alias("chunks"), F.min("chunk").alias("first"))
    return told.select("subject", "object", "chunks", F.lit(CONFIDENCE).alias("confidence"), F.col("first.doc_id").alias("evidence_doc"), F.col("first.chunk_index").alias("evidence_chunk"))


def aliases(name: Column) -> Column:
    """The canonical name, without blanks, and its initials if there are three."""
    parts = F.split(name, " ")
    initials = F.array_join(F.transform(parts, lambda x: F.substring(x, 1, 1)), "")
    return F.array_distinct(F.filter(F.array(name, F.array_join(parts, ""), F.when(F.size(parts) >= 3, initials)), lambda x: x.isNotNull()))


def match(queries: DataFrame, names: DataFrame, top: int = 8, head: int = HEAD) -> DataFrame:
    """``query_id, name, score``: the best ``top`` canonical names of each query, by an alias in it (1.0) or by shared terms.

    A query holds an alias where its letters and digits hold those of the name, or its initials. Names
    come in order, so a task that looks for the ``head`` first ones (bounded, broadcast) is done with a query at its
    ``top`` th. What is open then meets all names by keys: aliases by their first letters among the
    query's, shared terms by the ``top`` first names of each set of up to three of a name's terms (a
    further name of a set has ``top`` before it that score no less). So no query meets every name.
    """
    spark = queries.sparkSession
    terms = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("[a-z0-9_/-]{3,}"), F.lit(0)))
    said = F.lower("query")
    q = queries.where("query IS NOT NULL").select("query_id", F.regexp_replace(said, "[^a-z0-9]+", "").alias("compact"), terms(said).alias("asked"))
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    q = materialize(q.repartition(width).withColumn("no", F.monotonically_increasing_id()), "queries")  # few rows and much work
    sought = F.filter(aliases(F.col("name")), lambda x: ~x.contains(" "))
    known = materialize(names.select("name").distinct().select("name", sought.alias("sought"), terms(F.col("name")).alias("terms")), "names")
    # Written first: a collect would take as many rows from each partition to the driver.
    first = materialize(known.orderBy("name").limit(head + 1).select("name", "sought"), "first")
    first = sorted((r.name, r.sought) for r in first.collect())
    whole, first = len(first) <= head, first[:head]
    given = spark.sparkContext.broadcast(first)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for no, query_id, compact in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = list(islice((name for name, sought in given.value if any(x in compact for x in sought)), top))
                out += [(no, query_id, name) for name in (found if len(found) == top else [*found, None])]
            kinds = (batch.schema.field(0).type, batch.schema.field(1).type, pa.string())
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else ([], [], []), kinds, strict=True)], names=["no", "query_id", "name"])

    kind = q.schema["query_id"].dataType.simpleString()
    scanned = materialize(q.select("no", "query_id", "compact").mapInArrow(scan, f"no long, query_id {kind}, name string"), "scanned")
    found = scanned.where("name IS NOT NULL").withColumn("score", F.lit(1.0))
    left = q.join(scanned.where("name IS NULL").select("no"), "no", "left_semi")
    if not left.isEmpty():
        left = materialize(left, "left")
        more = _by_terms(left, known, top)
        if not whole:
            more = more.unionByName(_by_letters(left, known, top))
        found = found.unionByName(more).groupBy("no", "query_id", "name").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "name")
    return found.select("query_id", "name", F.round("score", 6).alias("score")).withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= top).drop("__r")


def _firsts(rows: DataFrame, key: str, top: int) -> DataFrame:
    """The ``top`` first names of each key."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy("name"))).where(F.col("__r") <= top).drop("__r")


def _by_letters(queries: DataFrame, known: DataFrame, top: int) -> DataFrame:
    """``no, query_id, name, score`` of ``queries(no, query_id, compact)`` that hold an alias, which waits at its first ``LETTERS``."""
    rows = _firsts(known.select("name", F.explode("sought").alias("alias")).distinct(), "alias", top).select("name", "alias", F.substring("alias", 1, LETTERS).alias("key"))
    rows = materialize(rows, "aliases")
    sizes = [r[0] for r in rows.select(F.length("key")).distinct().collect()]  # LETTERS numbers at most

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for no, compact in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys = list({compact[i : i + n] for n in sizes for i in range(len(compact) - n + 1)})
                for at in range(0, len(keys), 50_000):
                    some = keys[at : at + 50_000]
                    yield pa.record_batch([pa.array([no] * len(some), pa.int64()), pa.array(some, pa.string())], names=["no", "key"])

    # Keys are never broadcast: Spark takes them for as many as the texts that they are cut from.
    keys = queries.select("no", "compact").mapInArrow(cut, "no long, key string").hint("merge")
    met = keys.join(small(rows), "key").select("no", "alias", "name")
    return met.join(queries.select("no", "query_id", "compact").hint("merge"), "no").where(F.contains("compact", "alias")).select("no", "query_id", "name", F.lit(1.0).alias("score")).distinct()


def _by_terms(queries: DataFrame, known: DataFrame, top: int) -> DataFrame:
    """``no, query_id, name, score`` by the terms that ``queries(no, query_id, asked)`` and names share."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, terms in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                every = chain.from_iterable(combinations(sorted(terms), n) for n in (1, 2, 3))
                while some := list(islice(every, 10_000)):
                    yield pa.record_batch([pa.array([name] * len(some), pa.string()), pa.array([list(x) for x in some], pa.list_(pa.string()))], names=["name", "shared"])

    rows = _firsts(known.where("size(terms) > 0").select("name", "terms").mapInArrow(sets, "name string, shared array<string>"), "shared", top)
    # As above: a row for each term, and each with all of them, is far more than the table that it comes from.
    asked = queries.select("no", "query_id", F.explode("asked").alias("key"), "asked").hint("merge")
    # A set waits at its longest term, which is in fewer texts than a short one as a rule.
    key = F.element_at(F.array_sort("shared", lambda a, b: F.length(a) - F.length(b)), -1)
    met = asked.join(rows.withColumn("key", key), "key").where(F.size(F.array_intersect("shared", "asked")) == F.size("shared"))
    return met.select("no", "query_id", "name", F.least(F.lit(0.95), 0.55 + F.size("shared") * 0.15).alias("score"))


def entities(rows: DataFrame) -> DataFrame:
    return rows.groupBy("name").agg(F.sum("mentions").alias("mentions"), F.count_distinct("document_id").alias("documents"))


def pairs(rows: DataFrame, within: str) -> DataFrame:
    """Pairs of names that share a ``within``, from its set of names (``CANDIDATES`` for each text it has), so nothing is joined."""
    held = rows.groupBy(within).agg(F.array_sort(F.collect_set("name")).alias("names"))
    later = lambda i: F.slice("names", i + 2, F.greatest(F.size("names") - i - 1, F.lit(0)))
    both = F.flatten(F.transform("names", lambda x, i: F.transform(later(i), lambda y: F.struct(x.alias("subject"), y.alias("object")))))
    return held.select(within, F.explode(both).alias("p")).select(within, "p.*")


def touching(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """``chunk_id, subject, object, ends``: pairs in a chunk of which one or both are ``asked(name)``, a stated, broadcast few."""
    end = lambda c: asked.select(F.col("name").alias(c), F.lit(1).alias(f"{c}_hit"))
    p = pairs(rows.select("chunk_id", "name"), "chunk_id").join(end("subject"), "subject", "left").join(end("object"), "object", "left")
    return p.select("chunk_id", "subject", "object", (F.coalesce("subject_hit", F.lit(0)) + F.coalesce("object_hit", F.lit(0))).alias("ends")).where("ends > 0")


def relations(rows: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """Pairs of names that share a chunk, and in how many; with ``asked``, those that touch one of them alone."""
    p = pairs(rows.select("chunk_id", "name"), "chunk_id") if asked is None else touching(rows, asked)
    return p.groupBy("subject", "object").agg(F.count("*").alias("chunks")).withColumn("confidence", F.lit(CONFIDENCE))


def expand(related: DataFrame, asked: DataFrame) -> DataFrame:
    """Relations that touch an asked name, scored by confidence and matched ends."""
    end = lambda c: asked.select(F.col("name").alias(c), F.lit(1).alias(f"{c}_hit"))
    r = related.join(end("subject"), "subject", "left").join(end("object"), "object", "left")
    ends = F.coalesce("subject_hit", F.lit(0)) + F.coalesce("object_hit", F.lit(0))
    raw = ((0.72 + 0.18) * F.col("confidence") + F.when(ends == 2, 0.25).when(ends == 1, 0.08).otherwise(0.0)) * PREDICATE
    return r.where(ends > 0).withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(raw, F.lit(1.0))), 6)).select("subject", "object", "score")


def chunk_scores(rows: DataFrame, asked: DataFrame, expanded: DataFrame) -> DataFrame:
    """Best boost of every chunk: by an asked name in it, or by both ends of an expanded relation (of which one is asked)."""
    own = rows.join(asked, "name", "left_semi").select("chunk_id", F.lit(round((0.82 + 0.16) * CONFIDENCE, 6)).alias("score"))
    related = touching(rows, asked).join(small(expanded), ["subject", "object"]).select("chunk_id", "score")
    return own.unionByName(related).groupBy("chunk_id").agg(F.max("score").alias("score"))


def merge(base: DataFrame, graph: DataFrame, weight: float = 0.35) -> DataFrame:
    """Chunks of either side: the best of the base score, the blend and the graph score."""
    both = base.join(graph, "chunk_id", "full")
    blend = F.greatest("base", (1 - weight) * F.col("base") + weight * F.col("score"), "score")
    return both.withColumn("merged", F.round(F.when(F.col("base").isNull(), F.col("score")).when(F.col("score").isNull(), F.col("base")).otherwise(blend), 6))


def _sized(rows: DataFrame) -> DataFrame:
    """``document_id, name, df, first``: each document's names, with the number of documents that have it and the first of them."""
    d = rows.select("document_id", "name").distinct()
    return d.join(d.groupBy("name").agg(F.count("*").alias("df"), F.min("document_id").alias("first")), "name")


def document_links(rows: DataFrame) -> DataFrame:
    """Documents that share names: ``left_id, right_id, shared, strength`` (Jaccard), both counted on all names of either.

    A name in at most ``PAIRED`` documents pairs all of them; a more common one pairs each with its
    first document. Pairs of documents that share common names alone are left to ``common_names``,
    whose memberships hold every link that isn't a pair here.
    """
    sized = _sized(rows)
    rare = lambda c: sized.where(F.col("df") <= PAIRED).select(F.col("document_id").alias(c), "name")
    p = rare("left_id").join(rare("right_id"), "name").where("left_id < right_id").select("left_id", "right_id")
    hub = sized.where((F.col("df") > PAIRED) & (F.col("document_id") > F.col("first"))).select(F.col("first").alias("left_id"), F.col("document_id").alias("right_id"))
    p = p.unionByName(hub).distinct()
    own = rows.groupBy("document_id").agg(F.collect_set("name").alias("names"))  # a few names for each of a document's texts
    side = lambda c: own.select(F.col("document_id").alias(f"{c}_id"), F.col("names").alias(c))
    p = p.join(side("left"), "left_id").join(side("right"), "right_id")
    shared = F.size(F.array_intersect("left", "right"))
    return p.select("left_id", "right_id", shared.cast("long").alias("shared"), F.round(shared / (F.size("left") + F.size("right") - shared), 4).alias("strength"))


def common_names(rows: DataFrame) -> DataFrame:
    """``name, document_id, df``: members of each name in more than ``PAIRED`` documents; any two of a name are linked by it."""
    return _sized(rows).where(F.col("df") > PAIRED).select("name", "document_id", "df")
