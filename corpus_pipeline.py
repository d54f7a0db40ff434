"""A corpus pipeline of five stages: each takes the documents its predecessor kept.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns
a DataFrame, which ``run`` writes as Parquet in the shared folder and rereads for the next
stage. All but the last return the columns of ``documents``, with any others that came along.

Every stage decides by the text and, where it must, the id of a row, so rows of a repeated or
null id are judged one by one: equal rows share their fate in all stages but near_duplicates,
which keeps one of them. A null or empty text has no language and goes in the first stage;
later stages take it as having no words. An empty table stays empty. Columns named like the
operators' own do no harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corpusmill.llm.decontaminate import decontaminate
from corpusmill.llm.language_id import fit, held_out, identify
from corpusmill.llm.minhash_dedup import minhash_dedup
from corpusmill.llm.mixing import mix
from corpusmill.llm.packing import pack
from corpusmill.llm.scratch import clear, mark, materialize, small, spread

#: A text whose leading language covers less than this share of its words has no language; nor
#: has one of a lesser margin. On held-out clean texts of sf0.1 the least share was 0.60 and the
#: least margin 1.42; random letters had 0.43 at most, four languages in equal blocks a median share of 0.25.
LEAST_SHARE, LEAST_MARGIN = 0.5, 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has no letters, is in no learned language, or has no language on half of its words, go; with no labelled text at all nothing is learned and all go."""
    # A prediction hangs on the text alone, so texts to drop are named by their hash.
    key = F.xxhash64(F.col("text").cast("string"))
    seen = identify(docs.select(key.alias("doc_id"), "text"), fit(docs.where(~held_out(F.col("doc_id"), 5, 0))))
    bad = seen.where((F.col("lang_pred") == "und") | (F.col("score") < LEAST_SHARE) | (F.col("margin") < LEAST_MARGIN))
    gone = materialize(bad.select(F.col("doc_id").alias("__gone")).distinct(), "bad")
    return docs.join(small(gone), key == F.col("__gone"), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group stays: that of the smallest id (a null one comes last). Texts without words are no duplicates."""
    # Ids may repeat or be null, so rows get numbers; the written table keeps them, whatever happens to a task that reads it.
    rows = materialize(docs.withColumns({"__row": F.monotonically_increasing_id(), "__hash": F.xxhash64("text")}), "rows")
    found = minhash_dedup(rows, "__row").select(F.col("doc_id").alias("__row"), "component_id")
    named = materialize(found.join(rows.select("__row", "__hash", "doc_id"), "__row"), "named")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "__hash", "__row")
    stays = named.groupBy("component_id").agg(F.min(first)["__row"].alias("stays"), F.count("*").alias("n")).where("n > 1").select("component_id", "stays")
    gone = materialize(named.join(stays, "component_id").where("__row <> stays").select(F.col("__row").alias("gone_row")), "gone")
    return rows.join(small(gone), F.col("__row") == F.col("gone_row"), "left_anti").drop("__row", "__hash")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has a benchmark window go; a text without words stays."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Junk and toxic text is thinned to its target share beside the clean text, which stays; with no labels every domain is as likely."""
    return mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in rows of equal width; a text without words is its end token."""
    return pack(docs)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("packing", packing)]

#: Language models, circulant MinHash and the tokenizer are not SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; a stage's intermediate tables are deleted once its output is written."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    for name, stage in STAGES:
        since = mark()
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        clear(spark, since, keep=1)
    return docs
