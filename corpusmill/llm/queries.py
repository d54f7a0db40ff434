"""One query for each operator of this folder, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import fill_middle, passage_quality, toxicity, warc
from .chat_format import digests, format_conversations
from .conversation_repair import damage, repairs
from .decontaminate import contamination
from .language_id import identify_documents
from .minhash_dedup import minhash_dedup
from .mixing import mixing_rates
from .packing import pack
from .quality_rules import quality_rules
from .scratch import fresh_path, spread
from .suffix_tree import score_documents


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_table(spark, sf_dir, "documents"))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return digests(format_conversations(turns))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_documents(_documents(spark, sf_dir))


def op3_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_documents(spark, sf_dir))


def op4_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_quality.score_documents(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_documents(spark, sf_dir), _table(spark, sf_dir, "benchmark"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing_rates(_documents(spark, sf_dir), _table(spark, sf_dir, "labels"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup(_documents(spark, sf_dir))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_documents(spark, sf_dir))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(spark, "warc")
    warc.write_warc(spread(_table(spark, sf_dir, "pages")), path)
    return warc.page_records(warc.read_warc(spark, path))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.fill_in_middle(_documents(spark, sf_dir)))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repairs(damage(_table(spark, sf_dir, "conversations")), F.col("present"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from .sql import SQL

    return dict(SQL)
