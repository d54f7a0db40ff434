"""Where rows come from: file trees, object stores and shares by Hadoop path, SQL databases, sitemaps."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Known extensions, those that may be binary, folders never entered, the size limit.
EXTENSIONS = ["md", "txt", "csv", "html", "htm", "json", "xml", "eml", "epub", "pdf", "docx", "pptx", "xlsx"]
BINARY = ["pdf", "docx", "pptx", "xlsx", "epub"]
EXCLUDED = [".git", "node_modules", "__pycache__", ".venv"]
MAX_BYTES = 10 * 1024 * 1024
_MUTATING = re.compile(r"\b(insert|update|delete|drop|alter|create|truncate|grant|merge|call)\b", re.I)


def skip_reason(path: Column, length: Column, content: Column, max_bytes: int = MAX_BYTES) -> Column:
    """The first reason to skip a file, or null."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    excluded = path.rlike("/(" + "|".join(map(re.escape, EXCLUDED)) + ")/")
    nul = F.position(F.lit("00"), F.hex(F.substring(content, 1, 8192))) % 2 == 1
    return F.when(excluded, "excluded").when(~extension.isin(EXTENSIONS), "unsupported_extension").when(length > max_bytes, "file_too_large").when(nul & ~extension.isin(BINARY), "binary_file")


def scan(spark: SparkSession, root: str, glob: str = "*", max_bytes: int = MAX_BYTES) -> DataFrame:
    """``path, modificationTime, length, content, skip_reason`` of a tree on any Hadoop file system (file, s3a, gs, abfss)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return files.withColumn("skip_reason", skip_reason(F.col("path"), F.col("length"), F.col("content"), max_bytes))


def snapshot(files: DataFrame) -> DataFrame:
    """What change detection compares: path and a digest of time and size, without reading content."""
    return files.select("path", F.sha2(F.concat_ws("|", F.col("modificationTime").cast("string"), "length"), 256).alias("snapshot"))


def guarded(sql: str) -> str:
    """A single read-only statement, or ValueError."""
    one = sql.strip().rstrip(";")
    if ";" in one or not re.match(r"(?i)(select|with)\b", one) or _MUTATING.search(one):
        raise ValueError("only one SELECT or WITH statement is read")
    return one


def database(spark: SparkSession, url: str, sql: str, max_rows: int, **options: str) -> DataFrame:
    """Rows of a guarded query by JDBC; one more than the limit is read, so a caller sees whether it cuts."""
    return spark.read.format("jdbc").options(url=url, query=guarded(sql), **options).load().limit(max_rows + 1)


def sitemap_urls(pages: DataFrame, xml: str = "xml") -> DataFrame:
    return pages.select(F.explode(F.xpath(xml, F.lit("//*[local-name()='loc']/text()"))).alias("url")).select(F.trim("url").alias("url"))
