"""Text sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _whole_files(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", suffix).option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file_name"), "path", "length", F.col("content").cast("string").alias("_text"))


def read_documents(spark: SparkSession, path: str, suffix: str = "*.md") -> DataFrame:
    """(file_name, text) with one whole file per row; undecodable bytes become replacement characters, ``broken_documents`` lists their
    files. An empty file has no row."""
    return _whole_files(spark, path, suffix).select("file_name", F.make_valid_utf8("_text").alias("text"))


def broken_documents(spark: SparkSession, path: str, suffix: str = "*.md") -> DataFrame:
    """(file_name, length, n_replaced): files whose bytes aren't UTF-8 throughout, with the number of replacement characters in their text."""
    bad = _whole_files(spark, path, suffix).filter(~F.is_valid_utf8("_text"))
    return bad.select("file_name", "length", F.regexp_count(F.make_valid_utf8("_text"), F.lit("\ufffd")).cast("long").alias("n_replaced"))


def write_chunks(chunks: DataFrame, all_files: DataFrame, path: str, minimum: int = 50) -> None:
    """Chunks as Parquet plus one meta row (files, ok, chunks, tokens, limit)."""
    from quillstat.operators.chunking import corpus_summary

    chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    stored = chunks.sparkSession.read.parquet(f"{path}/chunks")
    meta = corpus_summary(all_files, stored).withColumn("min_tokens", F.lit(minimum))
    meta.write.mode("overwrite").json(f"{path}/meta")


def read_annotations(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines of annotations."""
    return spark.read.schema(schema).json(path)


def question_blocks(blocks: DataFrame, column: str = "value") -> DataFrame:
    """Blocks cut at ``---`` → the first question line of each, without multi-turn marks."""
    line = F.regexp_extract(F.col(column), r"(?m)^[^\S\n]*问题[：:](.*)$", 1)
    question = F.trim(F.regexp_replace(line, r"\(多轮.*?\)", ""))
    return blocks.withColumn("question", question).filter(F.col("question") != "")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Questions cut out of a text delimited by ``---``."""
    return question_blocks(spark.read.option("lineSep", "---").text(path)).select("question")


def list_filings(spark: SparkSession, path: str, summary_word: str = "摘要", summary_bytes: int = 200 * 1024) -> DataFrame:
    """Recursive listing (path, name, size, exchange, kind); only names and lengths are read, never contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return classify_listing(files, summary_word, summary_bytes)


def classify_listing(files: DataFrame, summary_word: str = "摘要", summary_bytes: int = 200 * 1024) -> DataFrame:
    """Exchange from the folder name; ``summary`` by name or small size."""
    # Folder names of the exchanges.
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    exchange = F.when(F.col("path").contains("上交所"), "SSE").when(F.col("path").contains("深交所"), "SZSE")
    kind = F.when(name.contains(summary_word) | (F.col("length") < summary_bytes), "summary").otherwise("full")
    return files.select("path", name.alias("name"), "length", exchange.alias("exchange"), kind.alias("kind"))
