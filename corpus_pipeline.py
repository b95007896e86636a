"""Corpus pipeline: quality rules, line dedup, near-dedup, mixing and packing of ``documents``.

Every stage takes an empty table to an empty one, reads whole texts of any length and leaves the columns of ``documents`` (the last one its places). Null
texts fail the quality rules; the later stages keep rows without text, lang, source or doc_id unless they say otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm import linededup, mixing, neardup, packing, quality
from quillstat.llm.common import WORD, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
DOMAIN = "CASE WHEN source RLIKE '^src[0-9]$' THEN 'web' ELSE 'curated' END"
WEIGHTS = {"domain": {"web": 1, "curated": 1}, "lang": {"en": 4, "de": 1, "fr": 1, "es": 1}}


def _documents(df: DataFrame) -> DataFrame:
    """The columns of ``documents``, with the length of the text as it is now."""
    return df.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the frequent lines of their host; a null source is a host of its own. Repeated rows share a verdict."""
    return _documents(quality.apply_quality_rules(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that match an earlier line of the corpus; those left without a word go, null texts among them. Rows without doc_id stay whole."""
    return _documents(linededup.without_repeated_lines(docs).where(F.col("text").rlike(WORD)))


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates (five-word shingles, similarity 0.8): the one with the smallest doc_id. Rows without doc_id stay."""
    return _documents(neardup.deduplicated(docs, shingle=5, percent=80))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Nine tenths of the tokens, to the target weights as far as the sources reach; every document once at most. Null lang and source are leaves of
    their own."""
    return _documents(mixing.mixed(docs, DOMAIN, WEIGHTS, share=0.9, max_epochs=1, seed=3))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in the sequences; a null text is the separator alone, repeated rows are packed each."""
    return packing.pack_documents(docs, packing.vocabulary(), with_ids=False).drop("ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the signatures of the third stage or the packing of the fifth.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
