"""Quality rules: cross-document line frequency per host, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.llm.common import SPACE, WORD, documents, written

#: Production limits: a line goes when more documents of its host hold it than both limits allow.
MAX_DOCS, MAX_SHARE = 20, 0.002
#: A document that loses at least this share of its words is depleted.
DEPLETED = 0.7


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    """Hash of a line in lower case with single spaces."""
    return F.xxhash64(F.lower(F.trim(F.regexp_replace(line, SPACE, " "))))


def text_measures(docs: DataFrame, source: str = "source") -> DataFrame:
    """Row-wise counts of whole texts: ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed``.

    A null text counts as empty. Repeated rows are measured each.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    d = documents(docs, "text", source).select(
        "doc_id", F.coalesce(F.col(source), F.lit("")).alias("host"), F.xxhash64(text).alias("content"), text.alias("text"))
    d = d.select(
        "doc_id", "host", "content", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.filter(_lines(F.col("text")), lambda x: x.rlike(WORD)).alias("lines"), F.regexp_count("text", F.lit(r"[#*$%&|<>]")).alias("n_symbols"))
    d = d.select(
        "doc_id", "host", "content", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.col("n_symbols").cast("long").alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") > 3, F.expr("transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2]))"))
        .otherwise(F.array().cast("array<bigint>")).alias("windows"))
    # Only texts with a repeated window are sorted: equal neighbours in (hash, place) order are the places found twice.
    places = F.expr("sort_array(transform(windows, (h, i) -> struct(h, i)))")
    d = d.withColumn("sorted", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), places))
    starts = F.expr(
        "sort_array(transform(filter(transform(sorted, (x, k) -> struct(x.i AS i, (k > 0 AND sorted[greatest(k - 1, 0)].h = x.h)"
        " OR (k < size(sorted) - 1 AND sorted[least(k + 1, size(sorted) - 1)].h = x.h) AS twice)), x -> x.twice), x -> x.i))")
    d = d.withColumn("starts", starts)
    # A place adds the words that the place before it doesn't cover.
    covered = F.expr("aggregate(transform(starts, (x, k) -> IF(k = 0, 3, least(3, x - starts[greatest(k - 1, 0)]))), 0L, (a, x) -> a + x)")
    d = d.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.select("doc_id", "host", "content", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"))


def host_lines(docs: DataFrame, source: str = "source") -> DataFrame:
    """One row per line that has a word: ``doc_id, row_id, host, content, place, line, line_words``; ``row_id`` numbers the rows without doc_id."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = documents(docs, "text", source).withColumn("row_id", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    d = d.select("doc_id", "row_id", F.coalesce(F.col(source), F.lit("")).alias("host"), F.xxhash64(text).alias("content"), F.posexplode(_lines(text)).alias("place", "row"))
    return d.where(F.col("row").rlike(WORD)).select(
        "doc_id", "row_id", "host", "content", "place", line_key(F.col("row")).alias("line"), F.regexp_count("row", F.lit(WORD)).cast("long").alias("line_words"))


def frequent_lines(lines: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """Lines (``host, line``) that more documents of the host hold than both limits allow.

    Rows with the same doc_id are one document, each row without one is a document. The counts are sums of partial counts, so a line that a third
    of all documents hold is never gathered in one task.
    """
    document = ["doc_id", "row_id"]
    hosts = lines.select("host", *document).distinct().groupBy("host").agg(F.count("*").alias("host_docs"))
    held = lines.select("host", "line", *document).distinct().groupBy("host", "line").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") > max_docs)
    return held.join(hosts, "host").where(F.col("n_docs") > max_share * F.col("host_docs")).select("host", "line")


def quality_rules(docs: DataFrame, max_docs: int = MAX_DOCS, max_share: float = MAX_SHARE, depleted: float = DEPLETED, source: str = "source") -> DataFrame:
    """Measures and verdict of every row of ``docs``: the columns of ``text_measures``, ``n_removed_words``, ``removed`` (keys of
    the lines that go) and ``kept``.

    A row is kept unless its base rules fail or the frequent lines of its host hold at least ``depleted`` of its words. A null
    text is empty and fails; a null host is the host ''. Repeated rows each get the same verdict; texts of any length are measured whole in
    their row; an empty table gives no rows.
    """
    lines = host_lines(docs, source)
    removed = (
        lines.join(frequent_lines(lines, max_docs, max_share), ["host", "line"]).drop("row_id").distinct()  # a repeated row's lines count once
        .groupBy(F.col("doc_id").alias("r_id"), F.col("host").alias("r_host"), F.col("content").alias("r_content"))
        .agg(F.sum("line_words").alias("n_removed_words"), F.collect_set("line").alias("removed")))
    base = text_measures(docs, source)
    d = base.join(removed, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("host") == F.col("r_host")) & (F.col("content") == F.col("r_content")), "left")
    d = d.withColumn("n_removed_words", F.coalesce("n_removed_words", F.lit(0).cast("long")))
    kept = ~F.col("base_failed") & (F.col("n_removed_words") < depleted * F.col("n_words"))
    return d.select(*base.columns, "n_removed_words", "removed", kept.alias("kept"))


def apply_quality_rules(docs: DataFrame, **limits) -> DataFrame:
    """The kept rows of ``docs``, all columns, without the lines that go. Rows with the same id, host and text share one verdict."""
    source = limits.get("source", "source")
    # Written first: a filter on the verdict would be pushed below the measures, which would copy them many times over.
    verdicts = written(quality_rules(docs, **limits).select("doc_id", "host", "content", "removed", "kept"), "verdicts").where("kept").select(
        F.col("doc_id").alias("_q_id"), F.col("host").alias("_q_host"), F.col("content").alias("_q_content"), F.col("removed").alias("_q_removed"))
    verdicts = verdicts.dropDuplicates(["_q_id", "_q_host", "_q_content"])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_q_id")) & (F.coalesce(F.col(source).cast("string"), F.lit("")) == F.col("_q_host")) & (F.xxhash64(text) == F.col("_q_content"))
    left = F.array_join(F.filter(_lines(text), lambda x: ~F.array_contains(F.col("_q_removed"), line_key(x)) | ~x.rlike(WORD)), "\n")
    joined = docs.join(verdicts, same)
    return joined.withColumn("text", F.when(F.col("_q_removed").isNull(), F.col("text")).otherwise(left)).select(*[F.col(f"`{c}`") for c in docs.columns])
