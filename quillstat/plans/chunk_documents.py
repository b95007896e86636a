"""Notes → cleaned, labelled, numbered chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.functions.expr import settled
from quillstat.functions.textclean import base_name, clean_all, note_metadata
from quillstat.operators import chunking
from quillstat.operators.filters import min_token_filter
from quillstat.session import spread, stored


def chunk_documents(notes: DataFrame, names: DataFrame, aliases: DataFrame, minimum: int = 100, maximum: int = 512,
                    floor: int = 50, number: bool = True, **options) -> DataFrame:
    """``notes`` has (file_name, text). Chunks of at least ``floor`` tokens with their document metadata.

    Every note is cleaned and cut once; the chunks are stored before the company lookup and the numbering
    read them.
    """
    docs = settled(spread(notes.select("file_name", "text"), "file_name"), text=clean_all(F.col("text"))).filter(F.col("text") != "")
    docs = settled(docs, h=chunking.heading_parts(F.col("text")))
    pieces = stored(min_token_filter(chunking.chunks(docs, "file_name", "text", minimum, maximum, keep=["h"], **options), floor), "chunks")
    headings = pieces.select("file_name", "h.named", "h.code", "h.before_colon", base_name(F.col("file_name")).alias("_file")).distinct()
    company = chunking.lookup_company(headings, "file_name", names, aliases)
    order = ["file_name", "section_no", "part"]
    rows = chunking.number_chunks(pieces, order, company, "file_name") if number else pieces.join(company, "file_name")
    return rows.withColumn("_m", note_metadata(F.col("file_name"))).select(
        F.col("file_name").alias("source_file"), "section_no", "part", "section", "text", "token_count", "company", "stock_code",
        F.col("_m.year").alias("year"), F.col("_m.period").alias("period"), F.col("_m.report_type").alias("report_type"),
        *(["chunk_index"] if number else []))
