"""Shared pieces: word patterns, table reading, written stage cuts, salted cells of large groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.session import work_path

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"
#: Shards grow in number with the input; beyond this many, several go through one partition one after the other.
MOST_PARTITIONS = 32_768


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def documents(df: DataFrame, *columns: str) -> DataFrame:
    """``doc_id`` and the named string columns alone, so that extra columns can never clash."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in columns])


def written(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage with a Parquet table in the shared folder and read it back."""
    path = work_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def block_of(member: str) -> Column:
    """A row's own block of the ``blocks`` of its group."""
    return F.pmod(F.xxhash64(member, F.lit(17)), F.col("blocks")).cast("int")


def cells(rows: DataFrame, sizes: DataFrame, key: str, member: str, block: int, asking: str | None = None) -> DataFrame:
    """Give each row of a group its cells, so that any two rows of the group share at least one cell.

    A group of at most ``block`` rows is one cell. A larger one is cut into blocks by a hash of ``member``, and each
    row goes to the cells of its block with every block, so one task never holds more than about two blocks. ``sizes``
    has ``key`` and ``n_rows``. Adds ``cell_a`` <= ``cell_b`` and ``part``, the row's own block. With ``asking``, a boolean column, only rows where it
    is true have to meet all others: the other rows go to the cells of blocks that hold such a row.
    """
    blocks = F.ceil(F.col("n_rows") / F.lit(float(block))).cast("int")
    dealt = rows.join(sizes, key).withColumn("blocks", blocks).withColumn("part", block_of(member))
    everywhere = F.sequence(F.lit(0), F.col("blocks") - 1)
    if asking is not None:
        wanted = dealt.where(asking).groupBy(key).agg(F.collect_set("part").alias("asked"))
        dealt = dealt.join(wanted, key)
        everywhere = F.when(F.array_contains("asked", F.col("part")), everywhere).otherwise(F.col("asked"))
    return (
        dealt.withColumn("other", F.explode(everywhere))
        .withColumn("cell_a", F.least("part", "other"))
        .withColumn("cell_b", F.greatest("part", "other"))
        .drop("n_rows", "blocks", "other", "asked")
    )
