"""Incremental loading of filing rows with upsert semantics.

Every micro-batch is written to its own epoch folder (a repeated batch overwrites itself, so recovery is
exact) and costs only its own rows. Readers see the newest row per key; ``compact`` folds the epochs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.operators.windows import all_columns, first_rows

KEYS = ["stock_code", "report_year", "report_period"]


def incremental_load(spark: SparkSession, source: str, target: str, schema: str, keys: list[str] | None = None, fmt: str = "json",
                     order: str | None = None, max_files: int | None = None) -> None:
    """Read the directory as a stream and upsert what is new."""
    keys = keys or KEYS
    reader = spark.readStream.schema(schema).format(fmt)
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader

    def upsert_batch(batch: DataFrame, epoch: int) -> None:
        latest = first_rows(batch, keys, [*([F.col(order).desc()] if order else []), *all_columns(batch)])
        latest.write.mode("overwrite").parquet(f"{target}/rows/epoch={epoch}")

    query = (reader.load(source).writeStream.foreachBatch(upsert_batch).option("checkpointLocation", f"{target}/_stream")
             .trigger(availableNow=True).start())
    query.awaitTermination()


def current_rows(spark: SparkSession, target: str, keys: list[str] | None = None, order: str | None = None) -> DataFrame:
    """The newest row per key: by ``order`` when given, else by epoch."""
    rows = spark.read.option("basePath", f"{target}/rows").parquet(f"{target}/rows")
    by = [F.col(order).desc()] if order else []
    return first_rows(rows, keys or KEYS, [*by, F.col("epoch").desc(), *all_columns(rows)]).drop("epoch")


def compact(spark: SparkSession, target: str, into: str, keys: list[str] | None = None, order: str | None = None) -> None:
    """Write the current rows as one epoch of a new table folder."""
    current_rows(spark, target, keys, order).write.mode("overwrite").parquet(f"{into}/rows/epoch=0")
