"""Statement tables: scan, catalogue, export, keyed upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.keys import KEYS, EntityKeys
from quillstat.operators.windows import all_columns, first_rows


def read_statements(spark: SparkSession, path: str, columns: list[str] | None = None, fmt: str = "parquet",
                    **options) -> DataFrame:
    """Scan a statement table (Parquet path, or JDBC with the caller's options) with a column list."""
    reader = spark.read.format(fmt).options(**options)
    df = reader.load(path) if fmt != "jdbc" else reader.load()
    return df.select(*columns) if columns else df


def write_statements(df: DataFrame, path: str, keys: EntityKeys = KEYS, mode: str = "overwrite") -> None:
    """Partitioned by year, the column nearly every request filters on."""
    df.write.mode(mode).partitionBy(keys.year).parquet(path)


def column_catalog(tables: dict[str, DataFrame], skip: list[str] | None = None, keys: EntityKeys = KEYS) -> DataFrame:
    """(table_name, column_name) of the metric columns; read from schemas, no data is scanned."""
    spark = next(iter(tables.values())).sparkSession
    skip = set(skip or keys.dims) | {"report_type", "unit_raw", "unit_std", "created_at", "serial_number"}
    pairs = [(t, c) for t, df in tables.items() for c in df.columns if c not in skip]
    return spark.createDataFrame(pairs, "table_name string, column_name string")


def export_table(df: DataFrame, prefix: str, path: str, fmt: str = "csv", column: str = "report_type") -> None:
    """Write the rows whose report type starts with a prefix."""
    out = df.filter(F.col(column).startswith(prefix)).write.mode("overwrite")
    if fmt == "csv":
        out = out.option("header", True)
    out.format(fmt).save(path)


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Insert or overwrite on a key; of several source rows with one key the first in ``order`` wins."""
    src = first_rows(source, keys, [*order, *all_columns(source)]) if order else source
    rows = src.withColumn("_new", F.lit(1)).unionByName(target.withColumn("_new", F.lit(0)), allowMissingColumns=True)
    return first_rows(rows, keys, [F.col("_new").desc(), *all_columns(rows)]).drop("_new")


def merge_facts(target: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    """Insert missing key rows and set every provided field; fields that are not provided stay."""
    new_cols = [c for c in wide.columns if c not in keys]
    joined = target.alias("t").join(wide.alias("s"), keys, "full")
    out = [*keys]
    for c in [*[c for c in target.columns if c not in keys], *[c for c in new_cols if c not in target.columns]]:
        sides = [F.col(f"s.{c}")] if c in new_cols else []
        sides += [F.col(f"t.{c}")] if c in target.columns else []
        out.append(F.coalesce(*sides).alias(c))
    return joined.select(*out)


def pivot_facts(facts: DataFrame, keys: list[str], fields: list[str], field: str = "field",
                value: str = "value") -> DataFrame:
    """Long facts → one wide row per key; the field list is given, so no extra pass finds it."""
    return facts.groupBy(*keys).agg(
        *[F.max(F.when(F.col(field) == f, F.col(value))).alias(f) for f in fields])


def replace_by_source(target: DataFrame, prefix: str, df: DataFrame, column: str = "report_type") -> DataFrame:
    """Drop the rows an earlier load wrote, then append the new ones."""
    keep = target.filter(~F.coalesce(F.col(column).startswith(prefix), F.lit(False)))
    return keep.unionByName(df, allowMissingColumns=True)


def distinct_entities(df: DataFrame, keys: EntityKeys = KEYS) -> DataFrame:
    return df.select(keys.code, keys.name).distinct()
