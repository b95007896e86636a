"""Sorts, limits and set operations on rankings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.keys import KEYS, EntityKeys, period_ordinal
from quillstat.operators.windows import rank


def top_n(df: DataFrame, metric: str, n: int = 10, tie: list[str] | None = None, keys: EntityKeys = KEYS) -> DataFrame:
    """The n largest values; planned as a distributed take-ordered."""
    return df.filter(F.col(metric).isNotNull()).orderBy(F.col(metric).desc(), *(tie or keys.row)).limit(n)


def trend_order(df: DataFrame, keys: EntityKeys = KEYS) -> DataFrame:
    return df.orderBy(keys.code, keys.year, period_ordinal(keys.period))


def newest_first(df: DataFrame, keys: EntityKeys = KEYS) -> DataFrame:
    return df.orderBy(F.col(keys.year).desc(), period_ordinal(keys.period).desc(), keys.code)


def severity_ordinal(severity: Column) -> Column:
    return F.when(severity == "high", 0).when(severity == "mid", 1).when(severity == "low", 2).otherwise(3)


def most_common(df: DataFrame, column: str, n: int) -> DataFrame:
    """The n most frequent values; ties by value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), column).limit(n)


def union_tables(tables: list[tuple[int, DataFrame]]) -> DataFrame:
    """Distinct union of the same projection over candidate tables, tagged with their priority."""
    parts = [df.withColumn("table_priority", F.lit(p)) for p, df in tables]
    return reduce(lambda a, b: a.unionByName(b), parts).distinct()


def intersect_top_n(df: DataFrame, fields: list[str], n: int, keys: EntityKeys = KEYS,
                    by: list[str] | None = None) -> DataFrame:
    """Entities in the top n of every field, with their rank in each.

    Each ranking leaves at most n rows (per group of ``by``), so the joins are small whatever the input.
    """
    by = by or []
    ranked = [
        rank(df, f, n, by=by or None, tie=[k for k in keys.row if k not in by])
        .select(*by, keys.code, keys.name, f, F.col("rank").alias(f"{f}_rank"))
        for f in fields
    ]
    out = ranked[0]
    for r in ranked[1:]:
        out = out.join(r.drop(keys.name), [*by, keys.code])
    return out

