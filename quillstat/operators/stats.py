"""Statistics, profiles and outliers.

Nothing here gathers a column in one task: counts and moments combine map-side, the exact median is read
off distributed positions, and per-column windows are replaced by joins with one row per column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.operators.windows import numbered


def exact_median(df: DataFrame, field: str, by: list[str]) -> DataFrame:
    """(by…, median) from the exact positions of the middle values."""
    v = df.select(*by, F.col(field).try_cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    # equal values collapse first, so ties cost nothing and the order is total
    counted = v.groupBy(*by, "_v").agg(F.count(F.lit(1)).alias("_c"))
    pos = numbered(counted, [F.col("_v")], "_p", by)
    return _weighted_median(pos, by)


def _weighted_median(pos: DataFrame, by: list[str]) -> DataFrame:
    """Median of counted values with their order positions, by running counts over blocks of positions."""
    from pyspark.sql import Window as W

    block = F.floor(F.col("_p") / 65536)
    rows = pos.withColumn("_b", block)
    sums = rows.groupBy(*by, "_b").agg(F.sum("_c").alias("_s"))
    before = sums.select(*by, "_b", F.coalesce(F.sum("_s").over(
        W.partitionBy(*by).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    total = sums.groupBy(*by).agg(F.sum("_s").alias("_n"))
    inside = F.sum("_c").over(W.partitionBy(*by, "_b").orderBy("_p").rowsBetween(W.unboundedPreceding, 0))
    joined = rows.join(before, [*by, "_b"]).withColumn("_hi", F.col("_before") + inside)
    joined = joined.join(total, by) if by else joined.withColumn("_k", F.lit(1)).join(
        F.broadcast(total.withColumn("_k", F.lit(1))), "_k")
    lo = F.floor((F.col("_n") + 1) / 2)
    hi = F.floor(F.col("_n") / 2) + 1
    covers_lo = (F.col("_hi") >= lo) & (F.col("_hi") - F.col("_c") < lo)
    covers_hi = (F.col("_hi") >= hi) & (F.col("_hi") - F.col("_c") < hi)
    picked = joined.filter(covers_lo | covers_hi)
    out = picked.groupBy(*by) if by else picked.groupBy()
    return out.agg(((F.min("_v") + F.max("_v")) / 2).alias("median"))


def group_stats(df: DataFrame, field: str, by: list[str] | None = None, digits: int | None = 4) -> DataFrame:
    """count, mean, exact median, min, max and population deviation of the numeric values."""
    by = by or []
    v = df.select(*by, F.col(field).try_cast("double").alias("_v"))
    base = (v.groupBy(*by) if by else v.groupBy()).agg(
        F.count("_v").alias("count"), F.avg("_v").alias("mean"), F.min("_v").alias("min"), F.max("_v").alias("max"),
        F.stddev_pop("_v").alias("std"))
    med = exact_median(df, field, by)
    if by:
        out = base.join(med, by, "left")
    else:
        out = base.withColumn("_k", F.lit(1)).join(F.broadcast(med.withColumn("_k", F.lit(1))), "_k", "left").drop("_k")
    if digits is None:
        return out
    return out.select(*by, "count", *[F.round(c, digits).alias(c) for c in ("mean", "median", "min", "max", "std")])


def melt(df: DataFrame, metrics: list[str], ids: list[str], field: str = "column", value: str = "value") -> DataFrame:
    """Wide → long with one double value per metric, without a shuffle."""
    wide = df.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(ids, metrics, field, value)


def profile_columns(df: DataFrame, metrics: list[str]) -> DataFrame:
    """Per column: rows, nulls, values, min, max, mean, and whether all are null."""
    return melt(df.withColumn("_row", F.lit(1)), metrics, ["_row"]).groupBy("column").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("value").isNull()).alias("n_null"),
        F.count("value").alias("n_value"), F.min("value").alias("min"), F.max("value").alias("max"),
        F.avg("value").alias("mean"), (F.count("value") == 0).alias("all_null"))


def mean_multiple_outliers(df: DataFrame, metrics: list[str], ids: list[str], factor: float = 10.0) -> DataFrame:
    """Values above ``factor`` × the mean of their column, when that mean is positive.

    The statistics are one row per column (bounded by the schema), so they are broadcast to the rows.
    """
    long = melt(df, metrics, ids)
    means = long.groupBy("column").agg(F.avg("value").alias("mean"))
    return long.join(F.broadcast(means), "column").filter(
        (F.col("mean") > 0) & (F.col("value") > F.col("mean") * factor)).select(*ids, "column", "value")


def three_sigma(df: DataFrame, metrics: list[str], ids: list[str], minimum: int = 10) -> DataFrame:
    """Values more than three population deviations from the mean of their column, with the z-score."""
    long = melt(df, metrics, ids).filter(F.col("value").isNotNull())
    stats = long.groupBy("column").agg(F.count("value").alias("_n"), F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    hit = (F.col("_n") >= minimum) & (F.col("_s") != 0) & (F.abs(F.col("value") - F.col("_m")) > F.col("_s") * 3)
    return long.join(F.broadcast(stats), "column").filter(hit).select(
        *ids, "column", "value", ((F.col("value") - F.col("_m")) / F.col("_s")).alias("z"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """All members of keys that occur more than once."""
    dup = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
    return df.join(dup.select(*keys), keys, "left_semi")


def duplicate_filings(df: DataFrame, keys: list[str], source: str, keep: int | None = None) -> DataFrame:
    """Keys loaded from more than one file, with the number of files and their names (with ``keep``: the smallest ones)."""
    from quillstat.operators.windows import first_rows

    per_file = df.groupBy(*keys, source).agg(F.count(F.lit(1)).alias("_n"))
    counts = per_file.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_files")).filter(F.col("n_files") > 1)
    named = per_file if keep is None else first_rows(per_file, keys, [F.col(source)], keep)
    names = named.groupBy(*keys).agg(
        F.concat_ws(",", F.sort_array(F.collect_list(source))).alias("files"))
    return counts.join(names, keys)
