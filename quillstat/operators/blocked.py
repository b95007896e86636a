"""Running values along long sequences, in two passes over range partitions.

A sequence (one conversation, one document, one table) may hold a large share of all rows, at positions of any distance. Rows are range-partitioned on
(sequence, position), so a hot sequence fills several partitions and small ones share one. The first pass reduces every partition to one row, what its last
sequence leaves behind; these rows are folded in order; the second pass starts each partition's first sequence with what was carried to it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillstat.session import stored


def _ranged(df: DataFrame, by: list[str], position: str, partitions: int | None) -> DataFrame:
    """Rows with ``_part``, the number of their range partition; stored, because the bounds are sampled."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(df.repartitionByRange(n, *by, position).withColumn("_part", F.spark_partition_id()), "ranged")


def _carried(ends: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(_part, _group, values…): what a partition's sequence ``_group`` takes over from the partitions before. ``ends`` has one row per partition, with its last
    sequence as ``_group``; a value folds the ends of one sequence in order (``values`` are expressions over the window of these rows)."""
    folded = ends.withColumns(values).withColumn("_next", F.lead("_part").over(W.partitionBy(F.lit(0)).orderBy("_part")))
    return folded.filter(F.col("_next").isNotNull()).select(F.col("_next").alias("_part"), "_group", *values)


def _ends():
    return W.partitionBy("_group").orderBy("_part")


def _entering(rows: DataFrame, carried: DataFrame, by: list[str]) -> DataFrame:
    """Rows with the values carried to their sequence; ``carried`` has one row per partition."""
    c = carried.withColumnRenamed("_part", "_to")
    same = (F.col("_part") == F.col("_to")) & F.struct(*by).eqNullSafe(F.col("_group"))
    return rows.join(F.broadcast(c), same, "left").drop("_to", "_group")


def carry_forward(df: DataFrame, by: list[str], position: str, columns: list[str], partitions: int | None = None,
                  suffix: str = "", before: bool = False) -> DataFrame:
    """Fill nulls of each column with the last value at or before the position (with ``before``: strictly before)."""
    rows = _ranged(df, by, position, partitions)
    sequence = F.struct(*[F.col(b) for b in by])
    known = {c: F.struct(*[F.col(b).alias(f"b{i}") for i, b in enumerate(by)], F.col(position).alias("at"), F.col(c).alias("value")) for c in columns}
    ends = rows.groupBy("_part").agg(F.max(sequence).alias("_group"), *[F.max(F.when(F.col(c).isNotNull(), known[c])).alias(f"_k_{c}") for c in columns])
    own = {c: F.when(F.struct(*[F.col(f"_k_{c}.b{i}") for i in range(len(by))]).eqNullSafe(F.col("_group")), F.col(f"_k_{c}.value")) for c in columns}
    ends = ends.select("_part", "_group", *[own[c].alias(f"_l_{c}") for c in columns])
    carried = _carried(ends, {f"_c_{c}": F.last(f"_l_{c}", ignorenulls=True).over(_ends()) for c in columns})
    inside = W.partitionBy("_part", *by).orderBy(position).rowsBetween(W.unboundedPreceding, -1 if before else 0)
    out = _entering(rows, carried, by)
    filled = {c + suffix: F.coalesce(F.last(c, ignorenulls=True).over(inside), F.col(f"_c_{c}")) for c in columns}
    return out.withColumns(filled).drop("_part", *[f"_c_{c}" for c in columns])


def running_sum(df: DataFrame, by: list[str], position: str, value: Column, name: str, partitions: int | None = None) -> DataFrame:
    """Inclusive running sum along the positions of each group."""
    rows = _ranged(df.withColumn("_v", value), by, position, partitions)
    sums = rows.groupBy("_part", *by).agg(F.sum("_v").alias("_s"))
    ends = sums.groupBy("_part").agg(F.max(F.struct(F.struct(*by).alias("g"), F.col("_s").alias("s"))).alias("_e")).select("_part", F.col("_e.g").alias("_group"), F.col("_e.s").alias("_s"))
    carried = _carried(ends, {"_off": F.sum("_s").over(_ends())})
    inside = W.partitionBy("_part", *by).orderBy(position).rowsBetween(W.unboundedPreceding, 0)
    total = F.coalesce(F.col("_off"), F.lit(0)) + F.sum("_v").over(inside)
    return _entering(rows, carried, by).withColumn(name, total).drop("_part", "_v", "_off")
