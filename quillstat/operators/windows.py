"""Ranking and ordered-row operators.

Every "first row of a group" below is a ``row_number`` filtered to a small constant. Spark plans a group
limit before the shuffle for that shape, so a hot key sends at most that many rows per task. Ranks
without a limit use :func:`numbered`, which range-partitions instead of sorting a group in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import MapType, VariantType

from quillstat.keys import KEYS, PREFER_CUMULATIVE, PREFER_HALF_YEAR, EntityKeys, period_ordinal, period_priority
from quillstat.operators.filters import present_count, row_is_sane
from quillstat.session import durable


def first_rows(df: DataFrame, by: list[str], order: list[Column], n: int = 1, number: str | None = None) -> DataFrame:
    """The first ``n`` rows of each group in the given order."""
    rn = number or "_rn"
    out = df.withColumn(rn, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(rn) <= n)
    return out if number else out.drop(rn)


def numbered(df: DataFrame, order: list[Column], name: str = "position", by: list[str] | None = None,
             partitions: int | None = None) -> DataFrame:
    """Exact 1-based position of every row in a total order, without a single-task sort.

    Rows are range-partitioned on (group, order keys), so neither a hot group nor many ties end in one
    task; positions are the offset in the partition plus the sizes of the partitions before it. The
    sorted rows are checkpointed because the boundaries are sampled. ``order`` must be a total order.
    """
    spark = df.sparkSession
    by = by or []
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(b) for b in by] + order
    marked = durable(
        df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    )
    pid = F.shiftrightunsigned("_id", 33)
    sizes = marked.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    # one row per partition: the window sees as many rows as there are partitions
    offsets = sizes.select(
        "_pid",
        F.coalesce(F.sum("_n").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_off"),
    )
    ranked = (
        marked.withColumn("_pid", pid).join(F.broadcast(offsets), "_pid")
        .withColumn("_pos", F.col("_off") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
        .drop("_id", "_pid", "_off")
    )
    if not by:
        return ranked.withColumnRenamed("_pos", name)
    starts = ranked.groupBy(*by).agg(F.min("_pos").alias("_first"))
    return (
        ranked.join(starts, by).withColumn(name, F.col("_pos") - F.col("_first") + 1).drop("_pos", "_first")
    )


def rank(df: DataFrame, field: str, top_k: int | None = None, ascending: bool = False, by: list[str] | None = None,
         tie: list[str] | None = None, keys: EntityKeys = KEYS) -> DataFrame:
    """Positional rank 1..n of the rows with a value; ties are broken by the key columns."""
    tie = tie if tie is not None else [k for k in keys.row if k not in (by or [])]
    order = [F.col(field).asc() if ascending else F.col(field).desc(), *[F.col(t) for t in tie]]
    valid = df.filter(F.col(field).isNotNull())
    if top_k is None:
        return numbered(valid, order, "rank", by)
    if by:
        return first_rows(valid, by, order, top_k, "rank")
    # the limit leaves top_k rows, so the unpartitioned window is bounded by the parameter
    return valid.orderBy(*order).limit(top_k).withColumn("rank", F.row_number().over(W.orderBy(*order)))


def all_columns(df: DataFrame) -> list[Column]:
    """A last tie-break: every column that has an order, so equal keys give the same row in every run."""
    return [F.col(f"`{f.name}`") for f in df.schema.fields if not isinstance(f.dataType, (MapType, VariantType))]


def dedupe_by_table_priority(df: DataFrame, priority: str, metrics: list[str], keys: EntityKeys = KEYS) -> DataFrame:
    """One row per key from the best table that has any of the metrics."""
    present = F.coalesce(*[F.col(m).cast("string") for m in metrics]).isNotNull()
    return first_rows(df.filter(present), keys.row, [F.col(priority), *all_columns(df)])


def best_period_per_entity(df: DataFrame, metrics: list[str], preferred: list[str] | None = None,
                           keys: EntityKeys = KEYS) -> DataFrame:
    """One row per entity: sane before implausible, then period preference, then most values present."""
    order = [
        row_is_sane(df).desc(),
        period_priority(keys.period, preferred or PREFER_HALF_YEAR).desc(),
        present_count(metrics).desc(),
        F.col(keys.year).desc(),
        *all_columns(df),
    ]
    return first_rows(df, [keys.code], order)


def best_period_per_year(df: DataFrame, metric: str, preferred: list[str] | None = None,
                         keys: EntityKeys = KEYS) -> DataFrame:
    """One row per entity and year by period preference, with a note when it is not the annual one."""
    best = first_rows(df.filter(F.col(metric).isNotNull()), [keys.code, keys.year],
                      [period_priority(keys.period, preferred or PREFER_CUMULATIVE).desc(), *all_columns(df)])
    note = F.when(F.col(keys.period) != "FY",
                  F.concat(F.lit("no annual figure, "), F.col(keys.period), F.lit(" used")))
    return best.withColumn("note", note)


def period_fallback(df: DataFrame, requested: DataFrame, year: int, metric: str, preferred: list[str] | None = None,
                    keys: EntityKeys = KEYS) -> DataFrame:
    """First available period per requested entity in a year; a no-data row when there is none."""
    found = best_period_per_year(df.filter(F.col(keys.year) == year), metric, preferred, keys)
    out = requested.select(keys.code).distinct().join(
        found.select(keys.code, keys.name, keys.period, metric, "note"), keys.code, "left")
    return (
        out.withColumn(keys.year, F.lit(year))
        .withColumn("no_data", F.col(keys.period).isNull())
        .withColumn("note", F.when(F.col("no_data"), F.lit("no data")).otherwise(F.col("note")))
    )


def latest_per_entity(df: DataFrame, keys: EntityKeys = KEYS) -> DataFrame:
    return first_rows(df, [keys.code], [F.col(keys.year).desc(), period_ordinal(keys.period).desc(), *all_columns(df)])


def recent_n(df: DataFrame, n: int, keys: EntityKeys = KEYS) -> DataFrame:
    """The newest ``n`` rows of each entity."""
    return first_rows(df, [keys.code], [F.col(keys.year).desc(), period_ordinal(keys.period).desc(), *all_columns(df)], n)


def first_row_per_year(df: DataFrame, keys: EntityKeys = KEYS) -> DataFrame:
    """The newest row of each entity and year."""
    return first_rows(df, [keys.code, keys.year], [period_ordinal(keys.period).desc(), *all_columns(df)])


def change_pct(current: Column, previous: Column, digits: int | None = 4) -> Column:
    """(cur − prev) / |prev| × 100; null without a non-zero base."""
    pct = F.try_divide(current.cast("double") - previous.cast("double"), F.abs(previous.cast("double"))) * 100
    return F.round(pct, digits) if digits is not None else pct


def yoy(df: DataFrame, metric: str, digits: int | None = 4, keys: EntityKeys = KEYS) -> DataFrame:
    """Change against the same period of the year before; the window holds one row per year."""
    w = W.partitionBy(keys.code, keys.period).orderBy(keys.year)
    prev_year = F.lag(keys.year).over(w)
    prev = F.when(prev_year == F.col(keys.year) - 1, F.lag(metric).over(w))
    return df.withColumn(f"{metric}_yoy", change_pct(F.col(metric), prev, digits))


def qoq(df: DataFrame, metric: str, digits: int | None = 4, keys: EntityKeys = KEYS) -> DataFrame:
    """Change against the period before, when that period is present."""
    w = W.partitionBy(keys.code).orderBy("_t")
    t = F.col(keys.year) * 4 + period_ordinal(keys.period)
    prev = F.when(F.lag("_t").over(w) == F.col("_t") - 1, F.lag(metric).over(w))
    return df.withColumn("_t", t).withColumn(f"{metric}_qoq", change_pct(F.col(metric), prev, digits)).drop("_t")


def cagr(df: DataFrame, metric: str, digits: int | None = 4, keys: EntityKeys = KEYS) -> DataFrame:
    """Compound annual growth between the first and last year with a value, per entity."""
    ends = df.filter(F.col(metric).isNotNull()).groupBy(keys.code).agg(
        F.min(keys.year).alias("start_year"), F.max(keys.year).alias("end_year"),
        F.min_by(metric, keys.year).alias("start_value"), F.max_by(metric, keys.year).alias("end_value"))
    a, b = F.col("start_value").cast("double"), F.col("end_value").cast("double")
    years = F.col("end_year") - F.col("start_year")
    growth = F.when((a > 0) & (b > 0) & (years > 0), (F.pow(b / a, F.lit(1.0) / years) - 1) * 100)
    return ends.withColumn("cagr", F.round(growth, digits) if digits is not None else growth)
