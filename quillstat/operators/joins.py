"""Joins between statements, requests and dictionaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillstat.functions import fixed
from quillstat.keys import KEYS, EntityKeys, period_ordinal
from quillstat.operators.windows import first_rows
from quillstat.session import broadcast_if_small


def owner_tables(metrics: list[str]) -> dict[str, str]:
    """Metric → owning table, the core table when the dictionary does not know it."""
    owner = {f: t for f, t, _, _ in fixed.FIELDS}
    return {m: owner.get(m, fixed.CORE_TABLE) for m in metrics}


def table_of_field(df: DataFrame, dictionary: DataFrame, field: str = "field") -> DataFrame:
    """Adds ``table_name`` from the dictionary, the core table as default."""
    d = dictionary.select(F.col("field").alias(field), F.col("table").alias("_t"))
    return df.join(broadcast_if_small(d), field, "left").withColumn(
        "table_name", F.coalesce("_t", F.lit(fixed.CORE_TABLE))).drop("_t")


def join_statements(tables: dict[str, DataFrame], metrics: list[str], owners: dict[str, str] | None = None,
                    keys: EntityKeys = KEYS) -> DataFrame:
    """Metrics from several statements in one row per key.

    A single table is used when it owns all metrics. Otherwise the table of the first metric leads: it
    gives the names, and only its first metric must be present.
    """
    owners = owners or owner_tables(metrics)
    by_table: dict[str, list[str]] = {}
    for m in metrics:
        by_table.setdefault(owners[m], []).append(m)
    if len(by_table) == 1:
        (name, cols), = by_table.items()
        present = F.coalesce(*[F.col(c).cast("string") for c in cols]).isNotNull()
        return tables[name].select(*keys.dims, *cols).filter(present)
    main = owners[metrics[0]]
    out = tables[main].select(*keys.dims, *by_table.pop(main)).filter(F.col(metrics[0]).isNotNull())
    for name, cols in by_table.items():
        out = out.join(tables[name].select(*keys.row, *cols), keys.row)
    return out.select(*keys.dims, *metrics)


def union_rows(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def merge_statements(frames: list[DataFrame], keys: EntityKeys = KEYS) -> DataFrame:
    """One row per key with the union of all metrics; the first frame with a value wins."""
    tagged = [f.withColumn("_src", F.lit(i)) for i, f in enumerate(frames)]
    rows = union_rows(tagged)
    metrics = [c for c in rows.columns if c not in (*keys.dims, "_src")]
    firsts = [F.min_by(F.col(m), F.when(F.col(m).isNotNull(), F.col("_src"))).alias(m) for m in [keys.name, *metrics]]
    return rows.groupBy(*keys.row).agg(*firsts)


def with_missing_entities(result: DataFrame, requested: DataFrame, keys: EntityKeys = KEYS) -> DataFrame:
    """Requested entities without any row appear once, flagged."""
    return requested.select(keys.code).distinct().join(result, keys.code, "left").withColumn(
        "no_data", F.col(keys.year).isNull())


def missing_members(requested: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    return requested.select(*on).distinct().join(found.select(*on).distinct(), on, "left_anti")


def resolve_metric(requests: DataFrame, catalog: DataFrame, owners: DataFrame, substitutes: DataFrame,
                   metric: str = "metric") -> DataFrame:
    """Metric → (field, table_name, substituted).

    The owning table of the dictionary comes first, then the statement tables in order; a metric that no
    table has is replaced when a substitute is known. The catalogue and the dictionaries are small
    dimensions with one row per column.
    """
    asked = requests.select(metric).distinct()
    order = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in fixed.TABLE_PRIORITY]), F.col("table_name")), F.lit(0))
    tables = catalog.select(F.col("column_name").alias("field"), "table_name").withColumn(
        "_prio", F.when(order > 0, order).otherwise(F.lit(9)))
    own = owners.select("field", F.col("table").alias("_own"))
    direct = (
        asked.withColumn("field", F.col(metric)).join(broadcast_if_small(tables), "field")
        .join(broadcast_if_small(own), "field", "left")
        .filter((F.col("_prio") < 9) | (F.col("_own") == F.col("table_name")))
        .withColumn("_prio", F.when(F.col("_own") == F.col("table_name"), 0).otherwise(F.col("_prio")))
        .withColumn("substituted", F.lit(False))
    )
    swapped = (
        asked.join(broadcast_if_small(substitutes), F.col(metric) == F.col("missing")).drop("missing")
        .join(broadcast_if_small(tables.filter(F.col("_prio") == 1)), "field")
        .withColumn("_prio", F.lit(20)).withColumn("substituted", F.lit(True))
    )
    best = first_rows(
        direct.select(metric, "field", "table_name", "_prio", "substituted")
        .unionByName(swapped.select(metric, "field", "table_name", "_prio", "substituted")),
        [metric], [F.col("_prio"), F.col("table_name")])
    return requests.join(best.drop("_prio"), metric, "left")


def retry_ladder(requests: DataFrame, rows: DataFrame, request_id: str = "request_id",
                 keys: EntityKeys = KEYS) -> DataFrame:
    """Rows of the strictest level that has any: full filter, without period, without period and year.

    All levels are evaluated in one join on the entity instead of one query per level.
    """
    want_year, want_period = F.col("want_year"), F.col("want_period")
    year_ok = want_year.isNull() | (F.col(keys.year) == want_year)
    period_ok = want_period.isNull() | (F.col(keys.period) == want_period)
    level = F.when(year_ok & period_ok, 0).when(year_ok, 1).otherwise(2)
    hits = requests.join(rows, keys.code).withColumn("level", level)
    # a request meets one entity's rows (years x periods), so the window group is small by construction
    best = F.min("level").over(W.partitionBy(request_id))
    return (hits.withColumn("_best", best).filter(F.col("level") <= F.col("_best"))
            .withColumn("level", F.col("_best")).drop("_best"))


def zip_by_position(left: DataFrame, right: DataFrame, position: str = "position") -> DataFrame:
    """n-th row with n-th row of two numbered frames."""
    return left.join(right, position)


def ordered_distinct(df: DataFrame, by: list[str], item: str, position: str) -> DataFrame:
    """Distinct items per group with their first position."""
    return df.groupBy(*by, item).agg(F.min(position).alias(position))


def newest_first(keys: EntityKeys = KEYS) -> list[Column]:
    return [F.col(keys.year).desc(), period_ordinal(keys.period).desc()]
