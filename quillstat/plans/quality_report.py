"""Quality report: all statement checks counted in one table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.keys import KEYS, EntityKeys
from quillstat.operators import quality, stats
from quillstat.session import durable


def quality_report(rows: DataFrame, metrics: list[str], revenue: str = "total_operating_revenue", profit: str = "net_profit",
                   keys: EntityKeys = KEYS) -> DataFrame:
    """(check, issues): duplicates, continuity, growth, logic, three sigma, multiples of the mean.

    Seven checks read the same rows, so the rows are written once first.
    """
    rows = durable(rows.select(*keys.dims, *metrics))
    parts = {
        "duplicate_keys": stats.duplicate_keys(rows, keys.row),
        "continuity": quality.cumulative_continuity(rows, revenue, keys=keys),
        "yoy_change": quality.yoy_anomaly(rows, [revenue, profit], keys=keys),
        "logic": quality.logic_violations(rows, keys.dims),
        "three_sigma": stats.three_sigma(rows, metrics, keys.dims),
        "mean_multiple": stats.mean_multiple_outliers(rows, metrics, keys.dims),
        "all_null_columns": stats.profile_columns(rows, metrics).filter("all_null"),
    }
    counted = [df.groupBy().agg(F.count(F.lit(1)).alias("issues")).select(F.lit(n).alias("check"), "issues") for n, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b), counted)
