"""Risk rules over merged statement rows, and alerts per entity.

Rows arrive one per (entity, year, period); every window works on one row per year of an entity.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillstat.keys import KEYS, EntityKeys, period_ordinal
from quillstat.operators.topk import severity_ordinal
from quillstat.operators.windows import first_row_per_year, first_rows

# Alert texts (type, rule, severity, suggestion).
DEBT = ("偿债风险", "资产负债率>70%", "high", "高负债风险")
CASH = ("现金流风险", "经营现金流连续为负", "high", "现金流风险")
RECEIVABLE = ("回款风险", "应收账款增长>营收增长", "mid", "回款能力下降")
INVENTORY = ("库存风险", "存货增长>营收增长", "mid", "库存积压风险")
DECLINE = ("盈利风险", "净利润连续下降", "high", "盈利能力下滑")
RETURN = ("ROE风险", "ROE<5%", "low", "股东回报能力较弱")


def _alert(df: DataFrame, rule: tuple, period: Column, value: Column, keys: EntityKeys) -> DataFrame:
    kind, name, severity, hint = rule
    return df.select(
        F.col(keys.code), F.col(keys.year), period.alias(keys.period), F.lit(kind).alias("alert_type"),
        F.lit(name).alias("rule"), F.lit(severity).alias("severity"), value.cast("double").alias("value"),
        F.lit(hint).alias("suggestion"))


def debt_ratio_alerts(rows: DataFrame, limit: float = 0.7, keys: EntityKeys = KEYS) -> DataFrame:
    a, b = F.col("asset_total_assets").cast("double"), F.col("liability_total_liabilities").cast("double")
    ratio = F.when(a > 0, b / a)
    return _alert(rows.withColumn("_r", ratio).filter(F.col("_r") > limit), DEBT, F.col(keys.period), F.col("_r"), keys)


def latest_present_per_year(rows: DataFrame, metric: str, keys: EntityKeys = KEYS) -> DataFrame:
    """The newest row of each year that has the metric."""
    return first_row_per_year(rows.filter(F.col(metric).isNotNull()), keys)


def longest_run(flag: Column, keys: EntityKeys = KEYS) -> Column:
    """Length of the run of flagged years a row ends, by its distance to the last unflagged year."""
    w = W.partitionBy(keys.code).orderBy(keys.year).rowsBetween(W.unboundedPreceding, 0)
    rn = F.row_number().over(W.partitionBy(keys.code).orderBy(keys.year))
    last_off = F.coalesce(F.max(F.when(~flag, F.col("_rn"))).over(w), F.lit(0))
    return rn - last_off


def _flagged_years(rows: DataFrame, flag: Column, consecutive: bool, keys: EntityKeys) -> DataFrame:
    rows = rows.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    if not consecutive:
        return rows.groupBy(keys.code).agg(F.count_if("_flag").alias("n"), F.max(F.when(F.col("_flag"), F.col(keys.year))).alias(keys.year))
    order = W.partitionBy(keys.code).orderBy(keys.year)
    runs = rows.withColumn("_rn", F.row_number().over(order)).withColumn("_run", longest_run(F.col("_flag"), keys))
    return runs.groupBy(keys.code).agg(F.max("_run").cast("long").alias("n"), F.max(F.when(F.col("_flag"), F.col(keys.year))).alias(keys.year))


def negative_cash_alerts(rows: DataFrame, minimum: int = 2, consecutive: bool = False, keys: EntityKeys = KEYS) -> DataFrame:
    """At least ``minimum`` years with negative operating cash; the value is the number of years."""
    yearly = latest_present_per_year(rows, "operating_cf_net_amount", keys)
    years = _flagged_years(yearly, F.col("operating_cf_net_amount") < 0, consecutive, keys)
    return _alert(years.filter(F.col("n") >= minimum), CASH, F.lit(None).cast("string"), F.col("n"), keys)


def growth_gap(rows: DataFrame, metric: str, base: str = "total_operating_revenue", floor: float = 1000.0,
               ceiling: float = 10.0, minimum: float = 0.1, keys: EntityKeys = KEYS) -> DataFrame:
    """Years in which the metric grew faster than revenue and by more than ``minimum``."""
    yearly = first_row_per_year(rows, keys)
    w = W.partitionBy(keys.code).orderBy(keys.year)
    m0, b0 = F.lag(metric).over(w).cast("double"), F.lag(base).over(w).cast("double")
    m1, b1 = F.col(metric).cast("double"), F.col(base).cast("double")
    grown = yearly.withColumn("_m0", m0).withColumn("_b0", b0)
    gm = F.when(F.col("_m0") >= floor, (m1 - F.col("_m0")) / F.col("_m0"))
    gb = F.when(F.col("_b0") >= floor, (b1 - F.col("_b0")) / F.col("_b0"))
    grown = grown.withColumn("metric_growth", gm).withColumn("base_growth", gb)
    g, b = F.col("metric_growth"), F.col("base_growth")
    return grown.filter((F.abs(g) <= ceiling) & (F.abs(b) <= ceiling) & (g > b) & (g > minimum)).drop("_m0", "_b0")


def growth_gap_alerts(rows: DataFrame, metric: str, rule: tuple, keys: EntityKeys = KEYS) -> DataFrame:
    return _alert(growth_gap(rows, metric, keys=keys), rule, F.lit(None).cast("string"), F.col("metric_growth"), keys)


def profit_decline_alerts(rows: DataFrame, minimum: int = 2, consecutive: bool = False, keys: EntityKeys = KEYS) -> DataFrame:
    """At least ``minimum`` year-on-year declines of profit; the value is their number."""
    yearly = latest_present_per_year(rows, "net_profit", keys)
    w = W.partitionBy(keys.code).orderBy(keys.year)
    years = _flagged_years(yearly.withColumn("_down", F.col("net_profit") < F.lag("net_profit").over(w)), F.col("_down"), consecutive, keys)
    return _alert(years.filter(F.col("n") >= minimum), DECLINE, F.lit(None).cast("string"), F.col("n"), keys)


def low_return_alerts(rows: DataFrame, keys: EntityKeys = KEYS) -> DataFrame:
    equity = F.col("equity_total_equity").cast("double")
    roe = F.when(equity > 0, F.col("net_profit").cast("double") / equity)
    return _alert(rows.withColumn("_r", roe).filter((F.col("_r") < 0.05) & (F.col("_r") > -1)), RETURN, F.col(keys.period), F.col("_r"), keys)


def all_alerts(rows: DataFrame, consecutive: bool = False, keys: EntityKeys = KEYS) -> DataFrame:
    """Alerts of the six rules over all entities at once."""
    parts = [
        debt_ratio_alerts(rows, keys=keys), negative_cash_alerts(rows, consecutive=consecutive, keys=keys),
        growth_gap_alerts(rows, "asset_accounts_receivable", RECEIVABLE, keys),
        growth_gap_alerts(rows, "asset_inventory", INVENTORY, keys),
        profit_decline_alerts(rows, consecutive=consecutive, keys=keys), low_return_alerts(rows, keys),
    ]
    return reduce(lambda a, b: a.unionByName(b), parts)


def dedupe_alerts(alerts: DataFrame, keys: EntityKeys = KEYS) -> DataFrame:
    """One alert per entity, type and rule: the newest."""
    return first_rows(alerts, [keys.code, "alert_type", "rule"],
                      [F.col(keys.year).desc_nulls_last(), period_ordinal(keys.period).desc()])


def alert_summary(alerts: DataFrame, keys: EntityKeys = KEYS) -> DataFrame:
    """Counts by severity and a text per entity; six rules bound the list of an entity."""
    one = dedupe_alerts(alerts, keys)
    item = F.struct(severity_ordinal(F.col("severity")).alias("o"), F.col("alert_type").alias("t"), F.col("suggestion").alias("s"))
    return one.groupBy(keys.code).agg(
        F.count(F.lit(1)).alias("alert_count"), F.count_if(F.col("severity") == "high").alias("high_count"),
        F.count_if(F.col("severity") == "mid").alias("mid_count"), F.count_if(F.col("severity") == "low").alias("low_count"),
        F.concat_ws("、", F.transform(F.array_sort(F.collect_list(item)), lambda x: x.getField("s"))).alias("summary"))
