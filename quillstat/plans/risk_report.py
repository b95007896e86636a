"""Composite reports: alerts per entity and one report row per entity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.keys import KEYS, EntityKeys
from quillstat.operators import filters, joins, risk, windows
from quillstat.session import durable


def risk_rows(tables: list[DataFrame], entities: list[str] | None = None, year: int | None = None,
              period: str | None = None, recent: int | None = None, keys: EntityKeys = KEYS) -> DataFrame:
    """Merged rows the rules run on: filtered by request, or all rows (with ``recent``: the newest of each entity and statement)."""
    parts = []
    for t in tables:
        t = filters.match_entity(t, entities, keys=keys) if entities else t
        if year is not None:
            t = filters.at_year(t, year, keys)
            t = filters.at_period(t, period, keys) if period else t
        elif recent is not None:
            t = windows.recent_n(t, recent, keys)
        parts.append(t)
    return joins.merge_statements(parts, keys)


def risk_alerts(tables: list[DataFrame], entities: list[str] | None = None, year: int | None = None,
                period: str | None = None, keys: EntityKeys = KEYS) -> DataFrame:
    """Deduplicated alerts of the requested entities (all entities when none is named).

    The merged rows feed six rules, so they are written once instead of being rebuilt per rule.
    """
    rows = durable(risk_rows(tables, entities, year, period, keys=keys))
    return risk.dedupe_alerts(risk.all_alerts(rows, keys=keys), keys)


def report_metrics(keys: EntityKeys = KEYS) -> list[Column]:
    """Report figures of a merged row; a missing input or a non-positive base gives null."""
    c = lambda n: F.col(n).cast("double")
    rev, cost, profit = c("total_operating_revenue"), c("operating_expense_cost_of_sales"), c("net_profit")
    equity, assets, debt = c("equity_total_equity"), c("asset_total_assets"), c("liability_total_liabilities")
    return [
        F.when(rev > 0, (rev - cost) / rev).alias("gross_margin"), F.when(rev > 0, profit / rev).alias("net_margin"),
        F.when(equity > 0, profit / equity).alias("roe"), F.when(assets > 0, debt / assets).alias("debt_ratio"),
    ]


def profit_rating(roe: Column) -> Column:
    return F.when(roe > 0.15, "盈利能力较强").when(roe > 0.05, "盈利能力一般").when(roe > 0, "盈利能力偏弱").otherwise("盈利能力较弱，需关注")


def debt_rating(ratio: Column) -> Column:
    return F.when(ratio.isNull(), "数据不足，无法评价").when(ratio < 0.4, "偿债压力较低").when(ratio < 0.6, "偿债压力适中").otherwise("偿债风险较高")


def cash_rating(cash: Column) -> Column:
    return F.when(cash.isNull(), "数据不足，无法评价").when(cash > 0, "现金流健康").otherwise("现金流承压")


def conclusion(roe: Column, ratio: Column, cash: Column, high: Column, total: Column) -> Column:
    """One sentence from the ratings and the number of alerts."""
    profit = F.when(roe > 0.15, "盈利能力较强").when(roe > 0.05, "盈利能力一般").otherwise("盈利能力偏弱")
    debt = F.when(ratio < 0.4, "偿债压力较低").when(ratio < 0.6, "偿债压力适中").when(ratio.isNotNull(), "偿债风险较高")
    flow = F.when(cash > 0, "现金流状况健康").when(cash.isNotNull(), "现金流状况较弱")
    risks = (F.when(high > 0, F.concat(F.lit("存在"), high.cast("string"), F.lit("项高风险")))
             .when(total > 0, F.concat(F.lit("存在"), total.cast("string"), F.lit("项风险提示"))).otherwise("未发现明显风险"))
    return F.concat_ws("，", profit, debt, flow, risks)


def company_report(tables: list[DataFrame], entities: list[str] | None = None, year: int | None = None,
                   keys: EntityKeys = KEYS) -> DataFrame:
    """One row per entity: latest figures, ratios, ratings, number of alerts and a conclusion."""
    merged = durable(risk_rows(tables, entities, keys=keys))
    shown = merged if year is None else risk_rows(tables, entities, year, keys=keys)
    latest = windows.latest_per_entity(shown, keys)
    summary = risk.alert_summary(risk.all_alerts(merged, keys=keys), keys)
    rows = latest.select(
        *keys.dims, "total_operating_revenue", "net_profit", "asset_total_assets", "liability_total_liabilities",
        F.col("operating_cf_net_amount"), *report_metrics(keys)).join(summary, keys.code, "left")
    count = lambda n: F.coalesce(F.col(n), F.lit(0))
    cash = F.col("operating_cf_net_amount")
    return rows.select(
        *[c for c in rows.columns if not c.endswith("_count") and c != "summary"],
        count("alert_count").alias("alert_count"), count("high_count").alias("high_count"),
        F.coalesce("summary", F.lit("")).alias("alerts"),
        profit_rating(F.col("roe")).alias("profit_rating"), debt_rating(F.col("debt_ratio")).alias("debt_rating"),
        cash_rating(cash).alias("cash_rating"),
        conclusion(F.col("roe"), F.col("debt_ratio"), cash, count("high_count"), count("alert_count")).alias("conclusion"))
