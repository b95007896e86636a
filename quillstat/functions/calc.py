"""Derived ratios as column expressions, and a registry of named formulas."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.keys import KEYS, EntityKeys


def _round(c: Column, digits: int | None) -> Column:
    return c if digits is None else F.round(c, digits)


def _d(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).try_cast("double")


def safe_ratio(a: Column | str, b: Column | str, digits: int | None = 4) -> Column:
    """a / b, null without both values or with a zero denominator."""
    return _round(F.try_divide(_d(a), _d(b)), digits)


def safe_pct(a: Column | str, b: Column | str, digits: int | None = 4) -> Column:
    return _round(F.try_divide(_d(a), _d(b)) * 100, digits)


def safe_diff(a: Column | str, b: Column | str, digits: int | None = 4) -> Column:
    return _round(_d(a) - _d(b), digits)


def safe_abs_diff(a: Column | str, b: Column | str, digits: int | None = 4) -> Column:
    return _round(F.abs(_d(a) - _d(b)), digits)


@dataclass(frozen=True)
class Formula:
    fields: tuple[str, ...]
    expression: str
    unit: str
    build: Callable[[int | None], Column]


def _share(part: str, whole: str, text: str) -> Formula:
    return Formula((part, whole), text, "%", lambda digits: safe_pct(part, whole, digits))


def _times(a: str, b: str, text: str, unit: str) -> Formula:
    return Formula((a, b), text, unit, lambda digits: safe_ratio(a, b, digits))


def _minus(a: str, b: str, text: str) -> Formula:
    return Formula((a, b), text, "万元", lambda digits: safe_diff(a, b, digits))


# Formula names, inputs, wording and units.
FORMULAS: dict[str, Formula] = {
    "销售毛利率": Formula(("total_operating_revenue", "operating_expense_cost_of_sales"), "(营收-营业成本)/营收*100", "%",
                     lambda digits: safe_pct(_d("total_operating_revenue") - _d("operating_expense_cost_of_sales"),
                                             "total_operating_revenue", digits)),
    "销售净利率": _share("net_profit", "total_operating_revenue", "净利润/营收*100"),
    "资产负债率": _share("liability_total_liabilities", "asset_total_assets", "负债总额/资产总额*100"),
    "研发费用占比": _share("operating_expense_rnd_expenses", "total_operating_revenue", "研发费用/营收*100"),
    "销售费用占比": _share("operating_expense_selling_expenses", "total_operating_revenue", "销售费用/营收*100"),
    "应收账款占比": _share("asset_accounts_receivable", "total_operating_revenue", "应收账款/营收*100"),
    "货币资金占比": _share("asset_cash_and_cash_equivalents", "asset_total_assets", "货币资金/总资产*100"),
    "净利润占未分配利润比": _share("net_profit", "equity_unappropriated_profit", "净利润/未分配利润*100"),
    "扣非净利润差值": Formula(("net_profit", "net_profit_excl_non_recurring"), "|净利润-扣非净利润|", "万元",
                       lambda digits: safe_abs_diff("net_profit", "net_profit_excl_non_recurring", digits)),
    "存货周转率": _times("operating_expense_cost_of_sales", "asset_inventory", "营业成本/存货", "次"),
    "经营现金流净利润比": _times("operating_cf_net_amount", "net_profit", "经营现金流/净利润", ""),
    "短期借款超货币资金": _minus("liability_short_term_loans", "asset_cash_and_cash_equivalents", "短期借款-货币资金"),
    "资产减存货": _minus("asset_total_assets", "asset_inventory", "总资产-存货"),
}


def calc_batch(df: DataFrame, formula: str, digits: int | None = 4, keys: EntityKeys = KEYS) -> DataFrame:
    """Keys plus formula, expression, value, unit and fields used; an unknown name gives error rows."""
    f = FORMULAS.get(formula)
    dims = [F.col(k) for k in keys.dims]
    if f is None:
        return df.select(*dims, F.lit(formula).alias("formula"), F.lit(None).cast("string").alias("expression"),
                         F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("unit"),
                         F.lit(None).cast("string").alias("fields_used"), F.lit(f"unknown formula: {formula}").alias("error"))
    known = [c for c in f.fields if c in df.columns]
    value = f.build(digits) if len(known) == len(f.fields) else F.lit(None).cast("double")
    return df.select(*dims, F.lit(formula).alias("formula"), F.lit(f.expression).alias("expression"), value.alias("value"),
                     F.lit(f.unit).alias("unit"), F.lit(",".join(f.fields)).alias("fields_used"),
                     F.lit(None).cast("string").alias("error"))


def list_formulas(spark) -> DataFrame:
    return spark.createDataFrame([(n, f.expression, f.unit, list(f.fields)) for n, f in FORMULAS.items()],
                                 "name string, expression string, unit string, fields array<string>")


def formula_order(df: DataFrame, tie: list[str] | None = None, keys: EntityKeys = KEYS) -> DataFrame:
    """Rows with a value, largest first."""
    return df.filter(F.col("value").isNotNull()).orderBy(F.col("value").desc(), *(tie or keys.row))


def comparison_table(df: DataFrame, values: list[str], label: str = "stock_abbr", year: str = "report_year") -> DataFrame:
    return df.select(F.col(label), F.col(year).cast("string").alias("year"), *values)
