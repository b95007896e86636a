"""Data-quality rules over statement rows and filings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillstat.keys import KEYS, EntityKeys, period_ordinal
from quillstat.operators.stats import melt

# Tolerances of the rules.
TOLERANCE = 0.02
SMALL = 100.0
CROSS_TOLERANCE = 0.05

# Inputs of the consistency rules (table prefix, field).
RULE_INPUTS = [
    ("inc", "total_operating_revenue"), ("inc", "operating_expense_cost_of_sales"), ("inc", "net_profit"), ("inc", "total_profit"),
    ("inc", "operating_revenue_yoy_growth"), ("inc", "net_profit_yoy_growth"),
    ("bal", "asset_total_assets"), ("bal", "liability_total_liabilities"), ("bal", "equity_total_equity"),
    ("cf", "net_cash_flow"), ("cf", "operating_cf_net_amount"), ("cf", "investing_cf_net_amount"), ("cf", "financing_cf_net_amount"),
    ("cpi", "net_profit"), ("cpi", "total_operating_revenue"), ("cpi", "eps"), ("cpi", "total_share_capital"), ("cpi", "roe"),
    ("cpi", "roe_weighted_excl_non_recurring"), ("cpi", "operating_revenue_yoy_growth"), ("cpi", "net_profit_yoy_growth"),
]
PREFIX = {"income_sheet": "inc", "balance_sheet": "bal", "cash_flow_sheet": "cf", "core_performance_indicators_sheet": "cpi"}


def filing_rows(facts: DataFrame, ids: list[str], table: str = "table_name", field: str = "field", value: str = "value") -> DataFrame:
    """Long facts → one row per filing: ``n_fields`` and the rule inputs as ``prefix__field``, in one combining pass."""
    long_name = {v: k for k, v in PREFIX.items()}
    return facts.groupBy(*ids).agg(F.count(F.lit(1)).alias("n_fields"), *[
        F.max(F.when((F.col(table) == long_name[p]) & (F.col(field) == f), F.col(value).cast("double"))).alias(f"{p}__{f}")
        for p, f in RULE_INPUTS])


def rule_columns(df: DataFrame) -> list[tuple[str, Column]]:
    """(rule, outcome): true or false, null when an input is missing. Twelve rules."""
    def g(prefix, field):
        name = f"{prefix}__{field}"
        return F.col(name).cast("double") if name in df.columns else F.lit(None).cast("double")

    ncf, ocf, icf, fcf = (g("cf", n) for n in ("net_cash_flow", "operating_cf_net_amount", "investing_cf_net_amount", "financing_cf_net_amount"))
    assets, debt, equity = (g("bal", n) for n in ("asset_total_assets", "liability_total_liabilities", "equity_total_equity"))
    profit_i, profit_c = g("inc", "net_profit"), g("cpi", "net_profit")
    profit = F.coalesce(profit_i, profit_c)
    pretax, cost = g("inc", "total_profit"), g("inc", "operating_expense_cost_of_sales")
    rev_i, rev_c = g("inc", "total_operating_revenue"), g("cpi", "total_operating_revenue")
    rev = F.coalesce(F.nullif(rev_i, F.lit(0.0)), rev_c)
    roe = F.coalesce(F.nullif(g("cpi", "roe"), F.lit(0.0)), g("cpi", "roe_weighted_excl_non_recurring"))
    shares = g("cpi", "total_share_capital")
    implied = g("cpi", "eps") * shares
    total = ocf + icf + fcf

    def agree(a, b, floor):
        return F.when(F.abs(a) > floor, F.abs(a - b) / F.abs(a) < CROSS_TOLERANCE)

    big_profit = F.abs(profit) > SMALL
    return [
        ("cash_flow_internal", F.when(F.abs(ncf) < SMALL, F.abs(total) < SMALL * 2)
         .when(ncf.isNotNull(), F.abs((ncf - total) / ncf) < TOLERANCE)),
        ("balance_identity", F.when(assets != 0, F.abs(assets - (debt + equity)) / F.abs(assets) < TOLERANCE)),
        ("np_ocf_direction", F.when(big_profit & (F.abs(ocf) > SMALL), (ocf / profit > -0.2) & (ocf / profit < 5.0))),
        ("eps_implied_np", F.when((shares > 0) & big_profit & implied.isNotNull(),
                                  F.when(implied * profit > 0, (implied / profit > 0.5) & (implied / profit < 2.0))
                                  .otherwise(F.abs(implied - profit) < F.greatest(F.abs(profit), F.lit(SMALL))))),
        ("profit_before_after_tax", F.when(pretax > 0, profit_i <= pretax * 1.03).when(pretax.isNotNull(), profit_i >= pretax * 1.03)),
        ("revenue_gt_cost", F.when(rev > 0, rev > cost)),
        ("revenue_positive", rev > 0),
        ("roe_range", (roe >= -0.5) & (roe <= 0.5)),
        ("cross_revenue", agree(rev_i, rev_c, SMALL)),
        ("cross_net_profit", agree(profit_i, profit_c, SMALL)),
        ("cross_rev_yoy", agree(g("inc", "operating_revenue_yoy_growth"), g("cpi", "operating_revenue_yoy_growth"), 0.0001)),
        ("cross_np_yoy", agree(g("inc", "net_profit_yoy_growth"), g("cpi", "net_profit_yoy_growth"), 0.0001)),
    ]


def consistency_checks(filings: DataFrame, ids: list[str]) -> DataFrame:
    """One row per filing and applicable rule: check, passed. No shuffle: the rules are exploded in the row."""
    outcomes = F.array(*[F.struct(F.lit(n).alias("check"), p.alias("passed")) for n, p in rule_columns(filings)])
    return filings.select(*ids, F.explode(outcomes).alias("o")).filter(F.col("o.passed").isNotNull()).select(*ids, "o.*")


def rule_counts(filings: DataFrame) -> tuple[Column, Column]:
    """(passed, applicable) as row expressions."""
    rules = [p for _, p in rule_columns(filings)]
    passed = sum((F.coalesce(p.cast("int"), F.lit(0)) for p in rules), F.lit(0))
    total = sum((p.isNotNull().cast("int") for p in rules), F.lit(0))
    return passed, total


def validation_score(passed: Column, total: Column) -> Column:
    """Share of passed rules in percent, half-even as whole number; 50 when no rule applies."""
    return F.when(total == 0, F.lit(50)).otherwise(F.bround(passed / total * 100).cast("int"))


# Trust in the extraction method.
SOURCE_SCORES = [("pdfplumber_standard", 95), ("pdfplumber_density", 75), ("llm_fallback", 50)]


def source_score(source: Column) -> Column:
    scores = F.create_map(*[F.lit(x) for kv in SOURCE_SCORES for x in kv])
    return F.coalesce(F.try_element_at(scores, source), F.lit(30))


def field_score(confidence: Column) -> Column:
    return F.when(confidence >= 80, 95).when(confidence >= 60, 70).when(confidence >= 40, 50).otherwise(30)


def volume_score(fields: Column) -> Column:
    bonus = (F.when(fields >= 3, 25).otherwise(0) + F.when(fields >= 5, 15).otherwise(0) + F.when(fields >= 8, 10).otherwise(0))
    return F.least(F.lit(50) + bonus, F.lit(100))


def confidence(source: Column, fields: Column, volume: Column, rules: Column) -> Column:
    """Weighted confidence with one decimal."""
    weighted = (source.cast("decimal(10,2)") * F.lit("0.25").cast("decimal(3,2)") + fields.cast("decimal(10,2)") * F.lit("0.25").cast("decimal(3,2)")
                + volume.cast("decimal(10,2)") * F.lit("0.20").cast("decimal(3,2)") + rules.cast("decimal(10,2)") * F.lit("0.30").cast("decimal(3,2)"))
    return F.round(weighted, 1)


def decision(conf: Column) -> Column:
    return F.when(conf >= 80, "auto").when(conf >= 60, "flagged").otherwise("rejected")


def load_summary(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def cumulative_continuity(rows: DataFrame, metric: str, tolerance: float = 0.1, keys: EntityKeys = KEYS) -> DataFrame:
    """Year-to-date values that fall by more than the tolerance from one period to the next."""
    w = W.partitionBy(keys.code, keys.year).orderBy("_o")
    r = rows.filter(F.col(metric).isNotNull()).withColumn("_o", period_ordinal(keys.period)).filter(F.col("_o") > 0)
    r = r.withColumn("previous_period", F.lag(keys.period).over(w)).withColumn("previous_value", F.lag(metric).over(w))
    floor = F.col("previous_value") * F.lit(str(1 - tolerance)).cast("decimal(3,2)")
    return r.filter(F.col(metric) < floor).drop("_o")


def yoy_anomaly(rows: DataFrame, metrics: list[str], limit: float = 10.0, base: float = 100.0, gap: int = 2,
                keys: EntityKeys = KEYS) -> DataFrame:
    """Changes of more than ``limit`` times against the year before (at most ``gap`` years back)."""
    long = melt(rows, metrics, keys.dims, "metric", "value").filter(F.col("value").isNotNull())
    w = W.partitionBy(keys.code, keys.period, "metric").orderBy(keys.year)
    r = long.withColumn("previous_year", F.lag(keys.year).over(w)).withColumn("previous_value", F.lag("value").over(w))
    change = F.abs((F.col("value") - F.col("previous_value")) / F.col("previous_value"))
    near = (F.col(keys.year) - F.col("previous_year") <= gap) & (F.abs("previous_value") > base) & (F.col("value") != 0)
    return r.withColumn("change", F.when(near, change)).filter(F.col("change") > limit)


def logic_violations(rows: DataFrame, ids: list[str]) -> DataFrame:
    """Rows where profit exceeds revenue or liabilities exceed assets."""
    rev, profit = F.col("total_operating_revenue"), F.col("net_profit")
    assets, debt = F.col("asset_total_assets"), F.col("liability_total_liabilities")
    issues = F.array(
        F.struct(F.lit("revenue_ge_profit").alias("rule"), ((rev > 0) & (profit != 0) & (rev < profit)).alias("bad")),
        F.struct(F.lit("assets_ge_liabilities").alias("rule"), ((assets != 0) & (debt != 0) & (assets < debt)).alias("bad")))
    return rows.select(*ids, F.explode(issues).alias("i")).filter("i.bad").select(*ids, F.col("i.rule").alias("rule"))

