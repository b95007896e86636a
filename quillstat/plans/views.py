"""Statement views derived from ``lineitem`` and ``supplier``.

The line items are aggregated once per (supplier, year, quarter), which collapses any hot supplier
map-side; the running sums then work on at most four rows per year and supplier.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_MONEY = "decimal(20,4)"
STATEMENTS = ["income", "balance", "cashflow", "core"]
TABLE_NAMES = {
    "income": "income_sheet",
    "balance": "balance_sheet",
    "cashflow": "cash_flow_sheet",
    "core": "core_performance_indicators_sheet",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _dec(value: str) -> Column:
    return F.lit(value).cast("decimal(4,2)")


def statement_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Year-to-date and life-to-date sums per supplier, year and quarter."""
    items = table(spark, sf_dir, "lineitem")
    # Exact integer arithmetic in 1/10000: cents of the price times hundredths of the rates. Whole numbers
    # stay in machine words for every row; an overflowing sum would fail (ANSI), never wrap.
    ep = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    d = F.round(F.col("l_discount") * 100).cast("bigint")
    t = F.round(F.col("l_tax") * 100).cast("bigint")
    returned = F.col("l_returnflag") == "R"
    rev, cost = ep * (100 - d), ep * (60 + t)
    parts = {
        "rev": rev,
        "cost": cost,
        "disc": ep * d,
        "np": rev - cost - F.when(returned, ep * 90).otherwise(0),
        "ast": ep * 100,
        "liab": ep * (50 + 4 * d),
        "ar": F.when(F.col("l_quantity") > 25, ep * 100),
        "inv": F.when(F.col("l_linenumber") >= 4, ep * 100),
        "taxed": ep * t,
        "ocf": F.when(returned, ep * -100).otherwise(ep * 50),
    }
    unit = F.lit("0.0001").cast("decimal(4,4)")
    quarterly = (
        items.select(
            "l_suppkey",
            F.year("l_shipdate").alias("y"),
            F.quarter("l_shipdate").alias("q"),
            *[c.alias(n) for n, c in parts.items()],
        )
        .groupBy("l_suppkey", "y", "q")
        .agg(*[(F.coalesce(F.sum(n), F.lit(0)).cast("decimal(20,0)") * unit).cast(_MONEY).alias(n) for n in parts])
    )
    ytd = W.partitionBy("l_suppkey", "y").orderBy("q").rowsBetween(W.unboundedPreceding, 0)
    ltd = W.partitionBy("l_suppkey").orderBy("y", "q").rowsBetween(W.unboundedPreceding, 0)
    life = {"ast", "liab"}
    running = quarterly.select(
        "l_suppkey", "y", "q",
        *[F.sum(n).over(ltd if n in life else ytd).cast(_MONEY).alias(n) for n in parts],
    )
    kept = running.filter(~((F.col("q") == 4) & (F.col("y") == 1999) & (F.col("l_suppkey") % 10 == 3)))
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    period = F.element_at(F.array(*[F.lit(p) for p in ("Q1", "H1", "Q3", "FY")]), F.col("q"))
    return kept.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).select(
        F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("stock_code"),
        F.col("s_name").alias("stock_abbr"),
        F.col("y").alias("report_year"),
        period.alias("report_period"),
        F.col("l_suppkey").alias("sk"),
        *parts,
    )


def _money(c: Column, name: str) -> Column:
    return c.cast(_MONEY).alias(name)


def _columns() -> dict[str, list[Column]]:
    c = F.col
    equity = (c("ast") - c("liab")).cast(_MONEY)
    equity = F.when(c("sk") % 17 == 0, equity * _dec("1.20")).otherwise(equity).cast(_MONEY)
    net_cash = (c("ocf") - c("disc") + c("taxed")).cast(_MONEY)
    net_cash = F.when(c("sk") % 13 == 0, net_cash * _dec("1.10")).otherwise(net_cash).cast(_MONEY)
    core_profit = F.when(c("sk") % 19 == 0, c("np") * _dec("1.10")).otherwise(c("np"))
    shares = (F.lit(100) + c("sk")).cast("double")

    def ratio(a: Column, b: Column, name: str) -> Column:
        return F.try_divide(a.cast("double"), b.cast("double")).alias(name)

    return {
        "income": [
            _money(c("rev"), "total_operating_revenue"),
            _money(c("cost"), "operating_expense_cost_of_sales"),
            _money(c("disc"), "operating_expense_selling_expenses"),
            _money(c("np"), "net_profit"),
        ],
        "balance": [
            _money(c("ast"), "asset_total_assets"),
            _money(c("liab"), "liability_total_liabilities"),
            _money(equity, "equity_total_equity"),
            _money(c("ar"), "asset_accounts_receivable"),
            _money(c("inv"), "asset_inventory"),
            _money(c("taxed"), "asset_cash_and_cash_equivalents"),
            _money(c("disc"), "liability_short_term_loans"),
        ],
        "cashflow": [
            _money(c("ocf"), "operating_cf_net_amount"),
            _money(-c("disc"), "investing_cf_net_amount"),
            _money(c("taxed"), "financing_cf_net_amount"),
            _money(net_cash, "net_cash_flow"),
        ],
        "core": [
            (F.lit(100) + c("sk")).cast("bigint").alias("total_share_capital"),
            _money(core_profit, "net_profit"),
            ratio(c("np"), shares, "eps"),
            ratio(c("np"), equity, "roe"),
            ratio(c("rev") - c("cost"), c("rev"), "gross_profit_margin"),
            ratio(c("np"), c("rev"), "net_profit_margin"),
        ],
    }


KEY_COLUMNS = ["stock_code", "stock_abbr", "report_year", "report_period"]


def statement(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the four statement views: income, balance, cashflow, core."""
    return statement_base(spark, sf_dir).select(*KEY_COLUMNS, *_columns()[name])


def statements(spark: SparkSession, sf_dir: str, names: list[str] = STATEMENTS) -> dict[str, DataFrame]:
    """Several views over one shared base, so that identical exchanges are reused."""
    base = statement_base(spark, sf_dir)
    cols = _columns()
    return {n: base.select(*KEY_COLUMNS, *cols[n]) for n in names}


def statement_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All distinct metrics of the four views in one row per key, from one scan."""
    cols = _columns()
    return statement_base(spark, sf_dir).select(
        *KEY_COLUMNS, *cols["income"], *cols["balance"], *cols["cashflow"],
        *[c for i, c in enumerate(cols["core"]) if i != 1],
        cols["core"][1].alias("core_net_profit"),
    )


def amount_facts(spark: SparkSession, sf_dir: str, by_filing: bool = False) -> DataFrame:
    """Long facts (keys, table, field, value) of the three amount statements, from one scan; with ``by_filing`` those of a filing lie in one partition, so what
    is grouped by filing or by more than that isn't shuffled again."""
    cols = _columns()
    base = statement_base(spark, sf_dir)
    wide = (base.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *KEY_COLUMNS) if by_filing else base).select(
        *KEY_COLUMNS,
        *[F.struct(*cols[n]).alias(n) for n in ("income", "balance", "cashflow")],
    )
    entries = []
    for n in ("income", "balance", "cashflow"):
        for field in wide.schema[n].dataType.fieldNames():
            entries.append(
                F.struct(F.lit(TABLE_NAMES[n]).alias("table_name"), F.lit(field).alias("field"),
                         F.col(f"{n}.{field}").alias("value"))
            )
    return wide.select(*KEY_COLUMNS, F.explode(F.array(*entries)).alias("f")).select(*KEY_COLUMNS, "f.*")
