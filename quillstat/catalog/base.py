"""Registry of named queries, each with an optional DuckDB oracle on the same tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Entry:
    name: str
    ids: tuple[str, ...]
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, ids: str, oracle: str | None = None):
    """Register a query under a name, with the inventory ids it exercises."""

    def wrap(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, tuple(ids.split()), fn, oracle)
        return fn

    return wrap


# Statement views for the oracle side, the same definitions as quillstat.plans.views.
VIEWS = """
li AS (SELECT l_suppkey sk, year(l_shipdate) y, quarter(l_shipdate) q, l_returnflag rf, l_quantity qty, l_linenumber ln,
  CAST(l_extendedprice AS DECIMAL(12,2)) ep, CAST(l_discount AS DECIMAL(4,2)) d, CAST(l_tax AS DECIMAL(4,2)) t FROM lineitem),
qs AS (SELECT sk, y, q,
  SUM(ep*(CAST(1 AS DECIMAL(4,2))-d)) rev, SUM(ep*(CAST(0.60 AS DECIMAL(4,2))+t)) cost, SUM(ep*d) disc,
  SUM(ep*(CAST(1 AS DECIMAL(4,2))-d) - ep*(CAST(0.60 AS DECIMAL(4,2))+t)
      - CASE WHEN rf='R' THEN ep*CAST(0.90 AS DECIMAL(4,2)) ELSE CAST(0 AS DECIMAL(4,2)) END) np,
  SUM(ep) ast, SUM(ep*(CAST(0.50 AS DECIMAL(4,2))+CAST(4 AS DECIMAL(4,2))*d)) liab,
  COALESCE(SUM(CASE WHEN qty>25 THEN ep END),0) ar, COALESCE(SUM(CASE WHEN ln>=4 THEN ep END),0) inv, SUM(ep*t) taxed,
  SUM(CASE WHEN rf='R' THEN -ep ELSE ep*CAST(0.50 AS DECIMAL(4,2)) END) ocf
  FROM li GROUP BY sk,y,q),
run AS (SELECT sk,y,q, SUM(rev) OVER a rev, SUM(cost) OVER a cost, SUM(disc) OVER a disc, SUM(np) OVER a np,
  SUM(ast) OVER b ast, SUM(liab) OVER b liab, SUM(ar) OVER a ar, SUM(inv) OVER a inv, SUM(taxed) OVER a taxed, SUM(ocf) OVER a ocf
  FROM qs WINDOW a AS (PARTITION BY sk,y ORDER BY q ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY sk ORDER BY y,q ROWS UNBOUNDED PRECEDING)),
sb AS (SELECT lpad(CAST(sk AS VARCHAR),6,'0') stock_code, s_name stock_abbr, CAST(y AS INTEGER) report_year,
  CASE q WHEN 1 THEN 'Q1' WHEN 2 THEN 'H1' WHEN 3 THEN 'Q3' ELSE 'FY' END report_period, r.*
  FROM run r JOIN supplier ON sk=s_suppkey WHERE NOT (q=4 AND y=1999 AND sk%10=3)),
income AS (SELECT stock_code, stock_abbr, report_year, report_period, CAST(rev AS DECIMAL(20,4)) total_operating_revenue,
  CAST(cost AS DECIMAL(20,4)) operating_expense_cost_of_sales, CAST(disc AS DECIMAL(20,4)) operating_expense_selling_expenses,
  CAST(np AS DECIMAL(20,4)) net_profit FROM sb),
balance AS (SELECT stock_code, stock_abbr, report_year, report_period, CAST(ast AS DECIMAL(20,4)) asset_total_assets,
  CAST(liab AS DECIMAL(20,4)) liability_total_liabilities,
  CAST(CASE WHEN sk%17=0 THEN CAST(ast-liab AS DECIMAL(20,4))*CAST(1.20 AS DECIMAL(4,2)) ELSE ast-liab END AS DECIMAL(20,4)) equity_total_equity,
  CAST(ar AS DECIMAL(20,4)) asset_accounts_receivable, CAST(inv AS DECIMAL(20,4)) asset_inventory,
  CAST(taxed AS DECIMAL(20,4)) asset_cash_and_cash_equivalents, CAST(disc AS DECIMAL(20,4)) liability_short_term_loans FROM sb),
cashflow AS (SELECT stock_code, stock_abbr, report_year, report_period, CAST(ocf AS DECIMAL(20,4)) operating_cf_net_amount,
  CAST(-disc AS DECIMAL(20,4)) investing_cf_net_amount, CAST(taxed AS DECIMAL(20,4)) financing_cf_net_amount,
  CAST(CASE WHEN sk%13=0 THEN CAST(ocf-disc+taxed AS DECIMAL(20,4))*CAST(1.10 AS DECIMAL(4,2)) ELSE ocf-disc+taxed END AS DECIMAL(20,4)) net_cash_flow FROM sb),
core AS (SELECT s.stock_code, s.stock_abbr, s.report_year, s.report_period, CAST(100+sk AS BIGINT) total_share_capital,
  CAST(CASE WHEN sk%19=0 THEN CAST(np AS DECIMAL(20,4))*CAST(1.10 AS DECIMAL(4,2)) ELSE np END AS DECIMAL(20,4)) net_profit,
  CAST(np AS DOUBLE)/CAST(100+sk AS DOUBLE) eps, CAST(np AS DOUBLE)/NULLIF(CAST(b.equity_total_equity AS DOUBLE),0) roe,
  CAST(rev-cost AS DOUBLE)/NULLIF(CAST(rev AS DOUBLE),0) gross_profit_margin, CAST(np AS DOUBLE)/NULLIF(CAST(rev AS DOUBLE),0) net_profit_margin
  FROM sb s JOIN balance b USING (stock_code, report_year, report_period))
"""

PERIOD_ORD = "CASE report_period WHEN 'Q1' THEN 1 WHEN 'H1' THEN 2 WHEN 'Q3' THEN 3 WHEN 'FY' THEN 4 ELSE 0 END"
PREFER_CUM = "CASE report_period WHEN 'FY' THEN 4 WHEN 'Q3' THEN 3 WHEN 'H1' THEN 2 WHEN 'Q1' THEN 1 ELSE 0 END"
PREFER_HALF = "CASE report_period WHEN 'FY' THEN 4 WHEN 'H1' THEN 3 WHEN 'Q3' THEN 2 WHEN 'Q1' THEN 1 ELSE 0 END"


def sql(body: str, ctes: str = "") -> str:
    """Prefix a SELECT with the statement views (and further common table expressions)."""
    return f"WITH {VIEWS}{', ' + ctes if ctes else ''} {body}"


def values(rows, columns: str) -> str:
    """A VALUES clause from Python rows."""

    def lit(v):
        if v is None:
            return "NULL"
        if isinstance(v, (int, float)):
            return str(v)
        return "'" + str(v).replace("'", "''") + "'"

    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS v({columns})"
