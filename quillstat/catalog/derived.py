"""Formulas, growth, statistics, units, risk, reports and quality checks over the statement views."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstat.catalog.base import PERIOD_ORD, query, sql
from quillstat.functions import calc, numbers
from quillstat.operators import filters, quality, risk, stats, topk, windows
from quillstat.plans import risk_report
from quillstat.plans.data_process import data_process
from quillstat.plans.quality_report import quality_report
from quillstat.plans.views import KEY_COLUMNS, statement, statement_wide, statements, table

DIMS = "stock_code, stock_abbr, report_year, report_period"
WIDE = ("income JOIN balance USING (stock_code, stock_abbr, report_year, report_period) JOIN cashflow USING (stock_code, stock_abbr, report_year, report_period)")


def D(x):
    return f"CAST({x} AS DOUBLE)"


def R(a, b):
    return f"CAST({a} AS DOUBLE)/NULLIF(CAST({b} AS DOUBLE),0)"


@query("formula_debt_ratio", "FN1 FN2 FN3", sql(
    f"SELECT {DIMS}, '资产负债率' formula, '负债总额/资产总额*100' expression, {R('liability_total_liabilities','asset_total_assets')}*100 AS value, '%' unit, "
    "'liability_total_liabilities,asset_total_assets' fields_used, CAST(NULL AS VARCHAR) error FROM balance"))
def formula_debt_ratio(spark, sf_dir):
    return calc.calc_batch(statement(spark, sf_dir, "balance"), "资产负债率", digits=None)


@query("formula_unknown", "FN3", sql(
    f"SELECT {DIMS}, '市盈率' formula, CAST(NULL AS VARCHAR) expression, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS VARCHAR) unit, CAST(NULL AS VARCHAR) fields_used, 'unknown formula: 市盈率' error FROM income"))
def formula_unknown(spark, sf_dir):
    return calc.calc_batch(statement(spark, sf_dir, "income"), "市盈率")


@query("formula_all_ratios", "FN1 FN2", sql(
    f"SELECT {DIMS}, (CAST(total_operating_revenue AS DOUBLE)-CAST(operating_expense_cost_of_sales AS DOUBLE))/NULLIF(CAST(total_operating_revenue AS DOUBLE),0)*100 gross, {R('net_profit','total_operating_revenue')}*100 net, "
    f"{R('operating_expense_selling_expenses','total_operating_revenue')}*100 selling, {R('asset_accounts_receivable','total_operating_revenue')}*100 receivable, {R('asset_cash_and_cash_equivalents','asset_total_assets')}*100 cash, "
    f"{R('operating_expense_cost_of_sales','asset_inventory')} turnover, {R('operating_cf_net_amount','net_profit')} cash_to_profit, {D('liability_short_term_loans')}-{D('asset_cash_and_cash_equivalents')} loans_over_cash, {D('asset_total_assets')}-{D('asset_inventory')} quick FROM {WIDE}"))
def formula_all_ratios(spark, sf_dir):
    names = {"gross": "销售毛利率", "net": "销售净利率", "selling": "销售费用占比", "receivable": "应收账款占比", "cash": "货币资金占比",
             "turnover": "存货周转率", "cash_to_profit": "经营现金流净利润比", "loans_over_cash": "短期借款超货币资金", "quick": "资产减存货"}
    return statement_wide(spark, sf_dir).select(*KEY_COLUMNS, *[calc.FORMULAS[f].build(None).alias(n) for n, f in names.items()])


@query("formula_order", "TK7 CP14 FN3", sql(
    f"SELECT {DIMS}, '存货周转率' formula, '营业成本/存货' expression, {R('operating_expense_cost_of_sales','asset_inventory')} AS value, '次' unit, 'operating_expense_cost_of_sales,asset_inventory' fields_used, CAST(NULL AS VARCHAR) error "
    f"FROM {WIDE} WHERE asset_inventory<>0"))
def formula_order(spark, sf_dir):
    return data_process(statement_wide(spark, sf_dir), "calc", {"formula": "存货周转率"}, digits=None)


@query("comparison_table", "FN45", sql(
    "SELECT stock_abbr, CAST(report_year AS VARCHAR) AS year, total_operating_revenue, net_profit FROM income WHERE report_period='FY'"))
def comparison_table(spark, sf_dir):
    rows = filters.at_period(statement(spark, sf_dir, "income"), "FY")
    return calc.comparison_table(rows, ["total_operating_revenue", "net_profit"])


@query("yoy_growth", "WN7", sql(
    f"SELECT {DIMS}, net_profit, (CAST(net_profit AS DOUBLE)-CAST(prev AS DOUBLE))/NULLIF(abs(CAST(prev AS DOUBLE)),0)*100 net_profit_yoy FROM (SELECT i.*, p.net_profit prev FROM income i LEFT JOIN "
    "(SELECT stock_code, report_year+1 report_year, report_period, net_profit FROM income) p USING (stock_code, report_year, report_period))"))
def yoy_growth(spark, sf_dir):
    return windows.yoy(statement(spark, sf_dir, "income").select(*KEY_COLUMNS, "net_profit"), "net_profit", digits=None)


@query("qoq_growth", "WN7", sql(
    f"SELECT {DIMS}, total_operating_revenue, (CAST(total_operating_revenue AS DOUBLE)-CAST(prev AS DOUBLE))/NULLIF(abs(CAST(prev AS DOUBLE)),0)*100 total_operating_revenue_qoq FROM (SELECT i.*, p.total_operating_revenue prev FROM "
    f"(SELECT *, report_year*4+{PERIOD_ORD} t FROM income) i LEFT JOIN (SELECT stock_code, report_year*4+{PERIOD_ORD}+1 t, total_operating_revenue FROM income) p USING (stock_code, t))"))
def qoq_growth(spark, sf_dir):
    return windows.qoq(statement(spark, sf_dir, "income").select(*KEY_COLUMNS, "total_operating_revenue"), "total_operating_revenue", digits=None)


@query("cagr_revenue", "WN8", sql(
    "SELECT stock_code, start_year, end_year, start_value, end_value, CAST(CASE WHEN start_value>0 AND end_value>0 AND end_year>start_year THEN (pow(CAST(end_value AS DOUBLE)/CAST(start_value AS DOUBLE), 1.0/(end_year-start_year))-1)*100 END AS DECIMAL(18,6)) cagr FROM ("
    "SELECT stock_code, MIN(report_year) start_year, MAX(report_year) end_year, arg_min(total_operating_revenue, report_year) start_value, arg_max(total_operating_revenue, report_year) end_value FROM income WHERE report_period='FY' GROUP BY 1)"))
def cagr_revenue(spark, sf_dir):
    rows = filters.at_period(statement(spark, sf_dir, "income"), "FY")
    return windows.cagr(rows, "total_operating_revenue", digits=None).withColumn("cagr", F.col("cagr").cast("decimal(18,6)"))


@query("group_stats_by_year", "AG1", sql(
    "SELECT report_year, COUNT(v) AS count, CAST(AVG(v) AS DECIMAL(18,4)) mean, CAST(MEDIAN(v) AS DECIMAL(18,6)) median, MIN(v) AS min, MAX(v) AS max, CAST(stddev_pop(v) AS DECIMAL(18,2)) std FROM (SELECT report_year, CAST(net_profit AS DOUBLE) v FROM income WHERE report_period='FY') GROUP BY 1"))
def group_stats_by_year(spark, sf_dir):
    out = stats.group_stats(filters.at_period(statement(spark, sf_dir, "income"), "FY"), "net_profit", ["report_year"], digits=None)
    return out.select("report_year", "count", F.col("mean").cast("decimal(18,4)").alias("mean"), F.col("median").cast("decimal(18,6)").alias("median"),
                      "min", "max", F.col("std").cast("decimal(18,2)").alias("std"))


@query("group_stats_all_orders", "AG1 CP14", 
    "SELECT COUNT(o_totalprice) AS count, CAST(AVG(o_totalprice) AS DECIMAL(18,2)) mean, CAST(MEDIAN(o_totalprice) AS DECIMAL(18,4)) median, MIN(o_totalprice) AS min, MAX(o_totalprice) AS max FROM orders")
def group_stats_all_orders(spark, sf_dir):
    out = data_process(table(spark, sf_dir, "orders"), "compare", {"mode": "stats", "field": "o_totalprice"}, digits=None)
    return out.select("count", F.col("mean").cast("decimal(18,2)").alias("mean"), F.col("median").cast("decimal(18,4)").alias("median"), "min", "max")


@query("compare_rank_mode", "CP14 WN5", sql(
    "SELECT stock_code, stock_abbr, report_year, report_period, net_profit, rank FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY net_profit DESC, stock_code, report_year, report_period) rank FROM income) WHERE rank<=25"))
def compare_rank_mode(spark, sf_dir):
    rows = statement(spark, sf_dir, "income").select(*KEY_COLUMNS, "net_profit")
    return data_process(rows, "compare", {"mode": "rank", "field": "net_profit", "top_k": 25})


@query("infer_unit", "FN9", sql(
    f"SELECT {DIMS}, CASE WHEN u THEN {D('asset_total_assets')}/10000 ELSE {D('asset_total_assets')} END asset_total_assets, CASE WHEN u THEN '元' ELSE '万元' END source_unit FROM balance, (SELECT COALESCE(abs(arg_min({D('NULLIF(asset_total_assets,0)')}, stock_code||report_year||report_period))>1e8,false) u "
    "FROM balance)"))
def infer_unit(spark, sf_dir):
    rows = statement(spark, sf_dir, "balance").select(*KEY_COLUMNS, "asset_total_assets")
    return numbers.infer_unit(rows, ["asset_total_assets"], [F.col(k) for k in ("stock_code", "report_year", "report_period")], digits=None)


FMT = ("CASE WHEN v IS NULL THEN '0' WHEN abs(v)>=10000 THEN printf('%.2f', v/10000)||' 亿元' WHEN abs(v)>=1 THEN format('{:,.2f}', v)||' 万元' "
       "WHEN abs(v)>=0.01 THEN printf('%.2f', v)||' 万元' ELSE printf('%.4f', v) END")


@query("smart_format", "FN11", 
    "SELECT c_custkey, printf('%.2f', v)||'%' pct, CASE WHEN v>=10000 THEN format('{:,.2f}', v)||' 元/股' ELSE printf('%.2f', v)||' 元/股' END per_share, "
    f"{FMT} screen, CASE WHEN abs(v*10)>=10000 THEN printf('%.2f', v*10/10000)||'亿' ELSE printf('%.2f', v*10)||'万' END alert, CASE WHEN abs(v)>=10000 THEN printf('%.2f', v/10000)||'亿元' ELSE printf('%.2f', v)||'万元' END report "
    "FROM (SELECT c_custkey, floor(c_acctbal)+0.25 v FROM customer)")
def smart_format(spark, sf_dir):
    v = F.floor("c_acctbal") + F.lit(0.25)
    rows = table(spark, sf_dir, "customer").select("c_custkey", v.alias("v"))
    return rows.select("c_custkey", numbers.format_amount(F.col("v"), F.lit("ratio")).alias("pct"),
                       numbers.format_amount(F.col("v"), F.lit("yuan_per_share")).alias("per_share"),
                       numbers.format_amount(F.col("v"), F.lit("wan")).alias("screen"),
                       numbers.format_amount(F.col("v") * 10, style="alert").alias("alert"),
                       numbers.format_amount(F.col("v"), style="report").alias("report"))


# risk and reports

YEARLY = f"(SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY stock_code, report_year ORDER BY {PERIOD_ORD} DESC) rn FROM {WIDE}) WHERE rn=1)"


@query("debt_ratio_alerts", "CP6", sql(
    "SELECT stock_code, report_year, report_period, '偿债风险' alert_type, '资产负债率>70%' rule, 'high' severity, r AS value, '高负债风险' suggestion FROM "
    f"(SELECT *, {D('liability_total_liabilities')}/{D('asset_total_assets')} r FROM balance WHERE asset_total_assets>0) WHERE r>0.7"))
def debt_ratio_alerts(spark, sf_dir):
    return risk.debt_ratio_alerts(statement(spark, sf_dir, "balance"))


@query("low_return_alerts", "CP6", sql(
    "SELECT stock_code, report_year, report_period, 'ROE风险' alert_type, 'ROE<5%' rule, 'low' severity, r AS value, '股东回报能力较弱' suggestion FROM "
    f"(SELECT *, {D('net_profit')}/{D('equity_total_equity')} r FROM {WIDE} WHERE equity_total_equity>0) WHERE r<0.05 AND r>-1"))
def low_return_alerts(spark, sf_dir):
    return risk.low_return_alerts(statement_wide(spark, sf_dir))


@query("negative_cash_years", "WN10", sql(
    "SELECT stock_code, MAX(report_year) report_year, CAST(NULL AS VARCHAR) report_period, '现金流风险' alert_type, '经营现金流连续为负' rule, 'high' severity, CAST(COUNT(*) AS DOUBLE) AS value, '现金流风险' suggestion FROM "
    f"{YEARLY} WHERE operating_cf_net_amount<0 GROUP BY 1 HAVING COUNT(*)>=2"))
def negative_cash_years(spark, sf_dir):
    return risk.negative_cash_alerts(statement(spark, sf_dir, "cashflow"))


@query("negative_cash_runs", "WN10", sql(
    "SELECT stock_code, MAX(last_neg) report_year, MAX(n) run FROM (SELECT stock_code, g, COUNT(*) n, MAX(report_year) last_neg FROM (SELECT stock_code, report_year, "
    f"yr - ROW_NUMBER() OVER (PARTITION BY stock_code ORDER BY yr) g FROM (SELECT stock_code, report_year, operating_cf_net_amount c, ROW_NUMBER() OVER (PARTITION BY stock_code ORDER BY report_year) yr FROM {YEARLY}) WHERE c<0) GROUP BY 1,2) GROUP BY 1 HAVING MAX(n)>=2"))
def negative_cash_runs(spark, sf_dir):
    return risk.negative_cash_alerts(statement(spark, sf_dir, "cashflow"), consecutive=True).select(
        "stock_code", "report_year", F.col("value").cast("long").alias("run"))


def _gap(metric):
    return (f"SELECT stock_code, report_year, gm metric_growth, gb base_growth FROM (SELECT stock_code, report_year, ({D(metric)}-m0)/m0 gm, ({D('total_operating_revenue')}-b0)/b0 gb FROM "
            f"(SELECT *, {D(f'LAG({metric}) OVER w')} m0, {D('LAG(total_operating_revenue) OVER w')} b0 FROM {YEARLY} WINDOW w AS (PARTITION BY stock_code ORDER BY report_year)) WHERE m0>=1000 AND b0>=1000) WHERE abs(gm)<=10 AND abs(gb)<=10 AND gm>gb AND gm>0.1")


@query("receivable_growth_gap", "WN9", sql(_gap("asset_accounts_receivable")))
def receivable_growth_gap(spark, sf_dir):
    return risk.growth_gap(statement_wide(spark, sf_dir), "asset_accounts_receivable").select("stock_code", "report_year", "metric_growth", "base_growth")


@query("inventory_growth_gap", "WN9", sql(_gap("asset_inventory")))
def inventory_growth_gap(spark, sf_dir):
    return risk.growth_gap(statement_wide(spark, sf_dir), "asset_inventory").select("stock_code", "report_year", "metric_growth", "base_growth")


@query("profit_decline_years", "WN11", sql(
    "SELECT stock_code, MAX(report_year) report_year, COUNT(*) declines FROM (SELECT stock_code, report_year, net_profit < LAG(net_profit) OVER (PARTITION BY stock_code ORDER BY report_year) down "
    f"FROM {YEARLY}) WHERE down GROUP BY 1 HAVING COUNT(*)>=2"))
def profit_decline_years(spark, sf_dir):
    return risk.profit_decline_alerts(statement(spark, sf_dir, "income")).select(
        "stock_code", "report_year", F.col("value").cast("long").alias("declines"))


ALERTS = (
    "alerts AS (SELECT stock_code, report_year, report_period, 'D' k, 'high' severity, '高负债风险' suggestion, 1 tord FROM balance WHERE asset_total_assets>0 AND "
    f"{D('liability_total_liabilities')}/{D('asset_total_assets')}>0.7 "
    f"UNION ALL SELECT stock_code, MAX(report_year), NULL, 'C', 'high', '现金流风险', 2 FROM {YEARLY} WHERE operating_cf_net_amount<0 GROUP BY 1 HAVING COUNT(*)>=2 "
    f"UNION ALL SELECT stock_code, report_year, NULL, 'R', 'mid', '回款能力下降', 3 FROM ({_gap('asset_accounts_receivable')}) "
    f"UNION ALL SELECT stock_code, report_year, NULL, 'I', 'mid', '库存积压风险', 4 FROM ({_gap('asset_inventory')}) "
    "UNION ALL SELECT stock_code, MAX(report_year), NULL, 'P', 'high', '盈利能力下滑', 5 FROM (SELECT stock_code, report_year, net_profit < LAG(net_profit) OVER (PARTITION BY stock_code ORDER BY report_year) down "
    f"FROM {YEARLY}) WHERE down GROUP BY 1 HAVING COUNT(*)>=2 "
    f"UNION ALL SELECT stock_code, report_year, report_period, 'E', 'low', '股东回报能力较弱', 6 FROM {WIDE} WHERE equity_total_equity>0 AND {D('net_profit')}/{D('equity_total_equity')}<0.05 AND {D('net_profit')}/{D('equity_total_equity')}>-1)")


@query("risk_alerts", "CP6 AG20 JN2 WN21", sql(
    f"SELECT stock_code, report_year, severity, suggestion FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY stock_code, k ORDER BY report_year DESC, {PERIOD_ORD} DESC) rn FROM alerts) WHERE rn=1", ALERTS))
def risk_alerts(spark, sf_dir):
    s = statements(spark, sf_dir, ["income", "balance", "cashflow"])
    return risk_report.risk_alerts(list(s.values())).select("stock_code", "report_year", "severity", "suggestion")


@query("alert_summary", "AG20 TK6", sql(
    "SELECT stock_code, COUNT(*) alert_count, COUNT(*) FILTER (severity='high') high_count, COUNT(*) FILTER (severity='mid') mid_count, COUNT(*) FILTER (severity='low') low_count FROM "
    "(SELECT DISTINCT stock_code, k, severity FROM alerts) GROUP BY 1", ALERTS))
def alert_summary(spark, sf_dir):
    from quillstat.session import durable

    return risk.alert_summary(risk.all_alerts(durable(statement_wide(spark, sf_dir)))).drop("summary")


@query("severity_order", "TK6", 
    "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'high' WHEN 'O' THEN 'mid' WHEN 'P' THEN 'low' ELSE 'none' END severity, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 WHEN 'P' THEN 2 ELSE 3 END position FROM orders")
def severity_order(spark, sf_dir):
    s = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.when(s == "F", "high").when(s == "O", "mid").when(s == "P", "low").otherwise("none").alias("severity"))
    return rows.withColumn("position", topk.severity_ordinal(F.col("severity"))).orderBy("position", "o_orderkey")


@query("company_report", "CP7 FN4 FN5 WN6", sql(
    "SELECT stock_code, report_year, report_period, total_operating_revenue, net_profit, gross_margin, net_margin, roe, debt_ratio, operating_cf_net_amount, COALESCE(alert_count,0) alert_count, COALESCE(high_count,0) high_count, "
    "CASE WHEN roe>0.15 THEN '盈利能力较强' WHEN roe>0.05 THEN '盈利能力一般' WHEN roe>0 THEN '盈利能力偏弱' ELSE '盈利能力较弱，需关注' END profit_rating, "
    "CASE WHEN debt_ratio IS NULL THEN '数据不足，无法评价' WHEN debt_ratio<0.4 THEN '偿债压力较低' WHEN debt_ratio<0.6 THEN '偿债压力适中' ELSE '偿债风险较高' END debt_rating, "
    "CASE WHEN operating_cf_net_amount>0 THEN '现金流健康' ELSE '现金流承压' END cash_rating FROM (SELECT *, "
    f"CASE WHEN total_operating_revenue>0 THEN ({D('total_operating_revenue')}-{D('operating_expense_cost_of_sales')})/{D('total_operating_revenue')} END gross_margin, CASE WHEN total_operating_revenue>0 THEN {D('net_profit')}/{D('total_operating_revenue')} END net_margin, "
    f"CASE WHEN equity_total_equity>0 THEN {D('net_profit')}/{D('equity_total_equity')} END roe, CASE WHEN asset_total_assets>0 THEN {D('liability_total_liabilities')}/{D('asset_total_assets')} END debt_ratio FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY stock_code ORDER BY report_year DESC, {PERIOD_ORD} DESC) rn FROM {WIDE}) WHERE rn=1) "
    "LEFT JOIN (SELECT stock_code, COUNT(*) alert_count, COUNT(*) FILTER (severity='high') high_count FROM (SELECT DISTINCT stock_code, k, severity FROM alerts) GROUP BY 1) USING (stock_code)", ALERTS))
def company_report(spark, sf_dir):
    s = statements(spark, sf_dir, ["income", "balance", "cashflow"])
    return risk_report.company_report(list(s.values())).drop("stock_abbr", "asset_total_assets", "liability_total_liabilities", "alerts", "conclusion")


# quality

METRICS = ["total_operating_revenue", "net_profit", "asset_total_assets", "liability_total_liabilities", "operating_cf_net_amount"]
LONG = "(SELECT stock_code, stock_abbr, report_year, report_period, c AS \"column\", v AS value FROM (SELECT stock_code, stock_abbr, report_year, report_period, unnest([" + ",".join(f"'{m}'" for m in METRICS) + "]) c, unnest([" + ",".join(D(m) for m in METRICS) + f"]) v FROM {WIDE}))"


@query("profile_columns", "AG2", sql(
    f"SELECT \"column\", COUNT(*) n_rows, COUNT(*)-COUNT(value) n_null, COUNT(value) n_value, MIN(value) AS min, MAX(value) AS max, CAST(AVG(value) AS DECIMAL(20,2)) AS mean, COUNT(value)=0 all_null FROM {LONG} GROUP BY 1"))
def profile_columns(spark, sf_dir):
    return stats.profile_columns(statement_wide(spark, sf_dir), METRICS).withColumn("mean", F.col("mean").cast("decimal(20,2)"))


@query("mean_multiple_outliers", "AG3", 
    "SELECT c_custkey, 'spend' AS \"column\", s AS value FROM (SELECT o_custkey c_custkey, CAST(SUM(CAST(o_totalprice AS DECIMAL(14,2))*(CASE WHEN o_custkey%97=0 THEN 40 ELSE 1 END)) AS DOUBLE) s FROM orders GROUP BY 1) WHERE s > 10*(SELECT AVG(s) FROM (SELECT CAST(SUM(CAST(o_totalprice AS DECIMAL(14,2))*(CASE WHEN o_custkey%97=0 THEN 40 ELSE 1 END)) AS DOUBLE) s FROM orders GROUP BY o_custkey))")
def mean_multiple_outliers(spark, sf_dir):
    weight = F.when(F.col("o_custkey") % 97 == 0, 40).otherwise(1)
    spend = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum(F.col("o_totalprice").cast("decimal(14,2)") * weight).cast("double").alias("spend"))
    return stats.mean_multiple_outliers(spend, ["spend"], ["c_custkey"])


@query("three_sigma_outliers", "AG5", sql(
    f"SELECT {DIMS}, l.\"column\", value, CAST((value-m)/s AS DECIMAL(12,4)) z FROM {LONG} l JOIN (SELECT \"column\", COUNT(value) n, AVG(value) m, stddev_pop(value) s FROM {LONG} GROUP BY 1) USING (\"column\") WHERE n>=10 AND s<>0 AND abs(value-m)>3*s"))
def three_sigma_outliers(spark, sf_dir):
    return stats.three_sigma(statement_wide(spark, sf_dir), METRICS, KEY_COLUMNS).withColumn("z", F.col("z").cast("decimal(12,4)"))


@query("duplicate_order_keys", "AG4", 
    "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem JOIN (SELECT l_orderkey, l_linenumber FROM lineitem GROUP BY 1,2 HAVING COUNT(*)>1) USING (l_orderkey, l_linenumber)")
def duplicate_order_keys(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return stats.duplicate_keys(rows, ["l_orderkey", "l_linenumber"])


@query("duplicate_filings", "AG4", 
    "SELECT user_id, event_type, n_files, files FROM (SELECT user_id, event_type, COUNT(*) n_files, array_to_string(list_sort(list(f)), ',') files FROM (SELECT DISTINCT user_id, event_type, 'f'||CAST(event_id%7 AS VARCHAR)||'.json' f FROM events) GROUP BY 1,2) WHERE n_files>1")
def duplicate_filings(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", F.concat(F.lit("f"), (F.col("event_id") % 7).cast("string"), F.lit(".json")).alias("file"))
    return stats.duplicate_filings(rows, ["user_id", "event_type"], "file")


@query("cumulative_continuity", "WN12", sql(
    "SELECT stock_code, stock_abbr, report_year, report_period, operating_cf_net_amount, pp previous_period, pv previous_value FROM (SELECT *, LAG(report_period) OVER w pp, LAG(operating_cf_net_amount) OVER w pv FROM cashflow "
    f"WINDOW w AS (PARTITION BY stock_code, report_year ORDER BY {PERIOD_ORD})) WHERE operating_cf_net_amount < pv*CAST(0.90 AS DECIMAL(3,2))"))
def cumulative_continuity(spark, sf_dir):
    rows = statement(spark, sf_dir, "cashflow").select(*KEY_COLUMNS, "operating_cf_net_amount")
    return quality.cumulative_continuity(rows, "operating_cf_net_amount")


@query("yoy_anomaly", "WN13", sql(
    "SELECT stock_code, stock_abbr, report_year, report_period, metric, value, py previous_year, pv previous_value, abs((value-pv)/pv) change FROM (SELECT *, LAG(report_year) OVER w py, LAG(value) OVER w pv FROM (SELECT stock_code, stock_abbr, report_year, report_period, 'total_operating_revenue' metric, "
    f"{D('total_operating_revenue')} AS value FROM income UNION ALL SELECT stock_code, stock_abbr, report_year, report_period, 'net_profit', {D('net_profit')} FROM income) WINDOW w AS (PARTITION BY stock_code, report_period, metric ORDER BY report_year)) WHERE report_year-py<=2 AND abs(pv)>100 AND value<>0 AND abs((value-pv)/pv)>10"))
def yoy_anomaly(spark, sf_dir):
    return quality.yoy_anomaly(statement(spark, sf_dir, "income"), ["total_operating_revenue", "net_profit"])


CHECK_CTE = (
    f"chk AS (SELECT i.stock_code, i.report_year, i.report_period, {D('i.total_operating_revenue')} rev, {D('i.operating_expense_cost_of_sales')} cost, {D('i.net_profit')} np, {D('b.asset_total_assets')} a, {D('b.liability_total_liabilities')} l, {D('b.equity_total_equity')} e, "
    f"{D('c.net_cash_flow')} ncf, {D('c.operating_cf_net_amount')} ocf, {D('c.investing_cf_net_amount')} icf, {D('c.financing_cf_net_amount')} fcf, {D('k.net_profit')} knp, k.eps, {D('k.total_share_capital')} sh, k.roe "
    "FROM income i JOIN balance b USING (stock_code, report_year, report_period) JOIN cashflow c USING (stock_code, report_year, report_period) JOIN core k USING (stock_code, report_year, report_period)), "
    "outcomes AS (SELECT stock_code, report_year, report_period, unnest(['cash_flow_internal','balance_identity','np_ocf_direction','eps_implied_np','revenue_gt_cost','revenue_positive','roe_range','cross_net_profit']) AS \"check\", unnest(["
    "CASE WHEN abs(ncf)<100 THEN abs(ocf+icf+fcf)<200 ELSE abs((ncf-(ocf+icf+fcf))/ncf)<0.02 END, CASE WHEN a<>0 THEN abs(a-(l+e))/abs(a)<0.02 END, CASE WHEN abs(np)>100 AND abs(ocf)>100 THEN ocf/np>-0.2 AND ocf/np<5.0 END, "
    "CASE WHEN sh>0 AND abs(np)>100 THEN CASE WHEN eps*sh*np>0 THEN eps*sh/np>0.5 AND eps*sh/np<2.0 ELSE abs(eps*sh-np)<greatest(abs(np),100) END END, CASE WHEN rev>0 THEN rev>cost END, rev>0, roe>=-0.5 AND roe<=0.5, CASE WHEN abs(np)>100 THEN abs(np-knp)/abs(np)<0.05 END]) passed FROM chk)")


def check_inputs(spark, sf_dir):
    """Rule inputs of every filing, straight from the wide statement row."""
    names = {"inc": ["total_operating_revenue", "operating_expense_cost_of_sales", "net_profit"],
             "bal": ["asset_total_assets", "liability_total_liabilities", "equity_total_equity"],
             "cf": ["net_cash_flow", "operating_cf_net_amount", "investing_cf_net_amount", "financing_cf_net_amount"],
             "cpi": ["eps", "total_share_capital", "roe"]}
    wide = statement_wide(spark, sf_dir)
    cols = [F.col(f).alias(f"{p}__{f}") for p, fs in names.items() for f in fs]
    return wide.select("stock_code", "report_year", "report_period", *cols, F.col("core_net_profit").alias("cpi__net_profit"))


@query("consistency_checks", "AG6 CP5", sql(
    "SELECT stock_code, report_year, report_period, \"check\", passed FROM outcomes WHERE passed IS NOT NULL", CHECK_CTE))
def consistency_checks(spark, sf_dir):
    return quality.consistency_checks(check_inputs(spark, sf_dir), ["stock_code", "report_year", "report_period"])


@query("validation_and_decision", "AG7 AG8", sql(
    "SELECT stock_code, report_year, report_period, passed, total, CAST(round_even(passed/total*100, 0) AS INTEGER) score, conf confidence, CASE WHEN conf>=80 THEN 'auto' WHEN conf>=60 THEN 'flagged' ELSE 'rejected' END decision FROM (SELECT *, "
    "CAST(ROUND(CAST(0.25 AS DECIMAL(3,2))*CAST(CASE WHEN report_period='FY' THEN 95 WHEN report_period='Q1' THEN 50 ELSE 75 END AS DECIMAL(10,2)) + CAST(0.25 AS DECIMAL(3,2))*80 + CAST(0.20 AS DECIMAL(3,2))*100 + CAST(0.30 AS DECIMAL(3,2))*CAST(round_even(passed/total*100,0) AS DECIMAL(10,2)), 1) AS DECIMAL(16,1)) conf FROM "
    "(SELECT stock_code, report_year, report_period, CAST(COUNT(*) FILTER (passed) AS INTEGER) passed, CAST(COUNT(passed) AS INTEGER) total FROM outcomes GROUP BY 1,2,3))", CHECK_CTE))
def validation_and_decision(spark, sf_dir):
    rows = check_inputs(spark, sf_dir)
    passed, total = quality.rule_counts(rows)
    scored = rows.select("stock_code", "report_year", "report_period", passed.alias("passed"), total.alias("total"))
    p = F.col("report_period")
    source = F.when(p == "FY", "pdfplumber_standard").when(p == "Q1", "llm_fallback").otherwise("pdfplumber_density")
    score = quality.validation_score(F.col("passed"), F.col("total"))
    conf = quality.confidence(quality.source_score(source), F.lit(80), quality.volume_score(F.lit(13)), score)
    return scored.withColumn("score", score).withColumn("confidence", conf.cast("decimal(16,1)")).withColumn(
        "decision", quality.decision(F.col("confidence")))


@query("logic_violations", "CP4", sql(
    f"SELECT {DIMS}, 'revenue_ge_profit' rule FROM {WIDE} WHERE total_operating_revenue>0 AND net_profit<>0 AND total_operating_revenue<net_profit UNION ALL "
    f"SELECT {DIMS}, 'assets_ge_liabilities' FROM {WIDE} WHERE asset_total_assets<>0 AND liability_total_liabilities<>0 AND asset_total_assets*CAST(0.72 AS DECIMAL(4,2))<liability_total_liabilities"))
def logic_violations(spark, sf_dir):
    rows = statement_wide(spark, sf_dir).withColumn("asset_total_assets", F.col("asset_total_assets") * F.lit("0.72").cast("decimal(4,2)"))
    return quality.logic_violations(rows, KEY_COLUMNS)


@query("quality_report", "CP4 AG2 AG3 AG4 AG5 WN12 WN13", sql(
    "SELECT 'duplicate_keys' AS \"check\", 0 issues UNION ALL SELECT 'continuity', 0 UNION ALL SELECT 'mean_multiple', (SELECT COUNT(*) FROM lng JOIN st USING (\"column\") WHERE m>0 AND value>10*m) UNION ALL "
    "SELECT 'three_sigma', (SELECT COUNT(*) FROM lng JOIN st USING (\"column\") WHERE n>=10 AND s<>0 AND abs(value-m)>3*s) UNION ALL SELECT 'all_null_columns', 0 UNION ALL SELECT 'logic', (SELECT COUNT(*) FROM income WHERE total_operating_revenue<net_profit AND net_profit<>0) UNION ALL "
    "SELECT 'yoy_change', (SELECT COUNT(*) FROM (SELECT *, LAG(report_year) OVER w py, LAG(value) OVER w pv FROM lng WHERE \"column\" IN ('total_operating_revenue','net_profit') WINDOW w AS (PARTITION BY stock_code, report_period, \"column\" ORDER BY report_year)) WHERE report_year-py<=2 AND abs(pv)>100 AND value<>0 AND abs((value-pv)/pv)>10)",
    f"lng AS {LONG}, st AS (SELECT \"column\", COUNT(value) n, AVG(value) m, stddev_pop(value) s FROM lng GROUP BY 1)"))
def quality_summary(spark, sf_dir):
    return quality_report(statement_wide(spark, sf_dir), METRICS)


@query("load_summary_by_period", "AG9", sql(
    "SELECT CASE report_period WHEN 'FY' THEN 'auto' WHEN 'Q1' THEN 'rejected' ELSE 'flagged' END decision, COUNT(*) n FROM income GROUP BY 1"))
def load_summary_by_period(spark, sf_dir):
    p = F.col("report_period")
    conf = F.when(p == "FY", 91.5).when(p == "Q1", 55.0).otherwise(70.0)
    return quality.load_summary(statement(spark, sf_dir, "income").withColumn("decision", quality.decision(conf)))
