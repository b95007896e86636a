"""Metric queries: lookup, trend, compare, top-n, joins of statements, rankings, requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstat.catalog.base import PERIOD_ORD, PREFER_CUM, PREFER_HALF, query, sql
from quillstat.functions import fixed
from quillstat.operators import filters, joins, topk, windows
from quillstat.plans.metric_query import MetricRequest, metric_query
from quillstat.plans.views import TABLE_NAMES, amount_facts, statement, statement_wide, statements, table
from quillstat.session import work_path
from quillstat.sources import statements as store

DIMS = "stock_code, stock_abbr, report_year, report_period"


def named(spark, sf_dir):
    return {TABLE_NAMES[n]: df for n, df in statements(spark, sf_dir).items()}


@query("top_n_revenue", "TK1 FLT2 FLT4 FLT11 SRC3", sql(
    f"SELECT {DIMS}, total_operating_revenue FROM income WHERE report_year=1997 AND report_period='FY' "
    "ORDER BY total_operating_revenue DESC, stock_code LIMIT 5"))
def top_n_revenue(spark, sf_dir):
    rows = filters.at_period(filters.at_year(statement(spark, sf_dir, "income"), 1997), "年报")
    return topk.top_n(filters.metric_projection(rows, ["total_operating_revenue"], "top_n"), "total_operating_revenue", 5)


@query("lookup_by_name_part", "FLT1 CP8 FLT5", sql(
    f"SELECT {DIMS}, total_operating_revenue, net_profit, false AS substituted FROM income "
    # each name is looked for as a name, a code and a part of a name: 000012 also lies in Supplier#000000120
    "WHERE report_year=1998 AND report_period='FY' AND (" + " OR ".join(f"stock_abbr='{x}' OR stock_code='{x}' OR contains(stock_abbr,'{x}')" for x in ("Supplier#000000007", "000012", "#00000002")) + ")"))
def lookup_by_name_part(spark, sf_dir):
    request = MetricRequest("lookup", ["total_operating_revenue", "net_profit"], ["seven", "000012", "#00000002"],
                            year=1998, period="全年", aliases={"seven": "Supplier#000000007"})
    return metric_query(named(spark, sf_dir), request)


@query("trend_best_period", "WN3 TK2 CP8", sql(
    f"SELECT {DIMS}, net_profit, note, false AS substituted FROM (SELECT *, CASE WHEN report_period<>'FY' THEN "
    "'no annual figure, '||report_period||' used' END note, "
    f"ROW_NUMBER() OVER (PARTITION BY stock_code, report_year ORDER BY {PREFER_CUM} DESC) rn FROM income WHERE report_year BETWEEN 1996 AND 2000) WHERE rn=1"))
def trend_best_period(spark, sf_dir):
    return topk.trend_order(metric_query(named(spark, sf_dir), MetricRequest("trend", ["net_profit"], year=1996, year_end=2000)))


@query("compare_period_fallback", "WN4 JN4 ST4", sql(
    "SELECT r.stock_code, i.stock_abbr, 1999 AS report_year, i.report_period, i.total_operating_revenue, "
    "i.stock_abbr IS NULL AS no_data, CASE WHEN i.stock_abbr IS NULL THEN 'no data' WHEN i.report_period<>'FY' THEN 'no annual figure, '||i.report_period||' used' END note "
    "FROM (SELECT DISTINCT lpad(CAST(c_custkey AS VARCHAR),6,'0') stock_code FROM customer) r LEFT JOIN (SELECT * FROM (SELECT *, ROW_NUMBER() OVER "
    f"(PARTITION BY stock_code ORDER BY {PREFER_CUM} DESC) rn FROM income WHERE report_year=1999) WHERE rn=1) i USING (stock_code)"))
def compare_period_fallback(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("stock_code"))
    return windows.period_fallback(statement(spark, sf_dir, "income"), wanted, 1999, "total_operating_revenue").select(
        "stock_code", "stock_abbr", "report_year", "report_period", "total_operating_revenue", "no_data", "note")


@query("requested_with_missing", "JN4", sql(
    "SELECT r.stock_code, b.stock_abbr, b.report_year, b.report_period, b.asset_total_assets, b.report_year IS NULL AS no_data FROM "
    "(SELECT DISTINCT lpad(CAST(o_custkey AS VARCHAR),6,'0') stock_code FROM orders) r LEFT JOIN "
    "(SELECT * FROM balance WHERE report_year=2000 AND report_period='H1') b USING (stock_code)"))
def requested_with_missing(spark, sf_dir):
    wanted = table(spark, sf_dir, "orders").select(F.lpad(F.col("o_custkey").cast("string"), 6, "0").alias("stock_code"))
    rows = filters.at_period(filters.at_year(statement(spark, sf_dir, "balance"), 2000), "上半年")
    return joins.with_missing_entities(rows.select("stock_code", "stock_abbr", "report_year", "report_period", "asset_total_assets"), wanted)


@query("missing_members", "ST4", sql(
    "SELECT DISTINCT lpad(CAST(c_custkey AS VARCHAR),6,'0') stock_code FROM customer "
    "WHERE lpad(CAST(c_custkey AS VARCHAR),6,'0') NOT IN (SELECT stock_code FROM income)"))
def missing_members(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 6, "0").alias("stock_code"))
    return joins.missing_members(wanted, statement(spark, sf_dir, "income"), ["stock_code"])


@query("join_three_statements", "JN1", sql(
    "SELECT i.stock_code, i.stock_abbr, i.report_year, i.report_period, net_profit, asset_total_assets, operating_cf_net_amount "
    "FROM income i JOIN balance b USING (stock_code, report_year, report_period) JOIN cashflow c USING (stock_code, report_year, report_period) "
    "WHERE net_profit IS NOT NULL"))
def join_three_statements(spark, sf_dir):
    return joins.join_statements(named(spark, sf_dir), ["net_profit", "asset_total_assets", "operating_cf_net_amount"])


@query("merge_statements", "JN2 ST2", sql(
    "SELECT stock_code, report_year, report_period, stock_abbr, total_operating_revenue, net_profit, asset_total_assets, operating_cf_net_amount "
    "FROM (SELECT * FROM income WHERE report_year<=1999) i FULL JOIN (SELECT stock_code, report_year, report_period, stock_abbr, asset_total_assets FROM balance WHERE report_period<>'Q3') b "
    "USING (stock_code, report_year, report_period, stock_abbr) FULL JOIN (SELECT stock_code, report_year, report_period, stock_abbr, operating_cf_net_amount FROM cashflow WHERE report_year>=1998) c "
    "USING (stock_code, report_year, report_period, stock_abbr)"))
def merge_statements(spark, sf_dir):
    s = statements(spark, sf_dir)
    dims = ["stock_code", "stock_abbr", "report_year", "report_period"]
    return joins.merge_statements([
        s["income"].filter("report_year <= 1999").select(*dims, "total_operating_revenue", "net_profit"),
        s["balance"].filter("report_period <> 'Q3'").select(*dims, "asset_total_assets"),
        s["cashflow"].filter("report_year >= 1998").select(*dims, "operating_cf_net_amount"),
    ])


@query("dedupe_by_table_priority", "WN1 ST1", sql(
    "SELECT stock_code, stock_abbr, report_year, report_period, net_profit, table_priority FROM (SELECT *, ROW_NUMBER() OVER "
    "(PARTITION BY stock_code, report_year, report_period ORDER BY table_priority) rn FROM ("
    f"SELECT {DIMS}, net_profit, 1 table_priority FROM income WHERE report_year<>1996 UNION SELECT {DIMS}, net_profit, 4 FROM core)) WHERE rn=1"))
def dedupe_by_table_priority(spark, sf_dir):
    s = statements(spark, sf_dir)
    cols = ["stock_code", "stock_abbr", "report_year", "report_period", "net_profit"]
    rows = topk.union_tables([(1, s["income"].filter("report_year <> 1996").select(*cols)), (4, s["core"].select(*cols))])
    return windows.dedupe_by_table_priority(rows, "table_priority", ["net_profit"])


@query("best_period_per_entity", "WN2 FLT9 FLT10", sql(
    "SELECT stock_code, stock_abbr, report_year, report_period, net_profit, roe FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY stock_code ORDER BY "
    f"(CASE WHEN COALESCE(abs(roe)<=1000,true) AND COALESCE(abs(gross_profit_margin)<=1000,true) AND COALESCE(abs(net_profit_margin)<=1000,true) THEN 1 ELSE 0 END) DESC, {PREFER_HALF} DESC, report_year DESC) rn "
    "FROM core) WHERE rn=1"))
def best_period_per_entity(spark, sf_dir):
    rows = statement(spark, sf_dir, "core")
    return windows.best_period_per_entity(rows, ["net_profit", "roe"]).select(
        "stock_code", "stock_abbr", "report_year", "report_period", "net_profit", "roe")


@query("sane_row_counts", "FLT9 FLT10", sql(
    "SELECT report_year, COUNT(*) n_rows, CAST(SUM(CASE WHEN COALESCE(abs(roe)<=1,true) AND COALESCE(abs(gross_profit_margin)<=1,true) AND COALESCE(abs(net_profit_margin)<=1,true) THEN 1 ELSE 0 END) AS BIGINT) n_sane, "
    "CAST(SUM((CASE WHEN eps IS NOT NULL THEN 1 ELSE 0 END)+(CASE WHEN roe IS NOT NULL THEN 1 ELSE 0 END)) AS BIGINT) n_values FROM core GROUP BY report_year"))
def sane_row_counts(spark, sf_dir):
    rows = statement(spark, sf_dir, "core")
    return rows.groupBy("report_year").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum(filters.row_is_sane(rows, 1.0).cast("int")).alias("n_sane"),
        F.sum(filters.present_count(["eps", "roe"])).alias("n_values"))


@query("rank_in_period", "WN5", sql(
    "SELECT stock_code, stock_abbr, report_year, report_period, net_profit, ROW_NUMBER() OVER (PARTITION BY report_year, report_period ORDER BY net_profit DESC, stock_code) rank FROM income"))
def rank_in_period(spark, sf_dir):
    rows = statement(spark, sf_dir, "income").select("stock_code", "stock_abbr", "report_year", "report_period", "net_profit")
    return windows.rank(rows, "net_profit", by=["report_year", "report_period"])


@query("rank_all_orders", "WN5", "SELECT o_orderkey, o_totalprice, ROW_NUMBER() OVER (ORDER BY o_totalprice, o_orderkey) rank FROM orders")
def rank_all_orders(spark, sf_dir):
    return windows.rank(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice",
                        ascending=True, tie=["o_orderkey"])


@query("rank_top_per_segment", "WN5 TK1", "SELECT c_mktsegment, c_custkey, c_acctbal, rank FROM (SELECT *, ROW_NUMBER() OVER "
       "(PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) rank FROM customer) WHERE rank<=10")
def rank_top_per_segment(spark, sf_dir):
    return windows.rank(table(spark, sf_dir, "customer").select("c_mktsegment", "c_custkey", "c_acctbal"), "c_acctbal", 10,
                        by=["c_mktsegment"], tie=["c_custkey"])


@query("latest_per_entity", "WN6", sql(
    f"SELECT {DIMS}, net_cash_flow FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY stock_code ORDER BY report_year DESC, {PERIOD_ORD} DESC) rn FROM cashflow) WHERE rn=1"))
def latest_per_entity(spark, sf_dir):
    return windows.latest_per_entity(statement(spark, sf_dir, "cashflow")).select(
        "stock_code", "stock_abbr", "report_year", "report_period", "net_cash_flow")


@query("recent_rows_per_entity", "WN21", sql(
    f"SELECT {DIMS}, asset_total_assets FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY stock_code ORDER BY report_year DESC, {PERIOD_ORD} DESC) rn FROM balance) WHERE rn<=10"))
def recent_rows_per_entity(spark, sf_dir):
    return windows.recent_n(statement(spark, sf_dir, "balance"), 10).select(
        "stock_code", "stock_abbr", "report_year", "report_period", "asset_total_assets")


@query("first_row_per_year", "WN22", sql(
    f"SELECT {DIMS}, asset_inventory FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY stock_code, report_year ORDER BY {PERIOD_ORD} DESC) rn FROM balance) WHERE rn=1"))
def first_row_per_year(spark, sf_dir):
    return windows.first_row_per_year(statement(spark, sf_dir, "balance")).select(
        "stock_code", "stock_abbr", "report_year", "report_period", "asset_inventory")


@query("intersect_top_n", "ST3", sql(
    "SELECT a.report_year, a.stock_code, a.stock_abbr, a.total_operating_revenue, a.rn total_operating_revenue_rank, b.net_profit, b.rn net_profit_rank FROM "
    "(SELECT *, ROW_NUMBER() OVER (PARTITION BY report_year ORDER BY total_operating_revenue DESC, stock_code) rn FROM income WHERE report_period='FY') a JOIN "
    "(SELECT *, ROW_NUMBER() OVER (PARTITION BY report_year ORDER BY net_profit DESC, stock_code) rn FROM income WHERE report_period='FY') b USING (report_year, stock_code) "
    "WHERE a.rn<=20 AND b.rn<=20"))
def intersect_top_n(spark, sf_dir):
    rows = filters.at_period(statement(spark, sf_dir, "income"), "FY").drop("report_period")
    from quillstat.keys import EntityKeys

    return topk.intersect_top_n(rows, ["total_operating_revenue", "net_profit"], 20, by=["report_year"],
                                keys=_YearKeys(EntityKeys()))


class _YearKeys:
    """Keys of rows that are already one per entity and year."""

    def __init__(self, k):
        self.code, self.name, self.year = k.code, k.name, k.year
        self.row = [k.code, k.year]


@query("any_metric_present", "FLT5", sql(
    f"SELECT {DIMS}, asset_accounts_receivable, asset_inventory FROM (SELECT {DIMS}, NULLIF(asset_accounts_receivable,0) asset_accounts_receivable, NULLIF(asset_inventory,0) asset_inventory FROM balance) "
    "WHERE asset_accounts_receivable IS NOT NULL OR asset_inventory IS NOT NULL"))
def any_metric_present(spark, sf_dir):
    metrics = ["asset_accounts_receivable", "asset_inventory"]
    rows = statement(spark, sf_dir, "balance").select(
        "stock_code", "stock_abbr", "report_year", "report_period", *[F.nullif(F.col(m), F.lit(0)).alias(m) for m in metrics])
    return filters.any_metric_present(rows, metrics)


REQUESTS = ("(SELECT o_orderkey request_id, lpad(CAST(o_custkey%100 AS VARCHAR),6,'0') stock_code, "
            "CASE WHEN o_orderstatus='P' THEN year(o_orderdate)+4 ELSE year(o_orderdate) END want_year, "
            "CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'FY' WHEN '2' THEN 'Q2' WHEN '3' THEN 'Q1' WHEN '4' THEN 'Q3' END want_period FROM orders)")


def requests(spark, sf_dir):
    prio = F.substring("o_orderpriority", 1, 1)
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("request_id"),
        F.lpad((F.col("o_custkey") % 100).cast("string"), 6, "0").alias("stock_code"),
        (F.year("o_orderdate") + F.when(F.col("o_orderstatus") == "P", 4).otherwise(0)).alias("want_year"),
        F.when(prio == "1", "FY").when(prio == "2", "Q2").when(prio == "3", "Q1").when(prio == "4", "Q3").alias("want_period"))


@query("retry_ladder", "FLT13", sql(
    "SELECT request_id, stock_code, report_year, report_period, net_profit, best level FROM (SELECT *, MIN(level) OVER (PARTITION BY request_id) best FROM ("
    "SELECT r.request_id, r.stock_code, i.report_year, i.report_period, i.net_profit, CASE WHEN i.report_year=want_year AND (want_period IS NULL OR report_period=want_period) THEN 0 "
    f"WHEN i.report_year=want_year THEN 1 ELSE 2 END level FROM {REQUESTS} r JOIN income i USING (stock_code))) WHERE level<=best"))
def retry_ladder(spark, sf_dir):
    rows = statement(spark, sf_dir, "income").select("stock_code", "report_year", "report_period", "net_profit")
    return joins.retry_ladder(requests(spark, sf_dir), rows).drop("want_year", "want_period")


@query("in_time_requests", "FLT3", sql(
    "SELECT r.request_id, r.stock_code, i.report_year, i.report_period, i.total_operating_revenue FROM (SELECT *, o.request_id%4 k FROM "
    f"{REQUESTS} o) r JOIN income i USING (stock_code) JOIN (SELECT stock_code, MAX(report_year) newest FROM income GROUP BY 1) m USING (stock_code) "
    "WHERE CASE WHEN k=0 THEN i.report_year BETWEEN want_year-1 AND want_year WHEN k=1 THEN i.report_year=newest "
    "ELSE i.report_year=want_year AND (want_period IS NULL OR report_period=want_period) END"))
def in_time_requests(spark, sf_dir):
    k = F.col("request_id") % 4
    reqs = requests(spark, sf_dir).select("request_id", "stock_code", F.struct(
        F.when(k == 0, "range").when(k == 1, "latest").when(k == 2, "quarter").otherwise("year").alias("type"),
        F.col("want_year").alias("year"), F.col("want_period").alias("period"),
        (F.col("want_year") - 1).alias("year_start"), F.col("want_year").alias("year_end")).alias("t"))
    rows = statement(spark, sf_dir, "income").select("stock_code", "report_year", "report_period", "total_operating_revenue")
    return filters.in_time(rows, reqs, ["stock_code"]).drop("t")


METRIC_OF = ("CASE p_size%6 WHEN 0 THEN 'total_profit' WHEN 1 THEN 'net_profit' WHEN 2 THEN 'asset_inventory' WHEN 3 THEN 'eps' "
             "WHEN 4 THEN 'operating_cf_net_amount' ELSE 'goodwill' END")


@query("resolve_metric_requests", "FLT12 SRC4", 
    f"SELECT p_partkey, {METRIC_OF} metric, CASE p_size%6 WHEN 0 THEN 'net_profit' WHEN 1 THEN 'net_profit' WHEN 2 THEN 'asset_inventory' WHEN 3 THEN 'eps' WHEN 4 THEN 'operating_cf_net_amount' END field, "
    "CASE p_size%6 WHEN 0 THEN 'income_sheet' WHEN 1 THEN 'income_sheet' WHEN 2 THEN 'balance_sheet' WHEN 3 THEN 'core_performance_indicators_sheet' WHEN 4 THEN 'cash_flow_sheet' END table_name, "
    "CASE p_size%6 WHEN 0 THEN true WHEN 5 THEN NULL ELSE false END substituted FROM part")
def resolve_metric_requests(spark, sf_dir):
    k = F.col("p_size") % 6
    asked = table(spark, sf_dir, "part").select("p_partkey", F.when(k == 0, "total_profit").when(k == 1, "net_profit").when(
        k == 2, "asset_inventory").when(k == 3, "eps").when(k == 4, "operating_cf_net_amount").otherwise("goodwill").alias("metric"))
    catalog = store.column_catalog(named(spark, sf_dir))
    owners = spark.createDataFrame([(f, t) for f, t, _, _ in fixed.FIELDS], "field string, table string")
    swaps = spark.createDataFrame(fixed.SUBSTITUTES, "missing string, field string")
    return joins.resolve_metric(asked, catalog, owners, swaps)


@query("column_catalog_counts", "SRC4", sql(
    "SELECT 'income_sheet' table_name, 'net_profit' column_name, COUNT(net_profit) n FROM income UNION ALL SELECT 'income_sheet','total_operating_revenue',COUNT(total_operating_revenue) FROM income "
    "UNION ALL SELECT 'income_sheet','operating_expense_cost_of_sales',COUNT(*) FROM income UNION ALL SELECT 'income_sheet','operating_expense_selling_expenses',COUNT(*) FROM income "
    "UNION ALL SELECT 'cash_flow_sheet', c, n FROM (SELECT COUNT(*) n FROM cashflow), (SELECT unnest(['operating_cf_net_amount','investing_cf_net_amount','financing_cf_net_amount','net_cash_flow']) c) "
    "UNION ALL SELECT 'balance_sheet', c, n FROM (SELECT COUNT(*) n FROM balance), (SELECT unnest(['asset_total_assets','liability_total_liabilities','equity_total_equity','asset_accounts_receivable','asset_inventory','asset_cash_and_cash_equivalents','liability_short_term_loans']) c)"))
def column_catalog_counts(spark, sf_dir):
    tables = {t: df for t, df in named(spark, sf_dir).items() if t != fixed.CORE_TABLE}
    facts = amount_facts(spark, sf_dir).groupBy("table_name", F.col("field").alias("column_name")).agg(F.count("value").alias("n"))
    return store.column_catalog(tables).join(facts, ["table_name", "column_name"])


@query("table_of_field", "JN16", sql(
    "SELECT f.field, COALESCE(t.tbl,'core_performance_indicators_sheet') table_name, n FROM (SELECT "
    "CASE l_linenumber%4 WHEN 0 THEN 'net_profit' WHEN 1 THEN 'asset_inventory' WHEN 2 THEN 'eps' ELSE 'unlisted' END field, COUNT(*) n FROM lineitem GROUP BY 1) f LEFT JOIN "
    "(SELECT * FROM (VALUES ('net_profit','income_sheet'),('asset_inventory','balance_sheet'),('eps','core_performance_indicators_sheet')) v(field,tbl)) t USING (field)"))
def table_of_field(spark, sf_dir):
    k = F.col("l_linenumber") % 4
    used = table(spark, sf_dir, "lineitem").groupBy(
        F.when(k == 0, "net_profit").when(k == 1, "asset_inventory").when(k == 2, "eps").otherwise("unlisted").alias("field")
    ).agg(F.count(F.lit(1)).alias("n"))
    return joins.table_of_field(used, spark.createDataFrame([(f, t) for f, t, _, _ in fixed.FIELDS], "field string, table string"))


@query("ordered_distinct_parts", "ST5", "SELECT l_orderkey, l_partkey%7 item, MIN(l_linenumber) position FROM lineitem GROUP BY 1,2")
def ordered_distinct_parts(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_partkey") % 7).alias("item"), F.col("l_linenumber").alias("position"))
    return joins.ordered_distinct(items, ["l_orderkey"], "item", "position")


@query("newest_first", "TK3", sql(
    f"SELECT {DIMS}, net_profit FROM income ORDER BY report_year DESC, {PERIOD_ORD} DESC, stock_code"))
def newest_first(spark, sf_dir):
    return topk.newest_first(statement(spark, sf_dir, "income").select("stock_code", "stock_abbr", "report_year", "report_period", "net_profit"))


@query("distinct_entities", "AG25", sql("SELECT DISTINCT stock_code, stock_abbr FROM income"))
def distinct_entities(spark, sf_dir):
    return store.distinct_entities(statement(spark, sf_dir, "income"))


@query("union_candidate_tables", "ST1", sql(
    f"SELECT {DIMS}, net_profit, 1 table_priority FROM income UNION SELECT {DIMS}, net_profit, 4 FROM core"))
def union_candidate_tables(spark, sf_dir):
    s = statements(spark, sf_dir)
    cols = ["stock_code", "stock_abbr", "report_year", "report_period", "net_profit"]
    return topk.union_tables([(1, s["income"].select(*cols)), (4, s["core"].select(*cols))])


@query("most_common_values", "TK8", "SELECT p_brand, COUNT(*) n FROM part GROUP BY 1 ORDER BY n DESC, p_brand LIMIT 10")
def most_common_values(spark, sf_dir):
    return topk.most_common(table(spark, sf_dir, "part"), "p_brand", 10)


@query("stored_statement_scan", "SRC3", sql(
    f"SELECT {DIMS}, net_profit FROM income WHERE report_year=1998"))
def stored_statement_scan(spark, sf_dir):
    path = work_path(spark, "income")
    store.write_statements(statement(spark, sf_dir, "income"), path)
    rows = store.read_statements(spark, path, ["stock_code", "stock_abbr", "report_year", "report_period", "net_profit"])
    return filters.at_year(rows, 1998)


TYPED = "CASE WHEN report_period='FY' THEN 'pdf_extracted' WHEN report_period='H1' THEN 'pdf_summary' ELSE 'manual' END report_type"


def typed(df):
    p = F.col("report_period")
    return df.withColumn("report_type", F.when(p == "FY", "pdf_extracted").when(p == "H1", "pdf_summary").otherwise("manual"))


@query("export_by_report_type", "SRC9", sql(
    f"SELECT {DIMS}, CAST(net_profit AS VARCHAR) net_profit, {TYPED} FROM income WHERE report_period IN ('FY','H1')"))
def export_by_report_type(spark, sf_dir):
    path = work_path(spark, "export")
    rows = typed(statement(spark, sf_dir, "income")).select("stock_code", "stock_abbr", "report_year", "report_period", "net_profit", "report_type")
    store.export_table(rows, "pdf", path)
    return spark.read.option("header", True).schema(
        "stock_code string, stock_abbr string, report_year int, report_period string, net_profit string, report_type string").csv(path)


@query("replace_by_source", "SRC12", sql(
    f"SELECT stock_code, report_year, report_period, net_profit, {TYPED} FROM income WHERE report_period IN ('Q1','Q3') "
    "UNION ALL SELECT stock_code, report_year, report_period, net_profit, 'pdf_extracted' FROM core WHERE report_period='FY'"))
def replace_by_source(spark, sf_dir):
    s = statements(spark, sf_dir)
    cols = ["stock_code", "report_year", "report_period", "net_profit"]
    new = s["core"].filter("report_period = 'FY'").select(*cols, F.lit("pdf_extracted").alias("report_type"))
    return store.replace_by_source(typed(s["income"]).select(*cols, "report_type"), "pdf", new)


@query("upsert_rows", "SRC10", sql(
    "SELECT stock_code, report_year, report_period, COALESCE(n.net_profit, o.net_profit) net_profit FROM (SELECT * FROM income WHERE report_year<=1999) o "
    "FULL JOIN (SELECT * FROM core WHERE report_year>=1998) n USING (stock_code, report_year, report_period)"))
def upsert_rows(spark, sf_dir):
    s = statements(spark, sf_dir)
    cols = ["stock_code", "report_year", "report_period", "net_profit"]
    return store.upsert(s["income"].filter("report_year <= 1999").select(*cols),
                        s["core"].filter("report_year >= 1998").select(*cols), ["stock_code", "report_year", "report_period"])


@query("condition_from_text", "FLT6", 
    "SELECT event_id, user_id, op, number, CASE op WHEN '>' THEN value>number WHEN '<' THEN value<number WHEN '>=' THEN value>=number WHEN '<=' THEN value<=number END passes FROM ("
    "SELECT event_id, user_id, value, CASE CAST(event_id%6 AS INTEGER) WHEN 0 THEN '>' WHEN 1 THEN '<' WHEN 2 THEN '>=' WHEN 3 THEN '<=' WHEN 4 THEN '>' END op, CAST(user_id AS DOUBLE) number FROM events)")
def condition_from_text(spark, sf_dir):
    k = F.col("event_id") % 6
    word = F.when(k == 0, "大于").when(k == 1, "小于").when(k == 2, "不低于").when(k == 3, "不高于").when(k == 4, "收入超过").otherwise("约")
    rows = table(spark, sf_dir, "events").withColumn("text", F.concat(word, F.col("user_id").cast("string"), F.lit("万元")))
    op, number = filters.condition_from_text(F.col("text"))
    return rows.select("event_id", "user_id", op.alias("op"), number.alias("number"),
                       filters.compare_values(F.col("value"), op, number).alias("passes"))


@query("fuzzy_condition_rows", "FLT7", sql(
    f"SELECT {DIMS}, net_profit, kind, passes FROM (SELECT *, CASE report_year%3 WHEN 0 THEN '亏损' WHEN 1 THEN '盈利' ELSE '正常' END kind, "
    "CASE report_year%3 WHEN 0 THEN net_profit<0 WHEN 1 THEN net_profit>0 END passes FROM income)"))
def fuzzy_condition_rows(spark, sf_dir):
    y = F.col("report_year") % 3
    rows = statement(spark, sf_dir, "income").withColumn("kind", F.when(y == 0, "亏损").when(y == 1, "盈利").otherwise("正常"))
    rule = filters.fuzzy_condition(F.concat(F.lit("哪些公司"), F.col("kind")))
    return rows.select("stock_code", "stock_abbr", "report_year", "report_period", "net_profit", "kind", filters.compare_values(
        F.col("net_profit").cast("double"), rule.getField("op"), rule.getField("value")).alias("passes"))


@query("filter_rows", "FLT8", sql(
    f"SELECT {DIMS}, total_operating_revenue, net_profit FROM income WHERE CAST(net_profit AS DOUBLE)>0 AND CAST(total_operating_revenue AS DOUBLE)<=2000000 AND report_year<>1997"))
def filter_rows(spark, sf_dir):
    rows = statement(spark, sf_dir, "income").select("stock_code", "stock_abbr", "report_year", "report_period", "total_operating_revenue", "net_profit")
    return filters.filter_rows(rows, [{"field": "net_profit", "op": ">", "value": 0}, {"field": "total_operating_revenue", "op": "<=", "value": 2e6},
                                      {"field": "report_year", "op": "!=", "value": 1997}])


@query("compare_companies", "CP8 WN2", sql(
    "SELECT stock_code, stock_abbr, report_year, report_period, total_operating_revenue, asset_total_assets, false substituted FROM (SELECT i.stock_code, i.stock_abbr, i.report_year, i.report_period, i.total_operating_revenue, b.asset_total_assets, ROW_NUMBER() OVER "
    f"(PARTITION BY i.stock_code ORDER BY {PREFER_HALF.replace('report_period','i.report_period')} DESC) rn FROM income i JOIN balance b USING (stock_code, report_year, report_period) WHERE i.report_year=1999 AND i.stock_abbr LIKE '%#00000000%') WHERE rn=1"))
def compare_companies(spark, sf_dir):
    return metric_query(named(spark, sf_dir), MetricRequest(
        "compare", ["total_operating_revenue", "asset_total_assets"], ["#00000000"], year=1999))


@query("top_n_substituted_metric", "CP8 FLT12", sql(
    f"SELECT {DIMS}, net_profit, true substituted FROM income WHERE report_year=1997 AND report_period='FY' ORDER BY net_profit DESC, stock_code LIMIT 10"))
def top_n_substituted_metric(spark, sf_dir):
    return metric_query(named(spark, sf_dir), MetricRequest("top_n", ["total_profit"], year=1997, period="FY"))


@query("statement_row_counts", "SRC3", sql(
    "SELECT report_year, report_period, COUNT(*) n_rows, SUM(total_operating_revenue) revenue, SUM(asset_total_assets) assets, SUM(net_cash_flow) cash "
    "FROM income JOIN balance USING (stock_code, report_year, report_period) JOIN cashflow USING (stock_code, report_year, report_period) GROUP BY 1,2"))
def statement_row_counts(spark, sf_dir):
    return statement_wide(spark, sf_dir).groupBy("report_year", "report_period").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("total_operating_revenue").alias("revenue"),
        F.sum("asset_total_assets").alias("assets"), F.sum("net_cash_flow").alias("cash"))
