"""Scalar rules on literal frames."""

import pytest
from pyspark.sql import functions as F

from quillstat.functions import calc, numbers, textclean
from quillstat.functions.timeparse import parse_time_expression
from quillstat.operators import pages, questions
from quillstat.sources.filings import filing_from_name

# Time wording with the expected type, year and period for current year 2026.
TIME_CASES = [
    ("2023", "year", 2023, None), ("2024年", "year", 2024, None), ("23年", "year", 2023, None), ("2024年年报", "year", 2024, "FY"),
    ("2023Q1", "quarter", 2023, "Q1"), ("2023一季度", "quarter", 2023, "Q1"), ("2023三季报", "quarter", 2023, "Q3"), ("2024前三季度", "quarter", 2024, "Q3"),
    ("2024H1", "half", 2024, "H1"), ("2024半年报", "half", 2024, "H1"), ("2024中报", "half", 2024, "H1"), ("2024下半年", "half", 2024, "H2"),
    ("2022到2024", "range", None, None), ("2022-2024", "range", None, None), ("近三年", "rolling", None, None), ("去年", "relative", 2025, None),
    ("前年净利润", "relative", 2024, None), ("今年", "relative", 2026, None), ("最新", "latest", None, None), ("600085", "latest", None, None),
]


def one(spark, expr, **cols):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'int' if isinstance(v, int) else 'double'}" for k, v in cols.items())
    return spark.createDataFrame([tuple(cols.values())], schema).select(expr.alias("x")).first()["x"]


def test_time_cases(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(TIME_CASES)], "i int, text string")
    got = {r["i"]: r["t"] for r in df.select("i", parse_time_expression(F.col("text"), 2026).alias("t")).collect()}
    for i, (text, kind, year, period) in enumerate(TIME_CASES):
        assert (got[i]["type"], got[i]["year"], got[i]["period"]) == (kind, year, period), text
    assert (got[14]["year_start"], got[14]["year_end"], got[14]["rolling"]) == (2023, 2025, 3)


@pytest.mark.parametrize("raw, value", [
    ("1,234.5", 1234.5), ("(1,234)", -1234.0), ("1，234", 1234.0), ("12%", 12.0), ("7*", 7.0), ("--", None), ("—", None), ("", None), ("N/A", None), ("abc", None), (" 3 000 ", 3000.0)])
def test_parse_number(spark, raw, value):
    assert one(spark, numbers.parse_number(F.col("a")), a=raw) == value


@pytest.mark.parametrize("raw, factor, unit, value", [
    ("5", 10000, "yuan_per_share", 5.0), ("45", 1, "ratio", 0.45), ("0.8", 1, "ratio", 0.8), ("20000", 1, "wan", 2.0), ("3", 100000000, "wan", 30000.0),
    ("1e20", 10000, "wan", None)])
def test_normalize(spark, raw, factor, unit, value):
    assert one(spark, numbers.normalize(F.col("a"), F.lit(factor), F.lit(unit)), a=raw) == value


def test_percent_aware(spark):
    assert one(spark, numbers.normalize(F.col("a"), F.lit(1), F.lit("ratio"), percent_aware=True), a="0.8%") == 0.008


@pytest.mark.parametrize("text, factor, found", [
    ("单位：万元", 10000, True), ("单位：元", 1, True), ("单位：元人", 1, False), ("人民币千元", 1000, True), ("以下数据的单位：人民币亿元", 100000000, True), ("没有", 1, False)])
def test_detect_unit(spark, text, factor, found):
    u = one(spark, numbers.detect_unit(F.col("a")), a=text)
    assert (u["factor"], u["found"]) == (factor, found)


def test_formulas(spark):
    row = spark.createDataFrame([(100000.0, 55000.0, 15000.0, 40000.0, 100000.0)],
                                "total_operating_revenue double, operating_expense_cost_of_sales double, net_profit double, liability_total_liabilities double, asset_total_assets double")
    r = row.select(*[calc.FORMULAS[n].build(4).alias(str(i)) for i, n in enumerate(["销售毛利率", "销售净利率", "资产负债率"])]).first()
    assert tuple(r) == (45.0, 15.0, 40.0)
    assert one(spark, calc.safe_pct("a", "b"), a=1.0, b=0.0) is None


@pytest.mark.parametrize("v, unit, text", [(12345.0, "wan", "1.23 亿元"), (1234.5, "wan", "1,234.50 万元"), (0.5, "wan", "0.50 万元"), (0.001, "wan", "0.0010"), (50.5, "ratio", "50.50%"), (1.2, "yuan_per_share", "1.20 元/股")])
def test_format(spark, v, unit, text):
    assert one(spark, numbers.format_amount(F.col("a"), F.lit(unit)), a=v) == text


def test_cleaning(spark):
    assert one(spark, textclean.clean_latex(F.col("a")), a=r"增长$1 2 . 5\%$和 3 4") == "增长12.5\\和 3 4"
    assert one(spark, textclean.clean_latex(F.col("a"), True), a="5%") == "5%"
    assert one(spark, textclean.clean_images(F.col("a")), a="a![x](y)b\n ![z](w) \nc") == "ab\n\nc"
    html = "<TABLE><tr><th>甲</th><th>乙</th></tr><tr><td>1</td><td></td></tr><tr><td>k</td><td>v</td><td>w</td></tr><tr><td>独</td></tr></TABLE>"
    assert one(spark, textclean.clean_html_tables(F.col("a")), a="x" + html + "y") == "x\n甲1；独\ny"
    assert one(spark, textclean.clean_characters(F.col("a")), a="中é，A\t�") == "中，A\t"
    long = "\n".join(["正文内容" * 10] * 5)
    assert one(spark, textclean.clean_footer(F.col("a")), a=long + "\n\n分析师声明\n更多") == long
    assert one(spark, textclean.clean_footer(F.col("a")), a="a\n\n" + "分析师声明" * 30) == ""


def test_tokens_and_bigrams(spark):
    assert sorted(one(spark, textclean.tokenize(F.col("a")), a="净利润 ABC 2024年 x")) == sorted(["abc", "2024", "x", "净利", "利润", "年"])
    assert one(spark, textclean.bigrams(F.col("a")), a="aab aab") == ["aa", "ab", "b ", " a"]


@pytest.mark.parametrize("text, role, year, period", [
    ("本期金额", "target", 2023, "FY"), ("上年同期", "prev", 2022, "FY"), ("增减变动", "delta", None, None), ("2023年12月31日", "target", 2023, "FY"),
    ("2022年", "prev", 2022, "FY"), ("2021年", "other", 2021, "FY"), ("2023年1-9月", "target", 2023, "Q3"), ("附注", "other", None, None)])
def test_column_role(spark, text, role, year, period):
    r = one(spark, pages.column_role(F.col("a"), F.lit(2023), F.lit("FY")), a=text)
    assert (r["role"], r["year"], r["period"]) == (role, year, period)


@pytest.mark.parametrize("name, expected", [
    ("600085_20250404_9F44.pdf", ("600085", None, 2025, "Q1")), ("600085_20250320_A.pdf", ("600085", None, 2024, "FY")),
    ("云南白药：2024年半年度报告.pdf", (None, "云南白药", 2024, "H1")), ("云南白药：2024年年度报告.pdf", (None, "云南白药", 2024, "FY"))])
def test_filing_names(spark, name, expected):
    assert tuple(one(spark, filing_from_name(F.col("a")), a=name)) == expected


@pytest.mark.parametrize("text, kind, rank", [("画图看看", "chart", None), ("生成报告", "report", None), ("第二名是谁", "rank", 2), ("前10名", "normal", 10), ("为什么", "analysis", None), ("那营收呢", "indicator", None)])
def test_request_kind(spark, text, kind, rank):
    got = one(spark, questions.request_kind(F.col("a"), F.lit(True) if kind == "normal" else None), a=text)
    assert got == kind
    assert one(spark, questions.rank_number(F.col("a")), a=text) == rank


def test_tag_line(spark):
    for line, tag in [("股票代码：600085", "metadata"), ("合并利润表", "table_header"), ("第一节 释义", "section_title"), ("目录", "toc"), ("正文", "text")]:
        assert one(spark, pages.tag_line(F.col("a")), a=line)["tag"] == tag


@pytest.mark.parametrize("raw, want", [("$$ 1 2 . 5 $$", " 12.5 "), ("a $1 2$ 3 4 $5 6$", "a 12 3 4 56"), ("cost $ 5 6", "cost  5 6"), ("$1 2$$3 4$", "1234"), ("$%\\alpha", ""), ("", "")])
def test_latex_pairs(spark, raw, want):
    from quillstat.functions.textclean import clean_latex

    row = spark.createDataFrame([(raw,)], "t string").select(clean_latex(F.col("t")).alias("x")).first()
    assert row.x == want
