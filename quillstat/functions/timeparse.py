"""Time expressions in questions, as one struct per text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstat.functions import fixed
from quillstat.functions.expr import let

TIME_TYPE = "struct<type:string,year:int,quarter:int,half:int,year_start:int,year_end:int,rolling:int,period:string,label:string>"


def _group(text: Column, pattern: str, group: int = 1) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def cn_number(token: Column) -> Column:
    """Digits or one Chinese numeral → integer, null otherwise."""
    names = F.create_map(*[F.lit(x) for kv in fixed.CN_DIGITS.items() for x in kv])
    return F.coalesce(token.try_cast("int"), F.try_element_at(names, token))


def _suffix(tail: Column) -> Column:
    """Period code of the wording right after a year."""
    chain = None
    for word, code in fixed.PERIOD_SUFFIXES:
        chain = F.when(tail.startswith(word), code) if chain is None else chain.when(tail.startswith(word), code)
    latin = F.upper(F.regexp_extract(tail, r"^([QqHhFf][1-4Yy])", 1))
    return chain.when(latin == "Q4", "FY").when(latin.isin("Q1", "Q2", "Q3", "H1", "H2", "FY"), latin)


def parse_time_expression(text: Column, current_year: Column | int) -> Column:
    """Struct with type, year, quarter, half, range, rolling years, period and label.

    Order: range, rolling, year with quarter, year with half, written year, relative year, bare year, latest.
    ``current_year`` is a parameter so that a batch is reproducible.
    """
    now = F.lit(current_year) if isinstance(current_year, int) else current_year
    quarter = r"(20\d{2})\s*(?:[Qq]([1-4])|([一二三四])季度|([一二三四])季报|(前三)季度|(年报|年度|FY))"
    half = r"(20\d{2})\s*(?:[Hh]([12])|(半年报|半年度|上半年|中报)|(下半年))"
    span = r"(20\d{2})\s*[-~到至—]\s*(20\d{2})"
    short = r"(?s)(?:^|[^A-Za-z\d])(\d{2})年(.*)$"
    # every pattern is matched once; what follows works on the matches
    found = {
        "a": _group(text, span, 1), "b": _group(text, span, 2), "n": _group(text, r"近(\d|[一二两三四五六七八九十]+)年"),
        "qy": _group(text, quarter, 1), "q1": _group(text, quarter, 2), "q2": F.coalesce(_group(text, quarter, 3), _group(text, quarter, 4)),
        "q3": _group(text, quarter, 5), "q4": _group(text, quarter, 6),
        "hy": _group(text, half, 1), "h1": _group(text, half, 2), "h2": _group(text, half, 3), "h3": _group(text, half, 4),
        "y": _group(text, r"(20\d{2})年"), "yt": F.regexp_extract(text, r"(?s)20\d{2}年(.*)$", 1),
        "s": _group(text, short, 1), "st": F.regexp_extract(text, short, 2),
        "w": _group(text, r"(?:^|[^\d])(20\d{2})(?:[^\d]|$)"), "wt": F.regexp_extract(text, r"(?s)(?:^|[^\d])20\d{2}([^\d].*|)$", 1),
        "text": F.coalesce(text, F.lit("")), "now": now,
    }
    return let(F.struct(*[c.alias(n) for n, c in found.items()]), _interpret)


def _interpret(m: Column) -> Column:
    """Matches → time struct, in order of precedence."""
    g = m.getField
    now, text = g("now"), g("text")

    def make(kind, label, year=None, period=None, **more):
        fields = {"year": year, "quarter": None, "half": None, "year_start": None, "year_end": None, "rolling": None, **more}
        return F.struct(F.lit(kind).alias("type"), *[(F.lit(None) if c is None else c).cast("int").alias(n) for n, c in fields.items()],
                        (F.lit(None) if period is None else period).cast("string").alias("period"), label.cast("string").alias("label"))

    def text_of(year, code=None):
        return F.concat(year.cast("string"), F.lit("年"), F.lit("") if code is None else F.coalesce(code, F.lit("")))

    def number(name):
        return g(name).try_cast("int")

    def dated(year, tail):
        code = _suffix(g(tail))
        return make("year", text_of(year, code), year, code)

    lo, hi = F.least(number("a"), number("b")), F.greatest(number("a"), number("b"))
    n = F.coalesce(cn_number(g("n")), F.lit(3))
    q = F.coalesce(number("q1"), cn_number(g("q2")), F.when(g("q3").isNotNull(), 3), F.when(g("q4").isNotNull(), 4))
    q_code = F.when(q == 4, F.lit("FY")).otherwise(F.concat(F.lit("Q"), q.cast("string")))
    h = F.coalesce(number("h1"), F.when(g("h2").isNotNull(), 1), F.when(g("h3").isNotNull(), 2))
    h_code = F.concat(F.lit("H"), h.cast("string"))
    return (
        F.when(g("a").isNotNull(), make("range", F.concat(lo.cast("string"), F.lit("-"), text_of(hi)), year_start=lo, year_end=hi))
        .when(g("n").isNotNull(), make("rolling", F.concat(F.lit("近"), text_of(n)), year_start=now - n, year_end=now - 1, rolling=n))
        .when(q.isNotNull(), make("quarter", text_of(number("qy"), q_code), number("qy"), q_code, quarter=q))
        .when(h.isNotNull(), make("half", text_of(number("hy"), h_code), number("hy"), h_code, half=h))
        .when(g("y").isNotNull(), dated(number("y"), "yt")).when(g("s").isNotNull(), dated(number("s") + 2000, "st"))
        .when(text.contains("去年"), make("relative", F.lit("去年"), now - 1)).when(text.contains("前年"), make("relative", F.lit("前年"), now - 2))
        .when(text.contains("今年") | text.contains("本年"), make("relative", F.lit("今年"), now))
        .when(g("w").isNotNull(), dated(number("w"), "wt"))
        .when(text.contains("最新") | text.contains("最近"), make("latest", F.lit("最新数据")))
        .otherwise(make("latest", F.lit("未指定时间")))
    )


def time_label(t: Column) -> Column:
    return F.when(t.getField("type") == "latest", F.lit("(未指定时间，默认显示最新数据)")).otherwise(t.getField("label"))
