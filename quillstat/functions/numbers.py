"""Number parsing, units and formatting as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.functions import fixed


# Texts that stand for a missing number.
MISSING = ["-", "--", "—", "不适", "N/A", "", "——"]


def parse_number(raw: Column) -> Column:
    """Text → double: missing marks, parentheses as minus, separators, footnote marks and percent signs."""
    t = F.trim(raw)
    bracketed = t.rlike(r"^\(.*\)$")
    inner = F.regexp_replace(F.regexp_replace(t, r"^\(|\)$", ""), ",", "")
    plain = F.regexp_replace(F.regexp_replace(t, r"[,，\s]", ""), r"[*]+$", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"†+$", ""), "%", "")
    number = F.when(bracketed, -inner.try_cast("double")).otherwise(plain.try_cast("double"))
    return F.when(t.isin(MISSING), F.lit(None).cast("double")).otherwise(number)


def normalize(raw: Column, unit_factor: Column, unit: Column, percent_aware: bool = False,
              digits: bool = True) -> Column:
    """Number in the canonical unit of its field.

    ``unit`` is the dictionary unit: per-share values stay, ratios above one are divided by 100, amounts
    become 10⁴ yuan (null above 10¹²). With ``percent_aware`` a percent sign decides about ratios instead.
    """
    v = parse_number(raw)
    rnd = F.round if digits else (lambda c, n: c)
    is_pct = raw.contains("%") if percent_aware else F.abs(rnd(v, 4)) > 1
    ratio = F.when(is_pct, rnd(v, 4) / 100).otherwise(rnd(v, 4))
    amount = rnd(v * unit_factor / F.lit(10000), 4)
    return (F.when(unit == "yuan_per_share", rnd(v, 4)).when(unit == "ratio", rnd(ratio, 6))
            .when(F.abs(amount) <= 1e12, amount))


def detect_unit(text: Column) -> Column:
    """Struct (factor, found, source): the first declaration in order of precedence, else (1, false, "")."""
    def entry(pattern, factor):
        source = F.regexp_extract(text, f"({pattern})", 1)
        return F.struct(factor.cast("long").alias("factor"), F.lit(True).alias("found"), source.alias("source"))

    in_text = fixed.UNIT_IN_TEXT
    read = reduce(lambda acc, p: acc.when(text.rlike(p[0]), F.lit(p[1])), in_text[1:],
                  F.when(text.rlike(in_text[0][0]), F.lit(in_text[0][1]))).otherwise(F.lit(1))
    chain = None
    for pattern, factor in [*fixed.UNIT_PATTERNS, *in_text]:
        value = entry(pattern, read if factor is None else F.lit(factor))
        chain = F.when(text.rlike(pattern), value) if chain is None else chain.when(text.rlike(pattern), value)
    none = F.struct(F.lit(1).cast("long").alias("factor"), F.lit(False).alias("found"), F.lit("").alias("source"))
    return F.coalesce(chain, none)


def unit_name(factor: Column) -> Column:
    names = F.create_map(*[F.lit(x) for n, f in fixed.UNIT_FACTORS for x in (f, n)])
    return F.coalesce(F.try_element_at(names, factor.cast("int")), F.lit("未知"))


def unit_factor(name: Column) -> Column:
    factors = F.create_map(*[F.lit(x) for pair in fixed.UNIT_FACTORS for x in pair])
    return F.try_element_at(factors, name)


def infer_unit(df: DataFrame, amounts: list[str], order: list[Column], digits: int | None = 4) -> DataFrame:
    """Divide the amounts by 10⁴ when the first non-zero amount of the frame in the given order exceeds 10⁸.

    All rows are looked at by one aggregate, which comes back as a one-row frame for the join.
    """
    first = reduce(lambda a, b: F.coalesce(a, b), [F.nullif(F.col(c).cast("double"), F.lit(0.0)) for c in amounts])
    head = df.select(first.alias("_v"), F.struct(*order).alias("_o"))
    sample = head.filter(F.col("_v").isNotNull()).agg(F.min_by("_v", "_o").alias("_v")).select(
        F.when(F.abs("_v") > 1e8, F.lit("元")).otherwise(F.lit("万元")).alias("source_unit"), F.lit(1).alias("_k"))
    joined = df.withColumn("_k", F.lit(1)).join(F.broadcast(sample), "_k").drop("_k")
    scaled = []
    for c in amounts:
        v = F.col(c).cast("double") / 10000
        v = v if digits is None else F.round(v, digits)
        scaled.append(F.when(F.col("source_unit") == "元", v).otherwise(F.col(c).cast("double")).alias(c))
    return joined.select(*[c for c in df.columns if c not in amounts], *scaled, "source_unit")


def _fixed2(c: Column, grouped: bool = False) -> Column:
    """Two decimals; ``grouped`` adds thousands separators."""
    return F.format_number(c, 2) if grouped else F.format_string("%.2f", c)


def format_amount(value: Column, unit: Column | None = None, style: str = "screen") -> Column:
    """Readable amount of a value in 10⁴ yuan.

    Styles: ``screen`` (ratio and per-share by dictionary unit, grouped below 10⁴), ``alert`` (short units),
    ``report`` (full units, "-" for null), ``answer`` (fractions below one shown as percent).
    """
    v = value.cast("double")
    a = F.abs(v)
    if style == "alert":
        out = F.when(a >= 10000, F.concat(_fixed2(v / 10000), F.lit("亿"))).otherwise(F.concat(_fixed2(v), F.lit("万")))
        return F.coalesce(out, F.lit("N/A"))
    if style == "report":
        out = F.when(a >= 10000, F.concat(_fixed2(v / 10000), F.lit("亿元"))).otherwise(F.concat(_fixed2(v), F.lit("万元")))
        return F.coalesce(out, F.lit("-"))
    unit = F.lit("wan") if unit is None else unit
    if style == "answer":
        out = (
            F.when((unit == "ratio") & (a < 1), F.concat(_fixed2(v * 100), F.lit("%")))
            .when((unit == "ratio") & (a < 100), F.concat(_fixed2(v), F.lit("%")))
            .when(a >= 10000, F.concat(_fixed2(v / 10000), F.lit(" 亿元")))
            .when(a >= 1, F.concat(_fixed2(v, True), F.lit(" 万元")))
            .otherwise(F.format_string("%.4f", v))
        )
        return F.when(v.isNull(), F.lit("N/A")).otherwise(out)
    out = (
        F.when(unit == "ratio", F.concat(_fixed2(v), F.lit("%")))
        .when((unit == "yuan_per_share") & (v >= 10000), F.concat(_fixed2(v, True), F.lit(" 元/股")))
        .when(unit == "yuan_per_share", F.concat(_fixed2(v), F.lit(" 元/股")))
        .when(a >= 10000, F.concat(_fixed2(v / 10000), F.lit(" 亿元")))
        .when(a >= 1, F.concat(_fixed2(v, True), F.lit(" 万元")))
        .when(a >= 0.01, F.concat(_fixed2(v), F.lit(" 万元")))
        .otherwise(F.format_string("%.4f", v))
    )
    return F.when(v.isNull(), F.lit("0")).otherwise(out)


def format_percent(value: Column) -> Column:
    return F.coalesce(F.concat(_fixed2(value.cast("double") * 100), F.lit("%")), F.lit("-"))
