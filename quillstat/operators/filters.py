"""Filters and predicates over statement rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.functions import fixed
from quillstat.keys import KEYS, EntityKeys
from quillstat.session import broadcast_if_small


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def contains_any(c: Column, words: list[str]) -> Column:
    return any_of([c.contains(w) for w in words])


def first_word(c: Column, pairs: list[tuple[str, str]], default: Column | None = None) -> Column:
    """The value of the first listed word that occurs in the text."""
    expr = reduce(lambda acc, p: acc.when(c.contains(p[0]), F.lit(p[1])), pairs[1:],
                  F.when(c.contains(pairs[0][0]), F.lit(pairs[0][1])))
    return expr if default is None else expr.otherwise(default)


def first_pattern(c: Column, pairs: list[tuple[str, object]], default: Column | None = None) -> Column:
    """The value of the first listed pattern that matches the text."""
    expr = reduce(lambda acc, p: acc.when(c.rlike(p[0]), F.lit(p[1])), pairs[1:],
                  F.when(c.rlike(pairs[0][0]), F.lit(pairs[0][1])))
    return expr if default is None else expr.otherwise(default)


def match_entity(df: DataFrame, names: list[str], aliases: dict[str, str] | None = None,
                 keys: EntityKeys = KEYS) -> DataFrame:
    """Rows whose entity is one of ``names``: alias first, then name, code or part of the name."""
    real = [(aliases or {}).get(n, n) for n in names]
    name, code = F.col(keys.name), F.col(keys.code)
    return df.filter(any_of([(name == x) | (code == x) | name.contains(x) for x in real]))


def at_year(df: DataFrame, year: int, keys: EntityKeys = KEYS) -> DataFrame:
    return df.filter(F.col(keys.year) == year)


def from_year(df: DataFrame, year: int, keys: EntityKeys = KEYS) -> DataFrame:
    return df.filter(F.col(keys.year) >= year)


def period_code(words: Column | str) -> Column:
    """Period wording → code; an exact wording first, then the first wording contained, else the text itself."""
    c = F.col(words) if isinstance(words, str) else words
    exact = F.create_map(*[F.lit(x) for pair in dict(fixed.PERIOD_WORDS).items() for x in pair])
    return F.coalesce(F.try_element_at(exact, c), first_word(c, fixed.PERIOD_WORDS), c)


def at_period(df: DataFrame, period: str, keys: EntityKeys = KEYS) -> DataFrame:
    return df.filter(F.col(keys.period) == period_code(F.lit(period)))


def in_time(df: DataFrame, requests: DataFrame, on: list[str], keys: EntityKeys = KEYS) -> DataFrame:
    """Rows that satisfy the time struct ``t`` of a request joined on ``on``.

    ``t`` has type, year, period, year_start and year_end. Without a time ("latest") the newest year of
    the request's entity is kept; that maximum is a grouped aggregate, not a window over the rows.
    """
    y, p = F.col(keys.year), F.col(keys.period)
    newest = df.groupBy(*on).agg(F.max(keys.year).alias("_newest"))
    joined = df.join(requests, on).join(newest, on)
    t = F.col("t")
    keep = (
        F.when(t.getField("type").isin("range", "rolling"), y.between(t.getField("year_start"), t.getField("year_end")))
        .when(t.getField("type") == "latest", y == F.col("_newest"))
        .otherwise((y == t.getField("year")) & (t.getField("period").isNull() | (p == t.getField("period"))))
    )
    return joined.filter(keep).drop("_newest")


def any_metric_present(df: DataFrame, metrics: list[str]) -> DataFrame:
    return df.filter(F.coalesce(*[F.col(m).cast("string") for m in metrics]).isNotNull())


def condition_from_text(text: Column) -> tuple[Column, Column]:
    """(operator, number) of a wording such as "大于100"; nulls without wording or number."""
    op = first_word(text, fixed.CONDITION_WORDS)
    number = F.regexp_extract(text, r"(\d+\.?\d*)", 1)
    return op, F.when(number != "", number.try_cast("double"))


def fuzzy_condition(text: Column) -> Column:
    """Struct (field, op, value) of the first fuzzy wording in the text, null without one."""
    def rule(w):
        return F.struct(F.lit(w[1]).alias("field"), F.lit(w[2]).alias("op"), F.lit(float(w[3])).alias("value"))

    words = fixed.FUZZY_WORDS
    return reduce(lambda acc, w: acc.when(text.contains(w[0]), rule(w)), words[1:],
                  F.when(text.contains(words[0][0]), rule(words[0])))


def compare_values(left: Column, op: Column, right: Column) -> Column:
    """Comparison whose operator is data."""
    return (F.when(op == ">", left > right).when(op == "<", left < right).when(op == ">=", left >= right)
            .when(op == "<=", left <= right).when(op == "==", left == right).when(op == "!=", left != right))


COMPARE = {
    ">": lambda a, b: a > b, "<": lambda a, b: a < b, ">=": lambda a, b: a >= b,
    "<=": lambda a, b: a <= b, "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
}


def filter_rows(df: DataFrame, conditions: list[dict]) -> DataFrame:
    """Conjunction of {field, op, value}; a missing or non-numeric value fails."""
    tests = [
        F.coalesce(COMPARE[c["op"]](F.col(c["field"]).try_cast("double"), F.lit(float(c["value"]))), F.lit(False))
        for c in conditions
    ]
    return df.filter(all_of(tests))


def ratio_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(w in c for w in ("margin", "ratio", "roe", "growth"))]


def row_is_sane(df: DataFrame, limit: float = 1000.0) -> Column:
    """False when a margin, ratio, return or growth column lies outside ±limit."""
    tests = [F.coalesce(F.abs(F.col(c).try_cast("double")) <= limit, F.lit(True)) for c in ratio_columns(df)]
    return all_of(tests)


def present_count(metrics: list[str]) -> Column:
    """Number of numeric, non-null metric columns in a row."""
    return reduce(lambda a, b: a + b, [F.col(m).try_cast("double").isNotNull().cast("int") for m in metrics], F.lit(0))


def metric_projection(df: DataFrame, metrics: list[str], intent: str = "lookup", keys: EntityKeys = KEYS) -> DataFrame:
    """Dimensions and metrics, in the order the intent shows them."""
    if len(metrics) == 1 and intent == "trend":
        return df.select(keys.year, *metrics, keys.name, keys.period, keys.code)
    if len(metrics) == 1 and intent == "lookup":
        return df.select(*metrics, keys.name, keys.year, keys.period, keys.code)
    return df.select(keys.name, keys.year, keys.period, *metrics, keys.code)


def exclude_labels(df: DataFrame, label: str, stop: DataFrame) -> DataFrame:
    """Drop rows whose label is on the stop list (column ``label``)."""
    return df.join(broadcast_if_small(stop.select(F.col("label").alias(label))), label, "left_anti")


def min_token_filter(chunks: DataFrame, minimum: int = 50) -> DataFrame:
    return chunks.filter(F.col("token_count") >= minimum)


def min_field_filter(facts: DataFrame, group: list[str], minimum: dict[str, int], table: str = "table_name") -> DataFrame:
    """Keep the groups whose number of fields reaches the minimum declared for their table."""
    need = F.create_map(*[F.lit(x) for kv in minimum.items() for x in kv])
    full = (facts.groupBy(*group, table).agg(F.count("value").alias("_n"))
            .filter(F.col("_n") >= F.coalesce(F.try_element_at(need, F.col(table)), F.lit(0))).drop("_n"))
    return facts.join(full, [*group, table], "left_semi")
