"""One lazy DataFrame per metric request: lookup, trend, compare, top-n."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.functions import fixed
from quillstat.keys import KEYS, EntityKeys
from quillstat.operators import filters, joins, topk, windows


@dataclass
class MetricRequest:
    """What to show: the intent, entities (codes, names or parts of names), metrics, time and limit."""

    intent: str
    metrics: list[str]
    entities: list[str] = field(default_factory=list)
    year: int | None = None
    year_end: int | None = None
    period: str | None = None
    top_k: int | None = None
    aliases: dict[str, str] = field(default_factory=dict)


def resolve(tables: dict[str, DataFrame], metrics: list[str]) -> tuple[list[str], dict[str, str], list[str]]:
    """Metrics → (fields present, field → table, replaced metrics), from column names only."""
    owners = joins.owner_tables(metrics)
    swap = dict(fixed.SUBSTITUTES)
    fields, where, replaced = [], {}, []
    for m in metrics:
        table = next((t for t in [owners[m], *fixed.TABLE_PRIORITY] if t in tables and m in tables[t].columns), None)
        if table is None and m in swap and swap[m] in tables[fixed.TABLE_PRIORITY[0]].columns:
            replaced.append(m)
            m, table = swap[m], fixed.TABLE_PRIORITY[0]
        if table is None:
            raise ValueError(f"no statement table has the metric {m}")
        if m not in fields:
            fields.append(m)
            where[m] = table
    return fields, where, replaced


def metric_query(tables: dict[str, DataFrame], request: MetricRequest, keys: EntityKeys = KEYS) -> DataFrame:
    """Build the query of a request over the statement tables (keyed by table name)."""
    fields, owners, replaced = resolve(tables, request.metrics)
    rows = joins.join_statements(tables, fields, owners, keys)
    if request.entities:
        rows = filters.match_entity(rows, request.entities, request.aliases, keys)
    first = fields[0]
    if request.intent == "trend":
        if request.year is not None:
            rows = filters.from_year(rows, request.year, keys)
        if request.year_end is not None:
            rows = rows.filter(F.col(keys.year) <= request.year_end)
        out = windows.best_period_per_year(rows, first, keys=keys)
    elif request.intent == "compare":
        rows = rows if request.year is None else filters.at_year(rows, request.year, keys)
        out = windows.best_period_per_entity(rows, fields, keys=keys)
    else:
        rows = rows if request.year is None else filters.at_year(rows, request.year, keys)
        rows = rows if request.period is None else filters.at_period(rows, request.period, keys)
        out = rows
    if request.top_k is not None or request.intent == "top_n":
        out = topk.top_n(out, first, request.top_k or 10, keys=keys)
    return out.withColumn("substituted", F.lit(bool(replaced)))
