"""Helpers that keep an expensive expression from being copied into every place that uses it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed once per row.

    They pass through a one-element generator, below which later filters and projections are not pushed;
    without it a filter on a cleaned text would clean the text again.
    """
    kept = [c for c in df.columns if c not in columns]
    made = F.struct(*[c.alias(n) for n, c in columns.items()])
    return df.select(*kept, F.inline(F.array(made)))
