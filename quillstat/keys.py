"""Key names and the order of reporting periods."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Period codes in calendar order, and the two preference orders in use.
PERIOD_ORDER = ["Q1", "H1", "Q3", "FY"]
PREFER_CUMULATIVE = ["FY", "Q3", "H1", "Q1"]
PREFER_HALF_YEAR = ["FY", "H1", "Q3", "Q1"]


@dataclass(frozen=True)
class EntityKeys:
    """Column names of the natural key of a statement row."""

    code: str = "stock_code"
    name: str = "stock_abbr"
    year: str = "report_year"
    period: str = "report_period"

    @property
    def row(self) -> list[str]:
        return [self.code, self.year, self.period]

    @property
    def dims(self) -> list[str]:
        return [self.code, self.name, self.year, self.period]


KEYS = EntityKeys()


def period_ordinal(period: Column | str) -> Column:
    """Q1 = 1 … FY = 4, anything else 0 (codes do not sort by name)."""
    return preference(period, PERIOD_ORDER)


def preference(period: Column | str, ascending: list[str]) -> Column:
    """1-based position in a list of codes, 0 when absent."""
    c = F.col(period) if isinstance(period, str) else period
    return F.coalesce(F.array_position(F.array(*[F.lit(p) for p in ascending]), c), F.lit(0)).cast("int")


def period_priority(period: Column | str, preferred_first: list[str]) -> Column:
    """Higher is better; 0 for unknown codes."""
    return preference(period, list(reversed(preferred_first)))
