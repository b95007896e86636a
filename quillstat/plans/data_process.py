"""Second-step computations on a queried result."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.functions import calc, numbers
from quillstat.keys import KEYS, EntityKeys
from quillstat.operators import filters, stats, topk, windows


def data_process(df: DataFrame, action: str, params: dict, amounts: list[str] | None = None, digits: int | None = 4,
                 keys: EntityKeys = KEYS) -> DataFrame:
    """``calc`` a formula, or ``compare`` by rank, filter, stats or intersect after unit inference."""
    if action == "calc":
        return calc.formula_order(calc.calc_batch(df, params["formula"], digits, keys), keys=keys)
    if action != "compare":
        raise ValueError(f"unknown action {action}: calc or compare")
    if amounts:
        df = numbers.infer_unit(df, amounts, [F.col(k) for k in keys.row], digits).drop("source_unit")
    mode = params.get("mode", "rank")
    if mode == "rank":
        return windows.rank(df, params["field"], params.get("top_k"), params.get("ascending", False), keys=keys)
    if mode == "filter":
        return filters.filter_rows(df, params["conditions"])
    if mode == "stats":
        return stats.group_stats(df, params["field"], params.get("by"), digits)
    if mode == "intersect":
        return topk.intersect_top_n(df, params["fields"], params.get("top_k", 5), keys)
    raise ValueError(f"unknown mode {mode}: rank, filter, stats or intersect")
