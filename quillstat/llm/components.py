"""Connected components of an edge table, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.llm.common import written


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``id, component`` (smallest id reachable) for every id of ``edges`` (``a, b`` long).

    Each round points the larger neighbours of a node at its smallest neighbour, then the smaller ones; both are sums of partial
    minima and a join, so a node with very many neighbours isn't gathered anywhere. Rounds are written to the shared folder.
    """

    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e if small else e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        joined = both.join(least, "a")
        if small:  # edges point down, from a to the smaller b
            out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b")))
        else:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return out.where(F.col("a") != F.col("b")).distinct()

    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), name)
    state = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == state:
            break
        state = mark
        now = written(star(star(now, small=False), small=True), name)
    found = now.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found.unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
