"""Mixing sources to target weights: budgets down a domain-language-source tree, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstat.llm.common import WORD, written

LEVELS = ["domain", "lang", "source"]
BIG = "decimal(38,0)"


def _weight(name: str, weights: Mapping[str, int]) -> Column:
    """Weight of a node by its name; names that aren't listed weigh 1."""
    if not weights:
        return F.lit(1).cast("long")
    table = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(int(v)).cast("long"))])
    return F.coalesce(F.element_at(table, F.col(name)), F.lit(1).cast("long"))


def _filled(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Share each parent's ``budget`` among its children by ``weight``: nobody gets more than ``capacity``, and what a full child can't take goes
    to its siblings by their weights. Children are full in the order of capacity over weight, so running sums find all of them at once."""
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    ordered = w.orderBy(F.col("capacity") / F.col("weight"), name)
    d = nodes.withColumn("upto", F.sum("capacity").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).cast(BIG))
    d = d.withColumn("after", F.coalesce(F.sum("weight").over(ordered.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)).cast(BIG))
    full = F.col("upto") * F.col("weight") + F.col("capacity") * F.col("after") <= F.col("budget").cast(BIG) * F.col("weight")
    d = d.withColumn("full", full)
    d = d.withColumn("taken", F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(w).cast(BIG))
    d = d.withColumn("open", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(w).cast(BIG))
    part = F.expr("(cast(budget AS decimal(38,0)) - taken) * weight div open")
    return d.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(part).cast("long")).drop("upto", "after", "full", "taken", "open")


def leaf_budgets(sizes: DataFrame, weights: Mapping[str, Mapping[str, int]], share: float, max_epochs: int) -> DataFrame:
    """``domain, lang, source, tokens, budget`` from the tokens of each leaf.

    The root's budget is ``share`` of all tokens (of nodes with a weight). A leaf holds its tokens ``max_epochs`` times at most. A node that can't fill
    its budget leaves the rest to its siblings; only what all of them can't take goes back to the parent's siblings, since every
    parent enters its own level with the capacity of its subtree. Budgets are rounded down; a node of weight 0 gets nothing.
    """
    d = sizes
    for level in LEVELS:
        d = d.withColumn(f"w_{level}", _weight(level, weights.get(level, {})))
    alive = (F.col("w_domain") > 0) & (F.col("w_lang") > 0) & (F.col("w_source") > 0)
    d = d.withColumn("alive_tokens", F.when(alive, F.col("tokens")).otherwise(F.lit(0)).cast("long"))
    d = d.withColumn("capacity", (F.col("alive_tokens") * max_epochs).cast("long"))
    parent: list[str] = []
    budgets = None
    for depth, level in enumerate(LEVELS):
        keys = LEVELS[: depth + 1]
        nodes = d.groupBy(*keys).agg(F.sum("capacity").alias("capacity"), F.sum("alive_tokens").alias("alive_tokens"), F.greatest(F.max(f"w_{level}"), F.lit(1)).alias("weight"))
        if budgets is None:
            total = F.sum("alive_tokens").over(Window.partitionBy(F.lit(0)))
            nodes = nodes.withColumn("budget", F.floor(total * F.lit(share)).cast("long"))
        else:
            nodes = nodes.join(budgets, parent)
        budgets = _filled(nodes, parent, level).select(*keys, "budget")
        parent = keys
    return d.select(*LEVELS, "tokens").join(budgets, LEVELS)


def mix_sources(docs: DataFrame, domain: str, weights: Mapping[str, Mapping[str, int]], share: float = 0.5, max_epochs: int = 4, seed: int = 0) -> DataFrame:
    """``doc_id, domain, lang, source, tokens, copies`` for every row of ``docs``: how often the mixture holds it. ``domain`` is an SQL expression.

    ``tokens`` counts words. A leaf's budget buys whole epochs of its documents first; the rest buys a prefix of the next epoch, whose order is seeded
    by ``seed`` and the epoch: the documents up to which the running sum of tokens stays within the rest. Rows of the same doc_id
    are bought together. Null names are '', a null or wordless text has no tokens and costs nothing, a leaf without tokens gives nothing, an empty table no rows.

    A running sum over a hot leaf isn't taken in one task: hashed order is cut into 4 096 ranges, whose sums decide for all but the one range per leaf
    in which the prefix ends.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.expr(domain).cast("string"), F.lit("")).alias("domain"), name("lang").alias("lang"), name("source").alias("source"),
                    F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("tokens"))
    d = written(d, "sizes")
    leaves = leaf_budgets(d.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), weights, share, max_epochs)
    leaves = leaves.select(*LEVELS, F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).cast("long").alias("epochs"),
                           F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(-1).cast("long").alias("rest"))
    d = d.join(leaves, LEVELS)
    place = F.md5(F.concat(F.lit(f"{seed}:"), F.col("epochs").cast("string"), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = written(d.withColumn("place", place).withColumn("range", F.conv(F.substring("place", 1, 3), 16, 10).cast("int")), "places")
    ranges = d.groupBy(*LEVELS, "range").agg(F.sum("tokens").alias("range_tokens"))
    before = F.sum("range_tokens").over(Window.partitionBy(*LEVELS).orderBy("range")) - F.col("range_tokens")
    ranges = ranges.withColumn("before", before)
    d = d.join(ranges, [*LEVELS, "range"])
    whole = F.col("before") + F.col("range_tokens") <= F.col("rest")
    ends = ~whole & (F.col("before") <= F.col("rest"))
    columns = ["doc_id", *LEVELS, "tokens"]
    settled = d.where(~ends).select(*columns, (F.col("epochs") + whole.cast("long")).alias("copies"))
    running = F.col("before") + F.sum("tokens").over(Window.partitionBy(*LEVELS, "range").orderBy("place"))
    ending = d.where(ends).select(*columns, (F.col("epochs") + (running <= F.col("rest")).cast("long")).alias("copies"))
    return settled.unionByName(ending)


def mixed(docs: DataFrame, domain: str, weights: Mapping[str, Mapping[str, int]], **options) -> DataFrame:
    """The rows of ``docs``, all columns, each as often as the mixture holds it."""
    copies = mix_sources(docs, domain, weights, **options).where("copies > 0").groupBy(F.col("doc_id").alias("_m_id"), F.col("domain").alias("_m_domain"), F.col("lang").alias("_m_lang"), F.col("source").alias("_m_source")).agg(F.max("copies").alias("_m_copies"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_m_id")) & (F.coalesce(F.col("lang").cast("string"), F.lit("")) == F.col("_m_lang")) & (F.coalesce(F.col("source").cast("string"), F.lit("")) == F.col("_m_source")) & (F.coalesce(F.expr(domain).cast("string"), F.lit("")) == F.col("_m_domain"))
    joined = docs.join(copies, same)
    repeated = joined.where("_m_copies > 1").withColumn("_m_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_m_copies")))).select(*docs.columns)
    return joined.where("_m_copies = 1").select(*docs.columns).unionByName(repeated)
