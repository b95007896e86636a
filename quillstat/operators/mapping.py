"""Labels → fields, and names → codes.

Labels and names repeat on every filing, so all scoring runs on the distinct ones and is joined back.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillstat.functions import fixed
from quillstat.operators.matching import either_contains_join, similar_join, similarity
from quillstat.operators.windows import first_rows
from quillstat.session import broadcast_if_small, stored


def strip_unit_suffix(label: Column) -> Column:
    """Without a trailing parenthesis, when two characters remain."""
    core = F.regexp_replace(label, r"[（(][^）)]*[）)]$", "")
    return F.when(F.length(core) >= 2, F.trim(core)).otherwise(label)


def clean_label(label: Column) -> Column:
    return F.regexp_replace(F.trim(label), r"[ 　]", "")


def pad_code(code: Column) -> Column:
    return F.when(F.length(code) < 6, F.lpad(code, 6, "0")).otherwise(code)


def characters(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?s)(.)"), F.lit(1))


def char_overlap(a: Column, b: Column) -> Column:
    """Share of the characters of ``a`` that occur in ``b``, of the longer length, 0–100."""
    hits = F.size(F.filter(characters(a), lambda c: b.contains(c)))
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, hits / longest * 100).otherwise(F.lit(0.0))


def lexical_score(a: Column, b: Column) -> Column:
    """0.3 × the better of overlap and edit similarity, at least 25 on containment."""
    base = F.greatest(char_overlap(a, b), similarity(a, b)) * 0.3
    inside = a.contains(b) | b.contains(a)
    return F.when(inside, F.greatest(base, F.lit(25.0))).otherwise(base)


def mapping_frequency_score(observations: Column, successes: Column) -> Column:
    """5 unseen; under three observations 5 + ⌊10·rate⌋; else ⌊20·rate⌋ + min(5, n div 100), at most 25."""
    n = F.coalesce(observations, F.lit(0))
    rate = F.coalesce(successes, F.lit(0)) / F.greatest(n, F.lit(1))
    many = F.least(F.floor(rate * 20) + F.least(F.floor(n / 100), F.lit(5)), F.lit(25))
    return F.when(n == 0, F.lit(5)).when(n < 3, F.floor(rate * 10) + 5).otherwise(many).cast("int")


def without_prefix(label: Column) -> Column:
    """The label after the first of the prefixes that it starts with; null without one."""
    stripped = None
    for p in fixed.LABEL_PREFIXES:  # in order of precedence
        rest = F.substring(label, len(p) + 1, 10**6)
        stripped = F.when(label.startswith(p), rest) if stripped is None else stripped.when(label.startswith(p), rest)
    return stripped


def label_candidates(labels: DataFrame, label: str, standard: DataFrame, most_frequent: int) -> DataFrame:
    """(label, standard) of the names that may reach the threshold of 55 for a label, or that contain it or lie in it.

    The characters of the label that a name holds are counted by the join on characters. They bound both the overlap and the edit similarity, since every edit
    but an insertion costs one of them; with all that can be added for table, frequency (``most_frequent``), prefix and unit, names that stay below 55 go
    before any edit distance is computed.
    """
    names = standard.select("standard").distinct()
    held = names.select("standard", F.explode(F.array_distinct(characters(F.col("standard")))).alias("_ch"))
    asked = labels.select(label, F.explode(characters(F.col(label))).alias("_ch")).groupBy(label, "_ch").agg(F.count(F.lit(1)).alias("_n"))
    met = asked.join(held, "_ch").groupBy(label, "standard").agg(F.sum("_n").alias("_hits"))
    a, s, rest = F.col(label), F.col("standard"), without_prefix(F.col(label))
    share = lambda text: F.col("_hits") / F.greatest(F.length(text), F.length(s)) * 100
    lexical = share(a) * 0.3
    bonus = F.when((F.length(rest) >= 2) & ((share(rest) * 0.3 > 20) | s.contains(rest) | rest.contains(s)), 15).otherwise(0)
    open_ = lexical + bonus + 15 + most_frequent + 10 >= 55 - 1e-6
    return met.filter(a.contains(s) | s.contains(a) | open_).select(label, "standard")


def map_fields(labels: DataFrame, dictionary: DataFrame, label: str = "label", context: str | None = None,
               pool: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """Adds field, table_name, standard, confidence to every row with a label; nulls when none qualifies.

    ``dictionary`` has (standard, field, table_name). Candidates are the standard names that :func:`label_candidates` leaves open
    and those whose pooled synonyms contain the label or lie in it; any other name stays below the threshold of 55, so nothing is missed.
    """
    ctx = F.col(context) if context else F.lit(None).cast("string")
    work = labels.select(F.col(label).alias("_raw"), ctx.alias("_ctx")).distinct().withColumn("_label", clean_label(F.col("_raw")))
    stop = labels.sparkSession.createDataFrame([(x,) for x in fixed.EXCLUDED_LABELS], "_raw string")
    work = work.join(F.broadcast(stop), "_raw", "left_anti").filter(F.length("_label") >= 2)
    attempts = work.select("_label", F.explode(F.array_distinct(F.array(
        F.struct(F.col("_label").alias("a"), F.lit(False).alias("clean")),
        F.struct(strip_unit_suffix(F.col("_label")).alias("a"), (strip_unit_suffix(F.col("_label")) != F.col("_label")).alias("clean"))))).alias("_t"))
    attempts = attempts.select("_label", F.col("_t.a").alias("_a"), F.col("_t.clean").alias("_clean")).distinct()

    # candidates: names that the bound leaves open, plus synonyms of the pool
    std = dictionary.select("standard", F.col("field").alias("_f"), F.col("table_name").alias("_tab"))
    asked = attempts.select("_a").distinct()
    shared = label_candidates(asked, "_a", std, 25 if history is not None else 20)
    if pool is None:
        pairs = shared.withColumn("_syn", F.lit(0))
    else:
        by_pool = either_contains_join(asked, "_a", pool.select(F.col("field").alias("_pf"), "synonym"), "synonym")
        syn = by_pool.join(std, F.col("_pf") == F.col("_f")).select("_a", "standard").distinct().withColumn("_syn", F.lit(25))
        pairs = shared.join(syn, ["_a", "standard"], "full").withColumn("_syn", F.coalesce("_syn", F.lit(0)))

    a, s = F.col("_a"), F.col("standard")
    stripped = without_prefix(a)
    scored = pairs.join(std, "standard").withColumn("_lex", lexical_score(a, s)).withColumn("_rest", stripped)
    bonus = F.when((F.col("_syn") == 0) & (F.length("_rest") >= 2), F.when(lexical_score(F.col("_rest"), s) > 20, 15).otherwise(0)).otherwise(0)
    prior = F.when(reduce(lambda x, y: x | y, [s.contains(w) for w in fixed.COMMON_NAMES]), 20).otherwise(10)
    scored = scored.select("_a", "standard", "_f", "_tab", (a == s).alias("_same"), (F.col("_lex") + F.col("_syn") + F.coalesce(bonus, F.lit(0))).alias("_base"), prior.alias("_prior"))
    if history is not None:
        seen = history.select(F.col("label").alias("_a"), F.col("field").alias("_f"), "observations", "successes")
        scored = scored.join(seen, ["_a", "_f"], "left").withColumn("_learned", mapping_frequency_score(F.col("observations"), F.col("successes")))
    else:
        scored = scored.withColumn("_learned", F.lit(5))

    rows = work.join(attempts, "_label").join(scored, "_a")
    table_bonus = F.when(F.col("_ctx").isNull(), 5).when(F.col("_ctx") == F.col("_tab"), 15).otherwise(-10)
    freq = F.when(F.col("_clean"), F.greatest("_learned", "_prior")).otherwise(F.col("_prior"))
    total = F.when(F.col("_same"), F.lit(100.0)).otherwise(F.col("_base") + table_bonus + freq + F.when(F.col("_clean"), 10).otherwise(0))
    rows = rows.withColumn("_total", total)
    best = first_rows(rows, ["_raw", "_ctx"], [F.round("_total", 9).desc(), F.length("standard").desc(), F.col("standard"), F.col("_tab")])
    inside = F.col("standard").contains(F.col("_label")) | F.col("_label").contains(F.col("standard"))
    accepted = best.filter(F.col("_total") >= F.when(inside, 40).otherwise(55)).select(
        "_raw", "_ctx", F.col("_f").alias("field"), F.col("_tab").alias("mapped_table"), "standard", F.round("_total", 1).alias("confidence"))
    out = labels.withColumn("_raw", F.col(label)).withColumn("_ctx", ctx)
    # one row per distinct label: rows stay where they are unless these are many
    joined = out.alias("l").join(broadcast_if_small(stored(accepted, "mapped")).alias("r"), (F.col("l._raw") == F.col("r._raw")) & F.col("l._ctx").eqNullSafe(F.col("r._ctx")), "left")
    return joined.select(*[F.col(f"l.{c}") for c in labels.columns], "r.field", "r.mapped_table", "r.standard", "r.confidence")


def learn_mappings(observed: DataFrame, history: DataFrame, pool: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """(history, pool) after a batch of (label, field, confidence): counts combine map-side, promotion runs once."""
    new = observed.filter(F.col("field").isNotNull()).groupBy(F.col(label).alias("label"), "field").agg(
        F.count(F.lit(1)).alias("observations"), F.count_if(F.col("confidence") >= 70).alias("successes"),
        F.sum("confidence").cast("double").alias("total_confidence"), F.max("confidence").alias("_top"))
    merged = history.withColumn("_top", F.lit(None).cast("double")).unionByName(new).groupBy("label", "field").agg(
        F.sum("observations").alias("observations"), F.sum("successes").alias("successes"),
        F.sum("total_confidence").alias("total_confidence"), F.max("_top").alias("_top"))
    promoted = merged.filter((F.col("_top") >= 85) & (F.col("observations") >= 10) & (F.col("successes") / F.col("observations") >= 0.8))
    pool2 = pool.unionByName(promoted.select("field", F.col("label").alias("synonym"))).distinct()
    return merged.drop("_top"), pool2


def best_value_per_field(rows: DataFrame, by: list[str], order: str = "row") -> DataFrame:
    """Of several labels mapped to one field: the highest confidence, first row on ties."""
    valid = rows.filter(F.col("field").isNotNull() & F.col("value").isNotNull())
    return first_rows(valid, [*by, "field"], [F.col("confidence").desc(), F.col(order)])


def cross_fill(facts: DataFrame, filing: list[str], tables: list[str] | None = None) -> DataFrame:
    """A field found in one statement of a filing fills the filing's other statements that lack it.

    The source is the first table in order. Tables per filing are at most the statement types and fields those of the dictionary, so the facts of a
    filing meet once.
    """
    order = [*fixed.TABLE_PRIORITY, fixed.CORE_TABLE] if tables is None else tables
    pos = F.array_position(F.array(*[F.lit(t) for t in order]), F.col("table_name"))
    per_field = facts.groupBy(*filing, "field").agg(F.min_by("value", pos).alias("_value"), F.collect_list(F.struct("table_name", "value")).alias("_own"))
    have = F.transform("_own", lambda x: x.getField("table_name"))
    all_ = per_field.withColumn("_tables", F.array_distinct(F.flatten(F.collect_list(F.array_distinct(have)).over(W.partitionBy(*filing)))))
    own = F.transform("_own", lambda x: F.struct(x.getField("table_name").alias("table_name"), x.getField("value").alias("value"), F.lit(False).alias("filled")))
    filled = F.transform(F.array_except("_tables", have), lambda t: F.struct(t.alias("table_name"), F.col("_value").alias("value"), F.lit(True).alias("filled")))
    return all_.select(*filing, "field", F.inline(F.concat(own, filled))).select(*filing, "table_name", "field", "value", "filled")


def without_suffix(name: Column) -> Column:
    """Array of the name without each of the legal suffixes that occur in it, in order of precedence."""
    return F.filter(F.array(*[F.when(name.contains(x), F.trim(F.replace(name, F.lit(x), F.lit("")))) for x in fixed.LEGAL_SUFFIXES]),
                    lambda x: x.isNotNull() & (x != ""))


def entity_lookup(names: DataFrame, dictionary: DataFrame, name: str = "name", contained: int = 80,
                  similar_from: float | None = None) -> DataFrame:
    """Adds code and confidence: exact 100, without suffix 95, containment either way, else best similarity.

    ``dictionary`` has (entity, code, pos). Every tier is an equi-join over distinct names.
    """
    asked = names.select(F.col(name).alias("_raw")).distinct().withColumn("_n", F.regexp_replace(F.trim("_raw"), r"[ 　]", "")).filter(F.length("_n") > 0)
    d = dictionary.select("entity", "code", "pos")
    keys = asked.select("_n").distinct()
    exact = keys.join(d, F.col("_n") == F.col("entity")).select("_n", "code", F.lit(100).alias("confidence"), F.col("pos").alias("_o"))
    stems = keys.select("_n", F.posexplode(without_suffix(F.col("_n"))).alias("_p", "_s"))
    stripped = stems.join(d, F.col("_s") == F.col("entity")).select("_n", "code", F.lit(95).alias("confidence"), F.col("_p").alias("_o"))
    inside = either_contains_join(keys, "_n", d, "entity").select("_n", "code", F.lit(contained).alias("confidence"), F.col("pos").alias("_o"))
    tiers = exact.withColumn("_tier", F.lit(1)).unionByName(stripped.withColumn("_tier", F.lit(2))).unionByName(inside.withColumn("_tier", F.lit(3)))
    if similar_from is not None:
        near = similar_join(keys, "_n", d, "entity", similar_from).select(
            "_n", "code", F.floor("score").cast("int").alias("confidence"), (-F.col("score") * 10**6 + F.col("pos") / 10**6).alias("_o"), F.lit(4).alias("_tier"))
        tiers = tiers.withColumn("_o", F.col("_o").cast("double")).unionByName(near)
    best = first_rows(tiers, ["_n"], [F.col("_tier"), F.col("_o"), F.col("code")])
    found = asked.join(best, "_n").select(F.col("_raw").alias(name), pad_code(F.col("code")).alias("code"), "confidence")
    return names.join(found, name, "left").withColumn("confidence", F.coalesce("confidence", F.lit(0)))
