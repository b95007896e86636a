"""Containment and similarity joins without cross products.

Containment: one side is a dictionary. Within its measured bounds it travels to the tasks as an automaton that finds all its terms in one pass over a
text; beyond them a text meets a term on the term's rarest gram. Similarity: two names meet on segments that at least one of the allowed edits spares.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.operators.windows import first_rows
from quillstat.session import broadcast_if_small, bounded_values

#: Dictionaries up to both bounds are found by automaton.
MAX_TERMS, MAX_TERM_BYTES = 200_000, 8 << 20


def characters_of(text: Column) -> Column:
    """Characters of a text, in one pass."""
    return F.regexp_extract_all(text, F.lit(r"(?s)(.)"), F.lit(1))


def _gram_rows(texts: DataFrame, key: str, text: str, sizes: tuple[int, ...]) -> DataFrame:
    """(key, _gram): the distinct n-grams of every text. The characters are cut once; a gram joins neighbours of that array."""
    c = "_characters"
    cut = texts.select(key, characters_of(F.col(text)).alias(c))
    made = [F.expr(f"IF(size({c}) >= {n}, transform(sequence(0, size({c}) - {n}), i -> concat({', '.join(f'{c}[i + {k}]' for k in range(n))})), array())") for n in sizes]
    return cut.select(key, F.explode(F.concat(*made)).alias("_gram")).distinct()


def rarest_gram(terms: DataFrame, term: str) -> DataFrame:
    """Each distinct term with its gram (three characters, or the whole of a shorter term) that the fewest terms hold, as ``_gram``."""
    t = terms.select(F.col(term).alias("_needle")).filter(F.length("_needle") > 0).distinct()
    short = t.filter(F.length("_needle") < 3).select("_needle", F.col("_needle").alias("_gram"))
    held = short.unionByName(_gram_rows(t.filter(F.length("_needle") >= 3), "_needle", "_needle", (3,)))
    counts = held.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    return held.join(counts, "_gram").groupBy("_needle").agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))


class Automaton:
    """All terms of a dictionary at once: one pass over a text finds every term in it, however many there are."""

    def __init__(self, terms: Iterable[str]):
        import ahocorasick

        self.tree = ahocorasick.Automaton()
        for t in terms:
            self.tree.add_word(t, t)
        self.empty = len(self.tree) == 0
        if not self.empty:
            self.tree.make_automaton()

    def found(self, text: str | None) -> list[str]:
        """Distinct terms in the text."""
        return [] if self.empty or not text else list({t for _, t in self.tree.iter(text)})


_AUTOMATA: dict[str, Automaton] = {}


def terms_in(text: Column, terms: list[str]) -> Column:
    """Distinct dictionary terms in a text; the dictionary is within the bounds above and travels as a broadcast variable."""
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(terms)
    name = f"{len(terms)}-{pd.util.hash_array(pd.array(terms, dtype=object).to_numpy()).sum() if terms else 0}"

    @F.pandas_udf("array<string>")
    def search(texts: pd.Series) -> pd.Series:
        if name not in _AUTOMATA:
            _AUTOMATA.clear()  # one dictionary at a time stays with a worker
            _AUTOMATA[name] = Automaton(shared.value)
        return texts.map(_AUTOMATA[name].found)

    return search(text)


def texts_with(term: Column, texts: list[str]) -> Column:
    """Dictionary texts that contain a term: the terms of a batch become an automaton and every dictionary text is read once."""
    from pyspark.sql import SparkSession

    shared = SparkSession.active().sparkContext.broadcast(texts)

    @F.pandas_udf("array<string>")
    def search(asked: pd.Series) -> pd.Series:
        automaton, holders = Automaton(asked.dropna().unique()), defaultdict(list)
        for t in shared.value:
            for needle in automaton.found(t):
                holders[needle].append(t)
        return asked.map(lambda x: holders.get(x, []))

    return search(term)


def contains_join(texts: DataFrame, text: str, terms: DataFrame, term: str, single: bool = True, small: str = "terms") -> DataFrame:
    """All pairs where the text contains the term; without ``single`` terms have at least two characters. Nulls and empty terms pair with nothing.

    ``small`` names the dictionary side (terms or texts). Its distinct values are measured; within ``MAX_TERMS`` and ``MAX_TERM_BYTES`` they are
    searched by automaton in time linear in the other side. A larger dictionary is joined on grams.
    """
    asked = terms.filter(F.length(term) >= (1 if single else 2))
    values = bounded_values(asked.select(term) if small == "terms" else texts.select(text), MAX_TERMS, MAX_TERM_BYTES)
    if values is None:
        return _gram_join(texts, text, asked, term)
    if small == "terms":
        hits = texts.filter(F.col(text).isNotNull()).withColumn("_needle", F.explode(terms_in(F.col(text), values)))
        return hits.join(broadcast_if_small(terms), F.col("_needle") == F.col(term)).drop("_needle")
    hits = asked.withColumn("_haystack", F.explode(texts_with(F.col(term), values)))
    return texts.join(hits, F.col(text) == F.col("_haystack")).drop("_haystack")


def _gram_join(texts: DataFrame, text: str, terms: DataFrame, term: str) -> DataFrame:
    """A term meets the texts that hold its rarest gram, so terms with a common prefix don't share a key. Only hashes of texts are exploded by gram; the
    texts join the candidates afterwards."""
    c = F.col(text)
    named = texts.withColumn("_haystack", F.xxhash64(c))
    left = _gram_rows(named.filter(c.isNotNull()).select("_haystack", c.alias("_hay")).distinct(), "_haystack", "_hay", (3, 2, 1))
    candidates = left.join(rarest_gram(terms, term), "_gram").select("_haystack", "_needle").distinct()
    hits = named.join(candidates, "_haystack").filter(F.contains(c, F.col("_needle"))).drop("_haystack")
    return hits.join(terms, F.col("_needle") == F.col(term)).drop("_needle")


def either_contains_join(left: DataFrame, a: str, right: DataFrame, b: str) -> DataFrame:
    """All pairs where one text contains the other; pairs of equal texts appear once. ``right`` is the dictionary."""
    forward = contains_join(left, a, right, b)
    backward = contains_join(right, b, left, a, small="texts").filter(F.col(a) != F.col(b))
    return forward.unionByName(backward)


def similarity(a: Column, b: Column) -> Column:
    """Edit similarity 0–100."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest > 0, (F.lit(1.0) - F.levenshtein(a, b) / longest) * 100).otherwise(F.lit(0.0))


def _segments(length: Column, edits: Column) -> Column:
    """(start, size) of ``edits + 1`` even parts of ``length`` characters."""
    return F.transform(F.sequence(F.lit(0), edits), lambda i: F.struct(
        F.floor(i * length / (edits + 1)).cast("int").alias("at"), (F.floor((i + 1) * length / (edits + 1)) - F.floor(i * length / (edits + 1))).cast("int").alias("size")))


def similar_join(left: DataFrame, a: str, right: DataFrame, b: str, threshold: float = 70.0) -> DataFrame:
    """All pairs with similarity of at least ``threshold`` (above 0), with the score. Compare distinct texts only.

    Texts of lengths m and n, the longer L, may differ by k = ⌊L · (1 − threshold / 100)⌋ edits. The shorter text is cut into k + 1 parts; k edits leave one
    of them whole, moved by at most (k + n − m) / 2 places one way and (k − n + m) / 2 the other. So a pair meets on (both lengths, part, its characters),
    and only pairs of lengths that can be similar at all. A part is empty where the text is shorter than k + 1; then the two meet on their lengths.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be positive")
    share = 1 - threshold / 100

    def edits(longer):
        return F.floor(longer * share + 1e-9).cast("int")

    def cut(df, text):
        return df.select(F.col(text).alias("_t"), F.length(text).alias("_own")).distinct()

    lengths = cut(right, b).select(F.col("_own").alias("_other")).distinct()
    near = F.abs(F.col("_own") - F.col("_other")) <= edits(F.greatest("_own", "_other"))
    sizes = cut(left, a).select("_own").distinct().join(broadcast_if_small(lengths), near)  # one row per pair of lengths that can match
    x = cut(left, a).join(sizes, "_own")
    y = cut(right, b).withColumnRenamed("_own", "_other").join(sizes, "_other")

    def keys(rows, own, other):
        """Parts of the shorter text where it is this one; else all substrings of the longer that may be such a part. Equal lengths: the left one is cut."""
        k, short = edits(F.greatest("_own", "_other")), F.least("_own", "_other")
        cuts = _segments(short, k)
        mine = F.col("_own") <= F.col("_other") if own == "_own" else F.col("_other") < F.col("_own")
        parts = F.transform(cuts, lambda s, i: F.struct(i.alias("part"), F.substring("_t", s["at"] + 1, s["size"]).alias("chars")))
        more = F.abs(F.col("_own") - F.col("_other"))

        def places(s):
            first = F.greatest(s["at"] - F.floor((k - more) / 2).cast("int"), F.lit(0))
            return F.sequence(first, F.greatest(first, F.least(s["at"] + F.floor((k + more) / 2).cast("int"), F.length("_t") - s["size"])))

        windows = F.flatten(F.transform(cuts, lambda s, i: F.transform(places(s), lambda p: F.struct(i.alias("part"), F.substring("_t", p + 1, s["size"]).alias("chars")))))
        return rows.select("_t", "_own", "_other", F.explode(F.array_distinct(F.when(mine, parts).otherwise(windows))).alias("_key"))

    met = keys(x, "_own", "_other").withColumnRenamed("_t", "_a").join(keys(y, "_other", "_own").withColumnRenamed("_t", "_b"), ["_own", "_other", "_key"])
    # Scored where they meet: only matches are shuffled to be told apart, a pair that shares several parts is scored as often.
    scored = met.withColumn("score", similarity(F.col("_a"), F.col("_b"))).filter(F.col("score") >= threshold).select("_a", "_b", "score").distinct()
    return left.join(scored, F.col(a) == F.col("_a")).drop("_a").join(right, F.col("_b") == F.col(b)).drop("_b").select(*left.columns, *right.columns, "score")


def fields_in_text(texts: DataFrame, text_id: str, text: str, terms: DataFrame, term: str) -> DataFrame:
    """Terms that occur in a text, without those inside a longer term that occurs as well. Adds ``score`` = length ratio × 0.8 + 0.2."""
    hits = contains_join(texts.select(text_id, text), text, terms, term).drop_duplicates([text_id, term])
    hits = hits.withColumn("score", F.length(term) / F.greatest(F.length(text), F.lit(1)) * 0.8 + 0.2).drop(text)
    return outer_terms(hits, text_id, terms, term)


def outer_terms(hits: DataFrame, text_id: str, terms: DataFrame, term: str) -> DataFrame:
    """Hits (text_id, term, …) without terms inside a longer one of the same text. Whether a term lies inside another depends on the dictionary alone, so the
    hits of a text are never compared all with all."""
    inner = terms.select(F.col(term).alias("_short")).distinct()
    nested = contains_join(terms.select(F.col(term).alias("_long")).distinct(), "_long", inner, "_short").filter("_long <> _short")
    covered = (
        hits.select(text_id, F.col(term).alias("_long")).join(nested, "_long")
        .select(text_id, F.col("_short").alias(term)).distinct()
    )
    return hits.join(covered, [text_id, term], "left_anti")


def synonym_join(terms: DataFrame, term: str, dictionary: DataFrame, synonym: str = "synonym") -> DataFrame:
    """Exact dictionary join: adds the dictionary columns and a score of 1."""
    d = broadcast_if_small(dictionary.withColumnRenamed(synonym, "_syn"))
    return terms.join(d, F.col(term) == F.col("_syn")).drop("_syn").withColumn("score", F.lit(1.0))


def synonym_substring_join(terms: DataFrame, term: str, dictionary: DataFrame, synonym: str = "synonym", top_k: int = 1) -> DataFrame:
    """Dictionary entries whose synonym contains the term, score = length ratio × 0.9, best k per term."""
    asked = terms.select(term).distinct().filter(F.length(term) > 0)
    pairs = contains_join(dictionary, synonym, asked, term, small="texts").withColumn("score", F.length(term) / F.length(synonym) * 0.9)
    return first_rows(pairs, [term], [F.col("score").desc(), F.col(synonym)], top_k)


def expand_concepts(terms: DataFrame, by: list[str], term: str, concepts: DataFrame, aliases: DataFrame,
                    position: str = "position") -> DataFrame:
    """Terms → fields: a concept or alias becomes its ordered fields, anything else stays.

    Fields are de-duplicated per group at their first position; ``expanded_from`` names the concept.
    """
    named = terms.join(broadcast_if_small(aliases.withColumnRenamed("alias", term)), term, "left")
    named = named.withColumn("_concept", F.coalesce("concept", F.col(term))).drop("concept")
    children = concepts.select(F.col("concept").alias("_concept"), F.col("pos").alias("_pos"), F.col("field").alias("_field"))
    rows = named.join(broadcast_if_small(children), "_concept", "left").select(
        *by, F.coalesce("_field", F.col(term)).alias("field"),
        F.when(F.col("_field").isNotNull(), F.col("_concept")).alias("expanded_from"),
        F.struct(F.col(position).alias("p"), F.coalesce("_pos", F.lit(0)).alias("q")).alias("_order"))
    return rows.groupBy(*by, "field").agg(F.min("_order").alias("_order"), F.min_by("expanded_from", "_order").alias("expanded_from")).select(
        *by, "field", "expanded_from", F.col("_order.p").alias(position), F.col("_order.q").alias("child"))
