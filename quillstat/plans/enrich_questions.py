"""Question log → understanding per sub-question."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstat.functions.expr import settled
from quillstat.functions.timeparse import parse_time_expression
from quillstat.operators import matching, questions
from quillstat.operators.windows import first_rows, numbered
from quillstat.session import broadcast_if_small, durable


def enrich_questions(log: DataFrame, names: DataFrame, synonyms: DataFrame, concepts: DataFrame, aliases: DataFrame, current_year: int,
                     session: str = "session_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(session, turn, part, sub_question, kind, company, fields, year, period, time_type).

    ``names`` is (term, company, pos), ``synonyms`` (synonym, field). Slots that a question leaves open are
    inherited from the session. The split questions and the terms found in them are stored once.
    """
    parts = questions.split_requests(log.select(session, turn, text), text)
    # position of a sub-question: dense over all sessions in the order of session, turn and part, so blocks of a session are full
    parts = settled(parts, t=parse_time_expression(F.col("sub_question"), current_year))
    parts = numbered(parts, [F.col(session), F.col(turn), F.col("part")], "_pos")
    parts = durable(parts.withColumn("_id", F.concat_ws("|", F.col(session).cast("string"), F.col(turn).cast("string"), F.col("part").cast("string"))))
    # One pass over the sub-questions finds the terms of all dictionaries; each then takes its own.
    words = concepts.select("concept").unionByName(aliases.select(F.col("alias").alias("concept"))).distinct()
    vocabulary = names.select("term").unionByName(synonyms.select(F.col("synonym").alias("term"))).unionByName(words.select(F.col("concept").alias("term"))).distinct()
    found = durable(matching.contains_join(parts.select("_id", "sub_question"), "sub_question", vocabulary, "term").select("_id", "term"))
    company = first_rows(found.join(names, "term"), ["_id"], [F.col("pos")]).select("_id", "company")
    named = found.withColumnRenamed("term", "synonym").join(broadcast_if_small(synonyms), "synonym")
    hits = matching.outer_terms(named, "_id", synonyms, "synonym").select("_id", "field", F.length("synonym").alias("_len"))
    group = found.join(broadcast_if_small(words), found["term"] == words["concept"], "left_semi").select("_id", "term", F.lit(1).alias("position"))
    expanded = matching.expand_concepts(group, ["_id"], "term", concepts, aliases).select("_id", "field", F.lit(0).alias("_len"))
    # a question holds a bounded number of dictionary fields
    fields = hits.unionByName(expanded).groupBy("_id").agg(F.array_sort(F.collect_set("field")).alias("fields"))
    rows = parts.join(company, "_id", "left").join(fields, "_id", "left").select(
        session, turn, "part", "_pos", "sub_question", "company", F.when(F.size("fields") > 0, F.array_join("fields", ",")).alias("fields"),
        F.col("t.year").alias("year"), F.col("t.period").alias("period"), F.col("t.type").alias("time_type"))
    opening = parts.groupBy(F.col(session).alias("_session")).agg(F.min("_pos").alias("_opening"))
    kind = questions.request_kind(F.col("sub_question"), F.col("company").isNotNull(), F.col("_pos") > F.col("_opening"))
    rows = rows.join(opening, F.col(session).eqNullSafe(F.col("_session"))).withColumn("kind", kind).drop("_session", "_opening")
    return questions.carry_slots(rows, [session], "_pos", ["company", "fields", "year", "period"]).drop("_pos")
