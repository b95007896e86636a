"""Question logs: kinds, splitting, slots, carry-forward, model output, evaluation.

Turns of a session are positions; slots are carried along them in blocks, so a session of any length works.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.functions import fixed
from quillstat.functions.timeparse import cn_number
from quillstat.operators.blocked import carry_forward, running_sum
from quillstat.operators.filters import contains_any
from quillstat.operators.matching import contains_join
from quillstat.operators.windows import first_rows
from quillstat.session import broadcast_if_small


# kinds

def request_kind(text: Column, has_company: Column | None = None, earlier: Column | None = None) -> Column:
    """chart, report, rank, analysis, indicator (a short follow-up) or normal; with ``earlier``, normal where no question went before."""
    kind = (F.when(contains_any(text, fixed.CHART_WORDS), "chart").when(contains_any(text, fixed.REPORT_WORDS), "report")
            .when(contains_any(text, fixed.RANK_WORDS), "rank").when(contains_any(text, fixed.ANALYSIS_WORDS), "analysis")
            .when(is_short_followup(text, has_company), "indicator").otherwise("normal"))
    return kind if earlier is None else F.when(earlier, kind).otherwise("normal")


def is_short_followup(text: Column, has_company: Column | None = None) -> Column:
    named = F.lit(False) if has_company is None else has_company
    short = (F.length(text) <= 8) & ~named & ~text.rlike(r"20\d{2}")
    return contains_any(text, fixed.FOLLOWUP_WORDS) | short


def rank_number(text: Column) -> Column:
    """Number after 第 or, without one, after 前."""
    numeral = "[一二三四五六七八九十0-9]+"
    first = F.nullif(F.regexp_extract(text, f"第({numeral})", 1), F.lit(""))
    second = F.nullif(F.regexp_extract(text, f"前({numeral})", 1), F.lit(""))
    return cn_number(F.coalesce(first, second))


def split_requests(df: DataFrame, text: str) -> DataFrame:
    """One row per sub-question (part, sub_question): split at the first listed connector that occurs."""
    t = F.col(text)
    connector = reduce(lambda acc, w: acc.when(t.contains(w), F.lit(w)), fixed.SPLIT_WORDS[1:], F.when(t.contains(fixed.SPLIT_WORDS[0]), F.lit(fixed.SPLIT_WORDS[0])))
    parts = F.transform(F.split(F.replace(t, connector, F.lit("\x01")), "\x01"), lambda p: F.regexp_replace(F.trim(p), r"^[，,、；;：:。.！!？?\s]+", ""))
    kept = F.filter(parts, lambda p: p != "")
    chosen = F.when(connector.isNull() | (F.size(kept) == 0), F.array(t)).otherwise(kept)
    return df.select("*", F.posexplode(chosen).alias("part", "sub_question"))


# dictionaries in text

def first_named(texts: DataFrame, text_id: str, text: str, names: DataFrame, term: str = "term", position: str = "pos") -> DataFrame:
    """(text_id, columns of names) of the dictionary entry that comes first in the dictionary among those in the text."""
    hits = contains_join(texts.select(text_id, text), text, names, term)
    return first_rows(hits.drop(text), [text_id], [F.col(position)])


def label_of(df: DataFrame, field: str, dictionary: DataFrame, name: str = "label") -> DataFrame:
    """Field → label; the field itself when it is unknown."""
    d = dictionary.select(F.col("field").alias(field), F.col("label").alias("_label"))
    return df.join(broadcast_if_small(d), field, "left").withColumn(name, F.coalesce("_label", F.col(field))).drop("_label")


def field_of(df: DataFrame, label: str, dictionary: DataFrame, name: str = "field") -> DataFrame:
    d = dictionary.select(F.col("label").alias(label), F.col("field").alias("_field"))
    return df.join(broadcast_if_small(d), label, "left").withColumn(name, F.col("_field")).drop("_field")


# sessions

def carry_slots(turns: DataFrame, session: list[str], turn: str, slots: list[str], partitions: int | None = None) -> DataFrame:
    """Every unspecified slot inherits the most recent value of its session; new values override."""
    return carry_forward(turns, session, turn, slots, partitions)


def recent_turns(turns: DataFrame, session: list[str], turn: str, answer: str, n: int, limit: int | None = None) -> DataFrame:
    """The last n turns of each session with whole answers (with ``limit``: their first characters)."""
    last = first_rows(turns, session, [F.col(turn).desc(), F.col(answer)], n)
    return last if limit is None else last.withColumn(answer, F.substring(answer, 1, limit))


# merging of slots

def merge_understanding(df: DataFrame) -> DataFrame:
    """Tagged slots over model slots, with the dictionary as last resort for the company; checks required slots.

    Columns used: intent, tag_companies, tag_indicators, tag_periods (arrays), model_company, model_indicator,
    model_period, model_year, dict_company, time_year, time_period.
    """
    head = lambda c: F.try_element_at(F.col(c), F.lit(1))
    blank = lambda c: F.nullif(c, F.lit(""))
    company = F.coalesce(blank(head("tag_companies")), blank(F.col("model_company")), blank(F.col("dict_company")))
    indicator = F.coalesce(blank(head("tag_indicators")), blank(F.col("model_indicator")))
    year = F.coalesce("time_year", "model_year")
    period = F.coalesce(blank(F.col("time_period")), blank(head("tag_periods")), blank(F.col("model_period")))
    out = df.withColumns({"company": company, "indicator": indicator, "year": year, "period": period})
    n = F.coalesce(F.size("tag_companies"), F.lit(0))
    intent = F.when((F.col("intent") == "comparison") & F.col("company").isNotNull() & (n < 2), "basic_query").otherwise(F.col("intent"))
    out = out.withColumn("intent", intent)
    problem = (F.when(F.col("intent") == "open_question", "open question")
               .when((F.col("intent") == "basic_query") & F.col("company").isNull(), "company missing")
               .when((F.col("intent") == "basic_query") & F.col("year").isNull(), "year missing")
               .when(F.col("indicator").isNull(), "indicator missing"))
    return out.withColumn("problem", problem)


# Intents that raise the confidence.
KNOWN_INTENTS = ["basic_query", "stat_query", "comparison", "time_trend", "fuzzy_intent", "analysis_query"]


def answer_confidence(intent: Column, indicator: Column, company: Column, year: Column, period: Column) -> Column:
    """0.3 plus 0.25, 0.2, 0.15, 0.1, 0.05 for what is present, within 0.1 and 0.95."""
    part = lambda c, v: F.when(c, F.lit(v).cast("decimal(4,2)")).otherwise(F.lit("0").cast("decimal(4,2)"))
    total = (F.lit("0.30").cast("decimal(4,2)") + part(intent.isin(KNOWN_INTENTS), "0.25") + part(indicator.isNotNull(), "0.20")
             + part(company.isNotNull(), "0.15") + part(year.isNotNull(), "0.10") + part(period.isNotNull(), "0.05"))
    return F.greatest(F.least(total, F.lit("0.95").cast("decimal(4,2)")), F.lit("0.10").cast("decimal(4,2)")).cast("decimal(4,2)")


# model output

def repair_model_json(raw: Column) -> Column:
    """Punctuation of generated JSON made regular."""
    t = F.translate(raw, " ，：“”「」《》[]", "\x01,:\"\"\"\"\"\"{}")
    t = F.replace(t, F.lit("\x01"), F.lit(""))
    t = F.replace(F.replace(t, F.lit("True"), F.lit("true")), F.lit("False"), F.lit("false"))
    t = F.regexp_replace(t, r':([一-鿿]+)"', r':"$1"')
    t = F.regexp_replace(t, r'":(\d+)"', r'":$1')
    return F.regexp_replace(t, r"year:(\d+),", r'"year":$1,')


def model_fields(raw: Column) -> Column:
    """Struct of the fields read out of repaired model text."""
    t = repair_model_json(raw)
    get = lambda p: F.nullif(F.regexp_extract(t, p, 1), F.lit(""))
    company = F.coalesce(get(r'"company":"([^"]+)"'), get(r'"company":([一-鿿]+)'))
    company = F.nullif(F.regexp_replace(company, "(近三年|近五年|去年|今年).*$", ""), F.lit(""))
    flag = lambda k: get(rf'"{k}":(true|false)') == "true"
    return F.struct(
        F.coalesce(get(r'"intent":"([^"]+)"'), F.lit("unknown")).alias("intent"), company.alias("company"), get(r'"year":(\d+)').try_cast("int").alias("year"),
        get(r'"period":"([^"]+)"').alias("period"), F.coalesce(get(r'"indicator":"([^"]+)"'), get(r'"indicator":([一-鿿]+)')).alias("indicator"),
        flag("needs_chart").alias("needs_chart"), flag("needs_rag").alias("needs_rag"), flag("is_multi_turn").alias("is_multi_turn"),
        get(r'"chart_type":"([^"]+)"').alias("chart_type"), get(r'"top_k":(\d+)').try_cast("int").alias("top_k"))


# training pairs

def training_pairs(df: DataFrame, position: str, question: str, multi: str, context: list[str], fields: list[str], by: list[str] | None = None,
                   partitions: int | None = None) -> DataFrame:
    """Adds input and output: prompt with the running context of earlier single-turn rows, JSON of the filled fields."""
    keys = by or ["_all"]
    rows = df if by else df.withColumn("_all", F.lit(0))
    fresh = rows.withColumns({f"_x_{c}": F.when(~F.col(multi), F.nullif(F.col(c).cast("string"), F.lit(""))) for c in context})
    carried = carry_forward(fresh, keys, position, [f"_x_{c}" for c in context], partitions, suffix="_before", before=True)
    ctx = F.to_json(F.struct(*[F.col(f"_x_{c}_before").alias(c) for c in context]))
    known = F.coalesce(*[F.col(f"_x_{c}_before") for c in context]).isNotNull()
    prefix = F.when(F.col(multi) & known, F.concat(F.lit("上文："), ctx, F.lit("\n"))).otherwise("")
    out = carried.withColumn("input", F.concat(prefix, F.lit("问题："), F.col(question), F.lit("\n输出JSON：")))
    out = out.withColumn("output", F.to_json(F.struct(*[F.nullif(F.col(c).cast("string"), F.lit("")).alias(c) for c in fields])))
    return out.drop("_all", *[f"_x_{c}" for c in context], *[f"_x_{c}_before" for c in context])


def hash_split(df: DataFrame, key: str, train_share: float = 0.8) -> DataFrame:
    """Adds ``part`` (train or test) by a hash of the key: stable and without overlap."""
    bucket = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("bigint") % 100
    return df.withColumn("part", F.when(bucket < int(train_share * 100), "train").otherwise("test"))


# spans and metrics

def bio_spans(tokens: DataFrame, sentence: list[str], position: str, token: str, label: str, partitions: int | None = None) -> DataFrame:
    """(sentence…, start, end, entity, text): B-x opens, matching I-x extends, anything else closes."""
    kind = F.regexp_extract(label, r"^[BI]-(.+)$", 1)
    rows = tokens.withColumn("_kind", kind).withColumn("_b", F.col(label).startswith("B-"))
    # a token continues the one before when it is I-x after B-x or I-x of the same kind
    previous = tokens.select(*sentence, (F.col(position) + 1).alias(position), F.regexp_extract(label, r"^[BI]-(.+)$", 1).alias("_pk"))
    rows = rows.join(previous, [*sentence, position], "left").withColumn(
        "_joined", ~F.col("_b") & (F.col("_kind") != "") & (F.col("_kind") == F.coalesce("_pk", F.lit(""))))
    numbered = running_sum(rows, sentence, position, (~F.col("_joined")).cast("int"), "_run", partitions)
    # a run that does not open with B- is no span
    ordered = numbered.filter(F.col("_kind") != "").withColumns({"_at": F.col(position), "_token": F.col(token)})
    spans = ordered.groupBy(*sentence, "_run").agg(
        F.min("_at").alias("start"), F.max("_at").alias("end"), F.min_by("_kind", "_at").alias("entity"),
        F.min_by("_b", "_at").alias("_open"), F.expr("listagg(_token, '') WITHIN GROUP (ORDER BY _at)").alias("_t"))
    return spans.filter("_open").select(*sentence, "start", "end", "entity", F.coalesce("_t", F.lit("")).alias("text"))


def entity_prf(gold: DataFrame, predicted: DataFrame, sentence: list[str]) -> DataFrame:
    """precision, recall, f1 and support by entity type, plus micro and macro averages."""
    key = [*sentence, "start", "end", "entity"]
    g, p = gold.select(*key).distinct().withColumn("_g", F.lit(1)), predicted.select(*key).distinct().withColumn("_p", F.lit(1))
    both = g.join(p, key, "full").groupBy("entity").agg(F.count_if(F.col("_g").isNotNull() & F.col("_p").isNotNull()).alias("tp"), F.count("_p").alias("n_pred"), F.count("_g").alias("support"))
    prec, rec = F.try_divide(F.col("tp"), F.col("n_pred")), F.try_divide(F.col("tp"), F.col("support"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))

    def measures(df):
        d = df.withColumn("precision", zero(prec)).withColumn("recall", zero(rec))
        return d.withColumn("f1", zero(F.try_divide(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))).select("entity", "precision", "recall", "f1", "support")

    per = measures(both)
    micro = measures(both.agg(F.sum("tp").alias("tp"), F.sum("n_pred").alias("n_pred"), F.sum("support").alias("support")).withColumn("entity", F.lit("micro avg")))
    macro = per.agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1"), F.sum("support").alias("support")).withColumn("entity", F.lit("macro avg"))
    return per.unionByName(micro).unionByName(macro)


def generation_metrics(df: DataFrame, predicted: str, expected: str) -> DataFrame:
    """Rates of valid JSON, equal intent and equal text."""
    p, e = F.trim(predicted), F.trim(expected)
    valid = F.try_parse_json(p).isNotNull()
    same = valid & F.get_json_object(p, "$.intent").eqNullSafe(F.get_json_object(e, "$.intent"))
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    return df.agg(F.count(F.lit(1)).alias("n"), rate(valid).alias("json_valid_rate"), rate(same).alias("intent_accuracy"), rate(p == e).alias("exact_match"))


# evaluation of a question suite

def needed_formula(text: Column) -> Column:
    words = fixed.FORMULA_WORDS
    return reduce(lambda acc, w: acc.when(text.contains(w[0]), F.lit(w[1])), words[1:], F.when(text.contains(words[0][0]), F.lit(words[0][1])))


def evaluate_questions(df: DataFrame, question: str = "question", rows: str = "n_rows", values: str = "n_values", error: str = "error") -> DataFrame:
    """Adds formula, needs and status (SKIP, ERROR, FAIL, PARTIAL, OK) with a detail text."""
    q = F.col(question)
    formula = needed_formula(q)
    status = (F.when(q.isNull() | (F.length(q) < 3), "SKIP").when(F.col(error).isNotNull(), "ERROR").when(F.coalesce(rows, F.lit(0)) == 0, "FAIL")
              .when(formula.isNotNull() & (F.coalesce(values, F.lit(0)) == 0), "PARTIAL").otherwise("OK"))
    detail = (F.when(F.col("status") == "ERROR", F.col(error)).when(F.col("status") == "FAIL", "no data")
              .when(F.col("status") == "PARTIAL", F.concat(F.col("formula"), F.lit(" without result"))))
    return df.withColumns({
        "formula": formula, "needs_compare": contains_any(q, fixed.COMPARE_WORDS), "needs_filter": contains_any(q, fixed.FILTER_WORDS),
        "needs_yoy": q.contains("同比"), "needs_industry": contains_any(q, fixed.INDUSTRY_WORDS), "status": status}).withColumn("detail", detail)


def suite_rollup(results: DataFrame) -> DataFrame:
    """(status, n, share) and the pass rate as its own row."""
    per = results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    total = results.agg(F.count_if(F.col("status").isin("OK", "PARTIAL")).alias("n")).select(F.lit("PASSED").alias("status"), "n")
    return per.unionByName(total)


def failure_reasons(results: DataFrame, n: int | None = None) -> DataFrame:
    """Whole reasons of failed questions by count (with ``n``: the most frequent ones)."""
    bad = results.filter(F.col("status").isin("FAIL", "ERROR"))
    counts = bad.groupBy(F.col("detail").alias("reason")).agg(F.count(F.lit(1)).alias("n"))
    return counts if n is None else counts.orderBy(F.col("n").desc(), "reason").limit(n)
