"""Question logs derived from ``events`` and ``conversations``: time, kinds, slots, spans, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstat.catalog.base import query, values
from quillstat.functions import fixed, timeparse
from quillstat.functions.expr import settled
from quillstat.operators import blocked, joins, matching, questions
from quillstat.operators.windows import numbered
from quillstat.plans.enrich_questions import enrich_questions
from quillstat.plans.views import table
from quillstat.session import stored, work_path
from quillstat.sources import documents as text_sources
from quillstat.sources.filings import dictionary_report, field_dictionary

YEAR = "(2018+event_id%7)"


def log(spark, sf_dir):
    """One question per event: the user is the session, the event id the turn."""
    e = table(spark, sf_dir, "events")
    s, y = F.lit, (F.lit(2018) + F.col("event_id") % 7).cast("string")
    company = F.concat(s("企业"), (F.col("user_id") % 20).cast("string"), s("号"))
    k = F.col("event_id") % 8
    text = (F.when(k == 0, F.concat(company, y, s("年营业收入是多少"))).when(k == 1, s("那净利润呢"))
            .when(k == 2, F.concat(company, y, s("-2024总资产走势，另外现金流分析怎么样"))).when(k == 3, F.concat(y, s("Q3毛利率排名前五")))
            .when(k == 4, F.concat(s("近三年"), company, s("研发费用画图"))).when(k == 5, F.concat(y, s("半年报归母净利润多少")))
            .when(k == 6, s("为什么去年下降")).otherwise(F.concat(s("最新盈利能力同时"), F.substring(y, 3, 2), s("年报存货"))))
    return e.select(F.col("user_id").alias("session_id"), F.col("event_id").alias("turn"), text.alias("text"))


LOG = f"""lg AS (SELECT user_id session_id, event_id turn, CAST(event_id%8 AS INTEGER) k, {YEAR} y, '企业'||CAST(user_id%20 AS VARCHAR)||'号' company, CASE event_id%8
 WHEN 0 THEN '企业'||CAST(user_id%20 AS VARCHAR)||'号'||CAST({YEAR} AS VARCHAR)||'年营业收入是多少' WHEN 1 THEN '那净利润呢'
 WHEN 2 THEN '企业'||CAST(user_id%20 AS VARCHAR)||'号'||CAST({YEAR} AS VARCHAR)||'-2024总资产走势，另外现金流分析怎么样' WHEN 3 THEN CAST({YEAR} AS VARCHAR)||'Q3毛利率排名前五'
 WHEN 4 THEN '近三年企业'||CAST(user_id%20 AS VARCHAR)||'号研发费用画图' WHEN 5 THEN CAST({YEAR} AS VARCHAR)||'半年报归母净利润多少' WHEN 6 THEN '为什么去年下降'
 ELSE '最新盈利能力同时'||substr(CAST({YEAR} AS VARCHAR),3,2)||'年报存货' END AS text FROM events)"""


@query("time_expressions", "FN12 FN13", f"WITH {LOG} SELECT turn, CASE k WHEN 0 THEN 'year' WHEN 2 THEN 'range' WHEN 3 THEN 'quarter' WHEN 4 THEN 'rolling' WHEN 5 THEN 'half' WHEN 6 THEN 'relative' WHEN 7 THEN 'year' ELSE 'latest' END AS type, "
       "CAST(CASE WHEN k IN (0,3,5,7) THEN y WHEN k=6 THEN 2025 END AS INTEGER) AS year, CASE k WHEN 3 THEN 3 END AS \"quarter\", CASE k WHEN 5 THEN 1 END AS half, CAST(CASE k WHEN 2 THEN least(y,2024) WHEN 4 THEN 2023 END AS INTEGER) year_start, "
       "CAST(CASE k WHEN 2 THEN greatest(y,2024) WHEN 4 THEN 2025 END AS INTEGER) year_end, CASE k WHEN 4 THEN 3 END AS rolling, CASE k WHEN 3 THEN 'Q3' WHEN 5 THEN 'H1' END AS period, CASE k WHEN 0 THEN CAST(y AS VARCHAR)||'年' WHEN 2 THEN CAST(least(y,2024) AS VARCHAR)||'-'||CAST(greatest(y,2024) AS VARCHAR)||'年' WHEN 3 THEN CAST(y AS VARCHAR)||'年Q3' "
       "WHEN 4 THEN '近3年' WHEN 5 THEN CAST(y AS VARCHAR)||'年H1' WHEN 6 THEN '去年' WHEN 7 THEN CAST(y AS VARCHAR)||'年' ELSE '(未指定时间，默认显示最新数据)' END label FROM lg")
def time_expressions(spark, sf_dir):
    t = settled(log(spark, sf_dir), t=timeparse.parse_time_expression(F.col("text"), 2026))
    return t.select("turn", *[f"t.{c}" for c in ("type", "year", "quarter", "half", "year_start", "year_end", "rolling", "period")], timeparse.time_label(F.col("t")).alias("label"))


@query("request_kinds", "FN36", f"WITH {LOG} SELECT turn, CASE k WHEN 1 THEN 'indicator' WHEN 2 THEN 'analysis' WHEN 3 THEN 'rank' WHEN 4 THEN 'chart' WHEN 6 THEN 'analysis' ELSE 'normal' END kind, CASE k WHEN 3 THEN 5 END rank_number FROM lg")
def request_kinds(spark, sf_dir):
    t = F.col("text")
    return log(spark, sf_dir).select("turn", questions.request_kind(t).alias("kind"), questions.rank_number(t).alias("rank_number"))


@query("split_requests", "FN38", f"WITH {LOG} SELECT turn, part, CASE WHEN k=2 AND part=0 THEN company||CAST(y AS VARCHAR)||'-2024总资产走势，' WHEN k=2 THEN '现金流分析怎么样' WHEN k=7 AND part=0 THEN '最新盈利能力' WHEN k=7 THEN substr(CAST(y AS VARCHAR),3,2)||'年报存货' ELSE text END sub_question FROM lg, (SELECT unnest([0,1]) part) WHERE part=0 OR k IN (2,7)")
def split_requests(spark, sf_dir):
    return questions.split_requests(log(spark, sf_dir), "text").select("turn", "part", "sub_question")


def company_terms(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("pos")).distinct().select(
        F.concat(F.lit("企业"), F.col("pos").cast("string"), F.lit("号")).alias("term"), F.concat(F.lit("C"), F.col("pos").cast("string")).alias("company"), "pos")


@query("company_in_text", "FN43", f"WITH {LOG} SELECT turn, 'C'||replace(replace(company,'企业',''),'号','') company FROM lg WHERE k IN (0,2,4)")
def company_in_text(spark, sf_dir):
    return questions.first_named(log(spark, sf_dir), "turn", "text", company_terms(spark, sf_dir)).select("turn", "company")


def synonyms(spark):
    return spark.createDataFrame(fixed.COMMON_SYNONYMS, "field string, synonym string")


SYN = values(fixed.COMMON_SYNONYMS, "field, synonym")


@query("fields_in_text", "JN9", f"WITH {LOG}, hit AS (SELECT turn, text, field, synonym FROM lg JOIN {SYN} ON contains(text, synonym)) SELECT h.turn, h.field, h.synonym, length(h.synonym)/length(h.text)*0.8+0.2 score FROM hit h WHERE NOT EXISTS (SELECT 1 FROM hit o WHERE o.turn=h.turn AND o.synonym<>h.synonym AND contains(o.synonym, h.synonym))")
def fields_in_text(spark, sf_dir):
    return matching.fields_in_text(log(spark, sf_dir), "turn", "text", synonyms(spark), "synonym").select("turn", "field", "synonym", "score")


@query("synonym_exact", "JN7", f"WITH t AS (SELECT event_id, CASE event_id%5 WHEN 0 THEN '营收' WHEN 1 THEN '净资产' WHEN 2 THEN 'ROE' WHEN 3 THEN '毛利' ELSE '存货' END term FROM events) SELECT event_id, term, field, 1.0::DOUBLE score FROM t JOIN {SYN} ON term=synonym")
def synonym_exact(spark, sf_dir):
    k = F.col("event_id") % 5
    t = table(spark, sf_dir, "events").select("event_id", F.when(k == 0, "营收").when(k == 1, "净资产").when(k == 2, "ROE").when(k == 3, "毛利").otherwise("存货").alias("term"))
    return matching.synonym_join(t, "term", synonyms(spark))


@query("synonym_substring", "JN8", f"WITH t AS (SELECT DISTINCT CASE event_id%5 WHEN 0 THEN '毛利' WHEN 1 THEN '现金' WHEN 2 THEN '费用' WHEN 3 THEN '总' ELSE '收益率' END term FROM events) SELECT term, synonym, field, score FROM (SELECT term, synonym, field, length(term)/length(synonym)*0.9 score, ROW_NUMBER() OVER (PARTITION BY term ORDER BY length(term)/length(synonym)*0.9 DESC, synonym) rn FROM t JOIN {SYN} ON contains(synonym, term)) WHERE rn<=2")
def synonym_substring(spark, sf_dir):
    k = F.col("event_id") % 5
    t = table(spark, sf_dir, "events").select(F.when(k == 0, "毛利").when(k == 1, "现金").when(k == 2, "费用").when(k == 3, "总").otherwise("收益率").alias("term"))
    return matching.synonym_substring_join(t, "term", synonyms(spark), top_k=2).select("term", "synonym", "field", "score")


CONCEPT_ROWS = [(c, i, f) for c, fs in fixed.CONCEPTS.items() for i, f in enumerate(fs)]


def concept_frames(spark):
    return (spark.createDataFrame(CONCEPT_ROWS, "concept string, pos int, field string"),
            spark.createDataFrame(list(fixed.CONCEPT_ALIASES.items()), "alias string, concept string"))


@query("expand_concepts", "JN10 ST5", f"WITH t AS (SELECT user_id, event_id position, CASE event_id%4 WHEN 0 THEN '盈利能力' WHEN 1 THEN '偿债分析' WHEN 2 THEN '资产结构' ELSE '商誉' END term FROM events), n AS (SELECT t.*, COALESCE(a.concept, term) c FROM t LEFT JOIN {values(list(fixed.CONCEPT_ALIASES.items()), 'alias, concept').replace('AS v(', 'AS a(')} ON term=a.alias), "
       f"r AS (SELECT user_id, COALESCE(k.field, term) field, CASE WHEN k.field IS NOT NULL THEN c END expanded_from, position, COALESCE(k.pos,0) child FROM n LEFT JOIN {values(CONCEPT_ROWS, 'concept, pos, field').replace('AS v(', 'AS k(')} ON c=k.concept) SELECT user_id, field, expanded_from, position, child FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id, field ORDER BY position, child) rn FROM r) WHERE rn=1")
def expand_concepts(spark, sf_dir):
    k = F.col("event_id") % 4
    t = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("position"), F.when(k == 0, "盈利能力").when(k == 1, "偿债分析").when(k == 2, "资产结构").otherwise("商誉").alias("term"))
    concepts, aliases = concept_frames(spark)
    return matching.expand_concepts(t, ["user_id"], "term", concepts, aliases)


SLOTS = ("SELECT user_id session_id, event_id turn, CASE WHEN event_type='purchase' THEN 'C'||CAST(event_id%9 AS VARCHAR) END company, CASE WHEN event_type IN ('click','purchase') THEN 'I'||CAST(event_id%4 AS VARCHAR) END indicator, CASE WHEN event_type='signup' THEN 2018+event_id%7 END AS year FROM events")


def slot_turns(spark, sf_dir):
    t = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("session_id"), F.col("event_id").alias("turn"), F.when(t == "purchase", F.concat(F.lit("C"), (F.col("event_id") % 9).cast("string"))).alias("company"),
        F.when(t.isin("click", "purchase"), F.concat(F.lit("I"), (F.col("event_id") % 4).cast("string"))).alias("indicator"), F.when(t == "signup", F.lit(2018) + F.col("event_id") % 7).alias("year"))


@query("carry_slots", "WN14", f"WITH s AS ({SLOTS}) SELECT session_id, turn, last_value(company IGNORE NULLS) OVER w company, last_value(indicator IGNORE NULLS) OVER w indicator, last_value(year IGNORE NULLS) OVER w AS year FROM s WINDOW w AS (PARTITION BY session_id ORDER BY turn ROWS UNBOUNDED PRECEDING)")
def carry_slots(spark, sf_dir):
    return questions.carry_slots(slot_turns(spark, sf_dir), ["session_id"], "turn", ["company", "indicator", "year"])


@query("recent_turns", "WN15", "SELECT conv_id, turn, role, text FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn DESC) rn FROM conversations) WHERE rn<=3")
def recent_turns(spark, sf_dir):
    return questions.recent_turns(table(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", 3)


@query("enriched_questions", "CP12", f"WITH {LOG}, p AS (SELECT session_id, turn, part, k, y, turn*1000+part pos, CASE WHEN k IN (0,4) OR (k=2 AND part=0) THEN 'C'||replace(replace(company,'企业',''),'号','') END company, "
       "CASE WHEN k=0 THEN 'total_operating_revenue' WHEN k=1 THEN 'net_profit' WHEN k=2 AND part=0 THEN 'asset_total_assets' WHEN k=2 THEN 'financing_cf_net_amount,investing_cf_net_amount,operating_cf_net_amount' WHEN k=3 THEN 'gross_profit_margin' WHEN k=4 THEN 'operating_expense_rnd_expenses' WHEN k=5 THEN 'net_profit' WHEN k=7 AND part=0 THEN 'gross_profit_margin,net_profit_margin,roe,roe_weighted_excl_non_recurring' WHEN k=7 THEN 'asset_inventory' END fields, "
       "CASE WHEN k IN (0,3,5) OR (k=7 AND part=1) THEN y WHEN k=6 THEN 2025 END yr, CASE WHEN k=3 THEN 'Q3' WHEN k=5 THEN 'H1' END per, CASE WHEN k=1 THEN 'indicator' WHEN k=3 THEN 'rank' WHEN k=4 THEN 'chart' WHEN k=6 OR (k=2 AND part=1) THEN 'analysis' WHEN k=7 AND part=1 THEN 'indicator' WHEN k=7 THEN 'indicator' ELSE 'normal' END kind "
       "FROM lg, (SELECT unnest([0,1]) part) WHERE part=0 OR k IN (2,7)) SELECT session_id, turn, part, CASE WHEN pos=MIN(pos) OVER (PARTITION BY session_id) THEN 'normal' ELSE kind END kind, last_value(company IGNORE NULLS) OVER w company, last_value(fields IGNORE NULLS) OVER w fields, CAST(last_value(yr IGNORE NULLS) OVER w AS INTEGER) AS year, last_value(per IGNORE NULLS) OVER w AS period FROM p WINDOW w AS (PARTITION BY session_id ORDER BY pos ROWS UNBOUNDED PRECEDING)")
def enriched_questions(spark, sf_dir):
    concepts, aliases = concept_frames(spark)
    out = enrich_questions(log(spark, sf_dir), company_terms(spark, sf_dir), synonyms(spark), concepts, aliases, 2026)
    return out.select("session_id", "turn", "part", "kind", "company", "fields", "year", "period")


@query("merged_understanding", "FN41 FN42", "SELECT event_id, CASE WHEN i='comparison' AND c IS NOT NULL AND n<2 THEN 'basic_query' ELSE i END intent, c company, ind indicator, yr AS year, CASE WHEN i='open_question' THEN 'open question' WHEN (i='basic_query' OR (i='comparison' AND c IS NOT NULL AND n<2)) AND c IS NULL THEN 'company missing' "
       "WHEN (i='basic_query' OR (i='comparison' AND c IS NOT NULL AND n<2)) AND yr IS NULL THEN 'year missing' WHEN ind IS NULL THEN 'indicator missing' END problem, CAST(least(0.30+(CASE WHEN i<>'open_question' THEN 0.25 ELSE 0 END)+(CASE WHEN ind IS NOT NULL THEN 0.20 ELSE 0 END)+(CASE WHEN c IS NOT NULL THEN 0.15 ELSE 0 END)+(CASE WHEN yr IS NOT NULL THEN 0.10 ELSE 0 END)+(CASE WHEN p IS NOT NULL THEN 0.05 ELSE 0 END),0.95) AS DECIMAL(4,2)) confidence FROM ("
       "SELECT event_id, CASE event_type WHEN 'view' THEN 'basic_query' WHEN 'click' THEN 'comparison' WHEN 'error' THEN 'open_question' ELSE 'stat_query' END i, CASE user_id%3 WHEN 0 THEN 'T1' WHEN 1 THEN CASE WHEN event_id%2=0 THEN 'M' END ELSE 'D' END c, CASE user_id%3 WHEN 0 THEN event_id%3 ELSE 0 END n, CASE WHEN event_id%4<>0 THEN 'X' END ind, CASE WHEN event_id%5=0 THEN 2020 WHEN event_id%5=1 THEN 2019 END yr, CASE WHEN event_id%7=0 THEN 'FY' END p FROM events WHERE NOT (user_id%3=0 AND event_id%3=0)) UNION ALL "
       "SELECT event_id, 'stat_query', NULL, NULL, NULL, 'indicator missing', CAST(0.55 AS DECIMAL(4,2)) FROM events WHERE user_id%3=0 AND event_id%3=0")
def merged_understanding(spark, sf_dir):
    e, u, t = F.col("event_id"), F.col("user_id") % 3, F.col("event_type")
    none = F.lit(None).cast("string")
    empty = (u == 0) & (e % 3 == 0)
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.when(empty, "stat_query").when(t == "view", "basic_query").when(t == "click", "comparison").when(t == "error", "open_question").otherwise("stat_query").alias("intent"),
        F.when(u == 0, F.slice(F.array(F.lit("T1"), F.lit("T2")), 1, (e % 3).cast("int"))).otherwise(F.array().cast("array<string>")).alias("tag_companies"),
        F.when(~empty & (e % 8 < 4) & (e % 4 != 0), F.array(F.lit("X"))).otherwise(F.array().cast("array<string>")).alias("tag_indicators"), F.array().cast("array<string>").alias("tag_periods"),
        F.when((u == 1) & (e % 2 == 0), "M").otherwise("").alias("model_company"), F.when(~empty & (e % 4 != 0), "X").otherwise(none).alias("model_indicator"),
        F.when(~empty & (e % 7 == 0), "FY").otherwise(none).alias("model_period"), F.when(~empty & (e % 5 == 0), 1999).when(~empty & (e % 5 == 1), 2019).alias("model_year"),
        F.when(u == 2, "D").otherwise(none).alias("dict_company"), F.when(~empty & (e % 5 == 0), 2020).alias("time_year"), none.alias("time_period"))
    m = questions.merge_understanding(rows)
    conf = questions.answer_confidence(*[F.col(c) for c in ("intent", "indicator", "company", "year", "period")])
    return m.select("event_id", "intent", "company", "indicator", "year", "problem", conf.alias("confidence"))


@query("repaired_model_output", "FN40", "SELECT event_id, CASE WHEN event_id%3=2 THEN 'unknown' ELSE 'time_trend' END intent, '企业'||CAST(user_id AS VARCHAR) company, 2018+event_id%7 AS year, CASE WHEN event_id%3=1 THEN '净利润' END indicator, CASE WHEN event_id%3=0 THEN true END needs_chart, CASE WHEN event_id%3=0 THEN CAST(event_id%10 AS INTEGER) END top_k FROM events")
def repaired_model_output(spark, sf_dir):
    e, s = F.col("event_id"), F.lit
    c, y = F.concat(s("企业"), F.col("user_id").cast("string")), (F.lit(2018) + e % 7).cast("string")
    raw = (F.when(e % 3 == 0, F.concat(s("{ “intent”：“time_trend”， “company”：“"), c, s("近三年”，\"year\":"), y, s("\",\"needs_chart\":True,\"top_k\": "), (e % 10).cast("string"), s("}")))
           .when(e % 3 == 1, F.concat(s("[\"intent\":\"time_trend\",\"company\":「"), c, s("」,year:"), y, s(",\"indicator\":净利润\"]"))).otherwise(F.concat(s("{\"company\":\""), c, s("\",\"year\":"), y, s("}"))))
    m = table(spark, sf_dir, "events").select("event_id", questions.model_fields(raw).alias("m"))
    return m.select("event_id", "m.intent", "m.company", F.col("m.year").cast("long").alias("year"), "m.indicator", "m.needs_chart", "m.top_k")


@query("training_pairs", "FN44", "SELECT event_id, CASE WHEN multi AND (company_b IS NOT NULL OR year_b IS NOT NULL) THEN '上文：{'||concat_ws(',', CASE WHEN company_b IS NOT NULL THEN '\"company\":\"'||company_b||'\"' END, CASE WHEN year_b IS NOT NULL THEN '\"year\":\"'||year_b||'\"' END)||'}'||chr(10) ELSE '' END||'问题：'||q||chr(10)||'输出JSON：' AS input, "
       "'{'||concat_ws(',', CASE WHEN company IS NOT NULL THEN '\"company\":\"'||company||'\"' END, CASE WHEN year IS NOT NULL THEN '\"year\":\"'||year||'\"' END)||'}' AS output FROM (SELECT *, last_value(CASE WHEN NOT multi THEN company END IGNORE NULLS) OVER w company_b, last_value(CASE WHEN NOT multi THEN year END IGNORE NULLS) OVER w year_b FROM (SELECT event_id, user_id, 'Q'||CAST(event_id AS VARCHAR) q, event_type='click' multi, "
       "CASE WHEN event_id%3=0 THEN 'C'||CAST(event_id%9 AS VARCHAR) END company, CASE WHEN event_id%4=0 THEN CAST(2018+event_id%7 AS VARCHAR) END AS year FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))")
def training_pairs(spark, sf_dir):
    e = F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.concat(F.lit("Q"), e.cast("string")).alias("q"), (F.col("event_type") == "click").alias("multi"),
                                                 F.when(e % 3 == 0, F.concat(F.lit("C"), (e % 9).cast("string"))).alias("company"), F.when(e % 4 == 0, (F.lit(2018) + e % 7).cast("string")).alias("year"))
    return questions.training_pairs(rows, "event_id", "q", "multi", ["company", "year"], ["company", "year"], by=["user_id"]).select("event_id", "input", "output")


@query("hash_split", "FN44", "SELECT part, COUNT(*) n, CAST(SUM(doc_id) AS BIGINT) s FROM (SELECT doc_id, CASE WHEN CAST(('0x'||substr(md5(CAST(doc_id AS VARCHAR)),1,8)) AS BIGINT)%100<80 THEN 'train' ELSE 'test' END part FROM documents) GROUP BY 1")
def hash_split(spark, sf_dir):
    return questions.hash_split(table(spark, sf_dir, "documents").select("doc_id"), "doc_id").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.sum("doc_id").alias("s"))


def tagged(spark, sf_dir, shift):
    """Tokens of every turn tagged by their length; ``shift`` moves the prediction away from the gold tags."""
    t = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(F.filter(F.split("text", " "), lambda x: x != "")).alias("pos", "token"))
    k = (F.length("token") + (F.col("pos") * shift) % 2) % 6
    label = F.when(k == 0, "B-COMP").when(k == 1, "I-COMP").when(k == 2, "B-METRIC").when(k == 3, "I-METRIC").otherwise("O")
    return t.select("conv_id", "turn", "pos", "token", label.alias("label"))


def TAGGED(shift):
    return (f"(SELECT conv_id, turn, pos, token, CASE k WHEN 0 THEN 'B-COMP' WHEN 1 THEN 'I-COMP' WHEN 2 THEN 'B-METRIC' WHEN 3 THEN 'I-METRIC' ELSE 'O' END label FROM (SELECT *, (length(token)+(pos*{shift})%2)%6 k FROM (SELECT conv_id, turn, unnest(w) token, generate_subscripts(w,1)-1 pos FROM (SELECT conv_id, turn, list_filter(string_split(text,' '), lambda x: x<>'') w FROM conversations))))")


def SPANS(shift):
    return (f"(SELECT conv_id, turn, MIN(pos) s, MAX(pos) e, MIN(kind) entity, string_agg(token,'' ORDER BY pos) AS text FROM (SELECT *, SUM(CASE WHEN cont THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS UNBOUNDED PRECEDING) g FROM (SELECT *, label LIKE 'I-%' AND substr(label,3)=substr(COALESCE(LAG(label) OVER (PARTITION BY conv_id, turn ORDER BY pos),'O'),3) AND COALESCE(LAG(label) OVER (PARTITION BY conv_id, turn ORDER BY pos),'O')<>'O' cont, substr(label,3) kind FROM {TAGGED(shift)})) WHERE label<>'O' GROUP BY conv_id, turn, g HAVING arg_min(label, pos) LIKE 'B-%')")


@query("bio_spans", "WN18", f"SELECT conv_id, turn, s AS start, e AS \"end\", entity, text FROM {SPANS(0)}")
def bio_spans(spark, sf_dir):
    return questions.bio_spans(tagged(spark, sf_dir, 0), ["conv_id", "turn"], "pos", "token", "label").select("conv_id", "turn", "start", "end", "entity", "text")


@query("entity_scores", "AG22", f"WITH g AS {SPANS(0)}, p AS {SPANS(1)}, j AS (SELECT entity, COUNT(*) FILTER (gg AND pp) tp, COUNT(*) FILTER (pp) np, COUNT(*) FILTER (gg) support FROM (SELECT COALESCE(g.entity,p.entity) entity, g.s IS NOT NULL gg, p.s IS NOT NULL pp FROM g FULL JOIN p ON g.conv_id=p.conv_id AND g.turn=p.turn AND g.s=p.s AND g.e=p.e AND g.entity=p.entity) GROUP BY 1), "
       "m AS (SELECT entity, COALESCE(tp/NULLIF(np,0),0) pr, COALESCE(tp/NULLIF(support,0),0) rc, support FROM (SELECT * FROM j UNION ALL SELECT 'micro avg', SUM(tp), SUM(np), SUM(support) FROM j)), f AS (SELECT *, COALESCE(2.0*pr*rc/NULLIF(pr+rc,0),0) f1 FROM m) SELECT entity, CAST(pr AS DECIMAL(10,6)) AS precision, CAST(rc AS DECIMAL(10,6)) recall, CAST(f1 AS DECIMAL(10,6)) f1, CAST(support AS BIGINT) support FROM f UNION ALL SELECT 'macro avg', CAST(AVG(pr) AS DECIMAL(10,6)), CAST(AVG(rc) AS DECIMAL(10,6)), CAST(AVG(f1) AS DECIMAL(10,6)), CAST(SUM(support) AS BIGINT) FROM f WHERE entity<>'micro avg'")
def entity_scores(spark, sf_dir):
    # only the places of the spans are compared, so their texts are not put together
    spans = [stored(questions.bio_spans(tagged(spark, sf_dir, s), ["conv_id", "turn"], "pos", "token", "label").drop("text"), "spans") for s in (0, 1)]
    out = questions.entity_prf(spans[0], spans[1], ["conv_id", "turn"])
    return out.select("entity", *[F.col(c).cast("decimal(10,6)").alias(c) for c in ("precision", "recall", "f1")], "support")


@query("generation_metrics", "AG23", "SELECT COUNT(*) n, AVG(CASE WHEN event_id%5<>0 THEN 1.0 ELSE 0 END) json_valid_rate, AVG(CASE WHEN event_id%5<>0 AND event_id%3<>0 THEN 1.0 ELSE 0 END) intent_accuracy, AVG(CASE WHEN event_id%5<>0 AND event_id%3<>0 THEN 1.0 ELSE 0 END) exact_match FROM events")
def generation_metrics(spark, sf_dir):
    e = F.col("event_id")
    expected = F.concat(F.lit('{"intent": "'), F.col("event_type"), F.lit('"}'))
    predicted = F.when(e % 5 == 0, F.concat(F.lit("["), expected)).when(e % 3 == 0, F.lit('{"intent": "other"}')).otherwise(F.concat(expected, F.lit(" ")))
    return questions.generation_metrics(table(spark, sf_dir, "events").select(predicted.alias("p"), expected.alias("e")), "p", "e")


EVAL = (f"{LOG}, ev AS (SELECT turn, text, CASE WHEN k=1 THEN 'timeout while reading' END error, CASE WHEN turn%11=0 THEN 0 ELSE 3 END n_rows, CASE WHEN turn%13=0 THEN 0 ELSE 2 END n_values, k FROM lg), "
        "st AS (SELECT turn, CASE WHEN k=3 THEN '销售毛利率' END formula, k=3 needs_compare, false needs_filter, CASE WHEN k=1 THEN 'ERROR' WHEN n_rows=0 THEN 'FAIL' WHEN k=3 AND n_values=0 THEN 'PARTIAL' ELSE 'OK' END status FROM ev)")


def evaluated(spark, sf_dir):
    t = F.col("turn")
    rows = log(spark, sf_dir).select("turn", F.col("text").alias("question"), F.when(t % 8 == 1, "timeout while reading").alias("error"),
                                     F.when(t % 11 == 0, 0).otherwise(3).alias("n_rows"), F.when(t % 13 == 0, 0).otherwise(2).alias("n_values"))
    return questions.evaluate_questions(rows)


@query("evaluated_questions", "CP13", f"WITH {EVAL} SELECT * FROM st")
def evaluated_questions(spark, sf_dir):
    return evaluated(spark, sf_dir).select("turn", "formula", "needs_compare", "needs_filter", "status")


@query("suite_rollup", "AG21", f"WITH {EVAL} SELECT status, COUNT(*) n FROM st GROUP BY 1 UNION ALL SELECT 'PASSED', COUNT(*) FILTER (status IN ('OK','PARTIAL')) FROM st")
def suite_rollup(spark, sf_dir):
    return questions.suite_rollup(evaluated(spark, sf_dir))


@query("failure_reasons", "AG21 TK8", f"WITH {EVAL} SELECT CASE status WHEN 'FAIL' THEN 'no data' ELSE 'timeout while reading' END reason, COUNT(*) n FROM st WHERE status IN ('FAIL','ERROR') GROUP BY 1")
def failure_reasons(spark, sf_dir):
    return questions.failure_reasons(evaluated(spark, sf_dir))


@query("zip_by_position", "JN15", "SELECT a.position, doc_id, event_id FROM (SELECT ROW_NUMBER() OVER (ORDER BY doc_id) position, doc_id FROM documents) a JOIN (SELECT ROW_NUMBER() OVER (ORDER BY value, event_id) position, event_id FROM events) b USING (position)")
def zip_by_position(spark, sf_dir):
    left = numbered(table(spark, sf_dir, "documents").select("doc_id"), [F.col("doc_id")])
    right = numbered(table(spark, sf_dir, "events").select("event_id", "value"), [F.col("value"), F.col("event_id")]).drop("value")
    return joins.zip_by_position(left, right)


@query("question_blocks", "SRC17", "SELECT CAST(event_id AS VARCHAR)||' '||event_type question FROM events WHERE event_type<>'error'")
def question_blocks(spark, sf_dir):
    """A text of question blocks delimited by --- is written by Spark and cut again."""
    path = work_path(spark, "questions")
    e = table(spark, sf_dir, "events")
    body = F.concat(F.lit("编号\n"), F.when(F.col("event_type") == "error", "无题").otherwise(F.concat(F.lit("问题："), F.col("event_id").cast("string"), F.lit(" "), F.col("event_type"), F.lit(" (多轮: 继承上文)"))), F.lit("\n---"))
    e.select(body.alias("value")).write.text(path)
    return text_sources.read_questions(spark, path)


@query("annotation_lines", "SRC17", "SELECT event_type, COUNT(*) n, CAST(SUM(user_id) AS BIGINT) s FROM events GROUP BY 1")
def annotation_lines(spark, sf_dir):
    path = work_path(spark, "annotations")
    table(spark, sf_dir, "events").select(F.col("event_type").alias("intent"), F.col("user_id").alias("company")).write.json(path)
    return text_sources.read_annotations(spark, path, "intent string, company long").groupBy(F.col("intent").alias("event_type")).agg(F.count(F.lit(1)).alias("n"), F.sum("company").alias("s"))


@query("field_labels", "FN47", f"SELECT l_orderkey, l_linenumber, f.field, f.label FROM lineitem JOIN (SELECT *, ROW_NUMBER() OVER ()-1 i FROM {values([(f, la) for f, _, _, la in fixed.FIELDS], 'field, label')}) f ON l_partkey%57=f.i".replace("ROW_NUMBER() OVER ()-1 i", "list_position([" + ",".join(f"'{f}'" for f, *_ in fixed.FIELDS) + "], field)-1 i"))
def field_labels(spark, sf_dir):
    names = F.array(*[F.lit(f) for f, *_ in fixed.FIELDS])
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.element_at(names, (F.col("l_partkey") % len(fixed.FIELDS) + 1).cast("int")).alias("field"))
    labelled = questions.label_of(rows, "field", field_dictionary(spark))
    return questions.field_of(labelled.drop("field"), "label", field_dictionary(spark)).select("l_orderkey", "l_linenumber", "field", "label")


@query("dictionary_problems", "JN7", "SELECT 'duplicate' problem, p_name entry FROM part GROUP BY 2 HAVING COUNT(DISTINCT p_type)>1 UNION ALL SELECT DISTINCT 'orphan', p_type FROM part WHERE p_type NOT IN (SELECT p_type FROM part WHERE p_size>48)")
def dictionary_problems(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    return dictionary_report(p.filter("p_size > 48").select(F.col("p_type").alias("label")), p.select(F.col("p_name").alias("synonym"), F.col("p_type").alias("label")))


@query("running_positions", "WN18", "SELECT user_id, event_id, CAST(SUM(CASE WHEN event_type='error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) errors FROM events")
def running_positions(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    return blocked.running_sum(e, ["user_id"], "event_id", (F.col("event_type") == "error").cast("int"), "errors").drop("event_type")
