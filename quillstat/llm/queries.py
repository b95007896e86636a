"""Registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from quillstat.llm import alignment, ann, chat, langid, licenses, linededup, mixing, neardup, negatives, packing, pagetext, quality, repeats
from quillstat.llm.common import table


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    model = langid.fit(docs.where(fold != 2).select("doc_id", "text", "lang"))
    return langid.identify(docs, model).withColumn("held_out", F.coalesce(fold == 2, F.lit(False)))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).drop("host", "content", "removed")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("detections")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = linededup.without_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return left.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, percent=80)


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), "id % 50 = 0", k=5)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), packing.vocabulary(), with_ids=False).drop("ids")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = repeats.without_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Production mixture: sources of one digit are web text, the others curated text.
DOMAIN = "CASE WHEN source RLIKE '^src[0-9]$' THEN 'web' ELSE 'curated' END"
WEIGHTS = {"domain": {"web": 1, "curated": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 2, "src10": 3}}
SHARE, EPOCHS, SEED = 0.8, 3, 11


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), DOMAIN, WEIGHTS, share=SHARE, max_epochs=EPOCHS, seed=SEED)


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    quoting = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", quoting), (-7, 1, "assistant", quoting)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select(*[F.col(c).cast(t).alias(c) for c, t in extra.dtypes]).unionByName(extra)
    return chat.conversation_digests(chat.format_turns(chat.text_messages(rows)))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align_tokenizers(table(spark, sf_dir, "documents"), *alignment.vocabularies())


def op12_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pagetext.extract_main_text(table(spark, sf_dir, "pages"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), "id % 100 = 0", "IF(id % 7 = 0, (label + 1) % 10, label)")


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_line_dedup": op1_line_dedup,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_nearest_neighbours": op3_nearest_neighbours,
    "op4_best_fit_packing": op4_best_fit_packing,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_source_mixing": op6_source_mixing,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_language_id": op8_language_id,
    "op9_quality_rules": op9_quality_rules,
    "op10_license_scan": op10_license_scan,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op12_html_extraction": op12_html_extraction,
    "op13_hard_negatives": op13_hard_negatives,
}

def _fill_sql(name: str, nodes: str, parent: str) -> str:
    """CTE ``name``: the children of ``nodes`` with their share of the parent's budget, as water filling by its definition."""
    w = f"PARTITION BY {parent}" if parent else ""
    return f"""
{name}_o AS (SELECT *, sum(capacity) OVER (o ROWS UNBOUNDED PRECEDING) AS upto, coalesce(sum(weight) OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS after
  FROM {nodes} WINDOW o AS ({w} ORDER BY CAST(capacity AS DOUBLE) / weight, {name})),
{name}_f AS (SELECT *, upto * weight + capacity * after <= CAST(budget AS HUGEINT) * weight AS filled FROM {name}_o),
{name}_b AS (SELECT * EXCLUDE (budget), CASE WHEN filled THEN capacity ELSE
  (CAST(budget AS HUGEINT) - sum(CASE WHEN filled THEN capacity ELSE 0 END) OVER ({w})) * weight // sum(CASE WHEN filled THEN 0 ELSE weight END) OVER ({w}) END AS budget FROM {name}_f)"""


def _weight_sql(level: str) -> str:
    return f"CASE {level} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END"


ORACLES = {
    "op13_hard_negatives": """
WITH u AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
  QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY label, embedding) = 1),
v AS (SELECT id, CASE WHEN id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, v FROM u),
s AS (SELECT a.id AS anchor_id, a.label AS own, r.id, r.label, CAST(list_inner_product(a.v, r.v) AS BIGINT) AS s
  FROM v AS a JOIN v AS r ON a.id <> r.id AND len(a.v) = len(r.v) WHERE a.id % 100 = 0),
p AS (SELECT anchor_id, id AS positive_id, s AS positive_score FROM s WHERE label = own QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY s DESC, id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, id) AS INTEGER) AS rank, id AS negative_id, positive_score, s AS negative_score
FROM p JOIN s USING (anchor_id) WHERE label <> own AND 30 * positive_score <= 100 * s AND 100 * s <= 90 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s DESC, id) <= 10""",
    "op6_source_mixing": rf"""
WITH d AS (SELECT doc_id, CASE WHEN regexp_matches(source, '^src[0-9]$') THEN 'web' ELSE 'curated' END AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS tokens FROM documents),
leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS HUGEINT) AS tokens, CAST(sum(tokens) * {EPOCHS} AS HUGEINT) AS capacity FROM d GROUP BY ALL),
n1 AS (SELECT domain, sum(capacity) AS capacity, CAST({_weight_sql('domain')} AS HUGEINT) AS weight, CAST(floor((SELECT CAST(sum(tokens) AS BIGINT) FROM leaf) * CAST({SHARE} AS DOUBLE)) AS BIGINT) AS budget FROM leaf GROUP BY domain),
{_fill_sql('domain', 'n1', '')},
n2 AS (SELECT domain, lang, sum(leaf.capacity) AS capacity, CAST({_weight_sql('lang')} AS HUGEINT) AS weight, any_value(domain_b.budget) AS budget FROM leaf JOIN domain_b USING (domain) GROUP BY domain, lang),
{_fill_sql('lang', 'n2', 'domain')},
n3 AS (SELECT domain, lang, source, leaf.capacity, CAST({_weight_sql('source')} AS HUGEINT) AS weight, lang_b.budget FROM leaf JOIN lang_b USING (domain, lang)),
{_fill_sql('source', 'n3', 'domain, lang')},
e AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs, CASE WHEN tokens > 0 THEN budget % tokens ELSE -1 END AS rest FROM leaf JOIN source_b USING (domain, lang, source)),
r AS (SELECT d.*, epochs, rest, sum(d.tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('{SEED}:' || CAST(epochs AS BIGINT) || ':' || coalesce(CAST(doc_id AS VARCHAR), ''))) AS running FROM d JOIN e USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, CAST(epochs + CASE WHEN running <= rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM r""",
    "op9_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
w AS (SELECT rid, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, string_split(text, chr(10)) AS rows FROM d),
win AS (SELECT rid, i, words[i] || chr(31) || words[i + 1] || chr(31) || words[i + 2] AS g FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (VALUES (0), (1), (2)) AS o(k) GROUP BY rid),
line AS (SELECT w.rid, host, coalesce(CAST(doc_id AS VARCHAR), 'row ' || w.rid) AS document, trim(regexp_replace(row, '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm, row, len(regexp_extract_all(row, '[^\x20\x09-\x0D]+')) AS n
  FROM (SELECT rid, unnest(rows) AS row FROM w) AS w JOIN d USING (rid) WHERE regexp_matches(row, '[^\x20\x09-\x0D]')),
freq AS (SELECT host, lower(norm) AS norm FROM line GROUP BY 1, 2
  HAVING count(DISTINCT document) > {quality.MAX_DOCS} AND count(DISTINCT document) > {quality.MAX_SHARE} * (SELECT count(DISTINCT document) FROM line AS h WHERE h.host = line.host)),
gone AS (SELECT rid, sum(n) AS n FROM line JOIN freq ON line.host = freq.host AND lower(line.norm) = freq.norm GROUP BY rid),
dup AS (SELECT rid, count(*) - count(DISTINCT row) AS n FROM line GROUP BY rid),
m AS (SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
  CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_removed_words
  FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid) LEFT JOIN gone USING (rid))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed_words < {quality.DEPLETED} * n_words AS kept FROM m""",
}
