"""Cleaning, measuring, sectioning and chunking of notes derived from ``documents`` and ``pages``."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillstat.catalog.base import query
from quillstat.functions import textclean
from quillstat.functions.expr import settled
from quillstat.operators import chunking, topk
from quillstat.plans.chunk_documents import chunk_documents
from quillstat.plans.views import table
from quillstat.session import spread, work_path
from quillstat.sources import documents as sources

# Notes: every document becomes a Markdown note with a title, headings, figures, a formula, a table, an image and,
# for some, a disclaimer. The same text is built on both sides.


def notes(spark, sf_dir):
    i, s = F.col("doc_id").cast("string"), F.lit
    k = F.col("doc_id") % 5
    heading = F.when(k == 0, "投资要点").when(k == 1, "财务数据").when(k == 2, "风险提示").when(k == 3, "行业竞争").otherwise("Outlook")
    html = F.concat(s("<table border=1><tr><th>营业收入</th><th> 净利润 </th></tr><tr><td>"), i, s("</td><td>"), F.col("n_chars").cast("string"),
                    s("</td></tr><tr><td>合计</td></tr><tr><td></td><td>7</td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>"))
    footer = F.when(F.col("doc_id") % 7 == 3, F.concat(s("\n\n声明段落\n分析师声明\n本人具有资格 "), i)).otherwise("")
    title = F.concat(s("# Supplier"), F.lpad((F.col("doc_id") % 100).cast("string"), 3, "0"),
                     F.when(k == 1, F.concat(s(" (6000"), (F.col("doc_id") % 100).cast("string"), s(")"))).otherwise("：点评"))
    text = F.concat(
        title, s("\n\n增长 $1 2 . 5 \\times 3$ 元 ![图](a.png) 50%\n\n## "), heading, s("\n"), F.replace("text", s("\n"), s("\n\n")),
        s("\n\n![logo](b.png)\n### 附注\n## 目录\n1\n# 评级\n"), html, s("\n\n\n\n结束"), footer)
    year = (F.lit(2015) + F.col("doc_id") % 10).cast("string")
    name = F.concat(s("Supplier"), F.lpad((F.col("doc_id") % 100).cast("string"), 3, "0"), s("_"), year,
                    F.when(k == 0, "年报点评").when(k == 1, "三季报业绩").when(k == 2, "首次覆盖").when(k == 3, "Q1简评").otherwise("memo"), s("_"), i, s(".md"))
    docs = spread(table(spark, sf_dir, "documents"), "doc_id")
    return docs.select("doc_id", name.alias("file_name"), text.alias("text"))


NOTES = """notes AS (SELECT doc_id, 'Supplier'||lpad(CAST(doc_id%100 AS VARCHAR),3,'0')||'_'||CAST(2015+doc_id%10 AS VARCHAR)||
 CASE doc_id%5 WHEN 0 THEN '年报点评' WHEN 1 THEN '三季报业绩' WHEN 2 THEN '首次覆盖' WHEN 3 THEN 'Q1简评' ELSE 'memo' END||'_'||CAST(doc_id AS VARCHAR)||'.md' file_name,
 '# Supplier'||lpad(CAST(doc_id%100 AS VARCHAR),3,'0')||CASE WHEN doc_id%5=1 THEN ' (6000'||CAST(doc_id%100 AS VARCHAR)||')' ELSE '：点评' END||
 chr(10)||chr(10)||'增长 $1 2 . 5 \\times 3$ 元 ![图](a.png) 50%'||chr(10)||chr(10)||'## '||
 CASE doc_id%5 WHEN 0 THEN '投资要点' WHEN 1 THEN '财务数据' WHEN 2 THEN '风险提示' WHEN 3 THEN '行业竞争' ELSE 'Outlook' END||chr(10)||
 replace(text, chr(10), chr(10)||chr(10))||chr(10)||chr(10)||'![logo](b.png)'||chr(10)||'### 附注'||chr(10)||'## 目录'||chr(10)||'1'||chr(10)||'# 评级'||chr(10)||
 '<table border=1><tr><th>营业收入</th><th> 净利润 </th></tr><tr><td>'||CAST(doc_id AS VARCHAR)||'</td><td>'||CAST(n_chars AS VARCHAR)||'</td></tr><tr><td>合计</td></tr><tr><td></td><td>7</td></tr><tr><td>1</td><td>2</td><td>3</td></tr></table>'||
 chr(10)||chr(10)||chr(10)||chr(10)||'结束'||CASE WHEN doc_id%7=3 THEN chr(10)||chr(10)||'声明段落'||chr(10)||'分析师声明'||chr(10)||'本人具有资格 '||CAST(doc_id AS VARCHAR) ELSE '' END AS text FROM documents)"""

CLEAN = NOTES + """,
c1 AS (SELECT doc_id, file_name, replace(regexp_replace(replace(text, '$1 2 . 5 \\times 3$', '12.5 \\times 3'), '\\\\[a-zA-Z]+', '', 'g'), '%', '') t, text raw FROM notes),
c1b AS (SELECT doc_id, file_name, raw, CASE WHEN raw LIKE '%$%$%$%' THEN NULL ELSE t END t FROM c1),
c2 AS (SELECT doc_id, file_name, regexp_replace(replace(c1.t, '$', ''), '!\\[[^\\n]*?\\]\\([^\\n]*?\\)', '', 'g') t FROM c1),
c3 AS (SELECT doc_id, file_name, regexp_replace(t, '<table border=1>.*?</table>', chr(10)||'营业收入'||regexp_extract(t, '<table border=1>.*?<tr><td>([^<]*)</td>', 1)||'；净利润'||regexp_extract(t, '<table border=1>.*?<tr><td>[^<]*</td><td>([^<]*)</td>', 1)||'；合计；净利润7'||chr(10), 's') t FROM c2),
c4 AS (SELECT doc_id, file_name, regexp_replace(t, '[^\\x{4E00}-\\x{9FFF}\\x{3000}-\\x{303F}\\x{FF00}-\\x{FFEF}\\x20-\\x7E\\n\\r\\t\\x{FE30}-\\x{FE4F}]', '', 'g') t FROM c3),
c5 AS (SELECT doc_id, file_name, CASE WHEN t LIKE '%分析师声明%' THEN regexp_replace(split_part(t, chr(10)||chr(10)||'声明段落'||chr(10)||'分析师声明', 1), '^\\s+|\\s+$', '', 'g') ELSE t END t FROM c4),
cleaned AS (SELECT doc_id, file_name, regexp_replace(regexp_replace(t, '\\n{3,}', chr(10)||chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM c5)"""


@query("token_estimate", "FN26",
       "SELECT doc_id, CAST(floor(len(regexp_extract_all(text,'[\\x{4E00}-\\x{9FFF}]'))/1.5 + len(regexp_extract_all(text,'[a-zA-Z0-9]'))/3.5 + len(string_split(text, chr(10)))*0.5) AS INTEGER) tokens FROM documents")
def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", textclean.estimate_tokens(F.col("text")).alias("tokens"))


@query("character_cleaning", "FN23",
       "SELECT page_id, md5(regexp_replace(html, '[^\\x{4E00}-\\x{9FFF}\\x{3000}-\\x{303F}\\x{FF00}-\\x{FFEF}\\x20-\\x7E\\n\\r\\t\\x{FE30}-\\x{FE4F}]', '', 'g')) digest FROM pages")
def character_cleaning(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.md5(textclean.clean_characters(F.col("html"))).alias("digest"))


@query("image_cleaning", "FN21", f"WITH {NOTES} SELECT doc_id, length(regexp_replace(text, '!\\[[^\\n]*?\\]\\([^\\n]*?\\)', '', 'g')) n, md5(regexp_replace(text, '!\\[[^\\n]*?\\]\\([^\\n]*?\\)', '', 'g')) digest FROM notes")
def image_cleaning(spark, sf_dir):
    t = textclean.clean_images(F.col("text"))
    return notes(spark, sf_dir).select("doc_id", F.length(t).alias("n"), F.md5(t).alias("digest"))


@query("latex_cleaning", "FN20",
       "SELECT o_orderkey, replace(CAST(o_totalprice AS VARCHAR), '.', '') || ' kg/' || CAST(o_custkey AS VARCHAR) AS text FROM orders")
def latex_cleaning(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    # digits of the price with a space between each pair of neighbours, inside a formula
    digits = F.replace(F.col("o_totalprice").cast("decimal(20,2)").cast("string"), F.lit("."), F.lit(""))
    raw = F.concat(F.lit("$"), F.regexp_replace(_trimmed(digits, F.col("o_totalprice")), r"(\d)(\d)", "$1 $2"), F.lit("\\ $kg/%"), F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", F.regexp_replace(textclean.clean_latex(raw), r"\\ ", " ").alias("text"))


def _trimmed(digits, price):
    """The decimal digits the way a double prints: without trailing zeros after the point, at least one."""
    return F.when(F.pmod(F.round(price * 100).cast("bigint"), F.lit(10)) == 0, F.regexp_replace(digits, "0$", "")).otherwise(digits)


@query("table_cleaning", "FN22", f"WITH {NOTES} SELECT doc_id, '营业收入'||CAST(doc_id AS VARCHAR)||'；净利润'||CAST(n_chars AS VARCHAR)||'；合计；净利润7' described FROM documents")
def table_cleaning(spark, sf_dir):
    t = textclean.clean_html_tables(F.col("text"))
    return notes(spark, sf_dir).select("doc_id", F.regexp_extract(t, r"(营业收入\d+；[^\n]*)", 1).alias("described"))


@query("footer_cleaning", "FN24", f"WITH {NOTES} SELECT doc_id, CASE WHEN doc_id%7=3 THEN md5(regexp_replace(split_part(text, chr(10)||chr(10)||'声明段落', 1), '^\\s+|\\s+$', '', 'g')) ELSE md5(text) END digest FROM notes")
def footer_cleaning(spark, sf_dir):
    return notes(spark, sf_dir).select("doc_id", F.md5(textclean.clean_footer(F.col("text"))).alias("digest"))


@query("clean_notes", "FN25 FN20 FN21 FN22 FN23 FN24", f"WITH {CLEAN} SELECT doc_id, length(text) n, md5(text) digest FROM cleaned")
def clean_notes(spark, sf_dir):
    t = textclean.clean_all(F.col("text"))
    return settled(notes(spark, sf_dir).select("doc_id", "text"), t=t).select("doc_id", F.length("t").alias("n"), F.md5("t").alias("digest"))


@query("note_metadata", "FN15", f"WITH {NOTES} SELECT doc_id, CAST(2015+doc_id%10 AS INTEGER) AS year, CASE doc_id%5 WHEN 0 THEN '年报点评' WHEN 1 THEN '三季报点评' WHEN 2 THEN '首次覆盖' WHEN 3 THEN '一季报点评' ELSE '公司点评' END report_type, "
       "CASE doc_id%5 WHEN 0 THEN 'FY' WHEN 1 THEN 'Q3' WHEN 3 THEN 'Q1' END AS period FROM notes")
def note_metadata(spark, sf_dir):
    m = textclean.note_metadata(F.col("file_name"))
    return notes(spark, sf_dir).select("doc_id", m.alias("m")).select("doc_id", "m.year", "m.report_type",
                                                                       F.when(F.col("m.period").isNotNull(), F.col("m.period")).alias("period"))


def company_names(spark, sf_dir):
    """Dictionary from the supplier table: names, and short aliases for some."""
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("Supplier"), F.lpad((F.col("s_suppkey") % 100).cast("string"), 3, "0")).alias("name")).distinct()
    names = s.filter(~F.col("name").endswith("7")).withColumn("pos", F.regexp_extract("name", r"(\d+)", 1).cast("int"))
    aliases = s.filter(F.col("name").endswith("7")).select(F.substring("name", 6, 6).alias("alias"), F.concat(F.lit("Real "), F.col("name")).alias("name"),
                                                          F.regexp_extract("name", r"(\d+)", 1).cast("int").alias("pos"))
    return names, aliases


@query("company_from_heading", "FN16", f"WITH {NOTES} SELECT doc_id, CASE WHEN doc_id%10=7 THEN 'Real ' ELSE '' END||'Supplier'||lpad(CAST(doc_id%100 AS VARCHAR),3,'0') company, CASE WHEN doc_id%5=1 THEN '6000'||CAST(doc_id%100 AS VARCHAR) END stock_code FROM notes")
def company_from_heading(spark, sf_dir):
    names, aliases = company_names(spark, sf_dir)
    return chunking.company_from_heading(notes(spark, sf_dir), "doc_id", "text", "file_name", names, aliases)


SECTIONS = NOTES + """,
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) n FROM notes),
sec AS (SELECT *, SUM(CASE WHEN regexp_matches(line, '^[\\t\\r ]*##? ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING) section_no FROM ln),
body AS (SELECT doc_id, section_no, MIN(CASE WHEN regexp_matches(line, '^[\\t\\r ]*##? ') THEN regexp_replace(regexp_replace(line, '^[\\t\\r ]*##? ', ''), '^\\s+|\\s+$', '', 'g') END) heading,
 COALESCE(string_agg(regexp_replace(line, '\\s+$', ''), chr(10) ORDER BY n) FILTER (WHERE NOT regexp_matches(line, '^[\\t\\r ]*##? ') AND regexp_replace(line, '^\\s+|\\s+$', '', 'g')<>'' AND NOT starts_with(regexp_replace(line, '^\\s+', ''), '###')), '') b FROM sec WHERE section_no>0 GROUP BY 1,2),
bodies AS (SELECT doc_id, section_no, heading, regexp_replace(b, '^\\s+|\\s+$', '', 'g') body FROM body)"""


@query("note_sections", "WN23 FN27", f"WITH {SECTIONS} SELECT doc_id, CAST(section_no AS INTEGER) section_no, heading, length(body) n, md5(body) digest, CASE WHEN regexp_matches(heading,'投资要点|核心观点|业绩') THEN '业绩分析' WHEN regexp_matches(heading,'财务|盈利|毛利|净利') THEN '财务分析' "
       "WHEN regexp_matches(heading,'风险|提示') THEN '风险提示' WHEN regexp_matches(heading,'行业|市场|竞争') THEN '行业分析' WHEN regexp_matches(heading,'研发|创新|管线') THEN '研发创新' WHEN regexp_matches(heading,'评级|估值') THEN '评级与估值' WHEN regexp_matches(heading,'目录|CONTENTS') THEN '目录' ELSE '其他' END section FROM bodies")
def note_sections(spark, sf_dir):
    s = chunking.sections(notes(spark, sf_dir), "doc_id", "text")
    return s.select("doc_id", "section_no", "heading", F.length("body").alias("n"), F.md5("body").alias("digest"),
                    textclean.classify_section(F.col("heading")).alias("section"))


TOK = "CAST(floor(len(regexp_extract_all(body,'[\\x{4E00}-\\x{9FFF}]'))/1.5 + len(regexp_extract_all(body,'[a-zA-Z0-9]'))/3.5 + len(string_split(body, chr(10)))*0.5) AS INTEGER)"


@query("whole_section_chunks", "CP9 FLT15", f"WITH {SECTIONS} SELECT doc_id, CAST(section_no AS INTEGER) section_no, {TOK} token_count, md5(body) digest FROM bodies WHERE body<>'' AND heading<>'目录' AND ({TOK}>=100 OR section_no=4) AND {TOK}>=50")
def whole_section_chunks(spark, sf_dir):
    c = chunking.chunks(notes(spark, sf_dir), "doc_id", "text", maximum=10**9)
    return c.filter(F.col("token_count") >= 50).select("doc_id", "section_no", "token_count", F.md5("text").alias("digest"))


_STRIPPED = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_SECTION = ("CASE WHEN regexp_matches(heading,'投资要点|核心观点|业绩') THEN '业绩分析' WHEN regexp_matches(heading,'财务|盈利|毛利|净利') THEN '财务分析' WHEN regexp_matches(heading,'风险|提示') THEN '风险提示' "
            "WHEN regexp_matches(heading,'行业|市场|竞争') THEN '行业分析' WHEN regexp_matches(heading,'研发|创新|管线') THEN '研发创新' WHEN regexp_matches(heading,'评级|估值') THEN '评级与估值' ELSE '其他' END")
# Greedy packing: a paragraph joins the open chunk while it fits; a chunk below 100 tokens is dropped when it closes.
CHUNKS = f"""WITH RECURSIVE {CLEAN}{SECTIONS[len(NOTES):].replace("FROM notes", "FROM cleaned")},
sized AS (SELECT *, {TOK} tok FROM bodies WHERE body<>'' AND heading<>'目录'),
pl AS (SELECT doc_id, section_no, n, line, SUM(CASE WHEN {_STRIPPED.format("line")}='' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, section_no ORDER BY n) g
 FROM sec JOIN sized USING (doc_id, section_no) WHERE tok>512 AND NOT regexp_matches(line, '^[\\t\\r ]*##? ')),
pa AS (SELECT doc_id, section_no, g, {_STRIPPED.format("string_agg(regexp_replace(line, '\\s+$', ''), chr(10) ORDER BY n)")} body FROM pl WHERE {_STRIPPED.format("line")}<>'' AND NOT starts_with({_STRIPPED.format("line")}, '###') GROUP BY 1,2,3),
pn AS (SELECT doc_id, section_no, body t, {TOK} k, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY g) i, count(*) OVER (PARTITION BY doc_id, section_no) n FROM pa WHERE body<>''),
pk AS (SELECT doc_id, section_no, i, n, t, k, CAST(NULL AS VARCHAR) done, 0 size FROM pn WHERE i=1
 UNION ALL SELECT p.doc_id, p.section_no, p.i, p.n, CASE WHEN pk.k+p.k<=512 THEN pk.t||chr(10)||chr(10)||p.t ELSE p.t END, CASE WHEN pk.k+p.k<=512 THEN pk.k+p.k ELSE p.k END,
 CASE WHEN pk.k+p.k>512 AND pk.k>=100 THEN pk.t END, pk.k FROM pk JOIN pn p ON p.doc_id=pk.doc_id AND p.section_no=pk.section_no AND p.i=pk.i+1),
cut AS (SELECT doc_id, section_no, i, done text, size FROM pk WHERE done IS NOT NULL UNION ALL SELECT doc_id, section_no, i+1, t, k FROM pk WHERE i=n AND k>=100),
parts AS (SELECT doc_id, section_no, row_number() OVER (PARTITION BY doc_id, section_no ORDER BY i)-1 part, text, size FROM cut
 UNION ALL SELECT doc_id, section_no, 0, body, tok FROM sized WHERE tok<=512 AND (tok>=100 OR section_no=4))"""


@query("note_chunks", "CP9 FLT15", f"""{CHUNKS} SELECT file_name source_file, CAST(section_no AS INTEGER) section_no, CAST(part AS INTEGER) part, {_SECTION} section, text, CAST(size AS INTEGER) token_count,
 CASE WHEN doc_id%10=7 THEN 'Real ' ELSE '' END||'Supplier'||lpad(CAST(doc_id%100 AS VARCHAR),3,'0') company, CASE WHEN doc_id%5=1 THEN '6000'||CAST(doc_id%100 AS VARCHAR) END stock_code,
 CAST(2015+doc_id%10 AS INTEGER) AS year, CASE doc_id%5 WHEN 0 THEN 'FY' WHEN 1 THEN 'Q3' WHEN 3 THEN 'Q1' END AS period,
 CASE doc_id%5 WHEN 0 THEN '年报点评' WHEN 1 THEN '三季报点评' WHEN 2 THEN '首次覆盖' WHEN 3 THEN '一季报点评' ELSE '公司点评' END report_type,
 row_number() OVER (ORDER BY file_name, section_no, part)-1 chunk_index FROM parts JOIN bodies USING (doc_id, section_no) JOIN (SELECT doc_id, file_name FROM notes) USING (doc_id) WHERE size>=50""")
def note_chunks(spark, sf_dir):
    names, aliases = company_names(spark, sf_dir)
    return chunk_documents(notes(spark, sf_dir), names, aliases)


@query("corpus_summary", "AG14 SRC8", f"WITH {SECTIONS}, ok AS (SELECT doc_id, {TOK} tok FROM bodies WHERE body<>'' AND heading<>'目录' AND ({TOK}>=100 OR section_no=4) AND {TOK}>=50) "
       "SELECT (SELECT COUNT(*) FROM documents) files, COUNT(DISTINCT doc_id) ok, (SELECT COUNT(*) FROM documents)-COUNT(DISTINCT doc_id) failed, COUNT(*) chunks, CAST(SUM(tok) AS BIGINT) tokens, SUM(tok)/COUNT(*) mean_tokens, 50 min_tokens FROM ok")
def corpus_summary(spark, sf_dir):
    path = work_path(spark, "chunks")
    n = notes(spark, sf_dir)
    c = chunking.chunks(n, "doc_id", "text", maximum=10**9).filter(F.col("token_count") >= 50).withColumn("source_file", F.col("doc_id").cast("string"))
    sources.write_chunks(c, n.select(F.col("doc_id").cast("string").alias("source_file")), path)
    return spark.read.schema("files long, ok long, failed long, chunks long, tokens long, mean_tokens double, min_tokens int").json(f"{path}/meta")


@query("documents_by_source", "AG14 TK8", "SELECT source, COUNT(*) n FROM documents GROUP BY 1 ORDER BY n DESC, source LIMIT 20")
def documents_by_source(spark, sf_dir):
    return topk.most_common(table(spark, sf_dir, "documents"), "source", 20)


BODIES = "f AS (SELECT item_id, '# '||CAST(item_id AS VARCHAR)||chr(10)||regexp_replace(text, '\\s+', ' ', 'g') body, item_id % 7 = 0 bad FROM benchmark)"


def document_files(spark, sf_dir):
    """Benchmark texts under their number as files of the caller, one each; every seventh ends in a byte that is no UTF-8."""
    path = work_path(spark, "notes")
    number = F.col("item_id").cast("string")
    body = F.concat(F.lit("# "), number, F.lit("\n"), F.regexp_replace("text", r"\s+", " "))
    odd = F.when(F.col("item_id") % 7 == 0, F.expr("X'20FF78'")).otherwise(F.expr("X''"))
    rows = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("doc"), number).alias("name"), F.concat(F.encode(body, "UTF-8"), odd).cast("string").alias("value"))
    rows.write.partitionBy("name").text(path)
    return path


@query("whole_file_documents", "SRC6", f"WITH {BODIES} SELECT item_id, md5(body||CASE WHEN bad THEN ' '||chr(65533)||'x' ELSE '' END||chr(10)) digest FROM f")
def whole_file_documents(spark, sf_dir):
    read = sources.read_documents(spark, document_files(spark, sf_dir), "*.txt")
    return read.select(F.regexp_extract("text", r"^# (\d+)", 1).cast("long").alias("item_id"), F.md5("text").alias("digest"))


@query("broken_documents", "SRC6", f"WITH {BODIES} SELECT CAST(strlen(body)+4 AS BIGINT) length, 1 n_replaced, COUNT(*) n FROM f WHERE bad GROUP BY 1")
def broken_documents(spark, sf_dir):
    bad = sources.broken_documents(spark, document_files(spark, sf_dir), "*.txt")
    return bad.groupBy("length", "n_replaced").agg(F.count(F.lit(1)).alias("n"))


@query("page_headings", "FN16", "SELECT page_id, regexp_replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '^\\s+|\\s+$', '', 'g') heading FROM pages")
def page_headings(spark, sf_dir):
    md = F.concat(F.lit("# "), F.regexp_extract("html", r"<h1>([^<]*)</h1>", 1))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(chunking.heading_parts(md).getField("heading"), F.lit("")).alias("heading"))
