"""Sections and chunks of Markdown notes; every document is cut inside its own row, without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstat.functions import fixed
from quillstat.functions.expr import settled
from quillstat.functions.textclean import SPACES, base_name, classify_section, estimate_tokens, strip
from quillstat.operators.matching import contains_join
from quillstat.operators.windows import first_rows, numbered


def _body(section: Column) -> Column:
    """Lines without blanks and third-level headings."""
    lines = F.transform(F.split(section, "\n"), lambda x: F.rtrim(x, F.lit(SPACES)))
    return strip(F.array_join(F.filter(lines, lambda x: (x != "") & ~strip(x).startswith("###")), "\n"))


def sections(docs: DataFrame, doc_id: str, text: str, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, keep…, section_no, heading, body, is_last, raw): one row per heading; the first is the title.

    A document without a second heading is one row with heading null.
    """
    parts = F.split(F.col(text), r"(?m)^(?=[^\S\n]*##? )")
    headed = F.filter(parts, lambda p: p.rlike(r"^[^\S\n]*##? "))
    keep = keep or []
    rows = settled(docs.select(doc_id, *keep, text), _h=headed).withColumn("_n", F.size("_h"))
    # both kinds of documents take one way, so that a text is read once
    title = lambda p: strip(F.regexp_replace(F.regexp_extract(p, r"^([^\n]*)", 1), r"^[^\S\n]*##? ", ""))
    part = lambda no, heading, raw, last: F.struct(no.alias("section_no"), heading.alias("heading"), raw.alias("raw"), last.alias("is_last"))
    whole = F.array(part(F.lit(1), F.lit(None).cast("string"), F.col(text), F.lit(True)))
    many = F.transform("_h", lambda p, i: part(i + 1, title(p), F.regexp_replace(p, r"^[^\n]*\n?", ""), i + 1 == F.col("_n")))
    out = rows.select(doc_id, *keep, F.inline(F.when(F.col("_n") <= 1, whole).otherwise(many)))
    return settled(out, body=F.when(F.col("heading").isNull(), strip(F.col("raw"))).otherwise(_body(F.col("raw"))))


def pack(paragraphs: Column, minimum: int, maximum: int, carry: bool = False) -> Column:
    """Greedy packing of paragraphs (array<struct<text, tokens>>) into chunks of the same type, in order.

    A remainder below ``minimum`` is dropped, or with ``carry`` joined to what follows.
    """
    empty = F.array().cast("array<struct<text:string,tokens:int>>")
    start = F.struct(empty.alias("done"), F.lit("").alias("text"), F.lit(0).alias("tokens"))

    def flush(done, text, tokens):
        full = (text != "") & (tokens >= minimum)
        return F.when(full, F.concat(done, F.array(F.struct(text.alias("text"), tokens.alias("tokens"))))).otherwise(done)

    def step(acc, item):
        done, text, tokens = acc.getField("done"), acc.getField("text"), acc.getField("tokens")
        para, size = item.getField("text"), item.getField("tokens")
        fits = tokens + size <= maximum
        fits = (fits | ((tokens > 0) & (tokens < minimum))) if carry else fits
        joined = F.when(text == "", para).otherwise(F.concat(text, F.lit("\n\n"), para))
        return F.struct(
            F.when(fits, done).otherwise(flush(done, text, tokens)).alias("done"),
            F.when(fits, joined).otherwise(para).alias("text"),
            F.when(fits, tokens + size).otherwise(size).alias("tokens"))

    return F.aggregate(paragraphs, start, step, lambda acc: flush(acc.getField("done"), acc.getField("text"), acc.getField("tokens")))


def chunks(docs: DataFrame, doc_id: str, text: str, minimum: int = 100, maximum: int = 512, carry: bool = False,
           keep_blank_lines: bool = True, keep: list[str] | None = None) -> DataFrame:
    """(doc_id, keep…, section_no, part, section, text, token_count) of all chunks.

    Sections of at most ``maximum`` tokens are one chunk; longer ones are packed from their paragraphs.
    Without ``keep_blank_lines`` the paragraphs are looked for after blank lines were removed, which leaves
    a long section whole.
    """
    keep = keep or []
    s = sections(docs, doc_id, text, keep)
    section = F.when(F.col("heading").isNull(), F.lit(fixed.WHOLE_TEXT)).otherwise(classify_section(F.col("heading")))
    s = settled(s.filter(F.coalesce(section, F.lit("")) != "目录").withColumn("section", section), tokens=estimate_tokens(F.col("body")))
    short = (F.col("tokens") < minimum) & (~F.col("is_last") | F.col("heading").isNull())
    s = s.filter((F.col("body") != "") & ~short)
    source = F.col("raw") if keep_blank_lines else F.col("body")
    texts = F.filter(F.transform(F.split(source, r"\n\s*\n"), _body), lambda p: p != "")
    sized = F.transform(texts, lambda p: F.struct(p.alias("text"), estimate_tokens(p).alias("tokens")))
    single = F.array(F.struct(F.col("body").alias("text"), F.col("tokens").alias("tokens")))
    whole = (F.col("tokens") <= maximum) | F.col("heading").isNull()
    s = settled(s.select(doc_id, *keep, "section_no", "section", "raw", "body", "tokens", whole.alias("_whole")), _items=F.when(
        F.col("_whole"), single).otherwise(sized))
    packed = F.when(F.col("_whole"), F.col("_items")).otherwise(pack(F.col("_items"), minimum, maximum, carry))
    return s.select(doc_id, *keep, "section_no", "section", F.posexplode(packed).alias("part", "_c")).select(
        doc_id, *keep, "section_no", "part", "section", F.col("_c.text").alias("text"), F.col("_c.tokens").alias("token_count"))


def number_chunks(rows: DataFrame, order: list[str], more: DataFrame | None = None, on: str | None = None) -> DataFrame:
    """Corpus-wide chunk index from 0 in the given order; only the keys are sorted, not the texts.

    The rows are read twice, so pass a stored frame. The columns of ``more`` meet the keys by ``on``, so the texts are dealt once.
    """
    keys = numbered(rows.select(*order), [F.col(c) for c in order], "_p")
    keys = keys if more is None else keys.join(more, on)
    return rows.join(keys, order).withColumn("chunk_index", F.col("_p") - 1).drop("_p")


def heading_parts(text: Column) -> Column:
    """Struct (heading, named, code, before_colon) of the first level-one heading."""
    heading = strip(F.regexp_extract(text, r"(?m)^#[^\S\n]+(.+)", 1))
    code = F.regexp_extract(heading, r"^.+?\s*\(([0-9A-Za-z.]+)\)", 1)
    named = F.when(code != "", strip(F.regexp_extract(heading, r"^(.+?)\s*\([0-9A-Za-z.]+\)", 1)))
    before = F.when(heading != "", strip(F.regexp_extract(heading, r"^([^：:]*)", 1)))
    return F.struct(F.nullif(heading, F.lit("")).alias("heading"), named.alias("named"), F.nullif(code, F.lit("")).alias("code"),
                    before.alias("before_colon"))


def company_from_heading(docs: DataFrame, doc_id: str, text: str, file_name: str, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """(doc_id, company, stock_code): heading with a code, heading before the colon, file name, else the industry bucket.

    ``names`` has (name, pos) and ``aliases`` (alias, name, pos). Each tier is a containment join on short texts.
    """
    d = settled(docs.select(doc_id, text, file_name), h=heading_parts(F.col(text)), _file=base_name(F.col(file_name)))
    return lookup_company(d.select(doc_id, "h.named", "h.code", "h.before_colon", "_file"), doc_id, names, aliases)


def lookup_company(d: DataFrame, doc_id: str, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """The lookup of :func:`company_from_heading` on (doc_id, named, code, before_colon, _file)."""
    by_name = names.select(F.col("name").alias("_term"), F.col("name").alias("_real"), "pos", F.lit(0).alias("_kind"))
    by_alias = aliases.select(F.col("alias").alias("_term"), F.col("name").alias("_real"), "pos", F.lit(1).alias("_kind"))
    # One pass over all three texts of a document; a tier is a text and a kind of term. Heading before the colon: a name may also contain it.
    parts = F.array(*[F.struct(F.lit(n).alias("_tier"), F.col(c).alias("_text")) for n, c in ((1, "named"), (3, "before_colon"), (5, "_file"))])
    rows = d.select(doc_id, F.inline(parts)).filter("_text <> ''")
    forward = contains_join(rows, "_text", by_name.unionByName(by_alias), "_term")
    backward = contains_join(by_name, "_term", rows.filter("_tier = 3"), "_text", small="texts")
    found = forward.unionByName(backward.select(*forward.columns)).select(doc_id, (F.col("_tier") + F.col("_kind")).alias("_tier"), "pos", F.col("_real").alias("company"))
    best = first_rows(found, [doc_id], [F.col("_tier"), F.col("pos")])
    return d.join(best, doc_id, "left").select(
        doc_id, F.coalesce("company", F.lit(fixed.INDUSTRY_BUCKET)).alias("company"),
        F.when(F.col("_tier") <= 2, F.col("code")).alias("stock_code"))


def corpus_summary(all_files: DataFrame, rows: DataFrame, source: str = "source_file") -> DataFrame:
    """files, ok, failed, chunks, tokens, mean tokens per chunk."""
    files = all_files.select(source).distinct().join(rows.groupBy(source).agg(
        F.count(F.lit(1)).alias("_c"), F.sum("token_count").alias("_t")), source, "left")
    return files.agg(
        F.count(F.lit(1)).alias("files"), F.count("_c").alias("ok"), F.count_if(F.col("_c").isNull()).alias("failed"),
        F.coalesce(F.sum("_c"), F.lit(0)).alias("chunks"), F.coalesce(F.sum("_t"), F.lit(0)).alias("tokens"),
        F.try_divide(F.sum("_t"), F.sum("_c")).alias("mean_tokens"))
