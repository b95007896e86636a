"""Lines, words, cells and pages of filings: tagging, scoring, units, spans and table clean-up.

Neighbouring pages meet in blocks of pages that reach a few pages beyond their ends, so every page is read and dealt once and a document of any
length is never one window group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillstat.functions import fixed
from quillstat.functions.expr import let, settled
from quillstat.functions.numbers import detect_unit, parse_number, unit_name
from quillstat.operators.filters import contains_any, first_word
from quillstat.operators.windows import first_rows


#: Pages of a block. A block starts ``FIRST_PAGES`` before a multiple of it, so short documents lie in one block.
PAGE_BLOCK, FIRST_PAGES = 64, 16


def with_neighbours(pages: DataFrame, page: str, above: int, below: int) -> DataFrame:
    """Rows with ``_block``; a page is also a row, with ``_mine`` false, of other blocks whose pages look up to ``above`` pages up or ``below`` pages down for it."""
    def block(p):
        return F.floor((p + FIRST_PAGES) / PAGE_BLOCK)

    p = F.col(page)
    seen = pages.select("*", block(p).alias("_b"), F.explode_outer(F.sequence(block(p - below), block(p + above))).alias("_block"))
    return seen.withColumn("_mine", F.col("_block").eqNullSafe(F.col("_b"))).drop("_b")


def _around(doc: str, page: str, first: int, last: int):
    """The pages of a block from ``first`` to ``last`` pages further on."""
    return W.partitionBy(doc, "_block").orderBy(page).rangeBetween(first, last)


# lines

def tag_line(line: Column) -> Column:
    """Struct (tag, sub_tag): metadata, table header, section title, cover, toc, text."""
    def entry(tag, sub=None):
        return F.struct(F.lit(tag).alias("tag"), F.lit(sub).cast("string").alias("sub_tag"))

    chain = None
    for pattern, sub in fixed.METADATA_LINES:
        chain = F.when(line.rlike(pattern), entry("metadata", sub)) if chain is None else chain.when(line.rlike(pattern), entry("metadata", sub))
    for word, table in fixed.TABLE_TITLES:
        chain = chain.when(line.contains(word), entry("table_header", table))
    for pattern in fixed.SECTION_LINES:
        chain = chain.when(line.rlike(pattern), entry("section_title"))
    return (chain.when(contains_any(line, fixed.COVER_WORDS), entry("cover")).when(contains_any(line, fixed.TOC_WORDS), entry("toc"))
            .otherwise(entry("text")))


def tag_lines(pages: DataFrame, ids: list[str], text: str = "text", cells: DataFrame | None = None) -> DataFrame:
    """(ids…, line_no, line, tag, sub_tag) of all non-blank lines; text lines that hold a cell become table lines."""
    lines = F.transform(F.split(F.col(text), "\n"), lambda x: F.trim(x))
    if cells is None:
        rows = pages.select(*ids, F.posexplode(lines).alias("line_no", "line")).filter("line <> ''")
        return settled(rows, _t=tag_line(F.col("line"))).select(*ids, "line_no", "line", "_t.tag", "_t.sub_tag")
    # a cell lies in a line of its own page, so they meet in the row of the page
    words = cells.select(*ids, F.trim("text").alias("_cell")).filter("_cell <> ''").groupBy(*ids).agg(F.collect_set("_cell").alias("_cells"))
    held = lambda x: F.coalesce(F.exists("_cells", lambda c: F.contains(x, c)), F.lit(False))
    both = F.transform(lines, lambda x: F.struct(x.alias("line"), held(x).alias("held")))
    rows = pages.select(*ids, text).join(words, ids, "left").select(*ids, F.posexplode(both).alias("line_no", "_l")).select(*ids, "line_no", "_l.*").filter("line <> ''")
    tagged = settled(rows, _t=tag_line(F.col("line")))
    tag = F.when((F.col("_t.tag") == "text") & F.col("held"), F.lit("table")).otherwise(F.col("_t.tag"))
    return tagged.select(*ids, "line_no", "line", tag.alias("tag"), "_t.sub_tag")


def first_match(blocks: DataFrame, doc: str, kind: str, order: list[str]) -> DataFrame:
    """(doc, value): first stock code or unit declaration of a document, metadata lines first."""
    if kind == "stock_code":
        value = F.coalesce(*[F.nullif(F.regexp_extract("line", p, 1), F.lit("")) for p in fixed.STOCK_CODE_PATTERNS[:4]])
        value = F.when((F.col("tag") == "metadata") & (F.col("sub_tag") == kind), F.regexp_extract("line", r"(\d{6})", 1)).otherwise(value)
    else:
        declared = F.col("line").rlike(r"单位[：:]\s*(?:人民币)?(?:万|千|亿)?元")
        value = F.when(((F.col("tag") == "metadata") & (F.col("sub_tag") == kind)) | declared, F.col("line"))
    first = F.when((F.col("tag") == "metadata") & (F.col("sub_tag") == kind), 0).otherwise(1)
    rows = blocks.withColumn("_v", value).filter(F.col("_v").isNotNull())
    return rows.groupBy(doc).agg(F.min_by("_v", F.struct(first.alias("f"), *order)).alias("value"))


def tabular_section_pages(blocks: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, table_name, page) of the pages with a statement title."""
    return blocks.filter("tag = 'table_header'").select(doc, F.col("sub_tag").alias("table_name"), page).distinct()


def title_tables(text: Column) -> Column:
    """Array of the statements with a title line in the text, as :func:`tag_line` finds them; lines are only judged where a title occurs."""
    words = [w for w, _ in fixed.TABLE_TITLES]
    metadata = lambda x: reduce(lambda a, b: a | b, [x.rlike(p) for p, _ in fixed.METADATA_LINES])
    hits = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: contains_any(x, words) & ~metadata(x))
    return F.when(contains_any(text, words), F.array_distinct(F.transform(hits, lambda x: first_word(x, fixed.TABLE_TITLES))))


# scores

def count_of(text: Column, word: str) -> Column:
    return ((F.length(text) - F.length(F.replace(text, F.lit(word), F.lit("")))) / len(word)).cast("int")


def _scaled(score: Column, lines: Column) -> Column:
    return F.when(lines < 10, F.floor(score * lines / 10)).otherwise(score).cast("int")


def _title_points(section: list[str]):
    """Points of one title line above a page for a statement with the given section words."""
    def points(x):
        weight = F.greatest(F.lit(15) - x.getField("offset") * 5, F.lit(5))
        return F.when(contains_any(x.getField("line"), section), weight).when(
            contains_any(x.getField("line"), fixed.TITLE_WORDS), F.floor(weight / 2).cast("int")).otherwise(0)

    return points


def page_scores(pages: DataFrame, ids: list[str], text: str = "text", titles: str | None = None, starts: bool = False) -> DataFrame:
    """(ids…, table_name, header, title, lines, words, numbers, score): one row per page and statement type.

    Everything is computed in the row of the page; ``titles`` names a column of title context
    (array of struct offset, line). With ``starts`` a column ``start`` tells whether the page has a title line of the statement.
    """
    t = F.col(text)
    line_count = F.size(F.filter(F.split(t, "\n"), lambda x: (F.length(F.trim(x)) > 10) & x.rlike(r"\d")))
    numbers = F.regexp_extract_all(t, F.lit(r"([+-]?\d[\d,]*\.?\d*(?:万|亿|元)?)"), F.lit(1))
    big = F.size(F.filter(numbers, lambda n: (F.length(F.translate(n, ",.", "")) >= 5) | n.contains("万") | n.contains("亿")))
    context = F.col(titles) if titles else F.array().cast("array<struct<offset:int,line:string>>")
    per_type = []
    for name, profile in fixed.PROFILES.items():
        header = F.least(sum((F.when(t.contains(w), 15).otherwise(0) for w in profile["section"]), F.lit(0)), F.lit(30))
        # most words are not on a page: they are looked for before they are counted
        words = sum((F.when(t.contains(w), F.least(count_of(t, w), F.lit(3)) * pts).otherwise(0) for w, pts in profile["weights"]), F.lit(0))

        title = F.least(F.aggregate(F.transform(context, _title_points(profile["section"])), F.lit(0), lambda a, x: a + x), F.lit(15))
        per_type.append(F.struct(F.lit(name).alias("table_name"), header.alias("header"), title.alias("title"), words.alias("_w"),
                                 contains_any(t, profile["ends"]).alias("foreign"), contains_any(t, profile["own"]).alias("own"),
                                 *([F.coalesce(F.array_contains("_titles", name), F.lit(False)).alias("start")] if starts else [])))
    made = {"_lines": line_count, "_big": big} | ({"_titles": title_tables(t)} if starts else {})
    rows = settled(pages, **made).select(*ids, "_lines", "_big", F.inline(F.array(*per_type)))
    scored = rows.select(
        *ids, "table_name", "header", "title", F.least("_lines", F.lit(20)).alias("lines"),
        _scaled(F.least(F.floor(F.col("_w") / 5), F.lit(25)), F.col("_lines")).alias("words"),
        _scaled(F.least(F.col("_big") * 3, F.lit(25)), F.col("_lines")).alias("numbers"), "foreign", "own", *(["start"] if starts else []))
    return scored.withColumn("score", F.col("header") + F.col("title") + F.col("lines") + F.col("words") + F.col("numbers"))


def page_kind(page: Column, text: Column) -> Column:
    """``summary`` for a first page with three summary words and no section in its first 600 characters."""
    hits = sum((F.when(text.contains(w), 1).otherwise(0) for w in fixed.SUMMARY_WORDS), F.lit(0))
    blocked = contains_any(F.substring(text, 1, 600), fixed.SUMMARY_BLOCKERS)
    return F.when((page == 0) & (hits >= 3) & ~blocked, "summary").otherwise("statement")


def title_context(pages: DataFrame, doc: str, page: str, text: str = "text", above: int = 3, keep: list[str] | None = None) -> DataFrame:
    """(doc, page, keep…, titles): first title-like line of each of the pages above."""
    keep = keep or []
    rows = with_neighbours(titled(pages.select(doc, page, *dict.fromkeys([text, *keep])), text).select(doc, page, *keep, "_title"), page, above, 0)
    return rows.withColumn("titles", titles_above(doc, page, above)).filter("_mine").select(doc, page, *keep, "titles")


def titled(pages: DataFrame, text: str) -> DataFrame:
    """Pages with ``_title``, their first title-like line."""
    return settled(pages, _title=F.trim(F.regexp_extract(text, rf"(?m)^([^\n]*[{''.join(fixed.TITLE_CHARACTERS)}][^\n]*)$", 1)))


def titles_above(doc: str, page: str, above: int) -> Column:
    """Array of struct (offset, line) from the ``_title`` of the pages above; for rows of :func:`with_neighbours`."""
    found = F.collect_list(F.when(F.col("_title") != "", F.struct(F.col(page).alias("at"), F.col("_title").alias("line")))).over(_around(doc, page, -above, -1))
    return F.array_sort(F.transform(found, lambda x: F.struct((F.col(page) - x.getField("at")).cast("int").alias("offset"), x.getField("line").alias("line"))))


def matrix_score(text: Column, table: str) -> Column:
    """Sum of the keyword weights present in a table's text."""
    return sum((F.when(text.contains(w), pts).otherwise(0) for w, pts in fixed.PROFILES[table]["weights"]), F.lit(0))


def pick_table(tables: DataFrame, by: list[str], text: str = "text", rows: str = "n_rows", types: list[str] | None = None) -> DataFrame:
    """Best table per page and statement type: 8 per keyword up to 60, then the number of rows."""
    scored = []
    for t in types or list(fixed.PROFILES):
        hits = sum((F.when(F.col(text).contains(w), 8).otherwise(0) for w, _ in fixed.PROFILES[t]["weights"]), F.lit(0))
        scored.append(F.struct(F.lit(t).alias("table_name"), F.least(hits, F.lit(60)).alias("content_score"), matrix_score(F.col(text), t).alias("matrix_score")))
    wide = tables.filter(F.col(rows) >= 2).select("*", F.inline(F.array(*scored)))
    return first_rows(wide, [*by, "table_name"], [F.col("content_score").desc(), F.col(rows).desc(), F.col("table_no")])


# units

def nearest_unit(pages: DataFrame, doc: str, page: str, text: str = "text", up: int = 5, down: int = 3) -> DataFrame:
    """(doc, page, factor, unit, source) for every page.

    The declaration before the first section mark of the page, then anywhere on it, then on the pages above
    and below; a page with a section mark ends the search after it was read.
    """
    t = F.col(text)
    marks = "|".join(fixed.SECTION_MARKS)
    head = F.regexp_extract(t, rf"(?s)^(.*?)(?:{marks}|\z)", 1)
    p = settled(pages.filter(F.trim(text) != "").select(doc, page, text), _head=detect_unit(head), _all=detect_unit(t), _mark=t.rlike(marks))
    own = F.when(F.col("_head.found"), F.col("_head")).when(F.col("_all.found"), F.col("_all"))
    p = with_neighbours(p.select(doc, page, own.alias("_own"), "_all", "_mark"), page, up, down)
    # at most up + down rows meet per page
    told = F.when(F.col("_all.found") | F.col("_mark"), F.struct(F.col(page).alias("at"), F.col("_all").alias("all"), F.col("_mark").alias("mark")))
    seen = p.withColumn("_seen", F.collect_list(told).over(_around(doc, page, -up, down))).filter("_mine")
    others = F.transform(F.filter("_seen", lambda x: x.getField("at") != F.col(page)), lambda x: F.struct(
        F.when(x.getField("at") < F.col(page), 1).otherwise(2).alias("dir"), F.abs(x.getField("at") - F.col(page)).alias("off"), x.getField("all").alias("_all"), x.getField("mark").alias("mark")))
    rows = settled(seen.select(doc, page, "_own", "_seen"), _others=others)
    stop = lambda d: F.array_min(F.transform(F.filter("_others", lambda x: (x.getField("dir") == d) & x.getField("mark")), lambda x: x.getField("off")))
    rows = settled(rows.select(doc, page, "_own", "_others"), _s1=stop(1), _s2=stop(2))
    admissible = F.filter("_others", lambda x: x.getField("_all").getField("found") & (x.getField("off") <= F.coalesce(
        F.when(x.getField("dir") == 1, F.col("_s1")).otherwise(F.col("_s2")), F.lit(max(up, down)))))
    near = F.array_min(F.transform(admissible, lambda x: F.struct(x.getField("dir"), x.getField("off"), x.getField("_all").alias("_all")))).getField("_all")
    out = settled(rows, _unit=F.coalesce("_own", near)).select(doc, page, F.col("_unit.factor").alias("factor"), F.col("_unit.source").alias("source"))
    return out.select(doc, page, F.coalesce("factor", F.lit(1)).alias("factor"), unit_name(F.coalesce("factor", F.lit(1))).alias("unit"),
                      F.coalesce("source", F.lit("default")).alias("source"))


def majority_unit(pages: DataFrame, doc: str, page: str, text: str = "text") -> DataFrame:
    """(doc, factor): most frequent declared unit, the first seen on ties; 1 without any."""
    found = settled(pages.select(doc, page, text), _u=detect_unit(F.col(text)))
    votes = found.filter("_u.found").groupBy(doc, F.col("_u.factor").alias("factor")).agg(F.count(F.lit(1)).alias("_n"), F.min(page).alias("_p"))
    best = first_rows(votes, [doc], [F.col("_n").desc(), F.col("_p")]).select(doc, "factor")
    return pages.select(doc).distinct().join(best, doc, "left").withColumn("factor", F.coalesce("factor", F.lit(1).cast("long")))


# spans

def statement_page_span(starts: DataFrame, scores: DataFrame, doc: str, page: str, minimum: int = 40, further: int = 4) -> DataFrame:
    """(doc, table_name, start_page, page): pages of each statement from its start page.

    The start must score ``minimum`` and carry its own title when another section starts on it; then it is
    followed by up to ``further`` pages, up to the next page with a foreign section.
    """
    s = scores.select(doc, page, "table_name", "score", "title", "foreign", "own")
    at = starts.select(doc, page, "table_name").distinct().withColumn("start", F.lit(True))
    return span_pages(s.join(at, [doc, page, "table_name"], "left").withColumn("start", F.coalesce("start", F.lit(False))), doc, page, minimum, further)


def span_pages(scores: DataFrame, doc: str, page: str, minimum: int = 40, further: int = 4) -> DataFrame:
    """:func:`statement_page_span` on scores with a column ``start``."""
    # a page with a foreign section ends a span just as a missing one does
    rows = scores.filter(F.col("start") | ~F.col("foreign")).select(doc, page, "table_name", "start", "score", "title", "foreign", "own")
    spans = with_neighbours(rows, page, 0, further).withColumn("_more", further_pages(doc, page, minimum, further)).filter("_mine AND _more IS NOT NULL")
    return spans.select(doc, "table_name", F.col(page).alias("start_page"), F.explode(F.sequence(F.lit(0), "_more")).alias("_off")).select(
        doc, "table_name", "start_page", (F.col("start_page") + F.col("_off")).alias(page))


def further_pages(doc: str, page: str, minimum: int, further: int) -> Column:
    """Number of pages after a page that starts a statement, null on others; for rows of :func:`with_neighbours` by page and statement."""
    w = W.partitionBy(doc, "_block", "table_name").orderBy(page).rangeBetween(1, further)
    foreign = F.coalesce("foreign", F.lit(True))
    away = lambda c: F.collect_set(F.when(c, F.col(page))).over(w)
    free = F.transform(F.array_except(away(~foreign), away(foreign)), lambda x: x - F.col(page))  # at most ``further``
    run = F.aggregate(F.array_sort(free), F.lit(0), lambda n, x: F.when(x == n + 1, n + 1).otherwise(n))
    begins = F.col("start") & (F.col("score") - F.col("title") >= minimum) & (~F.col("foreign") | F.col("own"))
    return F.when(begins, F.when(F.col("foreign"), 0).otherwise(run))


def merge_cross_page_table(rows: DataFrame, statement: list[str], label: str, score: str, page: str, row: str) -> DataFrame:
    """Rows of one statement on several pages: the first occurrence of a label wins, by page score; unlabelled rows stay."""
    named = first_rows(rows.filter(F.trim(label) != ""), [*statement, label], [F.col(score).desc(), F.col(page), F.col(row)])
    return named.unionByName(rows.filter(F.coalesce(F.trim(label), F.lit("")) == ""))


# words

def line_key(top: Column) -> Column:
    return F.bround(top / 3) * 3


def cluster_positions(words: DataFrame, page: list[str], gap: float = 15.0) -> DataFrame:
    """(page…, col, x_min, x_max): column bands from the left and right edges of the words.

    Equal edges collapse first, so the window over a page is bounded by the positions on it, not by its words.
    """
    edges = words.select(*page, F.explode(F.array("x0", "x1")).alias("x")).groupBy(*page, "x").agg(F.count(F.lit(1)).alias("_n"))
    w = W.partitionBy(*page).orderBy("x")
    new = F.when(F.col("x") - F.lag("x").over(w) > gap, 1).otherwise(0)
    bands = edges.withColumn("_new", new).withColumn("_c", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy(*page, "_c").agg(
        F.min("x").alias("x_min"), F.max("x").alias("x_max"), F.sum("_n").alias("_n")).filter(F.col("_n") >= 2)
    return bands.withColumn("col", F.row_number().over(W.partitionBy(*page).orderBy("x_min")) - 1).select(*page, "col", "x_min", "x_max")


def assign_columns(words: DataFrame, bands: DataFrame, page: list[str], word_id: str) -> DataFrame:
    """Every word goes to the first band that holds its centre."""
    cx = (F.col("x0") + F.col("x1")) / 2
    hits = words.withColumn("_cx", cx).join(bands, page).filter(F.col("_cx").between(F.col("x_min"), F.col("x_max")))
    return first_rows(hits, [*page, word_id], [F.col("col")]).drop("_cx", "x_min", "x_max")


# cells: (table…, row, col, text)

def _sorted_whole(table: list[str], *order: str):
    """All cells of a table, in an order that what follows needs as well: they are shuffled by table first and sorted once."""
    return W.partitionBy(*table).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)


def sparse_columns(cells: DataFrame, table: list[str], threshold: float = 0.30) -> DataFrame:
    """Cells without the columns filled in less than the threshold of the rows, unless only one would stay.

    The remaining columns are numbered again from 0. The cells of a table meet once, sorted by column.
    """
    per_table = _sorted_whole(table, "col")
    rows = cells.withColumn("_n", F.max("row").over(per_table) - F.min("row").over(per_table) + 1)
    counted = rows.withColumn("_keep", F.count_if(F.trim("text") != "").over(W.partitionBy(*table, "col")) / F.col("_n") >= threshold)
    counted = counted.withColumn("_enough", F.size(F.collect_set(F.when(F.col("_keep"), F.col("col"))).over(per_table)) > 1)
    kept = counted.filter(F.col("_keep") | ~F.col("_enough"))
    return kept.withColumn("col", F.dense_rank().over(W.partitionBy(*table).orderBy("col")) - 1).drop("_n", "_keep", "_enough")


# Cell texts that count as empty.
EMPTY = ["", "-", "--", "—"]


def split_pairs(cells: DataFrame, table: list[str]) -> DataFrame:
    """Cells with ``_to``, the row they are merged into: a label row without values absorbs the next row and keeps its label only; pairs do not overlap.

    Inside a run of such rows every second one starts a pair, so the start is the parity of the distance to
    the last row with values. Rows are numbered without gaps. The cells of a table meet once, sorted by row.
    """
    text = F.coalesce(F.trim("text"), F.lit(""))
    per_row, per_table, along = W.partitionBy(*table, "row"), _sorted_whole(table, "row"), W.partitionBy(*table).orderBy("row")
    label = F.max(F.when((F.col("col") == 0) & (text != ""), 1).otherwise(0)).over(per_row)
    values = F.max(F.when((F.col("col") > 0) & ~text.isin(EMPTY), 1).otherwise(0)).over(per_row)
    ended = cells.withColumns({"_start": F.min("row").over(per_table), "_end": F.max("row").over(per_table)})
    marked = ended.withColumn("_open", (label == 1) & (values == 0))
    closed = F.max(F.when(~F.col("_open"), F.col("row"))).over(along.rangeBetween(W.unboundedPreceding, 0))
    since = F.col("row") - F.coalesce(closed, F.col("_start") - 1) - 1
    marked = marked.withColumn("_first", F.col("_open") & (since % 2 == 0) & (F.col("row") < F.col("_end")))
    # the row after a start carries the values and takes the start's number
    marked = marked.withColumn("_to", F.coalesce(F.max(F.when(F.col("_first"), F.col("row"))).over(along.rangeBetween(-1, -1)), F.col("row")))
    return marked.filter((F.col("col") == 0) | ~F.col("_first")).drop("_open", "_start", "_end", "_first")


def merge_split_rows(cells: DataFrame, table: list[str]) -> DataFrame:
    """(table…, row, col, text) with the rows of :func:`split_pairs` as one."""
    text = F.coalesce(F.trim("text"), F.lit(""))
    kept = split_pairs(cells, table)
    pair = F.array_sort(F.collect_list(F.struct(F.col("row").alias("r"), text.alias("t"))))  # one or two cells
    return kept.groupBy(*table, "_to", "col").agg(F.array_join(F.transform(pair, lambda x: x.getField("t")), "").alias("text")).withColumnRenamed("_to", "row")


def header_cells(cells: DataFrame, table: list[str]) -> DataFrame:
    """(table…, header_from, header_to, heads): the header rows of every table and their cells, array of struct (row, col, t).

    First of the first three rows with a header word, else the first row; the next row belongs to the header when it has no digit. Only the
    first four rows are looked at, in one group per table.
    """
    text = lambda c: F.concat_ws("", F.transform(c, lambda x: F.coalesce(x.getField("t"), F.lit(""))))
    top = cells.filter(F.col("row") < 4).groupBy(*table).agg(F.array_sort(F.collect_list(F.struct("row", "col", F.col("text").alias("t")))).alias("_top"))
    rows = F.array_distinct(F.transform("_top", lambda x: x.getField("row")))
    texts = F.transform(rows, lambda r: F.struct(r.alias("row"), text(F.filter("_top", lambda x: x.getField("row") == r)).alias("t")))
    rows = settled(top, _rows=texts)
    hits = F.filter("_rows", lambda x: (x.getField("row") < 3) & contains_any(x.getField("t"), fixed.HEADER_WORDS))
    head = F.coalesce(F.array_min(F.transform(hits, lambda x: x.getField("row"))), F.array_min(F.transform("_rows", lambda x: x.getField("row"))))
    rows = settled(rows, header_from=head)
    more = F.exists("_rows", lambda x: (x.getField("row") == F.col("header_from") + 1) & ~x.getField("t").rlike(r"\d"))
    rows = settled(rows, header_to=F.when(more, F.col("header_from") + 1).otherwise(F.col("header_from")))
    return rows.select(*table, "header_from", "header_to", F.filter("_top", lambda x: x.getField("row").between(F.col("header_from"), F.col("header_to"))).alias("heads"))


def header_rows(cells: DataFrame, table: list[str]) -> DataFrame:
    """(table…, header_from, header_to) of every table, see :func:`header_cells`."""
    return header_cells(cells, table).drop("heads")


def head_texts(headers: DataFrame, kept: list[str]) -> DataFrame:
    """(kept…, col, text) of the columns of :func:`header_cells`; two header rows are joined per column."""
    of = lambda c: F.filter("heads", lambda x: x.getField("col") == c)
    joined = lambda c: F.array_join(F.transform(of(c), lambda x: F.coalesce(F.trim(x.getField("t")), F.lit(""))), "")
    columns = F.array_distinct(F.transform("heads", lambda x: x.getField("col")))
    return headers.select(*kept, F.inline(F.transform(columns, lambda c: F.struct(c.alias("col"), joined(c).alias("text")))))


def with_header(cells: DataFrame, table: list[str]) -> DataFrame:
    """Cells with the header_from and header_to of their table, as :func:`header_cells` finds them; the cells of a table meet once, sorted by row."""
    per_table = _sorted_whole(table, "row", "col")
    in_row = W.partitionBy(*table, "row").orderBy("col").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    row = F.col("row")
    top = cells.withColumn("_top", F.min(F.when(row < 4, row)).over(per_table)).filter(F.col("_top").isNotNull())
    texts = top.withColumn("_t", F.when(row < 4, F.concat_ws("", F.collect_list(F.when(row < 4, F.coalesce("text", F.lit("")))).over(in_row))))
    first = F.coalesce(F.min(F.when((row < 3) & contains_any(F.col("_t"), fixed.HEADER_WORDS), row)).over(per_table), F.col("_top"))
    headed = texts.withColumn("header_from", first)
    more = F.max(F.when((row == F.col("header_from") + 1) & (row < 4) & ~F.col("_t").rlike(r"\d"), 1).otherwise(0)).over(per_table)
    return headed.withColumn("header_to", F.col("header_from") + more).drop("_t", "_top")


def with_target(cells: DataFrame, table: list[str]) -> DataFrame:
    """Cells of :func:`with_header` with the target_col of their table, as :func:`target_columns` finds it in the joined heads."""
    per_table = W.partitionBy(*table)
    head, col = F.col("row").between(F.col("header_from"), F.col("header_to")), F.col("col")
    noted = cells.withColumn("_note", F.min(F.when(head & F.col("text").contains("附"), col)).over(per_table))
    found = noted.withColumn("_next", F.min(F.when(head & (col > F.col("_note")) & (F.trim("text") != ""), col)).over(per_table))
    return found.withColumn("target_col", F.when(F.col("_note").isNull(), 1).otherwise(F.coalesce("_next", F.col("_note") + 1)).cast("int")).drop("_note", "_next")


def split_header(cells: DataFrame, table: list[str]) -> tuple[DataFrame, DataFrame]:
    """(heads: table…, col, text; data: table…, row, col, text); two header rows are joined per column."""
    data = with_header(cells, table).filter(F.col("row") > F.col("header_to")).drop("header_from", "header_to")
    return head_texts(header_cells(cells, table), table), data


def column_role(text: Column, report_year: Column, report_period: Column) -> Column:
    """Struct (role, year, period, cumulative) of a column head; what is found in the text is looked for once."""
    def first_of(test, entries):
        return reduce(lambda acc, w: acc.when(test(w[0]), w[1]), entries[1:], F.when(test(entries[0][0]), entries[0][1]))

    def found(x):
        year = F.nullif(F.regexp_extract(x, r"(20\d{2})", 1), F.lit("")).try_cast("int")
        dated = F.when(x.rlike("累计|1-9|1-12"), "target_cumulative").otherwise("absolute_year")
        return F.struct(
            F.coalesce(first_of(x.contains, fixed.HEAD_WORDS), F.when(year.isNotNull(), dated), first_of(x.rlike, fixed.HEAD_PATTERNS), F.lit("other")).alias("kind"),
            year.alias("year"), first_of(x.contains, fixed.HEAD_PERIODS).alias("named"),
            F.when(x.rlike("累计|1-9|前三季度"), "Q3").when(x.rlike("上半年|1-6"), "H1").when(x.contains("1-12"), "FY").alias("cumulated"))

    def judged(f):
        year, named, cumulated = f.getField("year"), f.getField("named"), f.getField("cumulated")
        return F.struct(
            f.getField("kind").alias("kind"), F.when(cumulated.isNull() & named.isNotNull(), year).otherwise(F.coalesce(year, report_year)).alias("year"),
            F.coalesce(cumulated, named, report_period).alias("period"), cumulated.isNotNull().alias("cumulated"))

    def role(j):
        kind, read_year, period = j.getField("kind"), j.getField("year"), j.getField("period")
        dated_kind = kind.isin("quarter", "half", "absolute_year")
        name = (F.when(kind.isin("target", "target_cumulative"), "target").when(kind.isin("prev", "delta"), kind)
                .when(dated_kind & (read_year == report_year), "target").when(dated_kind & (read_year == report_year - 1), "prev").otherwise("other"))
        return F.struct(
            name.alias("role"),
            F.when(kind == "target", report_year).when(kind == "target_cumulative", F.coalesce(read_year, report_year)).when(kind == "prev", report_year - 1)
            .when(dated_kind, read_year).cast("int").alias("year"),
            F.when(kind.isin("target", "prev"), report_period).when(kind.isin("target_cumulative", "quarter", "half", "absolute_year"), period).alias("period"),
            F.coalesce((kind.isin("target_cumulative", "quarter", "half", "absolute_year")) & j.getField("cumulated"), F.lit(False)).alias("cumulative"))

    return let(text, lambda x: let(found(x), lambda f: let(judged(f), role)))


def target_columns(heads: DataFrame, table: list[str]) -> DataFrame:
    """(table…, target_col): the first filled head after a notes column, else column 1."""
    per = heads.groupBy(*table).agg(F.min(F.when(F.col("text").contains("附"), F.col("col"))).alias("_note"), F.collect_set(F.when(F.trim("text") != "", F.col("col"))).alias("_filled"))
    following = F.array_min(F.filter("_filled", lambda x: x > F.col("_note")))
    return per.select(*table, F.when(F.col("_note").isNull(), 1).otherwise(F.coalesce(following, F.col("_note") + 1)).cast("int").alias("target_col"))


def analyze_columns(heads: DataFrame, table: list[str], report_year: str, report_period: str) -> DataFrame:
    """Heads with role, year, period and cumulative; column 0 is the label, the target column is forced. The heads of a table meet once."""
    per_table = W.partitionBy(*table)
    noted = heads.withColumn("_note", F.min(F.when(F.col("text").contains("附"), F.col("col"))).over(per_table))
    found = noted.withColumn("_next", F.min(F.when((F.col("col") > F.col("_note")) & (F.trim("text") != ""), F.col("col"))).over(per_table))
    target = F.when(F.col("_note").isNull(), 1).otherwise(F.coalesce("_next", F.col("_note") + 1)).cast("int")
    joined = settled(found.withColumn("target_col", target), _r=column_role(F.col("text"), F.col(report_year), F.col(report_period)))
    role = F.when(F.col("col") == 0, "label").when(F.col("col") == F.col("target_col"), "target").otherwise(F.col("_r.role"))
    known = F.col("col") > 0
    return joined.select(*table, "col", "text", role.alias("role"), F.when(known, F.col("_r.year")).alias("year"),
                         F.when(known, F.col("_r.period")).alias("period"), (known & F.col("_r.cumulative")).alias("cumulative"))


def facts_from_paragraphs(pages: DataFrame, ids: list[str], text: str = "text") -> DataFrame:
    """(ids…, table_name, field, value): amounts written as ``keyword：number`` in running text."""
    found = [F.struct(F.lit(table).alias("table_name"), F.lit(field).alias("field"), parse_number(F.regexp_extract(text, pattern, 1)).alias("value"))
             for field, table, pattern in fixed.PARAGRAPH_FACTS]
    return pages.select(*ids, F.inline(F.array(*found))).filter(F.col("value").isNotNull())
