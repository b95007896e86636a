"""Findings of the next round: neighbouring pages in blocks, cells and headers in one group."""

import random

from pyspark.sql import functions as F

from quillstat.functions import textclean
from quillstat.functions.numbers import detect_unit
from quillstat.operators import blocked, chunking, pages
from quillstat.plans import filings as plans


def scans(df):
    return df._jdf.queryExecution().executedPlan().toString().count("FileScan")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def page_file(spark, tmp_path, rows):
    spark.createDataFrame(rows, "doc string, page int, text string").write.parquet(f"{tmp_path}/pages")
    return spark.read.parquet(f"{tmp_path}/pages")


def long_documents():
    """Documents over several blocks, with gaps and pages below zero; titles, units, section marks and foreign sections on random pages."""
    r = random.Random(3)
    parts = ["合并利润表", "资产负债表", "单位：万元", "单位：千元", "营业收入 1 净利润 2", "正文", "二、利润表 营业总收入 营业收入 净利润 利润总额", "现金流量表"]
    rows = "".join(f"\n期末余额 明细项目 {i} 1234567.00" for i in range(12))
    return [(d, p, "\n".join(r.sample(parts, r.randint(1, 3))) + rows) for d in ("a", "b") for p in range(-70, 200) if r.random() < 0.9]


def test_titles_and_units_over_blocks(spark, tmp_path):
    rows = long_documents()
    p = page_file(spark, tmp_path, rows)
    titles = {(x.doc, x.page): x.line for x in pages.titled(p, "text").select("doc", "page", F.col("_title").alias("line")).collect()}
    context = pages.title_context(p, "doc", "page")
    assert scans(context) == 1
    got = {(x.doc, x.page): [(t.offset, t.line) for t in x.titles] for x in context.collect()}
    assert got == {(d, n): [(o, titles[d, n - o]) for o in (1, 2, 3) if titles.get((d, n - o))] for d, n, _ in rows}
    units = pages.nearest_unit(p, "doc", "page")
    assert scans(units) == 1
    found = {(x.doc, x.page): x.factor for x in units.collect()}
    assert found.keys() == got.keys()
    declared = {(x.doc, x.page): x.u.factor for x in p.select("doc", "page", detect_unit(F.col("text")).alias("u")).collect() if x.u.found}
    marked = {(x.doc, x.page) for x in p.filter(F.col("text").rlike("|".join(pages.fixed.SECTION_MARKS))).collect()}

    def near(d, n):
        for step, most in ((-1, 5), (1, 3)):
            for o in range(1, most + 1):
                at = (d, n + step * o)
                if at in declared:
                    return declared[at]
                if at in marked:
                    break
        return 1

    for d, n, _ in rows:
        if (d, n) not in declared:
            assert found[d, n] == near(d, n), (d, n)


def spans_by_hand(scores, starts):
    """Definition of a statement's pages."""
    by = {(x.doc, x.table_name, x.page): x for x in scores}
    out = set()
    for d, t, n in starts:
        x = by[d, t, n]
        if x.score - x.title < 40 or (x.foreign and not x.own):
            continue
        out.add((d, t, n, n))
        for o in range(1, 5):
            y = by.get((d, t, n + o))
            if x.foreign or y is None or y.foreign:
                break
            out.add((d, t, n, n + o))
    return out


def test_spans_over_blocks(spark, tmp_path):
    p = page_file(spark, tmp_path, long_documents())
    scored = pages.page_scores(p, ["doc", "page"], starts=True)
    spans = pages.span_pages(scored, "doc", "page")
    assert scans(spans) == 1
    starts = pages.tabular_section_pages(pages.tag_lines(p, ["doc", "page"]), "doc", "page").select("doc", "table_name", "page")
    want = spans_by_hand(scored.collect(), [tuple(x) for x in starts.collect()])
    assert len(want) > 50 and {(x.doc, x.table_name, x.start_page, x.page) for x in spans.collect()} == want
    assert {(x.doc, x.table_name, x.start_page, x.page) for x in pages.statement_page_span(starts, scored, "doc", "page").collect()} == want


def test_statements_are_located_in_one_pass(spark, tmp_path, monkeypatch):
    p = page_file(spark, tmp_path, long_documents())
    passes, keep = [], plans.stored
    monkeypatch.setattr(plans, "stored", lambda df, *name: passes.append(scans(df)) or keep(df, *name))
    got = plans.locate_statements(p)
    context = pages.title_context(p, "doc", "page", keep=["text"])
    scored = pages.page_scores(context, ["doc", "page"], titles="titles", starts=True).collect()
    want = {(d, t, n) for d, t, _, n in spans_by_hand(scored, [(x.doc, x.table_name, x.page) for x in scored if x.start])}
    assert want and {(x.doc, x.table_name, x.page) for x in got.collect() if x.method == "section"} == want
    score = {(x.doc, x.table_name, x.page): x.score for x in scored}
    for x in got.collect():
        assert x.score == score[x.doc, x.table_name, x.page]
        if x.method != "section":
            assert (x.doc, x.table_name) not in {w[:2] for w in want}
    assert passes == [1]


def test_cells_meet_their_lines_without_a_shuffle_of_pairs(spark, tmp_path):
    p = page_file(spark, tmp_path, [("a", 0, "甲乙丙 1\n 甲乙 2 \n\n单位：元 甲乙丙"), ("a", 1, "甲乙丙"), ("b", 0, "x"), ("b", 1, None)])
    cells = spark.createDataFrame([("a", 0, " 甲乙丙 "), ("a", 0, "甲乙丙"), ("a", 0, ""), ("a", 0, None), ("b", 0, "x"), ("c", 0, "x")], "doc string, page int, text string")
    out = pages.tag_lines(p, ["doc", "page"], cells=cells)
    assert sorted((x.doc, x.page, x.line_no, x.line, x.tag) for x in out.collect()) == [
        ("a", 0, 0, "甲乙丙 1", "table"), ("a", 0, 1, "甲乙 2", "text"), ("a", 0, 3, "单位：元 甲乙丙", "metadata"), ("a", 1, 0, "甲乙丙", "text"), ("b", 0, 0, "x", "table")]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        assert exchanges(pages.tag_lines(p, ["doc", "page"], cells=cells)) <= 2
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_headers_take_one_shuffle(spark):
    rows = [(1, r, c, t) for r, line in enumerate([("表", None), ("项目", "期末余额"), ("", " 调整后 "), ("存货", "7")]) for c, t in enumerate(line)]
    rows += [(2, r, 0, t) for r, t in ((3, "附注"), (4, "甲"))] + [(3, 0, 1, "2020"), (3, 0, 0, "x"), (3, 1, 0, "y")]
    cells = spark.createDataFrame(rows, "t int, row int, col int, text string")
    headers = pages.header_cells(cells, ["t"])
    assert exchanges(headers) == 1
    assert sorted((x.t, x.header_from, x.header_to) for x in headers.collect()) == [(1, 1, 2), (2, 3, 3), (3, 0, 1)]
    heads, data = pages.split_header(cells, ["t"])
    assert sorted(tuple(x) for x in heads.collect()) == [(1, 0, "项目"), (1, 1, "期末余额调整后"), (2, 0, "附注"), (3, 0, "xy"), (3, 1, "2020")]
    assert sorted(tuple(x) for x in data.select("t", "row", "col", "text").collect()) == [(1, 3, 0, "存货"), (1, 3, 1, "7"), (2, 4, 0, "甲")]


def test_notes_are_read_once(spark, tmp_path):
    """Sections of headed and of plain notes come from one pass."""
    texts = ["# 甲公司\n正文 1\n## 乙\n\t尾  \n### 丙\n 末 ", "没有标题\n正文", "# 只有标题\n正文", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "d int, text string").write.parquet(f"{tmp_path}/notes")
    out = chunking.sections(spark.read.parquet(f"{tmp_path}/notes"), "d", "text")
    assert scans(out) == 1
    got = sorted((x.d, x.section_no, x.heading or "", x.raw, x.is_last, x.body) for x in out.collect())
    assert got == [(0, 1, "甲公司", "正文 1\n", False, "正文 1"), (0, 2, "乙", "\t尾  \n### 丙\n 末 ", True, "尾\n 末"), (1, 1, "", "没有标题\n正文", True, "没有标题\n正文"),
                   (2, 1, "", "# 只有标题\n正文", True, "# 只有标题\n正文"), (4, 1, "", "", True, "")]


def test_text_measures_by_definition(spark):
    r = random.Random(4)
    letters = "aZ09 \t\n\r\x0b\f中文，、。（）éПриа 😀#-"
    texts = ["", " \n", *("".join(r.choices(letters, k=r.randint(1, 60))) for _ in range(300))]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    kept = lambda c: "\x20" <= c <= "\x7e" or c in "\n\r\t" or any(a <= c <= b for a, b in ("一鿿", "　〿", "＀￯", "︰﹏"))
    for x in df.select("x", textclean.estimate_tokens(F.col("x")).alias("n"), textclean.clean_characters(F.col("x")).alias("c"), textclean.strip(F.col("x")).alias("s")).collect():
        han, alnum = sum("一" <= c <= "鿿" for c in x.x), sum(c.isascii() and c.isalnum() for c in x.x)
        assert x.n == int(han / 1.5 + alnum / 3.5 + (x.x.count("\n") + 1) * 0.5)
        assert x.c == "".join(c for c in x.x if kept(c)) and x.s == x.x.strip(" \t\n\x0b\f\r")


def test_ranges_are_stored_as_parquet(spark):
    """Rows of running values repeat their keys: a checkpoint wrote them out in full."""
    df = spark.range(1000).select((F.col("id") % 3).alias("s"), F.col("id").alias("t"))
    ranged = blocked._ranged(df, ["s"], "t", 5)
    assert scans(ranged) == 1 and ranged.drop("_part").exceptAll(df).isEmpty() and ranged.count() == 1000
