"""Files, state, upserts and streams."""

import json

import pytest
from pyspark.sql import functions as F

from quillstat.functions.textclean import clean_all
from quillstat.plans.filings import load_filings
from quillstat.session import work_path
from quillstat.sources import documents, filings, statements
from quillstat.sources.bucketed import BucketedTable
from quillstat.streaming import incremental, sessions


def record(code, name, period="FY", **data):
    return {"stock_code": code, "stock_abbr": name, "report_year": 2024, "report_period": period, "report_type": "full", "exchange": "SSE", "source": "pdfplumber_standard",
            "confidence": 80, "unit_info": {"income_sheet": {"unit_factor": 10000, "unit_raw": "万元", "unit_source_text": "单位：万元"}}, "data": data}


def test_read_and_load_filings(spark, tmp_path):
    full = {"income_sheet": {"total_operating_revenue": 2e8, "net_profit": 10.0, "unknown": 1.0}, "other_sheet": {"x": 1.0}}
    (tmp_path / "a.json").write_text(json.dumps(record("600001", "甲", **full), indent=1))
    (tmp_path / "b.json").write_text(json.dumps(record(None, "乙", **full)))
    (tmp_path / "c_summary.json").write_text(json.dumps(record("600003", "丙", **full)))
    (tmp_path / "d.json").write_text("{ broken")
    (tmp_path / "e.json").write_text(json.dumps(record("600005", "戊", other_sheet={"x": 1.0})))
    df = filings.read_filings(spark, str(tmp_path))
    assert sorted(r["source_file"] for r in df.select("source_file").collect()) == ["a.json", "b.json", "e.json"]
    catalog = spark.createDataFrame([("income_sheet", "total_operating_revenue"), ("income_sheet", "net_profit")], "table_name string, column_name string")
    names = spark.createDataFrame([("乙", "2", 0)], "entity string, code string, pos int")
    result = load_filings(df, catalog, names)
    decisions = {r["source_file"]: (r["stock_code"], r["decision"]) for r in result.decisions.collect()}
    assert decisions["b.json"][0] == "000002" and decisions["a.json"][1] != "rejected" and decisions["e.json"][1] == "rejected"
    assert result.facts.filter("source_file = 'a.json'").count() == 2
    assert {(r["stock_code"], r["field"]) for r in result.queue.collect()} == {("600001", "total_operating_revenue"), ("000002", "total_operating_revenue")}


def test_dictionary_file_and_state(spark, tmp_path):
    doc = {"tables": {"income_sheet": {"table_name_cn": "利润表", "description": "", "columns": [{"en": "net_profit", "cn": "净利润", "aliases": ["净利"]}, {"en": "eps", "cn": "每股收益"}]}}}
    (tmp_path / "schema.json").write_text(json.dumps(doc, ensure_ascii=False, indent=2))
    got = {(r["synonym"], r["field"]) for r in filings.read_field_dictionary(spark, str(tmp_path / "schema.json")).collect()}
    assert got == {("净利润", "net_profit"), ("净利", "net_profit"), ("每股收益", "eps")}
    pool, history = filings.mapping_state(spark, str(tmp_path / "none"))
    assert pool.count() == 0 and history.count() == 0


def test_read_documents(spark, tmp_path):
    (tmp_path / "x.md").write_bytes("# 标题\n\n正文".encode() + b"\xff")
    (tmp_path / "y.txt").write_text("no")
    rows = documents.read_documents(spark, str(tmp_path)).collect()
    assert [r["file_name"] for r in rows] == ["x.md"] and rows[0]["text"].startswith("# 标题\n\n正文")
    assert documents.read_documents(spark, str(tmp_path)).select(clean_all(F.col("text"))).first()[0] == "# 标题\n\n正文"


def test_listing(spark, tmp_path):
    for folder, name, size in [("上交所", "a.pdf", 300 * 1024), ("深交所", "b摘要.pdf", 300 * 1024), ("其他", "c.pdf", 10)]:
        (tmp_path / folder).mkdir()
        (tmp_path / folder / name).write_bytes(b"0" * size)
    got = {r["name"]: (r["exchange"], r["kind"]) for r in documents.list_filings(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": ("SSE", "full"), "b摘要.pdf": ("SZSE", "summary"), "c.pdf": (None, "summary")}


def test_questions_are_cut_out(spark, tmp_path):
    (tmp_path / "q.txt").write_text("1\n问题：净利润多少 (多轮: 继承上文)\n---\n无\n---\n问题:营收\n")
    assert sorted(r["question"] for r in documents.read_questions(spark, str(tmp_path / "q.txt")).collect()) == ["净利润多少", "营收"]


def test_merge_facts_keeps_what_is_not_provided(spark):
    target = spark.createDataFrame([("a", 1, 2.0, 3.0)], "k string, y int, p double, q double")
    new = spark.createDataFrame([("a", 1, 9.0, None), ("b", 1, 5.0, 6.0)], "k string, y int, p double, q double")
    assert sorted(map(tuple, statements.merge_facts(target, new, ["k", "y"]).collect())) == [("a", 1, 9.0, 3.0), ("b", 1, 5.0, 6.0)]


def test_review_needs_the_year(spark):
    facts = spark.createDataFrame([("a", "A", y, "FY", "income_sheet", "net_profit", 5e8) for y in (2023, 2024)],
                                  "stock_code string, stock_abbr string, report_year int, report_period string, table_name string, field string, value double")
    queue = filings.anomaly_queue(facts)
    d = spark.createDataFrame([("a", 2024, "FY", "income_sheet", "net_profit", "元")], "stock_code string, report_year int, period string, table_name string, field string, unit string")
    marked, fixed = filings.apply_review(queue, d)
    assert {(r["report_year"], r["status"]) for r in marked.collect()} == {(2023, "pending"), (2024, "approved")}
    assert [(r["report_year"], float(r["value"])) for r in fixed.collect()] == [(2024, 50000.0)]


def test_streamed_slots_equal_the_batch_rule(spark, tmp_path):
    base = 1_700_000_000
    rows = [("s1", base + 10, "甲", None), ("s1", base + 20, None, "x"), ("s1", base + 3000, None, None), ("s2", base + 5, "乙", None), ("s2", base + 6, None, None)]
    df = spark.createDataFrame(rows, "s string, t long, company string, indicator string").withColumn("ts", F.timestamp_seconds("t"))
    df.write.parquet(str(tmp_path / "in"))
    sessions.use_rocksdb(spark)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    sessions.run_available(sessions.carry_slots_stream(stream, "s", "ts", ["company", "indicator"]), str(tmp_path / "out"))
    got = {(r["s"], r["t"] - base): (r["company"], r["indicator"]) for r in spark.read.parquet(str(tmp_path / "out/data")).collect()}
    assert got == {("s1", 10): ("甲", None), ("s1", 20): ("甲", "x"), ("s1", 3000): (None, None), ("s2", 5): ("乙", None), ("s2", 6): ("乙", None)}


def test_incremental_load_and_compaction(spark, tmp_path):
    src, target, compacted = (str(tmp_path / n) for n in ("in", "t", "c"))
    schema = "stock_code string, report_year int, report_period string, v int"
    for batch in ([("a", 1, "FY", 1), ("b", 1, "FY", 1)], [("a", 1, "FY", 2)]):
        spark.createDataFrame(batch, schema).write.mode("append").json(src)
        incremental.incremental_load(spark, src, target, schema)
    assert sorted((r["stock_code"], r["v"]) for r in incremental.current_rows(spark, target).collect()) == [("a", 2), ("b", 1)]
    incremental.compact(spark, target, compacted)
    assert sorted((r["stock_code"], r["v"]) for r in incremental.current_rows(spark, compacted).collect()) == [("a", 2), ("b", 1)]


@pytest.mark.parametrize("name, rows", [("top_n_revenue", 5)])
def test_entry(spark, name, rows):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == rows and name in entry.queries()


def test_a_load_rewrites_its_own_buckets(spark):
    """Ten keys touch their buckets only; a load cut off after staging is finished by the next one, one cut off before has changed nothing."""
    import os

    path = work_path(spark, "bucketed")
    rows = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.lit("a").alias("w"))
    out = BucketedTable(spark, path, ["k"], 64)
    out.create(rows)

    def files():
        return {d: {f: os.stat(f"{path}/rows/{d}/{f}").st_mtime_ns for f in os.listdir(f"{path}/rows/{d}")} for d in os.listdir(f"{path}/rows") if d.startswith("_bucket=")}

    before = files()
    new = spark.createDataFrame([(i * 37, -i, "b") for i in range(9)] + [(99_999, 1, "b")], "k long, v long, w string")
    touched = out.upsert(new)
    after = files()
    assert len(before) == 64 and 0 < len(touched) <= 10 and {int(d.split("=")[1]) for d in after if after[d] != before[d]} == set(touched)
    want = {i: (2 * i, "a") for i in range(5000)} | {i * 37: (-i, "b") for i in range(9)} | {99_999: (1, "b")}
    assert {r.k: (r.v, r.w) for r in out.read().collect()} == want
    out.merge_facts(spark.createDataFrame([(5, 55), (70_000, 7)], "k long, v long"))
    want |= {5: (55, "a"), 70_000: (7, None)}
    assert {r.k: (r.v, r.w) for r in out.read().collect()} == want
    apply = BucketedTable._apply
    BucketedTable._apply = lambda self, staged: (_ for _ in ()).throw(RuntimeError("lost"))
    try:
        with pytest.raises(RuntimeError):
            out.upsert(spark.createDataFrame([(6, 66, "c")], "k long, v long, w string"))
    finally:
        BucketedTable._apply = apply
    spark.createDataFrame([(7, 0, "x")], "k long, v long, w string").write.parquet(f"{path}/staged/half")
    os.remove(f"{path}/staged/half/_SUCCESS")
    assert {r.k: (r.v, r.w) for r in out.read().collect()} == want
    out.recover()
    assert {r.k: (r.v, r.w) for r in out.read().collect()} == want | {6: (66, "c")} and os.listdir(f"{path}/staged") == []


def test_broken_filings_are_set_aside(spark, tmp_path):
    """One record per file: unreadable ones, wrong types and records without a company are quarantined, summaries skipped."""
    (tmp_path / "good.json").write_text('{"stock_code": "600001", "report_year": 2020, "data": {"income_sheet": {"net_profit": 1.5}}}')
    (tmp_path / "cut.json").write_text('{"stock_code": "600002", "report_year": ')
    (tmp_path / "nobody.json").write_text('{"report_year": 2020}')
    (tmp_path / "x_summary.json").write_text('{"oops"')
    (tmp_path / "typed.json").write_text('{"stock_code": "600003", "report_year": "no year"}')
    assert [r.stock_code for r in filings.read_filings(spark, str(tmp_path)).collect()] == ["600001"]
    got = {r.source_file: (r.reason, r.content) for r in filings.broken_filings(spark, str(tmp_path)).collect()}
    assert {k: v[0] for k, v in got.items()} == {"cut.json": "unreadable", "nobody.json": "unnamed", "typed.json": "unreadable"}
    assert got["cut.json"][1] == '{"stock_code": "600002", "report_year": ' and got["nobody.json"][1] is None


def test_broken_documents_are_listed(spark, tmp_path):
    (tmp_path / "a.md").write_bytes("# 标题\nok".encode())
    (tmp_path / "b.md").write_bytes(b"bad \xff\xfe bytes")
    (tmp_path / "c.txt").write_bytes(b"\xff")
    (tmp_path / "d.md").write_bytes(b"")
    got = {r.file_name: r.text for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.md": "# 标题\nok", "b.md": "bad \ufffd\ufffd bytes"}  # an empty file has no row
    assert [tuple(r) for r in documents.broken_documents(spark, str(tmp_path)).collect()] == [("b.md", 12, 2)]
