"""Findings at 6 GB: the stored index without single postings, tables of cells in one pass."""

import os
import random

import numpy as np

from pyspark.sql import functions as F

from quillstat.operators import mapping, pages, retrieval
from quillstat.plans import filings as plans
from quillstat.plans.hybrid_search import search_index
from quillstat.sources.index import build_index, load_index, search_postings


def shuffled(spark):
    """Bytes of shuffles written so far."""
    store = spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def folder_bytes(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names)


def corpus(n):
    r = np.random.default_rng(n)
    words = np.array(["".join(map(chr, r.integers(97, 123, r.integers(3, 9)))) for _ in range(4000)] + ["甲乙丙", "乙丙", "Éa", "9"])
    weights = 1 / np.arange(1, len(words) + 1)
    return [(d, " ".join(r.choice(words, r.integers(0, 300), p=weights / weights.sum()))) for d in range(n)]


def test_stored_postings_give_the_scores_of_a_search_without_index(spark, tmp_path):
    docs = [*corpus(2500), (2500, None), (2501, ""), (None, "9 9 9")]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(8).write.parquet(f"{tmp_path}/docs")
    d = spark.read.parquet(f"{tmp_path}/docs")
    queries = spark.createDataFrame([(f"q{i}", t + " 甲乙丙 unheard") for i, t in corpus(30)] + [("none", "")], "query_id string, query string")
    vectors = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(50)], "doc_id long, embedding array<double>")
    written = shuffled(spark)
    build_index(d, vectors, f"{tmp_path}/index")
    index = load_index(spark, f"{tmp_path}/index")
    rows = lambda df: sorted((x.query_id, x.rank, x.doc_id, round(x.score, 8)) for x in df.collect())
    got = rows(search_postings(index, queries, 7))
    written = shuffled(spark) - written
    named = d.filter("doc_id IS NOT NULL")
    assert got == rows(retrieval.bm25_top_k(named, queries, 7)) and len(got) > 150
    some = spark.createDataFrame([(i,) for i in range(0, 2500, 9)], "doc_id long")
    assert rows(search_postings(index, queries, 7, prefilter=some)) == rows(retrieval.bm25_top_k(named, queries, 7, prefilter=some))
    texts = sum(len(t.encode()) for _, t in docs if t)
    assert written < 1.2 * texts, written / texts
    assert folder_bytes(f"{tmp_path}/index") < 1.2 * texts, folder_bytes(f"{tmp_path}/index") / texts


def test_texts_of_found_chunks_are_not_shuffled(spark, tmp_path):
    docs = spark.createDataFrame(corpus(300), "doc_id long, text string")
    build_index(docs, spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(50)], "doc_id long, embedding array<double>"), f"{tmp_path}/index")
    queries = spark.createDataFrame([(i, t, [1.0, float(i)]) for i, t in corpus(3)], "query_id long, query string, query_vector array<double>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = search_index(load_index(spark, f"{tmp_path}/index"), queries)
        assert "BroadcastHashJoin" in out._jdf.queryExecution().executedPlan().toString()
        assert out.filter("text IS NOT NULL").count() == 15
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def pairs_by_hand(rows):
    """{row: (kept cells, row they go to)} of one table, rows as {row: kind}: o(pen), v(alues), b(lank)."""
    out, closed, first = {}, min(rows) - 1, None
    for r in sorted(rows):
        if rows[r] != "o":
            closed = r
        start = rows[r] == "o" and (r - closed - 1) % 2 == 0 and r < max(rows)
        out[r] = start, r - 1 if first == r - 1 else r
        first = r if start else first
    return out


def test_cells_of_a_table_meet_once(spark):
    """Clean-up steps shuffle cells once, and not at all where the cells of a filing already lie together."""
    r = random.Random(9)
    kinds = {t: {n: r.choice("ooovb") for n in range(1, 40) if t % 3 or r.random() < 0.8} for t in range(12)}
    texts = {"o": ("名", "--"), "v": ("名", "5"), "b": ("", "7")}
    rows = [(f"f{t // 2}", t, n, c, f"{x}{t}.{n}" if x == "名" else x) for t, of in kinds.items() for n, k in of.items() for c, x in enumerate(texts[k])]
    cells = spark.createDataFrame(rows, "filing string, t int, row int, col int, text string")
    for step in (pages.sparse_columns, pages.merge_split_rows, pages.with_header):
        assert exchanges(step(cells, ["filing", "t"])) == 1, step
    want = {}
    for t, of in kinds.items():
        for n, (start, to) in pairs_by_hand(of).items():
            for c, x in enumerate(texts[of[n]]):
                if c == 0 or not start:
                    want[t, to, c] = want.get((t, to, c), "") + (f"{x}{t}.{n}" if x == "名" else x)
    assert {(x.t, x.row, x.col): x.text for x in pages.merge_split_rows(cells, ["filing", "t"]).collect()} == want
    heads = [(f"f{t // 2}", t, 0, c, x) for t in kinds for c, x in enumerate(("项目", "本期"))]
    whole = cells.unionByName(spark.createDataFrame(heads, cells.schema)).withColumn("unit_factor", F.lit(1)).repartition(5, "filing")
    found = plans.table_rows(whole, ["filing", "t"], ["unit_factor"])
    assert exchanges(found) == 1
    assert {(x.t, x.row, c): v for x in found.collect() for c, v in enumerate((x.label, x.raw)) if v is not None} == want


def test_facts_of_a_filing_are_filled_in_one_shuffle(spark):
    facts = spark.createDataFrame([("a", "balance_sheet", "x", 1.0), ("a", "income_sheet", "x", 2.0), ("a", "cash_flow_sheet", "y", 3.0), ("b", "income_sheet", "x", None)],
                                  "f string, table_name string, field string, value double")
    out = mapping.cross_fill(facts.repartition(3, "f"), ["f"])
    assert exchanges(out) == 1
    first = out.filter("f = 'a' AND field = 'x' AND filled").first()
    assert first.table_name == "cash_flow_sheet" and first.value in (1.0, 2.0)
    assert sorted((x.f, x.table_name, x.field, x.filled) for x in out.collect()) == sorted([
        ("a", "balance_sheet", "x", False), ("a", "income_sheet", "x", False), ("a", "cash_flow_sheet", "x", True), ("a", "cash_flow_sheet", "y", False),
        ("a", "balance_sheet", "y", True), ("a", "income_sheet", "y", True), ("b", "income_sheet", "x", False)])


def test_heads_are_read_once(spark):
    """What is found in a head is looked for once, and the heads of a table meet once."""
    heads = spark.createDataFrame([(t, c, x) for t in (1, 2) for c, x in enumerate(("项目", "附注" if t == 1 else "2022年", "", "2023年1-9月", "上期金额"))], "t int, col int, text string")
    out = pages.analyze_columns(heads.withColumns({"y": F.lit(2023), "p": F.lit("FY")}), ["t"], "y", "p")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("前三季度") <= 2
    got = {(x.t, x.col): (x.role, x.year, x.period, x.cumulative) for x in out.collect()}
    assert got[1, 3] == ("target", 2023, "Q3", True) and got[1, 4] == ("prev", 2022, "FY", False) and got[1, 0][0] == got[2, 0][0] == "label"
    assert got[2, 1] == ("target", 2022, "FY", False) and got[1, 1][0] == got[1, 2][0] == "other"
    assert {x.t: x.target_col for x in pages.target_columns(heads, ["t"]).collect()} == {1: 3, 2: 1}
