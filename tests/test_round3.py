"""Findings of round 3: registered queries against their SQL on tables with the rows that told them apart."""

import datetime

import check_oracle
import duckdb
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillstat.operators import retrieval
from quillstat.session import shared_dir, stored
from quillstat.streaming import sessions

LINEITEM = ("l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
            "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz")


def line(order=1, part=1, supplier=1, number=1, quantity=1.0, shipped=datetime.datetime(1998, 11, 5)):
    return order, part, supplier, number, float(quantity), 1000.0 + part, 0.05, 0.02, "N", "O", shipped


def message(spark, tmp_path, name, **tables):
    """What the comparison of a query with its SQL says over the given tables; empty when they agree."""
    con = duckdb.connect()
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    return check_oracle.compare(spark, con, name, str(tmp_path))[:2]


def test_code_inside_a_longer_name(spark, tmp_path):
    keys = (7, 12, 20, 70, 120, 129, 1200, 4000)
    suppliers = [(k, f"Supplier#{k:09d}", 1, 0.0) for k in keys]
    lines = [line(supplier=k) for k in keys]
    got = message(spark, tmp_path, "lookup_by_name_part", supplier=(suppliers, "s_suppkey long, s_name string, s_nationkey int, s_acctbal double"), lineitem=(lines, LINEITEM))
    assert got == (6, "")  # 7, 12, 20 by name or code; 120, 129 and 1200 hold the digits of the code


def test_word_number_at_two_places(spark, tmp_path):
    # from a million parts on, line 1 of part 1000005 and line 2 of part 5 have the same word number
    lines = [line(order=o, part=p, number=n, quantity=3) for o in (1, 2) for n, p in ((1, 1_000_005), (2, 5), (2, 5), (3, 7))]
    assert message(spark, tmp_path, "assign_columns", lineitem=(lines, LINEITEM)) == (6, "")


def test_messages_to_the_state_do_not_grow_with_sessions():
    """Sessions of a key share one read, one write and one timer in a micro-batch."""

    class Handle:
        calls = 0

        def getValueState(self, *_):
            return self

        def call(self, *_):
            Handle.calls += 1

        get = update = clear = registerTimer = call

    class Times:
        def getCurrentWatermarkInMs(self):
            return 0

    merger = sessions._SessionMerger("user", 1_800_000_000)
    merger.init(Handle())
    rows = [Row(_at=k * 3_600_000_000) for k in range(500)]
    got = list(merger.handleInputRows((7,), iter(rows), Times()))
    assert [(x.user, x.first, x.end, x.n_events, x.alive) for x in got] == [(7, r._at, r._at + 1_800_000_000, 1, True) for r in rows]
    assert Handle.calls <= 3


def test_stored_cells_are_small(spark):
    """Cells repeat their keys in every row; a checkpoint writes them out, a stored table doesn't."""
    cells = spark.range(20_000).select(F.lit("000012").alias("stock_code"), F.lit("Supplier#000000012").alias("stock_abbr"), (F.col("id") % 5).alias("col"), F.col("id").alias("row"))
    before = spark.sparkContext._jvm.java.io.File(shared_dir(spark))
    table = stored(cells, "small-cells")
    folder = next(f for f in before.listFiles() if f.getName().startswith("small-cells"))
    assert sum(f.length() for f in folder.listFiles()) < 20_000 * 16
    assert table.dtypes == cells.dtypes and table.exceptAll(cells).isEmpty() and table.count() == 20_000


def test_scores_are_added_up_where_the_postings_lie(spark):
    """Postings and what is asked of them are dealt by block; no pair of query and document is shuffled before the k best are taken."""
    weighted = spark.createDataFrame([(i, f"t{i % 3}", 1.0, i % 4) for i in range(40)], "doc_id long, term string, weight double, block int")
    asked = spark.createDataFrame([(q, b, f"t{t}") for q in range(2) for b in range(4) for t in range(2)], "query_id long, block int, term string")
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    spark.conf.set(name, "false")
    try:
        plan = retrieval._block_scores(weighted, asked, "doc_id", "query_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset(name)
    assert plan.count("Exchange hashpartitioning(block") == plan.count("Exchange ") == 2
