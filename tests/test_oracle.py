"""Registered queries against their oracles at the smallest scale (QUILLSTAT_ALL=1 runs every query)."""

import os

import pytest

import __spark_entry__ as entry
from check_oracle import compare, oracle_connection

SF_DIR = "/root/testdata/sf0.001"
SAMPLE = ["top_n_revenue", "trend_best_period", "compare_period_fallback", "merge_statements", "retry_ladder", "rank_in_period", "intersect_top_n", "yoy_growth",
          "risk_alerts", "consistency_checks", "quality_report", "clean_notes", "note_sections", "bm25_top_documents", "vector_top_k", "map_labels_exact",
          "locate_statements", "load_decisions", "time_expressions", "enriched_questions", "bio_spans", "session_activity"]
NAMES = list(entry.queries()) if os.environ.get("QUILLSTAT_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF_DIR):
        pytest.skip("test data not present")
    return oracle_connection(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    _, message, _ = compare(spark, con, name, SF_DIR)
    assert message == "", message
