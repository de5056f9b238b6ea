"""The plans keep what makes them cheap: pruned scans, pushed filters, early group limits, no pairwise joins."""

import contextlib
import io

import pytest

from granary.plans import load_all
from granary.plans.registry import REGISTRY, Tables

load_all()

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        REGISTRY[name].plan(Tables(spark, FOLDER)).explain("formatted")
    return out.getvalue()


def test_typed_filter_reaches_the_scan(spark):
    text = plan(spark, "C04_filter_range")
    assert "GreaterThanOrEqual(l_extendedprice,90000.5)" in text
    assert "l_shipdate" not in text


def test_trend_reads_two_columns(spark):
    text = plan(spark, "E14_trend")
    assert "ReadSchema: struct<o_totalprice:double,o_orderdate:timestamp_ntz>" in text


@pytest.mark.parametrize("name", ["I05_active_run_per_file", "I07_last_n_messages", "E22_column_top_values", "F14_document_summary"])
def test_groups_are_cut_before_the_shuffle(spark, name):
    text = plan(spark, name)
    assert text.count("WindowGroupLimit") >= 2


@pytest.mark.parametrize(
    "name", ["D08_contains_join", "D09_fuzzy_join", "G01_dense_topk", "G06_lexical_score", "G08_rank_fusion", "J10_select_scope"]
)
def test_no_pairwise_joins(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


@pytest.mark.parametrize("name", ["E02_grouped_count", "E03_sum", "I21_metrics_snapshot", "L05_stream_file_status"])
def test_aggregates_combine_before_the_shuffle(spark, name):
    assert "partial_" in plan(spark, name)
