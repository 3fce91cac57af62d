"""Plans at scale: joins are equi-joins, filters and columns reach the scans, nothing gathers in one partition."""

import re
from pathlib import Path

import pytest

from palimpsest.plans import entity_queries, presence_queries, space_queries

DATA = "/root/testdata/sf0.001"
QUERIES = presence_queries.QUERIES | space_queries.QUERIES | entity_queries.QUERIES
#: One side has one row: ends of a timeline, counts of a side, a few prompts or query times.
ONE_ROW = {"snapshot_choice", "slice_4d", "segmentation_metrics", "detection_counts", "background_rejection", "restore_ids", "evaluate_all"}
#: Windows over a row per partition, or over sizes of ranges.
SMALL_WINDOW = {"vertex_renumber", "restore_ids"}

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data here")


@pytest.fixture(scope="module")
def plans(spark):
    return {name: q(spark, DATA)._jdf.queryExecution().executedPlan().toString() for name, q in QUERIES.items()}


def test_no_product_joins(plans):
    found = {n for n, p in plans.items() if re.search("CartesianProduct|NestedLoop", p)}
    assert found <= ONE_ROW


def test_no_window_over_all_rows(plans):
    found = {n for n, p in plans.items() if re.search(r"Window \[[^\n]*\n?[^\n]*Exchange SinglePartition", p)}
    assert found <= SMALL_WINDOW


def test_no_row_at_a_time_python(plans):
    assert not {n for n, p in plans.items() if "BatchEvalPython" in p}


@pytest.mark.parametrize(("name", "columns"), [("present_at_time", {"o_orderkey", "o_custkey", "o_orderdate", "l_orderkey", "l_shipdate"}), ("evidence_bins", {"ts", "user_id", "event_type"}), ("change_confusion", {"l_linestatus", "l_returnflag", "l_quantity"})])
def test_scans_read_only_what_is_used(plans, name, columns):
    read = {c.split(":")[0] for s in re.findall(r"ReadSchema: struct<([^>]*)>", plans[name]) for c in s.split(",")}
    assert read == columns


def test_filters_reach_the_scan(plans):
    assert re.search(r"PushedFilters: \[[^\]]*LessThan\(vec_id", plans["background_rejection"])
