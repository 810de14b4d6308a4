"""Registered queries against their SQL twins, and what their plans must not contain.

A sample runs by default; LEAFSTACK_ALL=1 compares every query (about eight minutes).
"""

import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.compare import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = ["match_summary", "validate", "proofread_scores", "instructions_fired", "classify", "near_dups", "segment_pages", "extract_fields",
          "discover_variants", "link_components", "usage_audit", "bad_transitions", "decisions", "stage_timeline", "stream_link", "stream_match_ready"]
PLANS = ["match_checks", "validate", "proofread_scores", "classify", "page_profile", "extract_fields", "variant_jaccard", "discover_variants",
         "quality_audit", "usage_audit", "cost_report", "event_timeline", "bad_transitions", "event_fanout", "route_documents", "history_check"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not here")


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", list(queries()) if os.environ.get("LEAFSTACK_ALL") else SAMPLE)
def test_same_as_sql(spark, con, name):
    ok, message = compare(spark, con, SF, name, queries()[name], oracle_sql().get(name))
    assert ok, message


@pytest.mark.parametrize("name", PLANS)
def test_plan(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython"):
        assert bad not in plan


def test_scan_is_narrow(spark):
    plan = queries()["doc_search"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan or "ReadSchema" in plan
    assert "text:string" not in plan


def test_entry(spark):
    assert {r.outcome for r in entry(spark).collect()} == {"PASS", "PASS_PARTIAL", "FAIL"}


def test_every_twin_has_a_query():
    assert set(oracle_sql()) <= set(queries())
