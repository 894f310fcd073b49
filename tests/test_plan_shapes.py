"""Physical plans: nothing crosses, nothing runs row by row in Python, scans are pruned."""

import re

import pytest

import __spark_entry__  # noqa: F401  registers the queries
from moveproof.plans import registry

QUERIES = registry.QUERIES
# queries that load files or run streams while they are built are covered by their own tests
LAZY = sorted(n for n in QUERIES if not n.startswith(("stream_", "csv_", "json_ingest", "load_",
                                                      "doc_load", "mv_")))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_cross_join_and_no_python(spark, root, name):
    plan = plan_of(QUERIES[name](spark, root))
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython",
                     "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas"):
        assert operator not in plan, operator


def exchanges(plan):
    return len(re.findall(r"Exchange (?:hash|range|Single)", plan))


@pytest.mark.parametrize("name, most", [
    ("detect_types_orders", 1), ("risk_score", 1), ("risk_factors", 1), ("naming_styles", 0),
    ("retention_split_events", 0), ("pk_check_lineitem", 2), ("snapshot_diff_customer", 1),
    ("dedup_lineitem", 1), ("run_history_latest", 2), ("profile_bytes", 1),
    ("artifact_consistency", 2), ("largest_datasets", 1), ("profile_columns_lineitem", 6),
])
def test_shuffles(spark, root, name, most):
    plan = plan_of(QUERIES[name](spark, root))
    assert exchanges(plan) <= most, plan


def test_scans_are_pruned(spark, root):
    plan = plan_of(QUERIES["fk_orphans_orders"](spark, root))
    assert "o_totalprice" not in plan and "c_name" not in plan
    plan = plan_of(QUERIES["discover_tables"](spark, root))
    assert "l_orderkey" not in plan


def test_column_profile_reads_each_column_once(spark, root):
    plan = plan_of(QUERIES["profile_columns_lineitem"](spark, root))
    schemas = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    columns = [c.split("#")[0] for s in schemas for c in s.split(",")]
    assert len(columns) == len(set(columns)) == 11
