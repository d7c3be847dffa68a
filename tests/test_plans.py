"""Physical-plan properties that matter at scale."""

import pytest

from souq.queries import queries

from .conftest import SMOKE_DIR

QUERIES = queries()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_or_nested_loop_join(spark, name):
    if name.startswith(("stream_", "model_", "churn_", "clv_", "merchant_risk", "risk_")) or name in (
            "audit_log_append", "append_sink", "truncate_reload", "csv_lake_export", "parquet_lake_export"):
        pytest.skip("writes or trains before planning")
    p = plan(QUERIES[name](spark, SMOKE_DIR))
    assert "CartesianProduct" not in p, name
    assert "BroadcastNestedLoopJoin" not in p, name
    assert "Python" not in p and "ArrowEval" not in p, name


def test_filter_and_projection_reach_the_scan(spark):
    df = QUERIES["filter_optional_conjunction"](spark, SMOKE_DIR)
    p = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in p
    scan = QUERIES["scan_table"](spark, SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(o_orderstatus,F)" in scan
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string,o_totalprice:double>" in scan


def test_keep_last_is_a_partial_aggregate(spark):
    p = plan(QUERIES["fact_orders"](spark, SMOKE_DIR))
    # max_by is combined map-side before the shuffle on order_id
    assert "partial_max_by" in p


def test_top_k_uses_group_limit_before_shuffle(spark):
    p = QUERIES["ab_ndcg_at_k"](spark, SMOKE_DIR)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in p
