"""Plan-shape properties of the registered queries (scale guards)."""

import os

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
HEAVY = {"tvf09_attrition_scores", "tvf09_feature_importance", "rm09_retention_scores", "rm08_retention_pipeline_model",
         "rm05_lookalikes", "tvf12_document_search", "tvf10_segments_summary"}


def _plan(spark, name):
    return E.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in E.queries() if n not in HEAVY and not n.startswith(("op", "pipeline"))))
def test_no_cross_join(spark, name):
    plan = _plan(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_flow_window_pushed_to_scan(spark):
    plan = E.queries()["kd_nna"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan


def test_per_key_top_k_is_partial_before_shuffle(spark):
    for name in ["rm05_next_best_action", "rm06_cross_platform", "rm10_asset_mix"]:
        assert "WindowGroupLimit" in _plan(spark, name)
