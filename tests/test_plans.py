"""Scale properties of the physical plans (regression guard)."""

import re

import pytest

from fleetlens.plans.registry import QUERIES
from tests.conftest import SF_SMALL


def _plan(spark, name):
    df = QUERIES[name](spark, SF_SMALL)
    df.write.format("noop").mode("overwrite").save()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["r5_intervention_ranking", "j2_j3_server_feature_table", "j6_label_horizon",
                                  "v4_v5_v7_curve_metrics", "v9_topk_capture", "r6_zero_perturbation",
                                  "e1_e5_history_chunked", "g2_usage_profile_ranked"])
def test_no_pair_expansion(spark, name):
    plan = _plan(spark, name)
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_filters_reach_the_scan(spark):
    plan = _plan(spark, "g5_g6_incident_profile")
    assert re.search(r"PushedFilters: \[.*EqualTo\(event_type,error\)", plan)


def test_top_k_is_limited_before_the_shuffle(spark):
    assert "WindowGroupLimit" in _plan(spark, "v9_topk_capture")


@pytest.mark.parametrize("name", ["r6_zero_perturbation", "b28_incident_sentence", "r7_mixed_factors", "b28_anomaly_sentence"])
def test_explanations_stay_in_the_row(spark, name):
    assert not re.search(r"Exchange|Window|SortMergeJoin", _plan(spark, name))


def test_ranking_is_a_bounded_top_n(spark):
    assert "TakeOrderedAndProject" in _plan(spark, "r5_intervention_ranking")
