"""Intervention ranking (R5) and perturbation explanations."""

from fleetlens.operators import explain as X
from fleetlens.operators.ranking import prioritize


def _cands(spark, rows):
    return spark.createDataFrame(rows, "server_id int, incident_probability double, monthly_spend_eur double, "
                                       "support_plan string, has_gpu int, is_managed int, capacity_used_pct double")


def test_prioritize_order_and_rank(spark):
    c = _cands(spark, [(1, 0.5, 100.0, "basic", 0, 0, 0.0), (2, 0.5, 100.0, "premium", 0, 0, 0.0),
                       (3, 0.1, 100.0, "basic", 0, 0, 0.0)])
    out = prioritize(c, 2).collect()
    assert [(r.server_id, r.rank) for r in out] == [(2, 1), (1, 2)]
    assert abs(out[0].priority_score - 75.0) < 1e-12


def test_prioritize_negative_n_and_empty(spark):
    c = _cands(spark, [(1, 0.5, 100.0, "basic", 0, 0, 0.0)])
    assert prioritize(c, -3).count() == 0
    assert prioritize(_cands(spark, []), 50).count() == 0


def test_zero_perturbation_linear(spark):
    df = spark.createDataFrame([(1, 2.0, -1.0, 0.5)], "id int, a double, b double, c double")
    sc = X.linear_scorer({"a": 1.0, "b": 3.0, "c": -2.0}, 0.5)
    out = X.perturbation_explain(df, ["id"], ["a", "b", "c"], sc, top_n=2).orderBy("rank").collect()
    assert [(r.feature, r.impact) for r in out] == [("b", -3.0), ("a", 2.0)]
    assert out[0].direction == "decreases_prediction" and out[1].direction == "increases_prediction"


def test_reference_perturbation_positive_only(spark):
    df = spark.createDataFrame([(1, 2.0, -1.0)], "id int, a double, b double")
    sc = X.linear_scorer({"a": 1.0, "b": 1.0}, 0.0)
    out = X.perturbation_explain(df, ["id"], ["a", "b"], sc, reference={"a": 0.0, "b": 0.0},
                                 positive_only=True, numeric_direction=True).collect()
    assert [(r.feature, r.impact, r.direction) for r in out] == [("a", 2.0, "above_normal")]


def test_prioritisation_from_scored_rows(spark):
    import datetime

    from fleetlens.operators.ranking import prioritize_scored
    day = datetime.date(2024, 1, 30)
    rows = [(1, day, 0.5, 100.0, "basic", 0, 0, 0.0, 0.4, 2, "serveurs standard"), (2, day, 0.5, 100.0, "premium", 0, 0, 0.0, 0.1, 0, "stress temperature"),
            (3, day, 0.5, 100.0, "basic", 0, 0, 0.0, 0.31, 1, "serveurs stockage")]
    df = spark.createDataFrame(rows, "server_id int, date date, incident_probability double, monthly_spend_eur double, support_plan string, "
                                     "has_gpu int, is_managed int, capacity_used_pct double, anomaly_score double, segment_cluster int, segment_profile string")
    out = prioritize_scored(df, 0.3, 2).collect()
    assert [(r.server_id, r["rank"], r.date) for r in out] == [(2, 1, day), (1, 2, day)]  # 3 ties with 1, the smaller key stays
    assert (out[0].is_anomaly, out[0].anomaly_context_multiplier, out[0].segmentation_context_multiplier) == (False, 1.0, 1.25)
    assert (out[1].is_anomaly, out[1].segment_cluster) == (True, 2) and out[1].anomaly_context_multiplier > 1
    assert prioritize_scored(df.where("false"), 0.3).collect() == [] and prioritize_scored(df, 0.3, -1).collect() == []
