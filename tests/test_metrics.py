"""Evaluation operators against hand-computed values."""

from pyspark.sql import functions as F

from fleetlens.operators import metrics as M


def _sc(spark, rows):
    return spark.createDataFrame(rows, "score double, y int")


def test_average_precision_and_auc(spark):
    sc = _sc(spark, [(.9, 1), (.8, 0), (.7, 1), (.6, 1), (.5, 0)])
    r = M.curve_metrics(M.score_curve(sc)).first()
    assert abs(r.average_precision - 0.805556) < 1e-6
    assert abs(r.roc_auc - 0.666667) < 1e-6


def test_curve_with_ties_and_many_buckets(spark):
    rows = [(0.5, 1), (0.5, 0), (0.9, 1), (0.1, 0), (0.5, 1), (0.3, 0)]
    sc = _sc(spark, rows)
    r = M.curve_metrics(M.score_curve(sc, buckets=3)).first()
    # brute force: AP over distinct thresholds, AUC by pair counting with half ties
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    ap, prev = 0.0, 0.0
    for t in sorted({s for s, _ in rows}, reverse=True):
        tp = sum(1 for s, y in rows if s >= t and y == 1)
        fp = sum(1 for s, y in rows if s >= t and y == 0)
        rec = tp / len(pos)
        ap += (rec - prev) * tp / (tp + fp)
        prev = rec
    assert abs(r.roc_auc - auc) < 1e-12
    assert abs(r.average_precision - ap) < 1e-12


def test_best_f1_lowest_threshold_on_ties(spark):
    sc = _sc(spark, [(.9, 1), (.8, 0), (.7, 1)])
    r = M.curve_metrics(M.score_curve(sc)).first()
    # F1 at .9 = 2*1*.5/1.5 = .6667, at .7 = 2*.6667*1/1.6667 = .8
    assert abs(r.best_threshold - 0.7) < 1e-12 and abs(r.best_f1 - 0.8) < 1e-12


def test_empty_curve_defaults(spark):
    r = M.curve_metrics(M.score_curve(_sc(spark, []))).first()
    assert r.best_threshold == 0.5 and r.best_f1 == 0.0


def test_topk_capture_example(spark):
    rows = [(1, 1, .9, 1), (1, 2, .8, 1), (2, 3, .7, 0), (2, 4, .6, 1), (3, 5, .5, 0)]
    df = spark.createDataFrame(rows, "date int, key int, score double, y int")
    r = M.topk_capture(df, "date", "key", "y", "score", ks=[1]).first()
    assert (r.selected_total, r.captured_incidents, r.total_incidents) == (3, 1, 3)
    assert abs(r.capture_rate - 1 / 3) < 1e-12 and abs(r.precision_at_k - 1 / 3) < 1e-12
    assert abs(r.mean_daily_capture_rate - 0.25) < 1e-12


def test_binary_metrics_zero_division(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "y int, pred int")
    r = M.binary_metrics(df).first()
    assert (r.precision, r.recall, r.f1, r.accuracy) == (0.0, 0.0, 0.0, 1.0)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 3.0), (0.0, 1.0)], "y double, pred double")
    r = M.regression_metrics(df).first()
    assert abs(r.mae - 2 / 3) < 1e-12
    assert abs(r.rmse - (2 / 3) ** 0.5) < 1e-12
    assert abs(r.safe_mape - (1.0 + 0.0 + 1.0) / 3) < 1e-12


def test_leaderboard_winner(spark):
    a = spark.createDataFrame([("m1", 0.3, 0.6)], "model string, average_precision double, roc_auc double")
    b = spark.createDataFrame([("m2", 0.5, 0.5)], "model string, average_precision double, roc_auc double")
    out = M.leaderboard([a, b], "average_precision").collect()
    assert [r.model for r in out] == ["m2", "m1"] and out[0].winner and not out[1].winner


def test_anomaly_evaluation_threshold(spark):
    tr = spark.createDataFrame([(float(i), 1 if i == 9 else 0) for i in range(10)], "score double, y int")
    te = spark.createDataFrame([(9.5, 1), (1.0, 0)], "score double, y int")
    r = M.anomaly_evaluation(tr, te).first()
    # contamination 0.1 -> linear quantile 0.9 of 0..9 = 8.1
    assert abs(r.threshold - 8.1) < 1e-12 and r.precision == 1.0 and r.recall == 1.0
    assert F is not None
