"""Registered evaluation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import rules as R
from fleetlens.operators import metrics as M
from fleetlens.operators import splits as SP
from fleetlens.operators import windows as W
from fleetlens.operators.joins import label_horizon
from fleetlens.operators.ranking import latest_rows
from fleetlens.plans import analogs as A
from fleetlens.plans.oracle_views import sql_with
from fleetlens.plans.base import r, register
from fleetlens.sources.tables import Tables

# Fixed values for the driver-table evaluation: the decision threshold on
# the scored documents, the deployed incident threshold used by the risk
# level rule, and the day that starts the anomaly test window.
DOC_THRESHOLD = 0.8
DEPLOYED_THRESHOLD = 0.0437
TEST_DAY = 12


def _sc(spark, sf_dir) -> DataFrame:
    return A.scored(Tables(spark, sf_dir))


def _pred(df: DataFrame, thr: float = DOC_THRESHOLD) -> DataFrame:
    return df.withColumn("pred", R.decision("score", thr))


PRED_SQL = f", SP AS (SELECT *, CASE WHEN score >= {DOC_THRESHOLD} THEN 1 ELSE 0 END AS pred FROM SC)\n"


# --- V1 ------------------------------------------------------------------------------
@register("v1_binary_metrics", sql_with(["SC"], PRED_SQL + f"""
, K AS (SELECT COUNT(*) AS n,
  SUM(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp, SUM(CASE WHEN y = 0 AND pred = 1 THEN 1 ELSE 0 END) AS fp,
  SUM(CASE WHEN y = 1 AND pred = 0 THEN 1 ELSE 0 END) AS fn, SUM(CASE WHEN y = 0 AND pred = 0 THEN 1 ELSE 0 END) AS tn FROM SP),
Q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0 END AS p,
                CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0 END AS rc FROM K)
SELECT {r('CASE WHEN n > 0 THEN (tp + tn) / n::DOUBLE ELSE 0.0 END')} AS accuracy, {r('p')} AS precision,
       {r('rc')} AS recall, {r('CASE WHEN p + rc > 0 THEN 2.0 * p * rc / (p + rc) ELSE 0.0 END')} AS f1,
       CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn
FROM Q"""))
def v1_binary_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.binary_metrics(_pred(_sc(spark, sf_dir)))


# --- V2 ------------------------------------------------------------------------------
@register("v2_confusion_matrix", sql_with(["SC"], PRED_SQL + """
SELECT y AS actual, CAST(SUM(CASE WHEN pred = 0 THEN 1 ELSE 0 END) AS BIGINT) AS pred_0,
       CAST(SUM(CASE WHEN pred = 1 THEN 1 ELSE 0 END) AS BIGINT) AS pred_1
FROM SP GROUP BY y"""))
def v2_confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.confusion_matrix(_pred(_sc(spark, sf_dir)))


# --- V3 ------------------------------------------------------------------------------
@register("v3_classification_report", sql_with(["SC"], PRED_SQL + f"""
, CL AS (SELECT c AS label_i,
     SUM(CASE WHEN y = c AND pred = c THEN 1 ELSE 0 END) AS tp,
     SUM(CASE WHEN pred = c THEN 1 ELSE 0 END) AS pp, SUM(CASE WHEN y = c THEN 1 ELSE 0 END) AS support
   FROM SP, (SELECT 0 AS c UNION ALL SELECT 1) GROUP BY c),
PR AS (SELECT CAST(label_i AS VARCHAR) AS label,
     CASE WHEN pp > 0 THEN tp / pp::DOUBLE ELSE 0.0 END AS precision,
     CASE WHEN support > 0 THEN tp / support::DOUBLE ELSE 0.0 END AS recall, support FROM CL),
F1 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM PR)
SELECT label, {r('precision')} AS precision, {r('recall')} AS recall, {r('f1')} AS f1, CAST(support AS BIGINT) AS support FROM F1
UNION ALL
SELECT 'macro avg', {r('AVG(precision)')}, {r('AVG(recall)')}, {r('AVG(f1)')}, CAST(SUM(support) AS BIGINT) FROM F1
UNION ALL
SELECT 'weighted avg', {r('SUM(precision * support) / SUM(support)')}, {r('SUM(recall * support) / SUM(support)')},
       {r('SUM(f1 * support) / SUM(support)')}, CAST(SUM(support) AS BIGINT) FROM F1"""))
def v3_classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.classification_report(_pred(_sc(spark, sf_dir)))


# --- B21-B23 decision, risk level, anomaly severity ----------------------------------------
@register("b21_b23_risk_levels", sql_with(["SC"], f"""
SELECT key, CASE WHEN score >= {DOC_THRESHOLD} THEN 1 ELSE 0 END AS pred,
  CASE WHEN score >= 0.5 THEN 'critical' WHEN score >= {DEPLOYED_THRESHOLD} THEN 'high'
       WHEN score >= 0.1 THEN 'medium' ELSE 'low' END AS risk_level,
  CASE WHEN score - {DOC_THRESHOLD} >= 0.1 THEN 'critical' WHEN score - {DOC_THRESHOLD} >= 0.03 THEN 'high'
       WHEN score - {DOC_THRESHOLD} >= 0 THEN 'medium' ELSE 'low' END AS severity,
  CASE WHEN score - {DOC_THRESHOLD} >= 0.1 THEN 1.6 WHEN score - {DOC_THRESHOLD} >= 0.03 THEN 1.35
       WHEN score - {DOC_THRESHOLD} >= 0 THEN 1.15 ELSE 1.0 END::DOUBLE AS anomaly_multiplier
FROM SC"""))
def b21_b23_risk_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    sc = _sc(spark, sf_dir)
    return sc.select("key", R.decision("score", DOC_THRESHOLD).alias("pred"),
                     R.risk_level("score", DEPLOYED_THRESHOLD).alias("risk_level"),
                     R.anomaly_severity("score", DOC_THRESHOLD).alias("severity"),
                     R.anomaly_multiplier("score", DOC_THRESHOLD).alias("anomaly_multiplier"))


# --- B30 min-max normalisation -----------------------------------------------------------------
@register("b30_minmax_normalize", sql_with(["SC"], f"""
, MM AS (SELECT MIN(score) AS lo, MAX(score) AS hi FROM SC)
SELECT key, {r('CASE WHEN hi - lo = 0 THEN 0.0 ELSE (score - lo) / (hi - lo) END')} AS norm_score FROM SC, MM"""))
def b30_minmax_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fleetlens.operators.scoring import minmax_normalize
    return minmax_normalize(_sc(spark, sf_dir), "score", "norm_score").select("key", "norm_score")


# --- V6 PR curve and V4/V5/V7 -------------------------------------------------------------------
CURVE_SQL = """
, D AS (SELECT score AS threshold, CAST(SUM(y) AS BIGINT) AS pos, CAST(SUM(1 - y) AS BIGINT) AS neg FROM SC GROUP BY score),
CU AS (SELECT *, CAST(SUM(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tp,
                 CAST(SUM(neg) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS fp FROM D),
TOT AS (SELECT SUM(pos) AS P, SUM(neg) AS N FROM D),
CV AS (SELECT threshold, pos, neg, tp, fp,
         CASE WHEN tp + fp > 0 THEN tp::DOUBLE / (tp + fp)::DOUBLE ELSE 0.0 END AS precision,
         CASE WHEN P > 0 THEN tp::DOUBLE / P::DOUBLE ELSE 1.0 END AS recall FROM CU, TOT)
"""


@register("v6_pr_curve", sql_with(["SC"], CURVE_SQL + f"""
SELECT {r('threshold')} AS threshold, pos, neg, tp, fp, {r('precision')} AS precision, {r('recall')} AS recall FROM CV"""))
def v6_pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.score_curve(_sc(spark, sf_dir))


CURVE_METRICS_SQL = CURVE_SQL + f"""
, F AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2.0 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM CV),
B AS (SELECT threshold, precision, recall, f1 FROM F ORDER BY f1 DESC, threshold ASC LIMIT 1),
AG AS (SELECT SUM(pos) AS P, SUM(neg) AS N, SUM(pos * precision) AS ap, SUM(neg * (tp - pos / 2.0)) AS auc FROM F)
SELECT {r('CASE WHEN P > 0 THEN ap / P ELSE 0.0 END')} AS average_precision,
       {r('CASE WHEN P > 0 AND N > 0 THEN auc / (P::DOUBLE * N::DOUBLE) END')} AS roc_auc,
       {r('COALESCE(B.threshold, 0.5)')} AS best_threshold, {r('COALESCE(B.precision, 0.0)')} AS best_precision,
       {r('COALESCE(B.recall, 0.0)')} AS best_recall, {r('COALESCE(B.f1, 0.0)')} AS best_f1
FROM AG LEFT JOIN B ON TRUE"""


@register("v4_v5_v7_curve_metrics", sql_with(["SC"], CURVE_METRICS_SQL))
def v4_v5_v7_curve_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.curve_metrics(M.score_curve(_sc(spark, sf_dir)))


# --- V8 regression metrics: naive forecast (today) vs next-day tickets -----------------------------
@register("v8_regression_metrics", sql_with(["GP"], f"""
, L AS (SELECT CAST(support_tickets AS DOUBLE) AS pred,
          CAST(LEAD(support_tickets, 1) OVER (PARTITION BY region ORDER BY date) AS DOUBLE) AS y FROM GP),
LL AS (SELECT * FROM L WHERE y IS NOT NULL),
MB AS (SELECT AVG(y) AS ybar FROM LL)
SELECT {r('AVG(ABS(pred - y))')} AS mae, {r('SQRT(AVG((pred - y) * (pred - y)))')} AS rmse,
       {r('CASE WHEN SUM((y - ybar) * (y - ybar)) > 0 THEN 1.0 - SUM((pred - y) * (pred - y)) / SUM((y - ybar) * (y - ybar)) ELSE 0.0 END')} AS r2,
       {r('AVG(ABS(pred - y) / GREATEST(y, 1.0))')} AS safe_mape, COUNT(*) AS n
FROM LL, MB"""))
def v8_regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    gp = A.group_day(Tables(spark, sf_dir))
    lt = W.lead_target(gp, "region", ["date"], "support_tickets", "y")
    return M.regression_metrics(lt.select(F.col("support_tickets").cast("double").alias("pred"),
                                          F.col("y").cast("double").alias("y")), "y", "pred")


# --- V9 daily top-K capture on labelled entity-days -----------------------------------------------
def incident_eval_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity-days with the 7-day incident label (J6) and a rule risk score
    (errors today + recent error rate): the driver analog of a scored test set."""
    t = Tables(spark, sf_dir)
    ed = A.entity_day(t)
    h = W.history_features(ed, "server_id", ["date"], ["n_error"], lags=(), mean_windows=(7,),
                           std_window=None, max_window=None, diff=False)
    lab = label_horizon(h, A.incidents(t), "server_id", "date", 1, 7, "y")
    return lab.select(F.col("server_id").alias("key"), "date", "y",
                      (F.col("n_error") + F.coalesce(F.col("n_error_rolling_mean_7"), F.lit(0.0))
                       + F.col("value_max") / F.lit(1000.0)).alias("score"))


INCIDENT_EVAL_SQL = """
, H AS (SELECT *, AVG(n_error) OVER (PARTITION BY server_id ORDER BY date ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS rm FROM ED),
IE AS (SELECT o.server_id AS key, o.date,
  CASE WHEN EXISTS (SELECT 1 FROM INC i WHERE i.server_id = o.server_id
                    AND i.date BETWEEN o.date + INTERVAL 1 DAY AND o.date + INTERVAL 7 DAY) THEN 1 ELSE 0 END AS y,
  n_error + COALESCE(rm, 0.0) + value_max / 1000.0::DOUBLE AS score FROM H o)
"""


@register("v9_topk_capture", sql_with(["ED", "INC"], INCIDENT_EVAL_SQL + f"""
, RK AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY date ORDER BY score DESC, key ASC) AS rk FROM IE),
KS AS (SELECT UNNEST([50, 100, 250, 500]) AS top_k_per_day),
DP AS (SELECT date, SUM(y) AS positives FROM IE GROUP BY date),
DY AS (SELECT top_k_per_day, date, COUNT(*) AS selected, SUM(y) AS hits FROM RK, KS WHERE rk <= top_k_per_day GROUP BY 1, 2),
J AS (SELECT DY.*, DP.positives FROM DY LEFT JOIN DP USING (date))
SELECT top_k_per_day, CAST(SUM(selected) AS BIGINT) AS selected_total, CAST(SUM(hits) AS BIGINT) AS captured_incidents,
       CAST(SUM(positives) AS BIGINT) AS total_incidents,
       {r('SUM(hits)::DOUBLE / NULLIF(SUM(positives), 0)')} AS capture_rate,
       {r('SUM(hits)::DOUBLE / NULLIF(SUM(selected), 0)')} AS precision_at_k,
       {r('AVG(CASE WHEN positives > 0 THEN hits / positives::DOUBLE END)')} AS mean_daily_capture_rate
FROM J GROUP BY top_k_per_day"""))
def v9_topk_capture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.topk_capture(incident_eval_table(spark, sf_dir), "date", "key", "y", "score")


# --- V15 histogram ----------------------------------------------------------------------------------
@register("v15_score_histogram", sql_with(["SC"], f"""
, MM AS (SELECT MIN(score) AS lo, MAX(score) AS hi FROM SC),
BB AS (SELECT y AS label, CASE WHEN hi = lo THEN 0 ELSE LEAST(CAST(FLOOR((score - lo) / ((hi - lo) / 50.0)) AS INTEGER), 49) END AS bin,
              lo, hi FROM SC, MM)
SELECT label, bin, COUNT(*) AS count, {r('ANY_VALUE(lo) + bin * CASE WHEN ANY_VALUE(hi) = ANY_VALUE(lo) THEN 0.0 ELSE (ANY_VALUE(hi) - ANY_VALUE(lo)) / 50.0 END')} AS bin_low
FROM BB GROUP BY label, bin"""))
def v15_score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.score_histogram(_sc(spark, sf_dir), "score", "y", 50)


# --- G13/G14/V14 anomaly evaluation ------------------------------------------------------------------
@register("v14_anomaly_evaluation", sql_with(["SC"], f"""
, TR AS (SELECT * FROM SC WHERE day < {TEST_DAY}),
TE AS (SELECT * FROM SC WHERE day >= {TEST_DAY}),
CT AS (SELECT GREATEST(AVG(y::DOUBLE), 0.001) AS c FROM TR),
TRS AS (SELECT score, ROW_NUMBER() OVER (ORDER BY score) - 1 AS i, COUNT(*) OVER () AS n FROM TR),
HH AS (SELECT (ANY_VALUE(n) - 1) * (1.0 - (SELECT c FROM CT)) AS h, ANY_VALUE(n) AS nn FROM TRS),
TV AS (SELECT ANY_VALUE(h) AS h, MAX(CASE WHEN i = FLOOR(h) THEN score END) AS lo,
              MAX(CASE WHEN i = LEAST(FLOOR(h) + 1, nn - 1) THEN score END) AS hi FROM TRS, HH),
TH AS (SELECT lo + (h - FLOOR(h)) * (hi - lo) AS t FROM TV),
PD AS (SELECT *, CASE WHEN score >= (SELECT t FROM TH) THEN 1 ELSE 0 END AS pred FROM TE),
K AS (SELECT SUM(CASE WHEN y = 1 AND pred = 1 THEN 1 ELSE 0 END) AS tp, SUM(CASE WHEN y = 0 AND pred = 1 THEN 1 ELSE 0 END) AS fp,
             SUM(CASE WHEN y = 1 AND pred = 0 THEN 1 ELSE 0 END) AS fn, AVG(pred::DOUBLE) AS pr, AVG(y::DOUBLE) AS yr FROM PD),
Q AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0.0 END AS p,
                CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0.0 END AS rc FROM K),
D AS (SELECT score AS threshold, SUM(y) AS pos, SUM(1 - y) AS neg FROM TE GROUP BY score),
CU AS (SELECT *, SUM(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS tpc,
                 SUM(neg) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS fpc FROM D),
AG AS (SELECT SUM(pos) AS npos, SUM(neg) AS nneg, SUM(pos * tpc::DOUBLE / (tpc + fpc)) AS ap,
              SUM(neg * (tpc - pos / 2.0)) AS auc FROM CU)
SELECT {r('(SELECT t FROM TH)')} AS threshold, {r('(SELECT c FROM CT)')} AS contamination,
       {r('pr')} AS predicted_anomaly_rate, {r('yr')} AS test_anomaly_rate,
       {r('p')} AS precision, {r('rc')} AS recall, {r('CASE WHEN p + rc > 0 THEN 2.0 * p * rc / (p + rc) ELSE 0.0 END')} AS f1,
       {r('CASE WHEN npos > 0 THEN ap / npos ELSE 0.0 END')} AS average_precision,
       {r('CASE WHEN npos > 0 AND nneg > 0 THEN auc / (npos::DOUBLE * nneg::DOUBLE) END')} AS roc_auc
FROM Q, AG"""))
def v14_anomaly_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    sc = _sc(spark, sf_dir)
    return M.anomaly_evaluation(sc.filter(F.col("day") < TEST_DAY), sc.filter(F.col("day") >= TEST_DAY))


# --- U1/S2/S6/V16 leaderboard of rule models ---------------------------------------------------------
def _lb_sql() -> str:
    parts = []
    for name, expr in (("length_score", "score"), ("inverse_score", "1.0 - score"), ("key_parity", "CAST(key % 2 AS DOUBLE)")):
        parts.append(f"""
{name}_D AS (SELECT {expr} AS threshold, SUM(y) AS pos, SUM(1 - y) AS neg FROM SC GROUP BY 1),
{name}_C AS (SELECT *, SUM(pos) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS tp,
                       SUM(neg) OVER (ORDER BY threshold DESC ROWS UNBOUNDED PRECEDING) AS fp FROM {name}_D),
{name}_M AS (SELECT '{name}' AS model, SUM(pos * tp::DOUBLE / (tp + fp)) / SUM(pos) AS average_precision,
              SUM(neg * (tp - pos / 2.0)) / (SUM(pos)::DOUBLE * SUM(neg)::DOUBLE) AS roc_auc FROM {name}_C)""")
    return ", " + ",".join(parts) + f"""
, LB AS (SELECT * FROM length_score_M UNION ALL SELECT * FROM inverse_score_M UNION ALL SELECT * FROM key_parity_M),
W AS (SELECT model FROM LB ORDER BY average_precision DESC, roc_auc DESC, model LIMIT 1)
SELECT LB.model, {r('average_precision')} AS average_precision, {r('roc_auc')} AS roc_auc,
       LB.model = (SELECT model FROM W) AS winner FROM LB"""


@register("u1_s2_s6_leaderboard", sql_with(["SC"], _lb_sql()))
def u1_s2_s6_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    sc = _sc(spark, sf_dir)
    rows = []
    for name, expr in (("length_score", F.col("score")), ("inverse_score", F.lit(1.0) - F.col("score")),
                       ("key_parity", (F.col("key") % 2).cast("double"))):
        cm = M.curve_metrics(M.score_curve(sc.withColumn("score", expr)))
        rows.append(cm.select(F.lit(name).alias("model"), "average_precision", "roc_auc"))
    return M.leaderboard(rows, "average_precision", "roc_auc", secondary_desc=True)


# --- S4 latest rows ---------------------------------------------------------------------------------
@register("s4_latest_rows", sql_with(["E"], """
SELECT event_id, server_id, CAST(date AS VARCHAR) AS date, event_type FROM E
ORDER BY date DESC, server_id ASC, event_id ASC LIMIT 100"""))
def s4_latest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.observations(Tables(spark, sf_dir)).select("event_id", "server_id", "date", "event_type")
    return latest_rows(e, 100, "date", ["server_id", "event_id"])


# --- P5 time folds ----------------------------------------------------------------------------------
@register("p5_time_folds", sql_with(["ED"], """
, DT AS (SELECT date, NTILE(4) OVER (ORDER BY date) - 1 AS block FROM (SELECT DISTINCT date FROM ED))
SELECT block, COUNT(DISTINCT ED.date) AS n_dates, COUNT(*) AS n_rows, CAST(MIN(ED.date) AS VARCHAR) AS first_date
FROM ED JOIN DT USING (date) GROUP BY block"""))
def p5_time_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    ed = A.entity_day(Tables(spark, sf_dir))
    b = SP.time_blocks(ed, "date", 3)
    return b.groupBy("block").agg(F.count_distinct("date").alias("n_dates"), F.count(F.lit(1)).alias("n_rows"),
                                  F.min("date").alias("first_date"))


# --- P1-P4 hash splits and samples (rows-only: the hash is Spark's) ----------------------------------
@register("p1_p4_splits")
def p1_p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.observations(Tables(spark, sf_dir)).withColumn("y", R.flag(F.col("event_type") == "error"))
    tr, te = SP.hash_split(e, "event_id", 0.2)
    str_, ste = SP.stratified_split(e, "event_id", "y", 0.2)
    sxr, sxe = SP.stratified_split_exact(e, "event_id", "y", 0.2)
    samp = SP.sample_n(e, 3000, "event_id")
    folds = SP.kfold(e, "event_id", 3)

    def part(name, d):
        return d.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("rows"),
                     F.avg(F.col("y").cast("double")).alias("positive_rate"))
    out = part("train", tr).unionByName(part("test", te)).unionByName(part("strat_train", str_)) \
        .unionByName(part("strat_test", ste)).unionByName(part("sample", samp)) \
        .unionByName(part("strat_exact_train", sxr)).unionByName(part("strat_exact_test", sxe))
    for i in range(3):
        out = out.unionByName(part(f"fold_{i}", folds.filter(F.col("fold") == i)))
    return out
