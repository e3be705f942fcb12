"""Registered model queries.

Training results are not SQL-reproducible, so most of these get the
rows-only check; the LOF and the scaler/imputer have DuckDB oracles.
"""

from __future__ import annotations

import uuid

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import rules as R
from fleetlens.operators import clustering as CL
from fleetlens.operators import features as FT
from fleetlens.operators import joins as J
from fleetlens.operators import metrics as M
from fleetlens.operators import models as MD
from fleetlens.operators import search as SE
from fleetlens.operators import splits as SP
from fleetlens.operators import transforms as TR
from fleetlens.operators import windows as W
from fleetlens.operators.extratrees import ExtraTrees
from fleetlens.operators.iforest import iforest_fit, iforest_score
from fleetlens.operators.lof import lof_fit, lof_scores
from fleetlens.operators.restarts import fit_kmeans, fit_mixtures
from fleetlens.plans import analogs as A
from fleetlens.plans.oracle_views import sql_with
from fleetlens.plans.queries_features import SPLIT_DATE
from fleetlens.plans.base import r, register
from fleetlens.session import checkpoint_dir, cut_lineage, scalars
from fleetlens.sources import io as IO
from fleetlens.sources.tables import Tables


# ---------------------------------------------------------------------------
# incident prediction (entity-day features, 7-day label)
# ---------------------------------------------------------------------------
#: events whose entity-days one task reads
EVENTS_A_TASK = 500_000


def incident_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    ed = A.entity_day(t)
    h = W.history_features(ed, "server_id", ["date"], ["n_obs", "value_sum", "n_error"])
    lab = J.label_horizon(h, A.incidents(t), "server_id", "date", 1, 7, "label")
    srv = A.servers(t).select("server_id", "segment", "support_plan", "has_gpu", "is_managed")
    rows = lab.join(srv, "server_id", "left").withColumns(R.calendar("date", "2024-01-01"))
    # a task's share of the rows stays the same: fits hold many times what a shuffled row takes
    parts = -(-t.events.count() // EVENTS_A_TASK)
    return rows.repartition(parts, "server_id", "date") if parts > spark.sparkContext.defaultParallelism else rows


def _prepared(spark, sf_dir):
    # one materialisation of the feature build; preprocessing statistics and
    # both splits read it instead of re-running the window/label plan
    f = cut_lineage(incident_features(spark, sf_dir))
    num, cat = TR.feature_columns(f, exclude=["server_id", "label", "date"])
    train, test = SP.temporal_split(f, "date", SPLIT_DATE)
    pre = TR.TabularPreprocessor(num, cat).fit(train)
    keep = ["server_id", "date", "label", "features"]
    # Materialised once: every fit and evaluation below re-reads these
    # instead of recomputing the window/label plan.
    return (cut_lineage(pre.transform(train).select(*keep)),
            cut_lineage(pre.transform(test).select(*keep)), pre)


@register("m6_r1_incident_scoring")
def m6_r1_incident_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient boosting fitted on the first time blocks of the training window;
    decision threshold = best F1 on its last block (not on the test set);
    test rows scored with probability, decision and risk level (R1)."""
    train, test, _ = _prepared(spark, sf_dir)
    blocks = SP.time_blocks(train, "date", 3)
    fit_tr, val = SP.time_fold(blocks, 3)
    params = {"maxIter": 20, "maxDepth": 3, "stepSize": 0.1}
    model = MD.classifier("gradient_boosting", params, weight=None).fit(fit_tr)
    thr = MD.evaluate_scores(MD.positive_probability(model.transform(val))).select("best_threshold").first()[0]
    scored = MD.positive_probability(model.transform(test))
    n_features = len(train.select("features").first()[0])
    meta = F.create_map(F.lit("model_type"), F.lit("GBTClassifier"),
                        F.lit("threshold"), F.lit(str(thr)),
                        F.lit("feature_count"), F.lit(str(n_features)))
    # prediction table with traceability (V17) and the response fields
    return scored.select(
        F.col("server_id").alias("key"), "date", F.col("label").alias("y"), "score",
        R.decision("score", thr).alias("pred"), R.risk_level("score", thr).alias("risk_level"),
        F.lit(thr).alias("threshold"), F.lit("gradient_boosting").alias("model"),
        R.fingerprint("server_id", "date").alias("input_hash"), meta.alias("metadata"))


@register("m1_m5_model_leaderboard")
def m1_m5_model_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dummy prior, balanced logistic regression, random forest, extra-trees
    substitute and binned GBT on the same temporal split; U1/S2/S6/V16."""
    train, test, _ = _prepared(spark, sf_dir)

    def one(name):
        scored, secs = MD.fit_score(name, train, test, {"numTrees": 40, "maxIter": 20})
        ev = cut_lineage(MD.evaluate_scores(scored))
        return ev.select(F.lit(name).alias("model"), "average_precision", "roc_auc", "best_f1",
                         F.lit(float(secs)).alias("training_seconds"))

    names = ("dummy_prior", "logistic_regression", "random_forest", "extra_trees", "hist_gradient_boosting")
    rows = MD.run_parallel([lambda n=n: one(n) for n in names], parallelism=5)
    return M.leaderboard(rows, "average_precision", "roc_auc", secondary_desc=True)


# ---------------------------------------------------------------------------
# segmentation
# ---------------------------------------------------------------------------
def _segmentation_input(spark, sf_dir):
    t = Tables(spark, sf_dir)
    ft = cut_lineage(FT.server_feature_table(A.servers(t), A.usage(t), A.incidents(t)))
    num, cat = TR.feature_columns(ft, exclude=["server_id"])
    pre = TR.TabularPreprocessor(num, cat).fit(ft)
    x = pre.transform(ft)
    x = TR.variance_filter(x, "features", "features_var").drop("features").withColumnRenamed("features_var", "features")
    return ft, cut_lineage(x.select("server_id", "segment", "features"))


@register("m9_m14_kmeans_sweep")
def m9_m14_kmeans_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K-means for k = 3..8 (M14) with squared-Euclidean silhouette, DB, CH and
    inertia per k; best silhouette first."""
    _, x = _segmentation_input(spark, sf_dir)

    models = fit_kmeans(x, [MD.kmeans(k, max_iter=100) for k in range(3, 9)])

    def one(k, m):
        a = cut_lineage(m.transform(x).select(vector_to_array("features").alias("v"),
                                              F.col("prediction").alias("cluster")))
        sil = CL.silhouette_sq(a, "v", "cluster")
        idx = scalars(CL.davies_bouldin_calinski(a, "v", "cluster"))
        return cut_lineage(sil.select(F.lit(k).alias("k"), F.lit(f"kmeans_k{k}").alias("model"), "silhouette",
                                      idx["davies_bouldin"].alias("davies_bouldin"),
                                      idx["calinski_harabasz"].alias("calinski_harabasz"),
                                      F.lit(m.training_cost).alias("inertia")))

    rows = MD.run_parallel([lambda k=k, m=m: one(k, m) for k, m in zip(range(3, 9), models)], parallelism=6)
    return M.leaderboard(rows, "silhouette")


@register("m10_gmm_criteria")
def m10_gmm_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaussian mixtures for k = 3..8 (M10, M14), restarted, with likelihood, BIC and AIC (V13) and
    the silhouette; smallest BIC first."""
    _, x = _segmentation_input(spark, sf_dir)
    n = x.count()

    sizes = [(k, MD.SEED + s) for k in range(3, 9) for s in range(2)]
    fits = fit_mixtures(x, [MD.gaussian_mixture(k, max_iter=100, seed=seed) for k, seed in sizes])

    def one(k: int) -> tuple:
        g = max((g for (size, _), g in zip(sizes, fits) if size == k), key=lambda g: g.log_likelihood)
        c = MD.mixture_criteria(g, n)
        return k, float(c["bic"]), float(c["aic"]), float(c["log_likelihood"]), SE.silhouette(g.transform(x))

    rows = MD.run_parallel([lambda k=k: one(k) for k in range(3, 9)], parallelism=6)
    return spark.createDataFrame(rows, "k int, bic double, aic double, log_likelihood double, silhouette double").orderBy("bic")


@register("f9_f10_pca")
def f9_f10_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PCA: smallest k reaching 90 % and 95 % of the variance (F9) and the 2-D coordinates."""
    _, x = _segmentation_input(spark, sf_dir)
    (_, k90), (_, k95) = TR.pca_by_variance(x, 0.90), TR.pca_by_variance(x, 0.95)
    coords = TR.pca_coordinates(x.withColumn("cluster", F.col("segment")), "server_id", "cluster")
    return coords.withColumns({"k_for_90pct": F.lit(k90), "k_for_95pct": F.lit(k95)})


@register("f4_f8_encoding_selection")
def f4_f8_encoding_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-hot (unknown -> zeros), drop-first slicing, ANOVA top-k: vector sizes."""
    f = cut_lineage(incident_features(spark, sf_dir))
    num, cat = TR.feature_columns(f, exclude=["server_id", "label", "date"])
    train, test = SP.temporal_split(f, "date", SPLIT_DATE)
    full = TR.TabularPreprocessor(num, cat).fit(train)
    dropf = TR.TabularPreprocessor(num, cat, drop_first=True).fit(train)
    a = full.transform(test).select(F.size(vector_to_array("features")).alias("n"))
    b = dropf.transform(test).select(F.size(vector_to_array("features")).alias("n"))
    sel = TR.select_k_best(full.transform(train), 10).select(F.size(vector_to_array("features_k")).alias("n"))
    return (a.agg(F.lit("one_hot").alias("variant"), F.max("n").alias("width"), F.count(F.lit(1)).alias("rows"))
             .unionByName(b.agg(F.lit("drop_first").alias("variant"), F.max("n").alias("width"), F.count(F.lit(1)).alias("rows")))
             .unionByName(sel.agg(F.lit("select_k_best").alias("variant"), F.max("n").alias("width"), F.count(F.lit(1)).alias("rows"))))


# ---------------------------------------------------------------------------
# support forecast
# ---------------------------------------------------------------------------
def _support_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region-day history, interactions, calendar and next-day label; the last day of a region keeps
    its row, with a null label."""
    gp = A.group_day(Tables(spark, sf_dir)).withColumn("support_tickets", F.col("support_tickets").cast("double"))
    h = W.history_features(gp, "region", ["date"], ["support_tickets", "network_latency_ms", "capacity_used_pct"])
    h = h.withColumns(R.region_interactions("capacity_used_pct", "network_latency_ms", "avg_rack_temperature_c",
                                            "scheduled_maintenance", "power_usage_mw"))
    h = cut_lineage(h.withColumns(R.calendar("date", "2024-01-01")))
    labelled = W.lead_target(h, "region", ["date"], "support_tickets", "label").select("region", "date", "label")
    return cut_lineage(h.join(labelled, ["region", "date"], "left"))


def _support_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    panel = _support_panel(spark, sf_dir)
    num, cat = TR.feature_columns(panel, exclude=["label", "date"])
    train, test = SP.temporal_split(panel, "date", SPLIT_DATE)
    train = train.where(F.col("label").isNotNull())
    pre = TR.TabularPreprocessor(num, cat).fit(train)
    model = ExtraTrees(n_trees=400, max_depth=5, feature_share=0.6, min_leaf=10).fit(pre.transform(train))
    pred = cut_lineage(model.transform(pre.transform(test)).select("region", "date", "label", "prediction"))
    clipped, rounded = R.clip_round("prediction")
    pred = pred.withColumn("prediction", clipped).withColumn("rounded_prediction", rounded)
    # the error of the days whose label is known
    mae = M.regression_metrics(pred.where(F.col("label").isNotNull()), "label", "prediction").select("mae").first()[0]
    lo, hi = R.prediction_interval("prediction", F.lit(mae))
    return pred.select("region", "date", "label", "prediction", "rounded_prediction",
                       lo.alias("expected_range_low"), hi.alias("expected_range_high"), F.lit(mae).alias("error_margin_mae"))


@register("m8_r2_support_forecast")
def m8_r2_support_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """400 extremely randomised trees on region-day history features (E1-E6, B12, B15), temporal
    split; every test day forecast, the last one (without a label) too, clipped and rounded, with a
    +-MAE range (R2, B19, B20)."""
    return _support_forecast(spark, sf_dir)


@register("m8_forecast_invariants", sql_with(["GP"], f"""
SELECT COUNT(*) AS rows, COUNT(DISTINCT region) AS without_label, CAST(MAX(date) AS VARCHAR) AS last_day, 0 AS bad_predictions,
       0 AS bad_rounding, 0 AS bad_ranges FROM GP WHERE date >= DATE '{SPLIT_DATE}'"""))
def m8_forecast_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for any forecast: every test day of every region, the unlabelled one too."""
    s = _support_forecast(spark, sf_dir)
    bad = lambda c: F.count_if(~F.coalesce(c, F.lit(False))).cast("int")
    p, e = F.col("prediction"), F.col("error_margin_mae")
    return s.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("label").isNull()).alias("without_label"), F.max("date").alias("last_day"),
                 bad(p >= 0).alias("bad_predictions"), bad(F.abs(F.col("rounded_prediction") - p) <= 0.5).alias("bad_rounding"),
                 bad((F.abs(F.col("expected_range_high") - p - e) < 1e-9)
                     & (F.abs(F.col("expected_range_low") - F.greatest(p - e, F.lit(0.0))) < 1e-9)).alias("bad_ranges"))


# ---------------------------------------------------------------------------
# anomaly detection
# ---------------------------------------------------------------------------
LOF_K_EMB = 10
LOF_CONTAMINATION = 0.1
MD_MAX_FIT = 30000  # fit rows of the deployed model, a parameter of it


@register("m12_lof_embeddings", sql_with([], f"""
, EMV AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label FROM embeddings),
FI AS (SELECT vec_id, x FROM EMV WHERE label <> 0),
PD AS (SELECT a.vec_id AS p, b.vec_id AS o, list_distance(a.x, b.x) AS d FROM FI a JOIN FI b ON a.vec_id <> b.vec_id),
NB AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY p ORDER BY d, o) AS rn FROM PD) WHERE rn <= {LOF_K_EMB}),
KD AS (SELECT p, MAX(d) AS kdist FROM NB GROUP BY p),
LR AS (SELECT NB.p, 1.0 / (AVG(GREATEST(KD.kdist, NB.d)) + 1e-10) AS lrd FROM NB JOIN KD ON NB.o = KD.p GROUP BY NB.p),
LF AS (SELECT NB.p, AVG(L2.lrd) / ANY_VALUE(L1.lrd) AS lof FROM NB JOIN LR L2 ON NB.o = L2.p JOIN LR L1 ON NB.p = L1.p GROUP BY NB.p),
OFS AS (SELECT QUANTILE_CONT(-lof, {LOF_CONTAMINATION}) AS offset_ FROM LF),
QD AS (SELECT q.vec_id AS q, f.vec_id AS o, list_distance(q.x, f.x) AS d FROM EMV q, FI f),
QN AS (SELECT * FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY q ORDER BY d, o) AS rn FROM QD) WHERE rn <= {LOF_K_EMB}),
QL AS (SELECT QN.q, AVG(LR.lrd) * (AVG(GREATEST(KD.kdist, QN.d)) + 1e-10) AS lof
       FROM QN JOIN KD ON QN.o = KD.p JOIN LR ON QN.o = LR.p GROUP BY QN.q)
SELECT q AS vec_id, {r('lof')} AS lof, {r('lof + (SELECT offset_ FROM OFS)')} AS anomaly_score FROM QL"""))
def m12_lof_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOF (k=10) fitted on the embeddings of labels != 0, every embedding
    scored in novelty mode; exact, so DuckDB reproduces it."""
    em = Tables(spark, sf_dir).embeddings
    return lof_scores(em.filter(F.col("label") != 0), em, "embedding", ["vec_id"], k=LOF_K_EMB,
                      contamination=LOF_CONTAMINATION)


def _anomaly_frame(spark, sf_dir):
    u = A.usage(Tables(spark, sf_dir))
    u = u.withColumns(R.obs_pressure("cpu_util_pct", "ram_util_pct", "disk_util_pct", "temperature_c",
                                     "net_in_gb", "net_out_gb", "capacity_used_pct"))
    u = u.withColumns(R.calendar("date", "2024-01-01"))
    # "overload" label analog: a rule of the inputs, as in the source data
    return u.withColumn("label", R.flag((F.col("cpu_util_pct") >= 85) & (F.col("ram_util_pct") >= 85)))


@register("m12_r4_anomaly_scoring")
def m12_r4_anomaly_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LOF k=35 fitted on <= 30,000 normal training rows; threshold = training
    quantile at 1 - contamination; test rows get score, flag and severity (R4)."""
    u = cut_lineage(_anomaly_frame(spark, sf_dir))
    num, _ = TR.feature_columns(u, exclude=["event_id", "server_id", "label", "date", "ts"])
    train, test = SP.temporal_split(u, "date", SPLIT_DATE)
    cont = M.contamination(train, "label")
    normal = train.filter(F.col("label") == 0)
    pre = TR.TabularPreprocessor(num).fit(normal)
    vec = lambda d: pre.transform(d).withColumn("x", vector_to_array("features"))
    model = lof_fit(vec(normal), "x", k=35, contamination=cont, max_fit_rows=MD_MAX_FIT, key="event_id")
    fit_scores = model.score(vec(SP.sample_n(normal, MD_MAX_FIT, "event_id")), "x", ["event_id"])
    thr = M.score_threshold(fit_scores, "anomaly_score", cont)
    scored = model.score(vec(test), "x", ["event_id"]).join(test.select("event_id", "date", "label"), "event_id")
    return scored.select("event_id", "date", F.col("label").alias("y"), "anomaly_score",
                         R.decision("anomaly_score", thr).alias("is_anomaly"),
                         R.anomaly_severity("anomaly_score", thr).alias("severity"),
                         F.lit(thr).alias("threshold"))


@register("m12_v14_lof_evaluation")
def m12_v14_lof_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deployed anomaly model's report: LOF (k=35) fitted on <= 30,000
    normal training rows; threshold = quantile of the fit rows' own scores at
    1 - contamination; test precision/recall/F1, AP and ROC-AUC (M12, G13,
    G14, V14)."""
    u = cut_lineage(_anomaly_frame(spark, sf_dir))
    num, _ = TR.feature_columns(u, exclude=["event_id", "server_id", "label", "date", "ts"])
    train, test = SP.temporal_split(u, "date", SPLIT_DATE)
    normal = train.filter(F.col("label") == 0)
    pre = TR.TabularPreprocessor(num).fit(normal)
    vec = lambda d: pre.transform(d).withColumn("x", vector_to_array("features"))
    cont = M.contamination(train, "label")
    model = lof_fit(vec(normal), "x", k=35, contamination=cont, max_fit_rows=MD_MAX_FIT, key="event_id")
    fit_rows = SP.sample_n(normal, MD_MAX_FIT, "event_id")
    tr_scores = model.score(vec(fit_rows), "x", ["event_id"]).join(fit_rows.select("event_id", "label"), "event_id")
    te_scores = model.score(vec(test), "x", ["event_id"]).join(test.select("event_id", "label"), "event_id")
    return M.anomaly_evaluation(tr_scores.select(F.col("anomaly_score").alias("score"), F.col("label").alias("y")),
                                te_scores.select(F.col("anomaly_score").alias("score"), F.col("label").alias("y")),
                                contamination_value=cont)


TREES, TREE_ROWS = 300, 256


def _forest(spark: SparkSession, sf_dir: str):
    """(scaled anomaly frame, forest): the reference's 300 trees of 256 rows, drawn from all rows."""
    u = cut_lineage(_anomaly_frame(spark, sf_dir))
    num, _ = TR.feature_columns(u, exclude=["event_id", "server_id", "label", "date", "ts"])
    x = TR.TabularPreprocessor(num).fit(u).transform(u).withColumn("x", vector_to_array("features"))
    x = cut_lineage(x.select("event_id", "label", "x"))
    return x, iforest_fit(x, "x", "event_id", n_trees=TREES, sample_size=TREE_ROWS)


@register("m11_isolation_forest")
def m11_isolation_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Isolation forest over all rows: mean path and score of every row."""
    x, forest = _forest(spark, sf_dir)
    return iforest_score(x, forest, "x", ["event_id", "label"])


@register("m11_forest_invariants", sql_with(["U"], f"""
SELECT COUNT(*) AS rows, {TREES} AS trees, LEAST(COUNT(*), {TREE_ROWS})::INTEGER AS fewest_tree_rows,
       LEAST(COUNT(*), {TREE_ROWS})::INTEGER AS most_tree_rows, COUNT(*) AS scores_in_range, COUNT(*) AS scores_of_paths,
       TRUE AS falls_with_path FROM U"""))
def m11_forest_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for any forest: every row scored, every tree full, scores in (0, 1] and falling
    strictly with the mean path."""
    x, forest = _forest(spark, sf_dir)
    s = iforest_score(x, forest, "x", ["event_id"])
    by_path = F.exp(-F.col("mean_path") / F.lit(forest.unit) * F.log(F.lit(2.0)))
    return s.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(forest.sizes)).alias("trees"),
        F.lit(min(forest.sizes)).alias("fewest_tree_rows"), F.lit(max(forest.sizes)).alias("most_tree_rows"),
        F.count_if((F.col("anomaly_score") > 0) & (F.col("anomaly_score") <= 1)).alias("scores_in_range"),
        F.count_if(F.abs(F.col("anomaly_score") - by_path) < 1e-12).alias("scores_of_paths"),
        (F.min_by("mean_path", "anomaly_score") >= F.max_by("mean_path", "anomaly_score")).alias("falls_with_path"))


# ---------------------------------------------------------------------------
# transforms with oracles
# ---------------------------------------------------------------------------
@register("f1_f3_impute_scale", sql_with(["GP"], f"""
, H AS (SELECT region, date, CAST(LAG(support_tickets, 1) OVER (PARTITION BY region ORDER BY date) AS DOUBLE) AS lag1 FROM GP),
ST AS (SELECT QUANTILE_CONT(lag1, 0.5) AS med FROM H),
F AS (SELECT region, date, COALESCE(lag1, (SELECT med FROM ST)) AS lag1 FROM H),
SC AS (SELECT AVG(lag1) AS m, STDDEV_POP(lag1) AS s FROM F)
SELECT region, CAST(date AS VARCHAR) AS date, {r('(lag1 - m) / CASE WHEN s = 0 OR s IS NULL THEN 1.0 ELSE s END')} AS lag1_scaled FROM F, SC"""))
def f1_f3_impute_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    gp = A.group_day(Tables(spark, sf_dir))
    h = W.history_features(gp, "region", ["date"], ["support_tickets"], lags=(1,), mean_windows=(),
                           std_window=None, max_window=None, diff=False)
    h = h.select("region", "date", F.col("support_tickets_lag1").cast("double").alias("lag1"))
    filled = TR.apply_fill(h, TR.fit_median(h, ["lag1"]))
    return TR.apply_scaler(filled, TR.fit_scaler(filled, ["lag1"])).withColumnRenamed("lag1", "lag1_scaled")


# ---------------------------------------------------------------------------
# sinks and sources round trip
# ---------------------------------------------------------------------------
@register("a2_a4_roundtrip")
def a2_a4_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the incident feature table partitioned by date (A2), read it back
    (A1), save/load a metadata entry (A3) and the fitted preprocessing + GBT
    as one PipelineModel (A4); the reloaded model re-scores the test rows
    and must give the same probabilities."""
    from pyspark.ml import PipelineModel
    base = f"{checkpoint_dir(spark).rstrip('/')}/fleetlens-io-{uuid.uuid4().hex}"
    f = incident_features(spark, sf_dir)
    IO.write_table(f, f"{base}/features", partition_by=["date"])
    back = IO.read_table(spark, f"{base}/features")
    num, cat = TR.feature_columns(back, exclude=["server_id", "label", "date"])
    train, test = SP.temporal_split(back, "date", SPLIT_DATE)
    pre = TR.TabularPreprocessor(num, cat).fit(train)
    gbt = MD.classifier("gradient_boosting", {"maxIter": 10}, weight=None).fit(pre.transform(train))
    unit = PipelineModel(stages=[*pre.stages(back.columns), gbt])
    MD.save_model(unit, f"{base}/model")
    IO.save_metadata(spark, {"model_type": "GBTClassifier", "threshold": 0.5,
                             "feature_columns": num + cat}, f"{base}/meta")
    meta = IO.load_metadata(spark, f"{base}/meta")
    missing = IO.load_metadata(spark, f"{base}/absent")
    again = MD.positive_probability(MD.load_model(f"{base}/model").transform(test), out="p_loaded")
    direct = MD.positive_probability(gbt.transform(pre.transform(test)), out="p_fit")
    j = again.select("server_id", "date", "p_loaded").join(direct.select("server_id", "date", "p_fit"),
                                                          ["server_id", "date"])
    return j.agg(F.count(F.lit(1)).alias("rows"),
                 F.max(F.abs(F.col("p_loaded") - F.col("p_fit"))).alias("max_abs_diff"),
                 F.lit(meta.get("model_type", "")).alias("model_type"),
                 F.lit(len(meta.get("feature_columns", []))).alias("feature_count"),
                 F.lit(len(missing)).alias("missing_meta_keys"))


# ---------------------------------------------------------------------------
# Attribution of the fitted incident model by perturbation
# ---------------------------------------------------------------------------
@register("r8_model_attribution")
def r8_model_attribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed local attribution of the GBT incident model (re-aim of the
    per-row tree explainer): every test row, each numeric feature set to its
    training median (G12 background), the whole expanded frame scored by one
    ``transform``; top 5 by |impact| with readable labels (R6/R8, S5, B26)."""
    from fleetlens.operators import explain as X
    f = cut_lineage(incident_features(spark, sf_dir))
    num, cat = TR.feature_columns(f, exclude=["server_id", "label", "date"])
    train, test = SP.temporal_split(f, "date", SPLIT_DATE)
    pre = TR.TabularPreprocessor(num, cat).fit(train)
    model = MD.classifier("gradient_boosting", {"maxIter": 20}, weight=None).fit(
        cut_lineage(pre.transform(train).select("features", "label")))

    def scorer(d: DataFrame) -> DataFrame:
        # preprocessing rewrites the numeric columns; keep the caller's copies
        cols = d.columns
        kept = d.select(*cols, *[F.col(c).alias(f"_o_{c}") for c in cols])
        scored = MD.positive_probability(model.transform(pre.transform(kept)), out="score")
        return scored.select(*[F.col(f"_o_{c}").alias(c) for c in cols], "score")

    medians = TR.fit_median(train, num)
    rows = cut_lineage(test.select("server_id", "date", *num, *cat))
    return X.perturbation_explain(rows, ["server_id", "date"], num, scorer, reference=medians,
                                  method="model_perturbation", carry=cat)


@register("m7_regressor_leaderboard")
def m7_regressor_leaderboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean baseline, random forest, gradient boosting and the extra-trees
    substitute on next-day tickets; MAE/RMSE/R2 leaderboard (M7, V8, V16)."""
    gp = A.group_day(Tables(spark, sf_dir)).withColumn("support_tickets", F.col("support_tickets").cast("double"))
    h = W.history_features(gp, "region", ["date"], ["support_tickets", "network_latency_ms"])
    h = cut_lineage(W.lead_target(h.withColumns(R.calendar("date", "2024-01-01")), "region", ["date"],
                                  "support_tickets", "label"))
    num, cat = TR.feature_columns(h, exclude=["label", "date"])
    train, test = SP.temporal_split(h, "date", SPLIT_DATE)
    pre = TR.TabularPreprocessor(num, cat).fit(train)
    tr = cut_lineage(pre.transform(train).select("features", "label"))
    te = cut_lineage(pre.transform(test).select("features", "label"))
    rows = []
    mean = tr.agg(F.avg("label")).scalar()
    rows.append(M.regression_metrics(te.withColumn("prediction", mean), "label", "prediction")
                .select(F.lit("mean_baseline").alias("model"), "mae", "rmse", "r2"))
    for name in ("random_forest", "gradient_boosting", "extra_trees"):
        m = MD.regressor(name, {"numTrees": 60, "maxIter": 20}).fit(tr)
        p = cut_lineage(m.transform(te).select("label", "prediction"))
        rows.append(M.regression_metrics(p, "label", "prediction").select(F.lit(name).alias("model"), "mae", "rmse", "r2"))
    lb = rows[0]
    for x in rows[1:]:
        lb = lb.unionByName(x)
    return lb.withColumn("neg_mae", -F.col("mae")).transform(
        lambda d: M.leaderboard([d], "neg_mae")).drop("neg_mae")


# ---------------------------------------------------------------------------
# the incident feature build itself (E1-E5 on entity-days + J6 + B15 + dims)
# ---------------------------------------------------------------------------
def _incident_features_sql() -> str:
    w = "OVER (PARTITION BY o.server_id ORDER BY o.date"
    cols = []
    for c in ("n_obs", "value_sum", "n_error"):
        x = f"CAST(o.{c} AS DOUBLE)"
        cols += [f"{r(f'LAG({x}, 1) {w})')} AS {c}_lag1", f"{r(f'LAG({x}, 7) {w})')} AS {c}_lag7",
                 f"{r(f'{x} - LAG({x}, 1) {w})')} AS {c}_diff1",
                 f"{r(f'AVG({x}) {w} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)')} AS {c}_rolling_mean_3",
                 f"{r(f'AVG({x}) {w} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)')} AS {c}_rolling_mean_7",
                 f"{r(f'STDDEV_SAMP({x}) {w} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)')} AS {c}_rolling_std_7",
                 f"{r(f'MAX({x}) {w} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)')} AS {c}_rolling_max_7"]
    hist = ",\n  ".join(cols)
    return f"""
SELECT o.server_id, CAST(o.date AS VARCHAR) AS date, o.n_obs, {r('o.value_sum')} AS value_sum,
  {r('o.value_max')} AS value_max, {r('o.value_avg')} AS value_avg, o.n_error,
  {hist},
  CASE WHEN EXISTS (SELECT 1 FROM INC i WHERE i.server_id = o.server_id
                    AND i.date BETWEEN o.date + INTERVAL 1 DAY AND o.date + INTERVAL 7 DAY) THEN 1 ELSE 0 END AS label,
  S.segment, S.support_plan, S.has_gpu, S.is_managed,
  CAST(isodow(o.date) - 1 AS INTEGER) AS day_of_week, CAST(day(o.date) AS INTEGER) AS day_of_month,
  CAST(date_diff('day', DATE '2024-01-01', o.date) AS INTEGER) AS days_since_start
FROM ED o LEFT JOIN SRV S ON o.server_id = S.server_id"""


@register("e1_j6_incident_feature_table", sql_with(["ED", "INC", "SRV"], _incident_features_sql()))
def e1_j6_incident_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entity-day history features, 7-day incident label, server attributes and
    calendar: the training table of the incident model."""
    f = incident_features(spark, sf_dir)
    hist = [c for c in f.columns if any(c.startswith(p + "_") for p in ("n_obs", "value_sum", "n_error"))]
    return f.withColumns({c: F.col(c).cast("double") for c in hist})
