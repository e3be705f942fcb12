"""Registered searches and model-driven responses (M13, M6, R1, R3, R5 + J9, R9)."""

from __future__ import annotations

import math

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import rules as R
from fleetlens.operators import clustering as CL
from fleetlens.operators import features as FT
from fleetlens.operators import joins as J
from fleetlens.operators import metrics as M
from fleetlens.operators import models as MD
from fleetlens.operators import rowexplain as RX
from fleetlens.operators import search as SE
from fleetlens.operators import splits as SP
from fleetlens.operators import transforms as TR
from fleetlens.operators.lof import lof_fit
from fleetlens.operators.ranking import prioritize_scored
from fleetlens.plans import analogs as A
from fleetlens.plans.base import r, register
from fleetlens.plans.oracle_views import sql_with
from fleetlens.plans.queries_core import BV_SQL
from fleetlens.plans.queries_features import SPLIT_DATE
from fleetlens.plans.queries_ml import MD_MAX_FIT, incident_features
from fleetlens.session import cut_lineage
from fleetlens.sources.tables import Tables

# The search lists of the incident model, its draws and its folds.
BOOSTING_SPACE = {
    "n_estimators": [100, 200, 700],
    "learning_rate": [0.01, 0.1, 0.2],
    "max_depth": [3, 5, 7],
    "min_samples_split": [2, 5, 10],
    "min_samples_leaf": [1, 2, 4],
    "subsample": [0.8, 0.9, 1.0],
}
BOOSTING_DRAWS, BOOSTING_FOLDS = 3, 4
#: draws candidates of 100 trees; one of 700 trees and depth 7 is thousands of jobs a fold (see the README)
BOOSTING_SEED = 52
# The ranges of the segmentation search, its draws and its folds.
SEGMENT_SPACES = {
    "kmeans": {"reducer": [None, 0.90, 0.95], "k": SE.whole_between(2, 8), "n_init": SE.whole_between(10, 40),
               "max_iter": SE.whole_between(200, 500), "init": ["k-means||", "random"]},
    "gaussian_mixture": {"reducer": [None, 0.90, 0.95], "k": SE.whole_between(2, 8), "n_init": SE.whole_between(2, 10),
                         "max_iter": SE.whole_between(100, 400)},
}
SEGMENT_DRAWS, SEGMENT_FOLDS = 8, 3


# --- stratified folds ----------------------------------------------------------------------------
@register("m13_stratified_folds", sql_with(["ED"], f"""
, N AS (SELECT CASE WHEN n_error > 0 THEN 1 ELSE 0 END AS label, COUNT(*) AS n FROM ED GROUP BY 1),
C AS (SELECT label, n, f AS fold, CASE WHEN f = 0 THEN 0 ELSE (f * (n - 1)) // {BOOSTING_FOLDS} + 1 END AS lo,
             CASE WHEN f = {BOOSTING_FOLDS} - 1 THEN n ELSE ((f + 1) * (n - 1)) // {BOOSTING_FOLDS} + 1 END AS hi
      FROM N, range({BOOSTING_FOLDS}) AS t(f))
SELECT label, fold::INTEGER AS fold, (hi - lo)::BIGINT AS rows FROM C WHERE hi > lo"""))
def m13_stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each class in each fold: equal to one row, whatever the hash."""
    ed = A.entity_day(Tables(spark, sf_dir)).withColumn("label", R.flag(F.col("n_error") > 0))
    return SE.stratified_folds(ed, ["server_id", "date"], "label", BOOSTING_FOLDS) \
        .groupBy("label", "fold").agg(F.count(F.lit(1)).alias("rows"))


# --- incident model: search, response ------------------------------------------------------------
def boosting(params: dict):
    """A node of fewer than ``min_samples_split`` rows is not split: with leaves of at least half as many none can be."""
    leaf = max(params["min_samples_leaf"], math.ceil(params["min_samples_split"] / 2))
    return MD.classifier("gradient_boosting", {
        "maxIter": params["n_estimators"], "stepSize": params["learning_rate"], "maxDepth": params["max_depth"],
        "minInstancesPerNode": leaf, "subsamplingRate": params["subsample"]}, weight=None)


def incident_pipeline(rows: DataFrame) -> SE.TabularPipeline:
    num, cat = TR.feature_columns(rows, exclude=["server_id", "label", "date"])
    return SE.TabularPipeline(num, cat, boosting, drop_first=True)


@register("m13_random_search")
def m13_random_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The incident model's search: draws without replacement from its six lists, four stratified
    folds, preparation refitted in each, accuracy; the refitted winner and the uniform baseline on
    the held-out fifth."""
    rows = cut_lineage(incident_features(spark, sf_dir))
    keys = ["server_id", "date"]
    train, test = SP.stratified_split_exact(rows, keys, "label", 0.2)
    train, test = cut_lineage(train), cut_lineage(test)
    folded = cut_lineage(SE.stratified_folds(train, keys, "label", BOOSTING_FOLDS))
    found = SE.search(incident_pipeline(rows), train, SE.fold_pairs(folded, "fold", BOOSTING_FOLDS), BOOSTING_SPACE,
                      SE.accuracy, BOOSTING_DRAWS, seed=BOOSTING_SEED, parallelism=8)
    scored = found.best.transform(test)
    # uniform baseline (M1): a class by the row's hash, each with one half
    uniform = F.avg((F.col("label") == F.pmod(F.xxhash64(*keys, F.lit(42)), F.lit(2))).cast("double"))
    return found.table(spark).drop("seconds").withColumns({
        "test_accuracy": F.when(F.col("rank") == 1, F.lit(SE.accuracy(scored))),
        "uniform_accuracy": F.lit(test.agg(uniform).first()[0])})


def _incident_model(spark: SparkSession, sf_dir: str, params: dict):
    """(model, train, test, threshold): fitted on the first time blocks, threshold on the last."""
    rows = cut_lineage(incident_features(spark, sf_dir))
    train, test = SP.temporal_split(rows, "date", SPLIT_DATE)
    fit_rows, val = SP.time_fold(SP.time_blocks(train, "date", 3), 3)
    model = incident_pipeline(rows).fit(cut_lineage(fit_rows), params)
    thr = MD.evaluate_scores(MD.positive_probability(model.transform(val))).select("best_threshold").first()[0]
    return model, train, test, thr


#: first entries of the search lists, for responses that need a fitted model but no search
BOOSTING_FIRST = {k: v[0] for k, v in BOOSTING_SPACE.items()} | {"learning_rate": 0.1}


def _incident_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    model, train, test, thr = _incident_model(spark, sf_dir, BOOSTING_FIRST)
    pre = model.preprocessor
    factors = [*[RX.Factor(c, pre.medians[c]) for c in pre.numeric], *[RX.Factor(c, pre.modes[c], RX.CATEGORY) for c in pre.categorical]]
    inputs = [f.name for f in factors]
    shown = test.select("server_id", "date", "label", F.struct(*inputs).alias("_in"), *inputs)
    prepared = model.prepare(shown).select("server_id", "date", "label", "_in", "features")
    trees = RX.Trees(model.model, "logistic")
    scored = RX.tree_scores(prepared, trees, RX.slot_changes(model, factors)).select(
        "server_id", "date", "label", "score", "_changed", "_in.*")
    top = RX.explained(scored, factors, method="model_perturbation")
    return top.select("server_id", "date", F.col("label").alias("y"), F.col("score").alias("incident_probability"),
                      R.decision("score", thr).alias("prediction"), R.risk_level("score", thr).alias("risk_level"),
                      F.lit(thr).alias("threshold"), "top_explanations",
                      R.incident_sentence(RX.labels(), "score").alias("human_explanation"),
                      R.fingerprint("server_id", "date").alias("input_hash"))


@register("r1_incident_response")
def r1_incident_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole incident response (R1, R8): probability, decision, risk level, the five factors with
    the largest effect (numbers against the training median, categories against the mode, scored
    inside the row by the exported trees) and the sentence."""
    return _incident_response(spark, sf_dir)


@register("r1_response_invariants", sql_with(["ED"], f"""
SELECT COUNT(*) AS rows, 0 AS bad_probabilities, 0 AS bad_decisions, 0 AS bad_risks, 0 AS bad_orders, 0 AS bad_directions,
       0 AS bad_sentences FROM ED WHERE date >= DATE '{SPLIT_DATE}'"""))
def r1_response_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _incident_response(spark, sf_dir)
    e, p = F.col("top_explanations"), F.col("incident_probability")
    bad = lambda c: F.count_if(~F.coalesce(c, F.lit(False))).cast("int")
    order = F.transform(e, lambda x: -x["abs_impact"])
    signs = F.forall(e, lambda x: (x["direction"] == "increases_prediction") == (x["impact"] >= 0))
    return s.agg(
        F.count(F.lit(1)).alias("rows"), bad((p >= 0) & (p <= 1)).alias("bad_probabilities"),
        bad((F.col("prediction") == 1) == (p >= F.col("threshold"))).alias("bad_decisions"),
        bad(F.col("risk_level") == R.risk_level("incident_probability", s.select("threshold").first()[0])).alias("bad_risks"),
        bad((F.array_sort(order) == order) & (F.size(e) == 5)).alias("bad_orders"), bad(signs).alias("bad_directions"),
        bad(F.col("human_explanation").contains(F.get(e, F.lit(0))["label"])).alias("bad_sentences"))


# --- segmentation: search, response --------------------------------------------------------------
def _cluster_model(kind: str):
    def make(params: dict):
        if kind == "kmeans":
            one = lambda seed: MD.kmeans(params["k"], init=params["init"], max_iter=params["max_iter"], seed=seed)
        else:
            one = lambda seed: MD.gaussian_mixture(params["k"], max_iter=params["max_iter"], seed=seed)
        return MD.Restarted(one, params["n_init"])
    return make


def segmentation_search(spark: SparkSession, sf_dir: str, draws: int = SEGMENT_DRAWS):
    """(all servers, winner, its family, table): both families searched by silhouette on held-out rows,
    the winner by silhouette on the test fifth."""
    t = Tables(spark, sf_dir)
    servers = cut_lineage(FT.server_feature_table(A.servers(t), A.usage(t), A.incidents(t)))
    num, cat = TR.feature_columns(servers, exclude=["server_id"])
    train, test = (cut_lineage(d) for d in SP.hash_split(servers, "server_id", 0.2))
    folded = cut_lineage(SP.kfold(train, "server_id", SEGMENT_FOLDS))
    folds = SE.fold_pairs(folded, "fold", SEGMENT_FOLDS)
    best, table = None, None
    for kind, space in SEGMENT_SPACES.items():
        pipeline = SE.TabularPipeline(num, cat, _cluster_model(kind))
        found = SE.search(pipeline, train, folds, space, SE.silhouette, draws, parallelism=4, keep=())
        score = SE.silhouette(found.best.transform(test))
        rows = found.table(spark).drop("seconds").select(F.lit(kind).alias("model"), "*", F.when(
            F.col("rank") == 1, F.lit(score).cast("double")).alias("test_silhouette"))
        table = rows if table is None else table.unionByName(rows)
        if best is None or (score or -1.0) > best[0]:
            best = (score or -1.0, found.best, kind)
    return servers, best[1], best[2], table


@register("m13_segmentation_search")
def m13_segmentation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation_search(spark, sf_dir)[3]


def segment_response(servers: DataFrame, model: SE.Fitted, family: str) -> DataFrame:
    """server_id, cluster, profile, membership probabilities and confidence, all of one model; the
    response array and sentence (R3, R9).  K-means has no memberships: an empty map, no confidence."""
    out = model.transform(servers).withColumn("cluster", F.col("prediction"))
    none = F.create_map().cast("map<string,double>")
    if family == "gaussian_mixture":
        p = vector_to_array("probability")
        names = F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda i: i.cast("string"))
        out = out.select("server_id", "cluster", F.map_from_arrays(names, p).alias("probabilities"))
    else:
        out = out.select("server_id", "cluster", none.alias("probabilities"))
    out = cut_lineage(out)
    names = CL.name_profiles(CL.cluster_profile(out.select("server_id", "cluster").join(servers, "server_id")))
    named = J.profile_lookup(out, names, "cluster").withColumn("confidence", F.try_element_at("probabilities", F.col("cluster").cast("string")))
    return named.select("server_id", "cluster", "profile_name", "profile_driver", "probabilities", "confidence",
                        RX.segment_factors("profile_name", "profile_driver", "confidence").alias("top_explanations"),
                        R.segment_sentence("profile_name", "profile_driver", "confidence").alias("human_explanation"))


@register("r3_segmentation_scoring")
def r3_segmentation_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The winner of the segmentation search on every server."""
    servers, model, family, _ = segmentation_search(spark, sf_dir)
    return segment_response(servers, model, family)


@register("r3_mixture_invariants", sql_with(["SRV"], """
SELECT COUNT(*) AS rows, 0 AS bad_sums, 0 AS not_the_likeliest, 0 AS bad_confidence, 0 AS without_profile, 0 AS bad_sentences FROM SRV"""))
def r3_mixture_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for any mixture: cluster, memberships and confidence come from the same model."""
    t = Tables(spark, sf_dir)
    servers = cut_lineage(FT.server_feature_table(A.servers(t), A.usage(t), A.incidents(t)))
    num, cat = TR.feature_columns(servers, exclude=["server_id"])
    model = SE.TabularPipeline(num, cat, _cluster_model("gaussian_mixture")).fit(
        servers, {"reducer": 0.90, "k": 5, "n_init": 3, "max_iter": 100})
    s = segment_response(servers, model, "gaussian_mixture")
    bad = lambda c: F.count_if(~F.coalesce(c, F.lit(False))).cast("int")
    p = F.map_values("probabilities")
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return s.agg(F.count(F.lit(1)).alias("rows"), bad(F.abs(total - 1.0) < 1e-9).alias("bad_sums"),
                 bad(F.col("confidence") == F.array_max(p)).alias("not_the_likeliest"),
                 bad(F.col("confidence") == F.get("top_explanations", F.lit(0))["impact"]).alias("bad_confidence"),
                 bad(F.col("profile_name") != "profil inconnu").alias("without_profile"),
                 bad(F.col("human_explanation").contains(F.col("profile_name"))
                     & F.col("human_explanation").contains("probabilite de cluster")).alias("bad_sentences"))


# --- prioritisation from three models ------------------------------------------------------------
def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per server and day: mean usage, server attributes, calendar; 7-day incident label and
    the overload label of the day."""
    t = Tables(spark, sf_dir)
    measures = ["cpu_util_pct", "ram_util_pct", "disk_util_pct", "temperature_c", "net_in_gb", "net_out_gb", "capacity_used_pct"]
    days = A.usage(t).groupBy("server_id", "date").agg(
        *[F.avg(F.col(m).cast("double")).alias(m) for m in measures],
        F.max(R.flag((F.col("cpu_util_pct") >= 85) & (F.col("ram_util_pct") >= 85))).alias("overload"))
    days = J.label_horizon(days, A.incidents(t), "server_id", "date", 1, 7, "label")
    srv = A.servers(t).select("server_id", "segment", "support_plan", "has_gpu", "is_managed", "monthly_spend_eur")
    return days.join(srv, "server_id", "left").withColumns(R.calendar("date", "2024-01-01"))


ANOMALY_INPUTS = ("cpu_util_pct", "ram_util_pct", "disk_util_pct", "temperature_c", "net_in_gb", "net_out_gb", "capacity_used_pct")
SEGMENT_INPUTS = (*ANOMALY_INPUTS, "monthly_spend_eur")
TOP_N = 50


class PriorityModels:
    """The three fitted models and their thresholds: what a deployment would load."""

    def __init__(self, train: DataFrame):
        num, cat = TR.feature_columns(train, exclude=["server_id", "label", "date", "overload"])
        self.incident = SE.TabularPipeline(num, cat, boosting, drop_first=True).fit(train, BOOSTING_FIRST)
        normal = cut_lineage(train.where("overload = 0"))
        self.scaling = TR.TabularPreprocessor(list(ANOMALY_INPUTS)).fit(normal)
        cont = M.contamination(train.select(F.col("overload").alias("label")), "label")
        self.anomaly = lof_fit(self._vector(normal), "x", k=35, contamination=cont, max_fit_rows=MD_MAX_FIT, key=["server_id", "date"])
        fitted = SP.sample_n(normal, MD_MAX_FIT, ["server_id", "date"])
        self.threshold = M.score_threshold(self.anomaly_scores(fitted), "anomaly_score", cont)
        self.segments = SE.TabularPipeline(list(SEGMENT_INPUTS), ["segment"], _cluster_model("kmeans")).fit(
            train, {"k": 5, "init": "k-means||", "max_iter": 200, "n_init": 3})
        clustered = self.segments.transform(train).select("server_id", "date", F.col("prediction").alias("cluster"))
        self.profiles = cut_lineage(CL.name_profiles(_day_profile(clustered.join(train, ["server_id", "date"]))))

    def _vector(self, rows: DataFrame) -> DataFrame:
        return self.scaling.transform(rows).withColumn("x", vector_to_array("features"))

    def anomaly_scores(self, rows: DataFrame) -> DataFrame:
        return self.anomaly.score(self._vector(rows), "x", ["server_id", "date"]).select("server_id", "date", "anomaly_score")

    def scored(self, rows: DataFrame) -> DataFrame:
        """Every input row with the outputs of the three models."""
        p = MD.positive_probability(self.incident.transform(rows), out="incident_probability") \
            .select("server_id", "date", "incident_probability")
        seg = J.profile_lookup(self.segments.transform(rows).select("server_id", "date", F.col("prediction").alias("cluster")),
                               self.profiles, "cluster", ["profile_name"]) \
            .select("server_id", "date", F.col("cluster").alias("segment_cluster"), F.col("profile_name").alias("segment_profile"))
        return J.gather_scores(rows, [p, self.anomaly_scores(rows), seg], ["server_id", "date"])


def _day_profile(rows: DataFrame) -> DataFrame:
    """Cluster means under the names that the profile rules read; what a day does not have is 0."""
    mean = lambda c: F.avg(F.col(c).cast("double"))
    return rows.groupBy("cluster").agg(
        F.count_distinct("server_id").alias("server_count"), mean("label").alias("incident_rate"),
        F.avg((F.col("cpu_util_pct") + F.col("ram_util_pct") + F.col("disk_util_pct")) / 3.0).alias("utilization_pressure_mean"),
        mean("temperature_c").alias("temperature_c_mean"), mean("disk_util_pct").alias("disk_util_pct_mean"),
        F.avg(F.col("net_in_gb") + F.col("net_out_gb")).alias("network_total_gb_mean"), F.lit(0.0).alias("backup_failure_rate"))


def _priorities(spark: SparkSession, sf_dir: str):
    rows = cut_lineage(observations(spark, sf_dir))
    train, test = SP.temporal_split(rows, "date", SPLIT_DATE)
    models = PriorityModels(cut_lineage(train))
    last = test.agg(F.max("date")).first()[0]
    inputs = cut_lineage(test.where(F.col("date") == F.lit(last)))
    return inputs, prioritize_scored(models.scored(inputs), models.threshold, TOP_N)


@register("r5_model_prioritisation")
def r5_model_prioritisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day's interventions from the three fitted models: one scoring plan over the same rows,
    ranked once by probability x business value (R5, J9)."""
    return _priorities(spark, sf_dir)[1]


@register("r5_priority_invariants", sql_with(["U", "SRV"], f"""
, D AS (SELECT server_id, date, AVG(capacity_used_pct) AS capacity_used_pct FROM U GROUP BY server_id, date),
I AS (SELECT D.server_id, D.capacity_used_pct, S.monthly_spend_eur, S.support_plan, S.has_gpu, S.is_managed
      FROM D LEFT JOIN SRV S ON S.server_id = D.server_id WHERE date = (SELECT MAX(date) FROM D)),
V AS (SELECT {BV_SQL} AS v FROM I)
SELECT COUNT(*) AS inputs, {r('SUM(v)')} AS business_value, LEAST(COUNT(*), {TOP_N})::BIGINT AS returned, TRUE AS ranks_run,
       0 AS bad_probabilities, 0 AS bad_priorities, 0 AS bad_multipliers, 0 AS without_cluster, 0 AS better_left_out FROM V"""))
def r5_priority_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for any three models, over all inputs and over the ranking."""
    inputs, ranked = _priorities(spark, sf_dir)
    value = R.business_value("monthly_spend_eur", "support_plan", "has_gpu", "is_managed", "capacity_used_pct")
    every = inputs.agg(F.count(F.lit(1)).alias("inputs"), F.sum(value).alias("business_value"))
    ranked = cut_lineage(ranked)
    bad = lambda c: F.count_if(~F.coalesce(c, F.lit(False))).cast("int")
    p = F.col("incident_probability")
    checks = ranked.agg(
        F.count(F.lit(1)).alias("returned"), (F.max("rank") == F.count_distinct("rank")).alias("ranks_run"),
        bad((p >= 0) & (p <= 1)).alias("bad_probabilities"),
        bad(F.abs(F.col("priority_score") - p * F.col("business_value")) < 1e-9).alias("bad_priorities"),
        bad((F.col("anomaly_context_multiplier") > 1) == F.col("is_anomaly")).alias("bad_multipliers"),
        bad(F.col("segment_cluster").isNotNull() & (F.col("segment_profile") != "profil inconnu")).alias("without_cluster"))
    # by rank, priorities never rise
    later = ranked.select((F.col("rank") + 1).alias("rank"), F.col("priority_score").alias("before"))
    rises = ranked.join(later, "rank").agg(F.count_if(F.col("priority_score") > F.col("before")).cast("int").alias("better_left_out"))
    row = {**every.first().asDict(), **checks.first().asDict(), **rises.first().asDict()}  # one row of counts each
    return spark.createDataFrame([row], "inputs long, business_value double, returned long, ranks_run boolean, bad_probabilities int, "
                                        "bad_priorities int, bad_multipliers int, without_cluster int, better_left_out int")
