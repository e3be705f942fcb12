"""Registered explanation, serving-feature and text queries
(R6, R7, R9, B16, B17, B19, B20, B26-B29, S5, J12)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import rules as R
from fleetlens.operators import completion as CP
from fleetlens.operators import rowexplain as RX
from fleetlens.operators import windows as W
from fleetlens.operators.features import mode_per_group
from fleetlens.operators.metrics import regression_metrics
from fleetlens.operators.quantiles import quantile_columns
from fleetlens.plans import analogs as A
from fleetlens.plans.oracle_views import sql_with
from fleetlens.plans.queries_features import SPLIT_DATE
from fleetlens.plans.base import r, register
from fleetlens.sources.tables import Tables

# Fixed values of the driver-table scorer: a linear risk score over usage
# measures (weights, bias) standing in for a fitted model.
WEIGHTS = {"cpu_util_pct": 0.004, "ram_util_pct": 0.003, "temperature_c": 0.002,
           "net_in_gb": -0.001, "net_out_gb": 0.005, "backup_success": -0.2}
BIAS = 0.25
FEATS = list(WEIGHTS)


def _score_sql(sub: dict[str, str] | None = None) -> str:
    sub = sub or {}
    expr = f"{BIAS}::DOUBLE"
    for f, w in WEIGHTS.items():
        expr = f"({expr} + {w}::DOUBLE * CAST({sub.get(f, f)} AS DOUBLE))"
    return expr


LABEL_SQL = """CASE feature WHEN 'cpu_util_pct' THEN 'CPU usage' WHEN 'ram_util_pct' THEN 'RAM usage'
  WHEN 'temperature_c' THEN 'server temperature' WHEN 'net_in_gb' THEN 'incoming network traffic'
  WHEN 'net_out_gb' THEN 'outgoing network traffic' ELSE replace(feature, '_', ' ') END"""


def _explain_sql(ref: dict[str, str], positive_only: bool, method: str, numeric_direction: bool, top_n: int = 5) -> str:
    parts = []
    for f in FEATS:
        sub = {f: ref[f]}
        parts.append(f"SELECT event_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS value, CAST({ref[f]} AS DOUBLE) AS reference, "
                     f"{_score_sql()} - {_score_sql(sub)} AS impact FROM U")
    filt = "WHERE impact > 0" if positive_only else ""
    order = "impact DESC, feature" if positive_only else "ABS(impact) DESC, feature"
    direction = ("CASE WHEN value > reference THEN 'above_normal' WHEN value < reference THEN 'below_normal' ELSE 'near_normal' END"
                 if numeric_direction else
                 "CASE WHEN impact >= 0 THEN 'increases_prediction' ELSE 'decreases_prediction' END")
    return f"""
, IM AS ({' UNION ALL '.join(parts)}),
RK AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY {order}) AS rank FROM IM {filt})
SELECT event_id, rank, feature, {LABEL_SQL} AS label, {r('value')} AS value, {r('reference')} AS reference,
       {r('impact')} AS impact, {r('ABS(impact)')} AS abs_impact, {direction} AS direction, '{method}' AS method
FROM RK WHERE rank <= {top_n}"""


@register("r6_zero_perturbation", sql_with(["U"], _explain_sql({f: "0.0" for f in FEATS}, False,
                                                              "permutation_fallback", False)))
def r6_zero_perturbation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return RX.one_row_each(_zero_explained(A.usage(Tables(spark, sf_dir))), ["event_id"])


def _zero_explained(u: DataFrame) -> DataFrame:
    """Every measure set to 0 in turn, inside the row."""
    factors = [RX.Factor(f, 0.0) for f in FEATS]
    return RX.explained(RX.column_scores(u, factors, RX.linear(WEIGHTS, BIAS)), factors)


def _medians(u: DataFrame) -> dict:
    train = u.filter(F.col("date") < F.to_date(F.lit(SPLIT_DATE)))
    row = quantile_columns(train, [], FEATS, 0.5, "").first()   # one number per feature
    return {f: float(row[f]) for f in FEATS}


MED_SQL = f", MED AS (SELECT {', '.join(f'QUANTILE_CONT(CAST({f} AS DOUBLE), 0.5) AS m_{f}' for f in FEATS)} FROM U WHERE date < DATE '{SPLIT_DATE}')\n"


@register("r7_reference_perturbation", sql_with(["U"], MED_SQL + _explain_sql(
    {f: f"(SELECT m_{f} FROM MED)" for f in FEATS}, True, "reference_perturbation", True)))
def r7_reference_perturbation(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = A.usage(Tables(spark, sf_dir))
    factors = [RX.Factor(f, m) for f, m in _medians(u).items()]
    scored = RX.column_scores(u, factors, RX.linear(WEIGHTS, BIAS))
    return RX.one_row_each(RX.explained(scored, factors, positive_only=True, value_directions=True,
                                        method="reference_perturbation"), ["event_id"])


# Fixed values of the driver-table scorer: weights of the one categorical input.
EVENT_WEIGHTS = {"error": 0.3, "click": 0.04, "purchase": -0.02}


def _mixed_explained(u: DataFrame) -> DataFrame:
    """Numeric measures against their training medians and the event type against its training
    mode, all inside the row; only factors that raise the score (R7 over both kinds)."""
    train = u.where(F.col("date") < F.to_date(F.lit(SPLIT_DATE)))
    usual = mode_per_group(train.withColumn("_all", F.lit(0)), "_all", "event_type").first()["event_type_mode"]
    factors = [*[RX.Factor(f, m) for f, m in _medians(u).items()], RX.Factor("event_type", usual, RX.CATEGORY)]
    scored = RX.column_scores(u, factors, RX.linear({**WEIGHTS, "event_type": EVENT_WEIGHTS}, BIAS))
    return RX.explained(scored, factors, positive_only=True, value_directions=True, method="reference_perturbation")


def _mixed_sql() -> str:
    """EX: the ranked factors of both kinds."""
    def total(sub: dict[str, str]) -> str:
        event = sub.get("event_type", "event_type")
        cases = " ".join(f"WHEN '{k}' THEN {w}::DOUBLE" for k, w in EVENT_WEIGHTS.items())
        return f"({_score_sql(sub)} + (CASE {event} {cases} ELSE 0.0::DOUBLE END))"

    refs = {f: f"(SELECT m_{f} FROM MED)" for f in FEATS}
    usual = "(SELECT event_type FROM USUAL)"
    parts = [f"""SELECT event_id, '{f}' AS feature, CAST({f} AS DOUBLE) AS number, CAST({refs[f]} AS DOUBLE) AS reference_number,
        NULL::VARCHAR AS category, NULL::VARCHAR AS usual, {total({})} - {total({f: refs[f]})} AS impact FROM U""" for f in FEATS]
    parts.append(f"""SELECT event_id, 'event_type', NULL::DOUBLE, NULL::DOUBLE, event_type, {usual},
        {total({})} - {total({"event_type": usual})} FROM U""")
    return MED_SQL + f""", USUAL AS (SELECT event_type FROM U WHERE date < DATE '{SPLIT_DATE}' GROUP BY 1 ORDER BY COUNT(*) DESC, 1 LIMIT 1),
IM AS ({' UNION ALL '.join(parts)}),
EX AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY event_id ORDER BY impact DESC, feature) AS rank FROM IM WHERE impact > 0)
"""


@register("r7_mixed_factors", sql_with(["U"], _mixed_sql() + f"""
SELECT event_id, rank, feature, {LABEL_SQL} AS label, {r('number')} AS number, {r('reference_number')} AS reference_number,
  category, usual, {r('impact')} AS impact,
  CASE WHEN category = usual THEN 'usual_category' WHEN category IS NOT NULL THEN 'unusual_category'
       WHEN number > reference_number THEN 'above_normal' WHEN number < reference_number THEN 'below_normal'
       ELSE 'near_normal' END AS direction
FROM EX WHERE rank <= 5"""))
def r7_mixed_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _mixed_explained(A.usage(Tables(spark, sf_dir)))
    e = top.select("event_id", F.posexplode("top_explanations").alias("_p", "_e"))
    kind = lambda c: F.when(F.col("_e.number").isNull(), F.col(c))
    return e.select("event_id", (F.col("_p") + 1).alias("rank"), "_e.feature", "_e.label", "_e.number", "_e.reference_number",
                    kind("_e.value").alias("category"), kind("_e.reference").alias("usual"), "_e.impact", "_e.direction")


@register("b28_anomaly_sentence", sql_with(["U"], _mixed_sql() + f"""
, LB AS (SELECT event_id, string_agg({LABEL_SQL}, ', ' ORDER BY rank) AS drivers FROM EX WHERE rank <= 3 GROUP BY event_id)
SELECT U.event_id, CASE WHEN drivers IS NULL
  THEN 'No single feature dominates this anomaly score; the alert comes from the combined server profile.'
  ELSE 'This server is flagged mainly because these signals differ from normal behavior: ' || drivers || '.' END AS human_explanation
FROM U LEFT JOIN LB ON U.event_id = LB.event_id"""))
def b28_anomaly_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _mixed_explained(A.usage(Tables(spark, sf_dir)))
    return top.select("event_id", R.anomaly_sentence(RX.labels()).alias("human_explanation"))


@register("b28_incident_sentence", sql_with(["U"], _explain_sql({f: "0.0" for f in FEATS}, False,
                                                               "permutation_fallback", False).replace(
    "\nSELECT event_id, rank,", "\n, EX AS (SELECT event_id, rank,").rstrip() + f"""),
LB AS (SELECT event_id, string_agg(label, ', ' ORDER BY rank) AS drivers FROM EX WHERE rank <= 3 GROUP BY event_id),
PB AS (SELECT event_id, LEAST(GREATEST({_score_sql()}, 0.0), 1.0) AS probability FROM U)
SELECT PB.event_id, {r('PB.probability')} AS probability,
  CASE WHEN LB.drivers IS NULL THEN 'Aucun facteur dominant n''a ete identifie; le risque vient de la combinaison globale des signaux.'
       ELSE printf('Le modele estime un risque incident de %.2f %%. Les facteurs qui expliquent le plus ce score sont: %s.',
                   PB.probability * 100.0, LB.drivers) END AS human_explanation
FROM PB LEFT JOIN LB ON PB.event_id = LB.event_id"""))
def b28_incident_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _zero_explained(A.usage(Tables(spark, sf_dir))).withColumn(
        "probability", F.least(F.greatest(F.col("score"), F.lit(0.0)), F.lit(1.0)))
    return top.select("event_id", "probability", R.incident_sentence(RX.labels(), "probability").alias("human_explanation"))


# --- B29 fingerprint -----------------------------------------------------------------------------
@register("b29_input_fingerprint", sql_with(["E"], """
SELECT event_id, substr(sha256('{"date":"' || CAST(date AS VARCHAR) || '","event_type":"' || event_type
       || '","server_id":' || CAST(server_id AS VARCHAR) || '}'), 1, 12) AS input_hash FROM E"""))
def b29_input_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.observations(Tables(spark, sf_dir))
    return e.select("event_id", R.fingerprint("server_id", "date", "event_type").alias("input_hash"))


# --- B16 point-in-time completion by fallback chains ---------------------------------------------
def complete_features(df: DataFrame, spec: dict[str, tuple]) -> DataFrame:
    """out = first non-null of (candidate columns..., default) per spec entry."""
    cols = {}
    for out, chain in spec.items():
        *cands, default = chain
        cols[out] = F.coalesce(*[F.col(c).cast("double") for c in cands], F.lit(float(default)))
    return df.withColumns(cols)


@register("b16_complete_features", sql_with(["E", "U", "INC"], """
, REF AS (SELECT MAX(date) AS ref FROM E),
IP AS (SELECT server_id, COUNT(*) AS incident_count, AVG(duration_minutes) AS incident_duration_minutes_mean FROM INC GROUP BY server_id)
SELECT U.event_id,
  ROUND(COALESCE(CAST(IP.incident_count AS DOUBLE), CASE WHEN U.event_type = 'error' THEN 1.0 ELSE 0.0 END, 0.0), 6) AS incident_count,
  ROUND(COALESCE(IP.incident_duration_minutes_mean, 0.0), 6) AS incident_duration_minutes_mean,
  ROUND(COALESCE(U.cpu_util_pct, 0.0), 6) AS cpu_util_pct,
  ROUND(COALESCE(U.backup_success::DOUBLE, 1.0), 6) AS backup_success,
  GREATEST(COALESCE(IP.incident_count, 1), 1) AS observation_count
FROM U LEFT JOIN IP ON U.server_id = IP.server_id"""))
def b16_complete_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    u = A.usage(t)
    ip = A.incidents(t).groupBy("server_id").agg(F.count(F.lit(1)).alias("agg_incident_count"),
                                                 F.avg("duration_minutes").alias("agg_duration_mean"))
    j = u.join(ip, "server_id", "left").withColumn(
        "point_incident", R.flag(F.col("event_type") == "error").cast("double"))
    out = complete_features(j, {
        "incident_count": ("agg_incident_count", "point_incident", 0.0),
        "incident_duration_minutes_mean": ("agg_duration_mean", 0.0),
        "cpu_util_pct": ("cpu_util_pct", 0.0),
        "backup_success": ("backup_success", 1.0),
    })
    return out.select("event_id", "incident_count", "incident_duration_minutes_mean", "cpu_util_pct",
                      "backup_success",
                      F.greatest(F.coalesce(F.col("agg_incident_count"), F.lit(1)), F.lit(1)).alias("observation_count"))


# --- B16 the whole server profile, with nulls in every position ------------------------------------
def _partial_inputs() -> dict[str, str]:
    """Each input column of the profile from an event, null for every seventh to eleventh of them."""
    out = {}
    for i, name in enumerate(CP.server_profile_spec()):
        if i % 4 == 3 and name != "observation_count":
            continue  # a column that the caller never gives
        given = f"(k + {i}) % 12" if name == "observation_count" else f"(value * {i + 1}.0) % 90.0"
        out[name] = f"CASE WHEN event_id % {7 + i % 5} = {i % 7} THEN NULL ELSE {given} END"
    return out


def _completed_sql() -> str:
    ctes, known = [], {}
    raw = ", ".join(f"CAST({e} AS {'INTEGER' if n == 'observation_count' else 'DOUBLE'}) AS {n}" for n, e in _partial_inputs().items())
    ctes.append(f"L0 AS (SELECT event_id, {raw} FROM E)")
    given = set(_partial_inputs())
    spec = dict(CP.server_profile_spec())
    for i, level in enumerate(CP.dependency_levels(spec), start=1):
        cols = []
        for n in level:
            if n == "observation_count":
                cols.append("CAST(GREATEST(COALESCE(observation_count, 1), 1) AS DOUBLE) AS observation_count")
            else:
                cols.append(f"CAST(COALESCE({n + ', ' if n in given else ''}{spec[n]}) AS DOUBLE) AS {n}")
        rest = [n for n in {**{g: 0 for g in given}, **known} if n not in level]
        ctes.append(f"L{i} AS (SELECT event_id, {', '.join([*cols, *rest])} FROM L{i - 1})")
        known.update({n: 0 for n in level})
    return ",\n".join(["", *ctes]) + "\nSELECT event_id, " + ", ".join(f"{r(n)} AS {n}" for n in spec) + f" FROM L{i}"


@register("b16_server_profile", sql_with(["E"], _completed_sql()))
def b16_server_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every column of the profile from partial inputs, computed fallbacks in dependency order."""
    e = A.observations(Tables(spark, sf_dir))
    given = e.select("event_id", *[F.expr(x).cast("int" if n == "observation_count" else "double").alias(n)
                                   for n, x in _partial_inputs().items()])
    return CP.complete_server_profile(given).select("event_id", *CP.server_profile_spec())


# --- B17 all five measures, B15 with the caller's calendar ------------------------------------------
def _forecast_sql() -> str:
    cols = []
    for m in CP.FORECAST_MEASURES:
        x = f"CAST({m} AS DOUBLE)"
        past = {"lag1": f"LAG({x}, 1) OVER w", "lag7": f"LAG({x}, 7) OVER w", "diff1": f"{x} - LAG({x}, 1) OVER w",
                "rolling_mean_3": f"AVG({x}) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)",
                "rolling_mean_7": f"AVG({x}) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)",
                "rolling_std_7": f"STDDEV_SAMP({x}) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)",
                "rolling_max_7": f"MAX({x}) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"}
        cols += [f"{r(f'COALESCE({e}, ' + ('0.0' if a in ('diff1', 'rolling_std_7') else x) + ')')} AS {m}_{a}" for a, e in past.items()]
    return f"""
SELECT region, CAST(date AS VARCHAR) AS date, {', '.join(cols)},
  {r('(capacity_used_pct + network_latency_ms + avg_rack_temperature_c) / 3')} AS infra_pressure,
  {r('scheduled_maintenance * network_latency_ms')} AS maintenance_latency_interaction,
  {r('capacity_used_pct * power_usage_mw')} AS capacity_power_interaction,
  CASE WHEN day(date) % 3 = 0 THEN 9 ELSE CAST(isodow(date) - 1 AS INTEGER) END AS day_of_week,
  CAST(day(date) AS INTEGER) AS day_of_month, CAST(date_diff('day', DATE '2024-01-01', date) AS INTEGER) AS days_since_start
FROM GP WINDOW w AS (PARTITION BY region ORDER BY date)"""


@register("b17_forecast_completion", sql_with(["GP"], _forecast_sql()))
def b17_forecast_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All five measures' history with the point-in-time fallback, the interactions, and calendar
    columns of which the caller gave some (every third day a value of its own)."""
    gp = A.group_day(Tables(spark, sf_dir)).withColumn("support_tickets", F.col("support_tickets").cast("double"))
    h = W.history_features(gp, "region", ["date"], list(CP.FORECAST_MEASURES), lags=(1, 7), mean_windows=(3, 7), std_window=7, max_window=7)
    h = h.withColumn("day_of_week", F.when(F.day("date") % 3 == 0, F.lit(9)))
    out = CP.complete(CP.complete(h, CP.forecast_spec()), CP.calendar_spec("date", "2024-01-01"), "int")
    names = [*CP.forecast_spec(), *CP.calendar_spec("date", "2024-01-01")]
    return out.select("region", "date", *names)


# --- B17 forecast features with point-in-time fallback -------------------------------------------
@register("b17_forecast_fallback", sql_with(["GP"], f"""
, H AS (SELECT region, date, CAST(support_tickets AS DOUBLE) AS v,
  LAG(CAST(support_tickets AS DOUBLE), 1) OVER w AS lag1, LAG(CAST(support_tickets AS DOUBLE), 7) OVER w AS lag7,
  AVG(CAST(support_tickets AS DOUBLE)) OVER (w ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS m3,
  STDDEV_SAMP(CAST(support_tickets AS DOUBLE)) OVER (w ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS s7
  FROM GP WINDOW w AS (PARTITION BY region ORDER BY date))
SELECT region, CAST(date AS VARCHAR) AS date, {r('COALESCE(lag1, v)')} AS support_tickets_lag1,
  {r('COALESCE(lag7, v)')} AS support_tickets_lag7, {r('COALESCE(v - lag1, 0.0)')} AS support_tickets_diff1,
  {r('COALESCE(m3, v)')} AS support_tickets_rolling_mean_3, {r('COALESCE(s7, 0.0)')} AS support_tickets_rolling_std_7
FROM H"""))
def b17_forecast_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    gp = A.group_day(Tables(spark, sf_dir)).withColumn("support_tickets", F.col("support_tickets").cast("double"))
    h = W.history_features(gp, "region", ["date"], ["support_tickets"], lags=(1, 7), mean_windows=(3,),
                           std_window=7, max_window=None)
    v = F.col("support_tickets")
    return h.select("region", "date",
                    F.coalesce("support_tickets_lag1", v).alias("support_tickets_lag1"),
                    F.coalesce("support_tickets_lag7", v).alias("support_tickets_lag7"),
                    F.coalesce("support_tickets_diff1", F.lit(0.0)).alias("support_tickets_diff1"),
                    F.coalesce("support_tickets_rolling_mean_3", v).alias("support_tickets_rolling_mean_3"),
                    F.coalesce("support_tickets_rolling_std_7", F.lit(0.0)).alias("support_tickets_rolling_std_7"))


# --- B19/B20 forecast post-processing ------------------------------------------------------------
@register("b19_b20_forecast_range", sql_with(["GP"], f"""
, H AS (SELECT region, date, CAST(support_tickets AS DOUBLE) AS v,
   AVG(CAST(support_tickets AS DOUBLE)) OVER (PARTITION BY region ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) - 10.0 AS p
   FROM GP),
HH AS (SELECT * FROM H WHERE p IS NOT NULL),
MA AS (SELECT AVG(ABS(GREATEST(p, 0.0) - v)) AS mae FROM HH)
SELECT region, CAST(date AS VARCHAR) AS date, {r('GREATEST(p, 0.0)')} AS prediction,
  CAST(round_even(GREATEST(p, 0.0), 0) AS INTEGER) AS rounded_prediction,
  {r('GREATEST(GREATEST(p, 0.0) - mae, 0.0)')} AS expected_range_low, {r('GREATEST(p, 0.0) + mae')} AS expected_range_high
FROM HH, MA"""))
def b19_b20_forecast_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    gp = A.group_day(Tables(spark, sf_dir)).withColumn("support_tickets", F.col("support_tickets").cast("double"))
    h = W.history_features(gp, "region", ["date"], ["support_tickets"], lags=(), mean_windows=(3,),
                           std_window=None, max_window=None, diff=False)
    h = h.withColumn("p", F.col("support_tickets_rolling_mean_3") - F.lit(10.0)).filter(F.col("p").isNotNull())
    clipped, rounded = R.clip_round("p")
    h = h.withColumn("prediction", clipped)
    mae = regression_metrics(h, "support_tickets", "prediction").first()["mae"]
    lo, hi = R.prediction_interval("prediction", mae)
    return h.select("region", "date", "prediction", rounded.alias("rounded_prediction"),
                    lo.alias("expected_range_low"), hi.alias("expected_range_high"))


# --- R9 segment explanation sentence -------------------------------------------------------------
def _r9_sql() -> str:
    from fleetlens.plans.queries_cluster import _names_sql
    head = _names_sql().rsplit("\nSELECT PF.cluster", 1)[0]
    return head + f"""
, NM AS (SELECT PF.cluster, PF.server_count / (SELECT SUM(server_count) FROM PF)::DOUBLE AS confidence,
         COALESCE(BE.label, 'serveurs standard') AS profile_name,
         CASE WHEN BE.label IS NULL THEN 'aucun ecart dominant'
              ELSE printf('%s (+%.2f vs moyenne clusters)', BE.col, BE.gap) END AS profile_driver
         FROM PF LEFT JOIN (SELECT * FROM BE WHERE rn = 1) BE ON PF.cluster = BE.cluster)
SELECT cluster, profile_name, profile_driver, {r('confidence')} AS confidence,
       printf('Ce serveur est classe dans le profil ''%s'' avec une probabilite de cluster de %.1f %%. Raison principale: %s.',
              profile_name, confidence * 100.0, profile_driver) AS human_explanation
FROM NM"""


def _register_r9():
    register("r9_segment_explanation", sql_with(["U", "INC", "SRV"], _r9_sql()))(r9_segment_explanation)


def r9_segment_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile, driver and membership share per segment as the response sentence."""
    from fleetlens.operators import clustering as CL
    from fleetlens.plans.queries_cluster import segment_clusters
    sc = segment_clusters(spark, sf_dir)
    prof = CL.cluster_profile(sc)
    names = CL.name_profiles(prof)
    total = prof.agg(F.sum("server_count")).scalar()
    j = prof.select("cluster", (F.col("server_count") / total).alias("confidence")).join(names, "cluster")
    return j.select("cluster", "profile_name", "profile_driver", "confidence",
                    R.segment_sentence("profile_name", "profile_driver", "confidence").alias("human_explanation"))
