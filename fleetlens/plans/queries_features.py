"""Registered feature-core queries: sources, derived columns, aggregations,
windows and joins (A1, A5, A6, B2-B15, G1-G12, E1-E6, J1-J7)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.functions import rules as R
from fleetlens.operators import features as FT
from fleetlens.operators import joins as J
from fleetlens.operators import windows as W
from fleetlens.operators.splits import temporal_split
from fleetlens.plans import analogs as A
from fleetlens.plans.oracle_views import sql_with
from fleetlens.plans.base import r, register
from fleetlens.session import checkpoint_dir
from fleetlens.sources import io as IO
from fleetlens.sources.requests import parse_requests
from fleetlens.sources.tables import Tables

SPLIT_DATE = "2024-01-21"  # temporal cut used on the driver tables (reference: 2026-03-01)


# --- A1 scan with typed, strict columns --------------------------------------
@register("a1_scan_events", sql_with(["E"], """
SELECT event_id, server_id, CAST(date AS VARCHAR) AS date, event_type, ROUND(value, 6) AS value, k FROM E"""))
def a1_scan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.observations(Tables(spark, sf_dir)).drop("ts")


# --- A5 dataset profile ---------------------------------------------------------
@register("a5_dataset_profile", sql_with(["E"], f"""
, X AS (SELECT server_id, date, event_type, value, k, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS is_error FROM E)
SELECT COUNT(*) AS rows, 6 AS cols,
       CAST(SUM((server_id IS NULL)::INT + (date IS NULL)::INT + (event_type IS NULL)::INT
              + (value IS NULL)::INT + (k IS NULL)::INT + (is_error IS NULL)::INT) AS BIGINT) AS missing_values,
       CAST(MIN(date) AS VARCHAR) AS min_date, CAST(MAX(date) AS VARCHAR) AS max_date,
       COUNT(DISTINCT server_id) AS distinct_entities, {r('AVG(is_error)')} AS label_rate,
       COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM X)) AS duplicate_rows
FROM X"""))
def a5_dataset_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.observations(Tables(spark, sf_dir)).select(
        "server_id", "date", "event_type", "value", "k",
        R.flag(F.col("event_type") == "error").alias("is_error"))
    return FT.dataset_profile(e, "date", "server_id", "is_error")


# --- A6 request parsing ------------------------------------------------------------
@register("a6_parse_requests", sql_with([], """
SELECT event_id,
       COALESCE(TRY_CAST(json_extract_string(props, '$.k') AS INTEGER), -1) AS k,
       COALESCE(TRY_CAST(json_extract_string(props, '$.top_n') AS INTEGER), 50) AS top_n,
       CASE WHEN TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) IS NULL THEN 0 ELSE 1 END AS valid
FROM events"""))
def a6_parse_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = Tables(spark, sf_dir).events
    out = parse_requests(ev, "props", {"k": "int", "top_n": "int"},
                         defaults={"k": -1, "top_n": 50}, required=["k"], keep=["event_id"])
    return out.select("event_id", "k", "top_n", F.col("_valid").cast("int").alias("valid"))


# --- B2 temporal split (+ G16 rates per side) ------------------------------------
@register("b2_temporal_split", sql_with(["E"], f"""
SELECT CASE WHEN date < DATE '{SPLIT_DATE}' THEN 'train' ELSE 'test' END AS part, COUNT(*) AS rows,
       {r("AVG(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END)")} AS positive_rate
FROM E GROUP BY 1"""))
def b2_temporal_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.observations(Tables(spark, sf_dir)).withColumn(
        "y", R.flag(F.col("event_type") == "error"))
    train, test = temporal_split(e, "date", SPLIT_DATE)
    from fleetlens.operators.metrics import positive_rates
    return positive_rates({"train": train, "test": test}, "y")


# --- B5/B9/B15 observation features -------------------------------------------------
@register("b9_b15_observation_features", sql_with(["U"], f"""
SELECT event_id, server_id,
  {r('cpu_util_pct * ram_util_pct / 100.0::DOUBLE')} AS cpu_ram_pressure,
  {r('temperature_c * cpu_util_pct / 100.0::DOUBLE')} AS thermal_pressure,
  {r('net_in_gb + net_out_gb')} AS network_total_gb,
  {r('net_in_gb - net_out_gb')} AS network_balance_gb,
  {r('(cpu_util_pct + ram_util_pct + disk_util_pct + capacity_used_pct) / 4.0::DOUBLE')} AS utilization_pressure,
  CASE WHEN cpu_util_pct >= 85 THEN 1 ELSE 0 END AS high_cpu,
  CASE WHEN temperature_c >= 70 THEN 1 ELSE 0 END AS high_temperature,
  1 - backup_success AS backup_failure,
  CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(day(date) AS INTEGER) AS day_of_month,
  CAST(date_diff('day', DATE '2024-01-01', date) AS INTEGER) AS days_since_start
FROM U"""))
def b9_b15_observation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = A.usage(Tables(spark, sf_dir))
    cols = R.obs_pressure("cpu_util_pct", "ram_util_pct", "disk_util_pct", "temperature_c",
                          "net_in_gb", "net_out_gb", "capacity_used_pct")
    cols.update({
        "high_cpu": R.at_least("cpu_util_pct", 85.0),
        "high_temperature": R.at_least("temperature_c", 70.0),
        "backup_failure": F.lit(1) - F.col("backup_success"),
    })
    cols.update(R.calendar("date", "2024-01-01"))
    return u.select("event_id", "server_id", *[v.alias(k) for k, v in cols.items()])


# --- A1 strict CSV scan, A2 sink -------------------------------------------------------------------
@register("a1_a2_csv_scan", sql_with(["E"], """
SELECT event_id, server_id, CAST(date AS VARCHAR) AS date, event_type, ROUND(value, 6) AS value, k FROM E"""))
def a1_a2_csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations written as CSV files partitioned by type, then read back with an explicit schema
    in which a malformed row ends the job."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/fleetlens-csv-{uuid.uuid4().hex}"
    e = A.observations(Tables(spark, sf_dir)).select("event_id", "server_id", "date", "event_type", "value", "k")
    IO.write_table(e, path, "csv", partition_by=["event_type"])
    return IO.read_table(spark, path, "event_id long, server_id long, date date, value double, k int, event_type string", "csv")


# --- B25 business value ------------------------------------------------------------
def _bv_sql():
    from fleetlens.plans.queries_core import BV_SQL
    return BV_SQL


@register("b25_business_value", sql_with(["SRV"], f"""
SELECT server_id, support_plan, {r(_bv_sql())} AS business_value FROM SRV"""))
def b25_business_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.servers(Tables(spark, sf_dir))
    return s.select("server_id", "support_plan",
                    R.business_value("monthly_spend_eur", "support_plan", "has_gpu", "is_managed",
                                     "capacity_used_pct").alias("business_value"))


# --- G1-G4 usage profile -------------------------------------------------------------
MEAS = FT.USAGE_MEASURES


def _usage_profile_sql(rounded: bool = True) -> str:
    rr = r if rounded else (lambda e: e)
    base = """
, UP AS (SELECT *, (cpu_util_pct + ram_util_pct + disk_util_pct) / 3.0::DOUBLE AS utilization_pressure,
            temperature_c * cpu_util_pct / 100.0::DOUBLE AS thermal_cpu_pressure,
            net_in_gb + net_out_gb AS network_total_gb FROM U),
RK AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY server_id ORDER BY date DESC, event_id DESC) AS rn FROM UP),
G AS (SELECT server_id,
"""
    aggs = []
    for m, fns in [("cpu_util_pct", "mean max std"), ("ram_util_pct", "mean max std"),
                   ("disk_util_pct", "mean max std"), ("net_in_gb", "mean sum"), ("net_out_gb", "mean sum"),
                   ("temperature_c", "mean max std"), ("backup_success", "mean min"),
                   ("utilization_pressure", "mean"), ("thermal_cpu_pressure", "mean max"),
                   ("network_total_gb", "mean sum")]:
        for fn in fns.split():
            sql_fn = {"mean": "AVG", "max": "MAX", "std": "STDDEV_SAMP", "sum": "SUM", "min": "MIN"}[fn]
            expr = f"{sql_fn}({m})"
            if m == "backup_success" and fn == "min":
                aggs.append(f"  {expr} AS {m}_{fn}")
            else:
                aggs.append(f"  {rr(expr)} AS {m}_{fn}")
    aggs.append("  COUNT(*) AS observation_count")
    aggs += [f"  {rr(f'QUANTILE_CONT({m}, 0.9)')} AS {m}_p90" for m in MEAS]
    aggs += [f"  {rr(f'AVG(CASE WHEN rn <= 7 THEN {m} END)')} AS {m}_recent7_mean" for m in MEAS]
    aggs += [
        f"  {rr('AVG(CASE WHEN cpu_util_pct >= 85 THEN 1.0 ELSE 0.0 END)')} AS high_cpu_day_rate",
        f"  {rr('AVG(CASE WHEN ram_util_pct >= 85 THEN 1.0 ELSE 0.0 END)')} AS high_ram_day_rate",
        f"  {rr('AVG(CASE WHEN temperature_c >= 70 THEN 1.0 ELSE 0.0 END)')} AS high_temperature_day_rate",
        f"  {rr('AVG(1.0 - backup_success)')} AS backup_failure_rate",
    ]
    # unrounded shifts for the feature table
    for name, m in (("usage", "cpu_util_pct"), ("temp", "temperature_c"), ("net", "network_total_gb")):
        aggs.append(f"  AVG(CASE WHEN rn <= 7 THEN {m} END) - AVG({m}) AS _s_{name}")
    return base + ",\n".join(aggs) + "\nFROM RK GROUP BY server_id)\n"


ORACLE_G1_G4 = sql_with(["U"], _usage_profile_sql() + "SELECT * EXCLUDE (_s_usage, _s_temp, _s_net) FROM G")


@register("g1_g4_usage_profile", ORACLE_G1_G4)
def g1_g4_usage_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FT.usage_profile(A.usage(Tables(spark, sf_dir)))


@register("g2_usage_profile_ranked", ORACLE_G1_G4)
def g2_usage_profile_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G1-G4 with every entity above the quantile size limit (10 rows), so the
    p90s take the rank path (distinct values, bucketed ranges, running counts)
    on the driver tables; same oracle as the aggregate path."""
    return FT.usage_profile(A.usage(Tables(spark, sf_dir)), quantile_bucket_rows=10)


# --- G5/G6 incident profile ------------------------------------------------------------
INC_PROFILE_TMPL = """
, REF AS (SELECT MAX(date) AS ref FROM E),
IP AS (SELECT server_id, COUNT(*) AS incident_count, COUNT(DISTINCT date) AS incident_day_count,
  ROUND(AVG(duration_minutes), 6) AS incident_duration_minutes_mean,
  ROUND(MAX(duration_minutes), 6) AS incident_duration_minutes_max,
  ROUND(SUM(duration_minutes), 6) AS incident_duration_minutes_sum,
  ROUND(AVG(customer_visible), 6) AS customer_visible_rate,
  ROUND(AVG(sla_breach), 6) AS sla_breach_rate,
  ROUND(AVG(root_cause_known), 6) AS root_cause_known_rate,
  CAST(SUM(CASE WHEN severity = 'critical' THEN 1 ELSE 0 END) AS BIGINT) AS critical_incident_count,
  ROUND(AVG(CASE WHEN severity IN ('high', 'critical') THEN 1 ELSE 0 END), 6) AS high_severity_incident_rate,
  CAST(SUM(CASE WHEN component = 'disk' THEN 1 ELSE 0 END) AS BIGINT) AS disk_incident_count,
  CAST(SUM(CASE WHEN component = 'network' THEN 1 ELSE 0 END) AS BIGINT) AS network_incident_count,
  CAST(SUM(CASE WHEN component = 'hypervisor' THEN 1 ELSE 0 END) AS BIGINT) AS hypervisor_incident_count,
  CAST(SUM(CASE WHEN date >= (SELECT ref FROM REF) - INTERVAL 29 DAY THEN 1 ELSE 0 END) AS BIGINT) AS recent30_incident_count,
  CAST(SUM(CASE WHEN date >= (SELECT ref FROM REF) - INTERVAL 29 DAY AND severity IN ('high', 'critical') THEN 1 ELSE 0 END) AS BIGINT) AS recent30_high_severity_count,
  CAST(date_diff('day', MAX(date), (SELECT ref FROM REF)) AS INTEGER) AS days_since_last_incident
FROM INC GROUP BY server_id)
"""
INC_PROFILE_SQL = INC_PROFILE_TMPL
INC_PROFILE_RAW = INC_PROFILE_TMPL.replace("ROUND(", "(").replace(", 6) AS", ") AS")


@register("g5_g6_incident_profile", sql_with(["E", "INC"], INC_PROFILE_SQL + "SELECT * FROM IP"))
def g5_g6_incident_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    ref = str(A.observations(t).agg(F.max("date")).first()[0])
    return FT.incident_profile(A.incidents(t), ref)


# --- J2/J3 + B8/B13/B14: the server feature table ----------------------------------------
def _server_features_sql(rounded: bool = True) -> str:
    rr = r if rounded else (lambda e: e)
    fill = ", ".join(
        f"COALESCE(IP.{k}, {v}) AS {k}" if not isinstance(v, float) else f"COALESCE(IP.{k}, 0.0) AS {k}"
        for k, v in FT.INCIDENT_DEFAULTS.items())
    return (_usage_profile_sql(rounded) + (INC_PROFILE_SQL if rounded else INC_PROFILE_RAW) + f"""
, FTB AS (SELECT S.server_id, S.region, S.country, S.segment, S.support_plan,
       {rr('S.monthly_spend_eur')} AS monthly_spend_eur, S.has_gpu, S.is_managed,
       {rr('S.capacity_used_pct')} AS capacity_used_pct, G.* EXCLUDE (server_id), {fill}
  FROM SRV S LEFT JOIN G ON S.server_id = G.server_id LEFT JOIN IP ON S.server_id = IP.server_id)
SELECT * EXCLUDE (_s_usage, _s_temp, _s_net),
  {rr('CASE WHEN COALESCE(observation_count, 0) > 0 THEN incident_count / CAST(COALESCE(observation_count, 0) AS DOUBLE) ELSE 0.0 END')} AS incident_rate,
  {rr('CASE WHEN LEAST(COALESCE(observation_count, 0), 30) > 0 THEN recent30_incident_count / CAST(LEAST(COALESCE(observation_count, 0), 30) AS DOUBLE) ELSE 0.0 END')} AS recent30_incident_rate,
  {rr('_s_usage')} AS recent_usage_shift,
  {rr('_s_temp')} AS recent_temperature_shift,
  {rr('_s_net')} AS recent_network_shift
FROM FTB""")


def server_features_cte(rounded: bool = False) -> str:
    """The feature-table SQL as a CTE named FT (for queries built on it)."""
    body = _server_features_sql(rounded)
    head, tail = body.rsplit("\nSELECT * EXCLUDE", 1)
    return head + "\n, FT AS (SELECT * EXCLUDE" + tail + ")\n"


@register("j2_j3_server_feature_table", sql_with(["U", "INC", "SRV"], _server_features_sql()))
def j2_j3_server_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    return FT.server_feature_table(A.servers(t), A.usage(t), A.incidents(t))


# --- G7 region-day rollup ----------------------------------------------------------------
@register("g7_region_day_rollup", sql_with(["RDL"], f"""
SELECT region, CAST(date AS VARCHAR) AS date,
  {r('AVG(l_discount)')} AS l_discount_mean, {r('AVG(l_tax)')} AS l_tax_mean,
  {r('AVG(l_quantity)')} AS l_quantity_mean, {r('MAX(l_quantity)')} AS l_quantity_max,
  {r('AVG(l_extendedprice)')} AS l_extendedprice_mean, {r('MAX(l_extendedprice)')} AS l_extendedprice_max,
  COUNT(DISTINCT server_id) AS active_servers
FROM RDL GROUP BY region, date"""))
def g7_region_day_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = A.region_day_lines(Tables(spark, sf_dir))
    return FT.region_day_rollup(lines, ("region", "date"), ["l_discount", "l_tax"],
                                ["l_quantity", "l_extendedprice"])


# --- G8 experiment profile ----------------------------------------------------------------
@register("g8_alt_profile", sql_with(["U"], f"""
SELECT server_id,
  {r('AVG(cpu_util_pct)')} AS cpu_util_pct_mean, {r('MAX(cpu_util_pct)')} AS cpu_util_pct_max,
  {r('STDDEV_SAMP(cpu_util_pct)')} AS cpu_util_pct_std, {r('SUM(cpu_util_pct)')} AS cpu_util_pct_sum,
  {r('MIN(cpu_util_pct)')} AS cpu_util_pct_min,
  {r('AVG(net_in_gb)')} AS net_in_gb_mean, {r('MAX(net_in_gb)')} AS net_in_gb_max,
  {r('STDDEV_SAMP(net_in_gb)')} AS net_in_gb_std, {r('SUM(net_in_gb)')} AS net_in_gb_sum,
  {r('MIN(net_in_gb)')} AS net_in_gb_min,
  ARG_MIN(event_type, (date, event_id)) AS event_type_first,
  COUNT(*) AS row_count
FROM U GROUP BY server_id"""))
def g8_alt_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = A.usage(Tables(spark, sf_dir))
    return FT.alt_profile(u, "server_id", ["cpu_util_pct", "net_in_gb"], ["event_type"])


# --- G8 + J10 + B10: the whole experiment profile -------------------------------------------------
EXPERIMENT_FIRSTS = ("has_gpu", "is_managed", "monthly_spend_eur")
EXPERIMENT_CATEGORIES = ("region", "country", "segment", "support_plan", "event_type")


def _experiment_sql() -> str:
    agg = {"mean": "AVG", "max": "MAX", "min": "MIN", "std": "STDDEV_SAMP", "sum": "SUM"}
    cols = [f"COALESCE({agg[a]}(CAST({m} AS DOUBLE)), 0) AS {m}_{a}" for m, names in FT.EXPERIMENT_AGGREGATES.items() for a in names]
    firsts = [f"COALESCE(ARG_MIN({c}, (date, event_id)), 0) AS {c}_first" for c in EXPERIMENT_FIRSTS]
    modes = [f"""(SELECT server_id, {c} FROM (SELECT server_id, {c}, ROW_NUMBER() OVER (PARTITION BY server_id ORDER BY COUNT(*) DESC, {c}) AS rn
                  FROM FA WHERE {c} IS NOT NULL GROUP BY server_id, {c}) WHERE rn = 1) AS M_{c}""" for c in EXPERIMENT_CATEGORIES]
    joins = " ".join(f"LEFT JOIN {m} ON M_{c}.server_id = N.server_id" for c, m in zip(EXPERIMENT_CATEGORIES, modes))
    names = [f"{m}_{a}" for m, group in FT.EXPERIMENT_AGGREGATES.items() for a in group]
    return f"""
, FA AS (SELECT U.* EXCLUDE (capacity_used_pct), GP.scheduled_maintenance, GP.avg_rack_temperature_c, GP.power_usage_mw,
                GP.network_latency_ms, GP.capacity_used_pct, S.region, S.country, S.segment, S.support_plan, S.has_gpu, S.is_managed, S.monthly_spend_eur
         FROM U LEFT JOIN GP ON U.event_type = GP.region AND U.date = GP.date LEFT JOIN SRV S ON U.server_id = S.server_id),
N AS (SELECT server_id, {', '.join([*cols, *firsts])}, COUNT(date) AS observation_count FROM FA GROUP BY server_id)
SELECT N.server_id, {', '.join(f'{r(n)} AS {n}' for n in names)}, {', '.join(f'{c}_first' for c in EXPERIMENT_FIRSTS)}, observation_count,
  {', '.join(f'M_{c}.{c}' for c in EXPERIMENT_CATEGORIES)},
  {r('(cpu_util_pct_mean + ram_util_pct_mean + disk_util_pct_mean + capacity_used_pct_mean) / 4')} AS utilization_pressure_mean,
  {r('net_in_gb_sum + net_out_gb_sum')} AS network_total_gb_sum, {r('temperature_c_mean * cpu_util_pct_mean / 100')} AS thermal_cpu_pressure,
  {r('1 - backup_success_mean')} AS backup_failure_rate
FROM N {joins}"""


@register("g8_j10_experiment_profile", sql_with(["U", "GP", "SRV"], _experiment_sql()))
def g8_j10_experiment_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Usage days with the metrics of their group and the attributes of their server, as the
    experiment's server table."""
    t = Tables(spark, sf_dir)
    gp = A.group_day(t).select(F.col("region").alias("event_type"), "date", "scheduled_maintenance", "avg_rack_temperature_c",
                               "power_usage_mw", "network_latency_ms", "capacity_used_pct")
    srv = A.servers(t).drop("customer_id", "capacity_used_pct")
    fact = A.usage(t).drop("capacity_used_pct").join(gp, ["event_type", "date"], "left").join(srv, "server_id", "left")
    return FT.experiment_profile(fact, "server_id", EXPERIMENT_FIRSTS, EXPERIMENT_CATEGORIES)


# --- G9 mode per group ----------------------------------------------------------------------
@register("g9_mode_per_group", sql_with(["E"], """
, C AS (SELECT server_id, event_type, COUNT(*) AS n FROM E GROUP BY server_id, event_type),
R AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY server_id ORDER BY n DESC, event_type) AS rn FROM C)
SELECT server_id, event_type AS event_type_mode FROM R WHERE rn = 1"""))
def g9_mode_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FT.mode_per_group(A.observations(Tables(spark, sf_dir)), "server_id", "event_type")


# --- G12 reference values ---------------------------------------------------------------------
@register("g12_reference_values", sql_with(["U"], f"""
SELECT 'cpu_util_pct' AS feature, 'numeric' AS kind, {r('QUANTILE_CONT(cpu_util_pct, 0.5)')} AS median,
       {r('AVG(cpu_util_pct)')} AS mean, {r('STDDEV_POP(cpu_util_pct)')} AS std, NULL::VARCHAR AS mode FROM U
UNION ALL
SELECT 'temperature_c', 'numeric', {r('QUANTILE_CONT(temperature_c, 0.5)')}, {r('AVG(temperature_c)')},
       {r('STDDEV_POP(temperature_c)')}, NULL FROM U
UNION ALL
SELECT 'event_type', 'categorical', NULL, NULL, NULL,
       (SELECT event_type FROM (SELECT event_type, COUNT(*) AS n FROM U GROUP BY 1) ORDER BY n DESC, event_type LIMIT 1)"""))
def g12_reference_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = A.usage(Tables(spark, sf_dir))
    return FT.reference_values(u, ["cpu_util_pct", "temperature_c"], ["event_type"])


# --- E1-E5 history features, B12 interactions -----------------------------------------------
HIST = ("support_tickets", "network_latency_ms", "capacity_used_pct")


def _history_sql(cols) -> str:
    w = "OVER (PARTITION BY region ORDER BY date"
    parts = []
    for c in cols:
        parts += [
            f"{r(f'LAG({c}, 1) {w})')} AS {c}_lag1",
            f"{r(f'LAG({c}, 7) {w})')} AS {c}_lag7",
            f"{r(f'{c} - LAG({c}, 1) {w})')} AS {c}_diff1",
            f"{r(f'AVG({c}) {w} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)')} AS {c}_rolling_mean_3",
            f"{r(f'AVG({c}) {w} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)')} AS {c}_rolling_mean_7",
            f"{r(f'STDDEV_SAMP({c}) {w} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)')} AS {c}_rolling_std_7",
            f"{r(f'MAX({c}) {w} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)')} AS {c}_rolling_max_7",
        ]
    return ",\n  ".join(parts)


def _dbl(c):
    return f"CAST({c} AS DOUBLE)"


ORACLE_E1_E5 = sql_with(["GP"], f"""
, GPD AS (SELECT region, date, CAST(support_tickets AS DOUBLE) AS support_tickets, network_latency_ms,
                 capacity_used_pct, power_usage_mw, avg_rack_temperature_c, scheduled_maintenance FROM GP)
SELECT region, CAST(date AS VARCHAR) AS date,
  {_history_sql(HIST)},
  {r('(capacity_used_pct + network_latency_ms + avg_rack_temperature_c) / 3.0::DOUBLE')} AS infra_pressure,
  {r('scheduled_maintenance * network_latency_ms')} AS maintenance_latency_interaction,
  {r('capacity_used_pct * power_usage_mw')} AS capacity_power_interaction
FROM GPD""")


@register("e1_e5_history_features", ORACLE_E1_E5)
def e1_e5_history_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    gp = A.group_day(Tables(spark, sf_dir)).withColumn("support_tickets", F.col("support_tickets").cast("double"))
    h = W.history_features(gp, "region", ["date"], HIST)
    h = h.withColumns(R.region_interactions("capacity_used_pct", "network_latency_ms",
                                            "avg_rack_temperature_c", "scheduled_maintenance",
                                            "power_usage_mw"))
    keep = ["region", "date"] + [c for c in h.columns if any(c.startswith(x + "_") for x in HIST)] + [
        "infra_pressure", "maintenance_latency_interaction", "capacity_power_interaction"]
    return h.select(*keep)


def _e1_e5_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1-E5 with every panel group treated as hot (share 10 %, no size
    floor): the chunk + halo path on the driver tables, checked against the
    same oracle as the plain window."""
    gp = A.group_day(Tables(spark, sf_dir)).withColumn("support_tickets", F.col("support_tickets").cast("double"))
    h = W.history_features(gp, "region", ["date"], HIST, hot_share=0.1, min_hot_rows=0)
    h = h.withColumns(R.region_interactions("capacity_used_pct", "network_latency_ms",
                                            "avg_rack_temperature_c", "scheduled_maintenance",
                                            "power_usage_mw"))
    keep = ["region", "date"] + [c for c in h.columns if any(c.startswith(x + "_") for x in HIST)] + [
        "infra_pressure", "maintenance_latency_interaction", "capacity_power_interaction"]
    return h.select(*keep)


register("e1_e5_history_chunked", ORACLE_E1_E5)(_e1_e5_chunked)


# --- E6 lead target ---------------------------------------------------------------------------
ORACLE_E6 = sql_with(["GP"], """
, L AS (SELECT region, date, support_tickets,
          LEAD(support_tickets, 1) OVER (PARTITION BY region ORDER BY date) AS support_tickets_next_1d,
          CAST(isodow(date) - 1 AS INTEGER) AS day_of_week, CAST(day(date) AS INTEGER) AS day_of_month
        FROM GP)
SELECT region, CAST(date AS VARCHAR) AS date, support_tickets, support_tickets_next_1d, day_of_week, day_of_month
FROM L WHERE support_tickets_next_1d IS NOT NULL""")


@register("e6_lead_target", ORACLE_E6)
def e6_lead_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    gp = A.group_day(Tables(spark, sf_dir))
    cal = R.calendar("date", "2024-01-01")
    out = W.lead_target(gp, "region", ["date"], "support_tickets", "support_tickets_next_1d")
    return out.select("region", "date", "support_tickets", "support_tickets_next_1d",
                      cal["day_of_week"].alias("day_of_week"), cal["day_of_month"].alias("day_of_month"))


def _e6_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E6 with every panel group treated as hot: the forward-halo chunk path,
    same oracle as the plain lead."""
    gp = A.group_day(Tables(spark, sf_dir))
    cal = R.calendar("date", "2024-01-01")
    out = W.lead_target(gp, "region", ["date"], "support_tickets", "support_tickets_next_1d",
                        hot_share=0.1, min_hot_rows=0)
    return out.select("region", "date", "support_tickets", "support_tickets_next_1d",
                      cal["day_of_week"].alias("day_of_week"), cal["day_of_month"].alias("day_of_month"))


register("e6_lead_target_chunked", ORACLE_E6)(_e6_chunked)


@register("j6_label_next_rows", sql_with(["ED"], """
SELECT server_id, CAST(date AS VARCHAR) AS date,
  COALESCE(MAX(CASE WHEN n_error > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY server_id ORDER BY date
           ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING), 0) AS label
FROM ED"""))
def j6_label_next_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observation-count wording of the label (next 7 observations of the
    entity carry an error)."""
    ed = A.entity_day(Tables(spark, sf_dir)).withColumn("has_error", R.flag(F.col("n_error") > 0))
    return J.label_next_rows(ed, "server_id", ["date"], "has_error", 7).select("server_id", "date", "label")


# --- J6 range label join -------------------------------------------------------------------------
@register("j6_label_horizon", sql_with(["ED", "INC"], """
SELECT o.server_id, CAST(o.date AS VARCHAR) AS date, o.n_obs,
  CASE WHEN EXISTS (SELECT 1 FROM INC i WHERE i.server_id = o.server_id
                    AND i.date BETWEEN o.date + INTERVAL 1 DAY AND o.date + INTERVAL 7 DAY) THEN 1 ELSE 0 END AS label
FROM ED o"""))
def j6_label_horizon(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    ed = A.entity_day(t).select("server_id", "date", "n_obs")
    return J.label_horizon(ed, A.incidents(t), "server_id", "date", 1, 7)


# --- J7 previous-day join ------------------------------------------------------------------------
@register("j7_prev_day_join", sql_with(["GP"], f"""
SELECT a.region, CAST(a.date AS VARCHAR) AS date, a.support_tickets,
       b.support_tickets AS support_tickets_prev_day, {r('b.network_latency_ms')} AS network_latency_ms_prev_day
FROM GP a LEFT JOIN GP b ON a.region = b.region AND a.date = b.date + INTERVAL 1 DAY"""))
def j7_prev_day_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    gp = A.group_day(Tables(spark, sf_dir)).select("region", "date", "support_tickets", "network_latency_ms")
    out = J.prev_day_join(gp, "region", "date", ["support_tickets", "network_latency_ms"])
    return out.select("region", "date", "support_tickets", "support_tickets_prev_day", "network_latency_ms_prev_day")


# --- J1 star fact assembly -----------------------------------------------------------------------
@register("j1_star_fact", sql_with([], f"""
SELECT l.l_orderkey, l.l_linenumber, o.o_orderpriority, c.c_mktsegment, n.n_name, r.r_name,
       {r('l.l_extendedprice * (1 - l.l_discount)')} AS revenue
FROM lineitem l
LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
LEFT JOIN customer c ON o.o_custkey = c.c_custkey
LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN region r ON n.n_regionkey = r.r_regionkey"""))
def j1_star_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    fact = t.lineitem.select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount",
                             F.col("l_orderkey").alias("o_orderkey"))
    out = J.assemble_fact(fact, [
        (t.orders.select("o_orderkey", "o_custkey", "o_orderpriority"), ["o_orderkey"]),
        (t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "c_nationkey"), ["o_custkey"]),
        (t.nation.select(F.col("n_nationkey").alias("c_nationkey"), "n_name", "n_regionkey"), ["c_nationkey"]),
        (t.region.select(F.col("r_regionkey").alias("n_regionkey"), "r_name"), ["n_regionkey"]),
    ])
    return out.select("l_orderkey", "l_linenumber", "o_orderpriority", "c_mktsegment", "n_name", "r_name",
                      (F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount"))).alias("revenue"))


# --- J5 full outer alignment of daily series -------------------------------------------------------
@register("j5_full_align", sql_with(["E"], """
, A1 AS (SELECT date, COUNT(*) AS clicks FROM E WHERE event_type = 'click' AND value >= 100 GROUP BY date),
A2 AS (SELECT date, COUNT(*) AS errors FROM E WHERE event_type = 'error' AND value >= 300 GROUP BY date),
A3 AS (SELECT date, COUNT(*) AS signups FROM E WHERE event_type = 'signup' AND value >= 400 GROUP BY date)
SELECT CAST(COALESCE(A1.date, A2.date, A3.date) AS VARCHAR) AS date,
       COALESCE(clicks, 0) AS clicks, COALESCE(errors, 0) AS errors, COALESCE(signups, 0) AS signups
FROM A1 FULL OUTER JOIN A2 ON A1.date = A2.date
FULL OUTER JOIN A3 ON COALESCE(A1.date, A2.date) = A3.date"""))
def j5_full_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = A.observations(Tables(spark, sf_dir))

    def series(kind, lo, name):
        return (e.filter((F.col("event_type") == kind) & (F.col("value") >= lo))
                 .groupBy("date").agg(F.count(F.lit(1)).alias(name)))
    return J.full_align([series("click", 100, "clicks"), series("error", 300, "errors"),
                         series("signup", 400, "signups")], "date")
