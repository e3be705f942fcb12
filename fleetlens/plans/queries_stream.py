"""Registered streaming queries: the driver's events file replayed through
Structured Streaming (watermarked daily windows, keyed history state, foreachBatch ranking), with
the closing flush, so the oracles cover every day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fleetlens.plans import analogs as A
from fleetlens.plans.base import r, register
from fleetlens.plans.oracle_views import sql_with
from fleetlens.plans.queries_core import BV_SQL
from fleetlens.sources.tables import Tables
from fleetlens.streaming.daily import DAILY_SCHEMA, HISTORY_SCHEMA, RANK_SCHEMA, Replay, replay_daily

#: one replay an application and input, read by the three queries
_RUNS: dict[tuple[str, str], Replay] = {}


def _run(spark: SparkSession, sf_dir: str) -> Replay:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _RUNS:
        _RUNS.clear()
        _RUNS[key] = replay_daily(spark, sf_dir, A.servers(Tables(spark, sf_dir)), 50, file_glob="events.parquet")
    return _RUNS[key]


@register("st1_stream_daily_aggregates", sql_with(["ED"], f"""
SELECT CAST(date AS VARCHAR) AS date, server_id, n_obs, n_error, {r('value_sum')} AS value_sum FROM ED"""))
def st1_stream_daily_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(DAILY_SCHEMA).parquet(_run(spark, sf_dir).daily).select("date", "server_id", "n_obs", "n_error", "value_sum")


@register("st2_stream_daily_ranking", sql_with(["ED", "SRV"], f"""
, P AS (SELECT ED.date, ED.server_id, ED.n_error / (ED.n_error + 5.0::DOUBLE) AS incident_probability,
               {BV_SQL} AS business_value
        FROM ED LEFT JOIN SRV ON ED.server_id = SRV.server_id),
Q AS (SELECT *, incident_probability * business_value AS priority_score FROM P),
RK AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY date ORDER BY priority_score DESC, server_id) AS rank FROM Q)
SELECT CAST(date AS VARCHAR) AS date, server_id, {r('incident_probability')} AS incident_probability,
       {r('business_value')} AS business_value, {r('priority_score')} AS priority_score, rank
FROM RK WHERE rank <= 50"""))
def st2_stream_daily_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(RANK_SCHEMA).parquet(_run(spark, sf_dir).ranking).drop("epoch")


def _history_sql() -> str:
    w = "OVER (PARTITION BY server_id ORDER BY date"
    back = lambda n: f"{w} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
    cols = {"lag1": f"LAG(value_sum, 1) {w})", "lag7": f"LAG(value_sum, 7) {w})", "diff1": f"value_sum - LAG(value_sum, 1) {w})",
            "rolling_mean_3": f"AVG(value_sum) {back(3)}", "rolling_mean_7": f"AVG(value_sum) {back(7)}",
            "rolling_std_7": f"STDDEV_SAMP(value_sum) {back(7)}", "rolling_max_7": f"MAX(value_sum) {back(7)}"}
    return f"""
SELECT CAST(date AS VARCHAR) AS date, server_id, n_obs, n_error, {r('value_sum')} AS value_sum,
  {', '.join(f'{r(e, 4)} AS value_sum_{n}' for n, e in cols.items())} FROM ED"""


@register("st3_stream_history", sql_with(["ED"], _history_sql()))
def st3_stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day with its lags and rolling statistics from the keyed state, the last days from the flush."""
    from pyspark.sql import functions as F

    from fleetlens.plans.base import half_away_round
    from fleetlens.streaming.daily import HISTORY_COLUMNS
    rows = spark.read.schema(HISTORY_SCHEMA).parquet(_run(spark, sf_dir).history).drop("epoch")
    return rows.withColumns({c: half_away_round(F.when(~F.isnan(c), F.col(c)), 4) for c in HISTORY_COLUMNS})
