"""Completion of partial inputs by computed fallbacks.

A specification names every output and the expression that stands in where the caller gave no
value; the expression may use other outputs, which are then completed first.  Each output is
``coalesce(given value, expression)``; outputs that do not depend on each other are completed in
one projection, so the plan is a few projections over the rows and nothing else.

Defined cases: a missing input column counts as null; a null or absent value takes the
expression; an expression that is null stays null; outputs that need each other are an error.
"""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dependency_levels(spec: Mapping[str, str]) -> list[list[str]]:
    """Outputs in groups; each group needs only outputs of the groups before it."""
    needs = {name: {w for w in re.findall(r"[A-Za-z_]\w*", text) if w in spec and w != name} for name, text in spec.items()}
    done: set[str] = set()
    levels = []
    while len(done) < len(spec):
        ready = [n for n in spec if n not in done and needs[n] <= done]
        if not ready:
            raise ValueError(f"outputs that need each other: {sorted(set(spec) - done)}")
        levels.append(ready)
        done |= set(ready)
    return levels


def complete(df: DataFrame, spec: Mapping[str, str], kind: str = "double") -> DataFrame:
    """Every output of ``spec`` under its own name; other columns stay as they are."""
    for level in dependency_levels(spec):
        given = {c for c in df.columns}
        df = df.withColumns({n: F.coalesce(*([F.col(f"`{n}`").cast(kind)] if n in given else []), F.expr(spec[n]).cast(kind))
                             for n in level})
    return df


# The server profile that a single observation stands for, column by column.
#: inputs of one observation and their defaults
POINT_INPUTS = {
    "cpu_util_pct": "0", "ram_util_pct": "0", "disk_util_pct": "0", "net_in_gb": "0", "net_out_gb": "0",
    "temperature_c": "0", "backup_success": "1", "observation_count": "1",
    "utilization_pressure": "(cpu_util_pct + ram_util_pct + disk_util_pct) / 3",
    "thermal_cpu_pressure": "temperature_c * cpu_util_pct / 100",
    "network_total_gb": "net_in_gb + net_out_gb",
}
SERVER_INPUTS = ("cpu_cores", "ram_gb", "disk_tb", "age_days", "has_gpu", "is_managed")
#: aggregates of each measure that a profile holds
PROFILE_AGGREGATES = {
    "cpu_util_pct": ("mean", "max", "std", "p90", "recent7_mean"),
    "ram_util_pct": ("mean", "max", "std", "p90", "recent7_mean"),
    "disk_util_pct": ("mean", "max", "std", "p90", "recent7_mean"),
    "net_in_gb": ("mean", "sum", "p90", "recent7_mean"),
    "net_out_gb": ("mean", "sum", "p90", "recent7_mean"),
    "temperature_c": ("mean", "max", "std", "p90", "recent7_mean"),
    "backup_success": ("mean", "min"),
    "utilization_pressure": ("mean", "p90", "recent7_mean"),
    "thermal_cpu_pressure": ("mean", "max", "p90", "recent7_mean"),
    "network_total_gb": ("mean", "sum", "p90", "recent7_mean"),
}
#: the rest, each with what it follows from
PROFILE_RATES = {
    "high_cpu_day_rate": "CASE WHEN cpu_util_pct >= 85 THEN 1 ELSE 0 END",
    "high_ram_day_rate": "CASE WHEN ram_util_pct >= 85 THEN 1 ELSE 0 END",
    "high_temperature_day_rate": "CASE WHEN temperature_c >= 70 THEN 1 ELSE 0 END",
    "backup_failure_rate": "1 - backup_success_mean",
    "incident_count": "0",
    "incident_day_count": "incident_count",
    "incident_duration_minutes_mean": "0",
    "incident_duration_minutes_max": "incident_duration_minutes_mean",
    "incident_duration_minutes_sum": "incident_count * incident_duration_minutes_mean",
    "customer_visible_rate": "0",
    "sla_breach_rate": "0",
    "root_cause_known_rate": "0",
    "critical_incident_count": "0",
    "high_severity_incident_rate": "0",
    "disk_incident_count": "0",
    "network_incident_count": "0",
    "hypervisor_incident_count": "0",
    "recent30_incident_count": "incident_count",
    "recent30_high_severity_count": "0",
    "days_since_last_incident": "GREATEST(observation_count, 30)",
    "incident_rate": "incident_count / observation_count",
    "recent30_incident_rate": "recent30_incident_count / GREATEST(LEAST(observation_count, 30), 1)",
    "recent_usage_shift": "cpu_util_pct_recent7_mean - cpu_util_pct_mean",
    "recent_temperature_shift": "temperature_c_recent7_mean - temperature_c_mean",
    "recent_network_shift": "network_total_gb_recent7_mean - network_total_gb_mean",
}


def _aggregate_default(measure: str, aggregate: str) -> str:
    """What one observation says about an aggregate: no spread, its value times the days, or its value."""
    return {"std": "0", "sum": f"{measure} * observation_count"}.get(aggregate, measure)


def server_profile_spec() -> dict[str, str]:
    """The whole profile: point inputs, server attributes, aggregates and rates."""
    return {**POINT_INPUTS, **{c: "0" for c in SERVER_INPUTS},
            **{f"{m}_{a}": _aggregate_default(m, a) for m, names in PROFILE_AGGREGATES.items() for a in names},
            **PROFILE_RATES}


def complete_server_profile(df: DataFrame) -> DataFrame:
    """Point-in-time inputs as a server profile (B16).  Fewer than one observation counts as one."""
    if "observation_count" in df.columns:
        df = df.withColumn("observation_count", F.greatest(F.coalesce(F.col("observation_count").cast("int"), F.lit(1)), F.lit(1)))
    return complete(df, server_profile_spec())


# The measures of the forecast's history and the interactions of the day.
FORECAST_MEASURES = ("support_tickets", "network_latency_ms", "capacity_used_pct", "power_usage_mw", "avg_rack_temperature_c")
INTERACTIONS = {
    "infra_pressure": "(capacity_used_pct + network_latency_ms + avg_rack_temperature_c) / 3",
    "maintenance_latency_interaction": "scheduled_maintenance * network_latency_ms",
    "capacity_power_interaction": "capacity_used_pct * power_usage_mw",
}


def forecast_spec() -> dict[str, str]:
    """History a region's day without one stands for: today's value, and no change or spread."""
    flat = {f"{m}_{a}": m for m in FORECAST_MEASURES
            for a in ("lag1", "lag7", "rolling_mean_3", "rolling_mean_7", "rolling_max_7")}
    still = {f"{m}_{a}": "0" for m in FORECAST_MEASURES for a in ("diff1", "rolling_std_7")}
    return {**flat, **still, **INTERACTIONS}


def calendar_spec(date: str, start: str) -> dict[str, str]:
    """Calendar columns, where the caller's own values win."""
    return {"day_of_week": f"weekday({date})", "day_of_month": f"day({date})",
            "days_since_start": f"datediff({date}, DATE '{start}')"}
