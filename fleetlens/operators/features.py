"""Entity and group feature tables (aggregations G1-G12, A5, J2-J4, B13/B14).

Each builder is one ``groupBy().agg()`` pass (partial aggregation map side,
final aggregation after one shuffle on the key) instead of the several
groupings-then-joins a pandas version needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import rules as R
from fleetlens.operators.quantiles import exact_quantiles, quantile_columns
from fleetlens.operators.topk import top_k_per_group

# Usage measures of the server profile and the thresholds of
# its day rates (cpu >= 85, ram >= 85, temperature >= 70).
USAGE_MEASURES = ("cpu_util_pct", "ram_util_pct", "disk_util_pct", "temperature_c",
                  "net_in_gb", "net_out_gb", "utilization_pressure",
                  "thermal_cpu_pressure", "network_total_gb")
HIGH_CPU, HIGH_RAM, HIGH_TEMP = 85.0, 85.0, 70.0
RECENT_ROWS = 7
NO_INCIDENT_RECENCY = 999


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def with_server_pressure(usage: DataFrame) -> DataFrame:
    """Add utilization_pressure, thermal_cpu_pressure, network_total_gb."""
    return usage.withColumns(R.server_pressure(
        "cpu_util_pct", "ram_util_pct", "disk_util_pct", "temperature_c", "net_in_gb", "net_out_gb"))


def percentile(col: str, q: float, exact: bool = True, accuracy: int = 10000) -> Column:
    """Quantile as one aggregate expression: exact ``percentile`` (fine for
    bounded groups) or the bounded-memory sketch.  Feature tables use
    ``operators.quantiles`` for exact values without a per-group value map."""
    if exact:
        return F.percentile(F.col(col), F.lit(q))
    return F.percentile_approx(F.col(col), F.lit(q), F.lit(accuracy)).cast("double")


def usage_profile(usage: DataFrame, key: str = "server_id", date_col: str = "date",
                  tiebreak: str = "event_id", exact_percentiles: bool = True,
                  recent_rows: int = RECENT_ROWS, max_group_rows: int | None = None,
                  quantile_bucket_rows: int = 200_000) -> DataFrame:
    """Server usage profile: G1 (24 aggregates), G2 (p90 x9), G3 (recent-7 means), G4 (rates).

    ``usage`` needs the daily-usage columns.  The recent-N means use the
    last N observations of each entity by (date, tiebreak); they are ranked
    with an exact hot-group-safe top-k and joined back on the key.
    """
    u = with_server_pressure(usage)
    aggs = [
        F.avg("cpu_util_pct").alias("cpu_util_pct_mean"),
        F.max("cpu_util_pct").alias("cpu_util_pct_max"),
        F.stddev_samp("cpu_util_pct").alias("cpu_util_pct_std"),
        F.avg("ram_util_pct").alias("ram_util_pct_mean"),
        F.max("ram_util_pct").alias("ram_util_pct_max"),
        F.stddev_samp("ram_util_pct").alias("ram_util_pct_std"),
        F.avg("disk_util_pct").alias("disk_util_pct_mean"),
        F.max("disk_util_pct").alias("disk_util_pct_max"),
        F.stddev_samp("disk_util_pct").alias("disk_util_pct_std"),
        F.avg("net_in_gb").alias("net_in_gb_mean"),
        F.sum("net_in_gb").alias("net_in_gb_sum"),
        F.avg("net_out_gb").alias("net_out_gb_mean"),
        F.sum("net_out_gb").alias("net_out_gb_sum"),
        F.avg("temperature_c").alias("temperature_c_mean"),
        F.max("temperature_c").alias("temperature_c_max"),
        F.stddev_samp("temperature_c").alias("temperature_c_std"),
        F.avg("backup_success").alias("backup_success_mean"),
        F.min("backup_success").alias("backup_success_min"),
        F.avg("utilization_pressure").alias("utilization_pressure_mean"),
        F.avg("thermal_cpu_pressure").alias("thermal_cpu_pressure_mean"),
        F.max("thermal_cpu_pressure").alias("thermal_cpu_pressure_max"),
        F.avg("network_total_gb").alias("network_total_gb_mean"),
        F.sum("network_total_gb").alias("network_total_gb_sum"),
        F.count(F.lit(1)).alias("observation_count"),
    ]
    if not exact_percentiles:
        aggs += [percentile(m, 0.9, False).alias(f"{m}_p90") for m in USAGE_MEASURES]
    aggs += [
        F.avg(F.when(F.col("cpu_util_pct") >= HIGH_CPU, 1.0).otherwise(0.0)).alias("high_cpu_day_rate"),
        F.avg(F.when(F.col("ram_util_pct") >= HIGH_RAM, 1.0).otherwise(0.0)).alias("high_ram_day_rate"),
        F.avg(F.when(F.col("temperature_c") >= HIGH_TEMP, 1.0).otherwise(0.0)).alias("high_temperature_day_rate"),
        F.avg(F.lit(1.0) - F.col("backup_success")).alias("backup_failure_rate"),
    ]
    base = u.groupBy(key).agg(*aggs)
    if exact_percentiles:
        # exact p90s by rank (operators.quantiles): no per-group value map
        p90 = quantile_columns(u, [key], USAGE_MEASURES, 0.9, "_p90", max_group_rows=max_group_rows,
                               bucket_rows=quantile_bucket_rows, buckets=8 if quantile_bucket_rows < 1000 else 64)
        base = base.join(p90, key, "left")
    recent = top_k_per_group(
        u.select(key, date_col, tiebreak, *USAGE_MEASURES), [key],
        [F.col(date_col).desc(), F.col(tiebreak).desc()], recent_rows)
    recent = recent.groupBy(key).agg(*[F.avg(m).alias(f"{m}_recent7_mean") for m in USAGE_MEASURES])
    # Both sides are one row per key and hash-partitioned on it already.
    return base.join(recent, key, "left")


def incident_profile(incidents: DataFrame, reference_date, key: str = "server_id",
                     date_col: str = "date") -> DataFrame:
    """Incident profile (G5) with recency (G6) at ``reference_date``.

    ``reference_date`` is a date string (read once from the data by the
    caller) or a date Column.  Entities without incidents are filled by
    ``spine_fill``.
    """
    ref = F.to_date(F.lit(reference_date)) if isinstance(reference_date, str) else reference_date
    sev, comp = F.col("severity"), F.col("component")
    is_high = R.flag(sev.isin("high", "critical"))
    recent = R.flag(F.col(date_col) >= F.date_sub(ref, 29))
    return incidents.groupBy(key).agg(
        F.count(F.lit(1)).alias("incident_count"),
        F.count_distinct(date_col).alias("incident_day_count"),
        F.avg("duration_minutes").alias("incident_duration_minutes_mean"),
        F.max("duration_minutes").alias("incident_duration_minutes_max"),
        F.sum("duration_minutes").alias("incident_duration_minutes_sum"),
        F.avg("customer_visible").alias("customer_visible_rate"),
        F.avg("sla_breach").alias("sla_breach_rate"),
        F.avg("root_cause_known").alias("root_cause_known_rate"),
        F.sum(R.flag(sev == "critical")).cast("long").alias("critical_incident_count"),
        F.avg(is_high).alias("high_severity_incident_rate"),
        F.sum(R.flag(comp == "disk")).cast("long").alias("disk_incident_count"),
        F.sum(R.flag(comp == "network")).cast("long").alias("network_incident_count"),
        F.sum(R.flag(comp == "hypervisor")).cast("long").alias("hypervisor_incident_count"),
        F.sum(recent).cast("long").alias("recent30_incident_count"),
        F.sum(recent * is_high).cast("long").alias("recent30_high_severity_count"),
        F.datediff(ref, F.max(date_col)).alias("days_since_last_incident"),
    )


INCIDENT_DEFAULTS = {
    "incident_count": 0, "incident_day_count": 0,
    "incident_duration_minutes_mean": 0.0, "incident_duration_minutes_max": 0.0,
    "incident_duration_minutes_sum": 0.0, "customer_visible_rate": 0.0,
    "sla_breach_rate": 0.0, "root_cause_known_rate": 0.0, "critical_incident_count": 0,
    "high_severity_incident_rate": 0.0, "disk_incident_count": 0,
    "network_incident_count": 0, "hypervisor_incident_count": 0,
    "recent30_incident_count": 0, "recent30_high_severity_count": 0,
    "days_since_last_incident": NO_INCIDENT_RECENCY,
}


def spine_fill(spine: DataFrame, agg: DataFrame, key: str, defaults: dict) -> DataFrame:
    """Every spine row kept; missing aggregates take ``defaults``."""
    return spine.join(agg, key, "left").fillna(defaults)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``df`` unchanged after checking that no key repeats (J2 one-to-one).

    The largest key multiplicity is one partial-aggregating pass over the key
    columns (a one-number result); a duplicate raises before the join runs.
    """
    keys = list(keys)
    worst = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    if worst is not None and worst > 1:
        raise ValueError(f"one_to_one: duplicate key {keys}")
    return df


def server_feature_table(servers: DataFrame, usage: DataFrame, incidents: DataFrame,
                         key: str = "server_id", reference_date=None,
                         exact_percentiles: bool = True) -> DataFrame:
    """Server feature table: spine LEFT usage profile LEFT incident profile
    plus incident rates (B13), recent shifts (B14) and inf -> NULL (B8).

    ``reference_date`` defaults to the last usage date (one aggregate).
    """
    # one small aggregate gives the reference date (last usage date) and the
    # largest per-entity row count (which picks the quantile strategy)
    facts = (usage.groupBy(key).agg(F.count(F.lit(1)).alias("_n"), F.max("date").alias("_d"))
                  .agg(F.max("_n").alias("n"), F.max("_d").alias("d")).first())
    up = usage_profile(usage, key, exact_percentiles=exact_percentiles, max_group_rows=facts["n"] or 0)
    if reference_date is None:
        reference_date = str(facts["d"])
    ip = incident_profile(incidents, reference_date, key)
    # The profiles are grouped on the key, so only the spine can repeat a key;
    # it is guarded, and the joins after it are plain key joins.
    spine = assert_unique(servers.drop("customer_id"), [key])
    ft = spine.join(up, key, "left")
    ft = spine_fill(ft, ip, key, INCIDENT_DEFAULTS)
    obs = F.coalesce(F.col("observation_count"), F.lit(0))
    ft = ft.withColumns({
        "incident_rate": R.safe_divide("incident_count", obs),
        "recent30_incident_rate": R.safe_divide("recent30_incident_count", F.least(obs, F.lit(30))),
        "recent_usage_shift": F.col("cpu_util_pct_recent7_mean") - F.col("cpu_util_pct_mean"),
        "recent_temperature_shift": F.col("temperature_c_recent7_mean") - F.col("temperature_c_mean"),
        "recent_network_shift": F.col("network_total_gb_recent7_mean") - F.col("network_total_gb_mean"),
    })
    dbl = [n for n, t in ft.dtypes if t == "double"]
    return ft.withColumns({n: R.null_if_infinite(n) for n in dbl})


def region_day_rollup(lines: DataFrame, group_cols: Sequence[str] = ("region", "date"),
                      mean_cols: Sequence[str] = (), mean_max_cols: Sequence[str] = (),
                      entity: str = "server_id") -> DataFrame:
    """Group-day rollup (G7): means, mean+max pairs and a distinct entity count."""
    aggs = [F.avg(c).alias(f"{c}_mean") for c in mean_cols]
    for c in mean_max_cols:
        aggs += [F.avg(c).alias(f"{c}_mean"), F.max(c).alias(f"{c}_max")]
    aggs.append(F.count_distinct(entity).alias("active_servers"))
    return lines.groupBy(*group_cols).agg(*aggs)


def alt_profile(df: DataFrame, key: str, measures: Sequence[str], firsts: Sequence[str],
                date_col: str = "date", tiebreak: str = "event_id") -> DataFrame:
    """Experiment profile (G8): mean/max/std/sum/min per measure, the first
    value of descriptive columns and the row count.

    pandas ``first`` depends on row order; here it is the value at the
    earliest (date, tiebreak), made deterministic with ``min_by`` on a struct.
    """
    order = F.struct(F.col(date_col), F.col(tiebreak))
    aggs = []
    for m in measures:
        aggs += [F.avg(m).alias(f"{m}_mean"), F.max(m).alias(f"{m}_max"),
                 F.stddev_samp(m).alias(f"{m}_std"), F.sum(m).alias(f"{m}_sum"),
                 F.min(m).alias(f"{m}_min")]
    aggs += [F.min_by(F.col(c), order).alias(f"{c}_first") for c in firsts]
    aggs.append(F.count(F.lit(1)).alias("row_count"))
    return df.groupBy(key).agg(*aggs)


def mode_per_group(df: DataFrame, key: str | Sequence[str], col: str, alias: str | None = None) -> DataFrame:
    """Most frequent value per group, ties -> smallest value.

    Two partial-aggregating passes: counts per (key, value), then the best
    (count desc, value asc) per key with ``max_by`` -- no window, no
    per-group collection, so a hot key costs one row per distinct value.
    """
    keys = [key] if isinstance(key, str) else list(key)
    counts = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    # smallest (-count, value) = highest count, then smallest value
    return (counts.filter(F.col(col).isNotNull())
                  .groupBy(*keys)
                  .agg(F.min_by(F.col(col), F.struct(-F.col("_n"), F.col(col))).alias(alias or f"{col}_mode")))


def modes_per_group(df: DataFrame, key: str, cols: Sequence[str]) -> DataFrame:
    """``key`` + every column's most frequent value, ties -> smallest (J10): the values of all
    columns are counted in one aggregate and picked in a second, whatever their number."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).cast("string").alias("v")) for i, c in enumerate(cols)]))
    counts = df.select(key, cells.alias("_e")).where(F.col("_e.v").isNotNull()) \
        .groupBy(key, F.col("_e.i").alias("_i"), F.col("_e.v").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(key).agg(*[
        F.min_by("_v", F.when(F.col("_i") == i, F.struct(-F.col("_n"), F.col("_v")))).alias(c) for i, c in enumerate(cols)])


# The measures of the experiment's server profile with their aggregates.
EXPERIMENT_AGGREGATES = {
    "cpu_util_pct": ("mean", "max", "std"), "ram_util_pct": ("mean", "max", "std"), "disk_util_pct": ("mean", "max", "std"),
    "net_in_gb": ("mean", "max", "sum"), "net_out_gb": ("mean", "max", "sum"), "temperature_c": ("mean", "max", "std"),
    "backup_success": ("mean", "min"), "scheduled_maintenance": ("mean",), "avg_rack_temperature_c": ("mean", "max"),
    "power_usage_mw": ("mean", "max"), "network_latency_ms": ("mean", "max", "std"), "capacity_used_pct": ("mean", "max", "std"),
}


def experiment_profile(df: DataFrame, key: str, firsts: Sequence[str], categorical: Sequence[str],
                       date_col: str = "date", tiebreak: str = "event_id") -> DataFrame:
    """The experiment's server table (G8, J10, B10): aggregates of each measure, descriptive columns
    at the earliest (date, tiebreak), the row count, categorical modes merged back onto them, nulls
    as 0, and the pressures of the aggregates."""
    make = {"mean": F.avg, "max": F.max, "min": F.min, "std": F.stddev_samp, "sum": F.sum}
    order = F.struct(F.col(date_col), F.col(tiebreak))
    numbers = df.groupBy(key).agg(
        *[make[a](F.col(m).cast("double")).alias(f"{m}_{a}") for m, names in EXPERIMENT_AGGREGATES.items() for a in names],
        *[F.min_by(F.col(c), order).alias(f"{c}_first") for c in firsts], F.count(F.col(date_col)).alias("observation_count"))
    out = numbers.fillna(0).join(modes_per_group(df, key, categorical), key, "left")
    return out.withColumns({
        "utilization_pressure_mean": (F.col("cpu_util_pct_mean") + F.col("ram_util_pct_mean") + F.col("disk_util_pct_mean")
                                      + F.col("capacity_used_pct_mean")) / 4,
        "network_total_gb_sum": F.col("net_in_gb_sum") + F.col("net_out_gb_sum"),
        "thermal_cpu_pressure": F.col("temperature_c_mean") * F.col("cpu_util_pct_mean") / 100,
        "backup_failure_rate": 1 - F.col("backup_success_mean")})


def reference_values(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """Long table (feature, kind, median, mean, std, mode) of reference values.

    One aggregate for the numeric block (exact median, mean, population std)
    unpivoted with ``stack``; one mode pass per categorical column.
    """
    num_aggs = []
    for c in numeric:
        num_aggs += [F.avg(c).alias(f"{c}__mean"), F.stddev_pop(c).alias(f"{c}__std")]
    parts = []
    if numeric:
        wide = df.agg(*num_aggs)
        stack = ", ".join(f"'{c}', `{c}__mean`, `{c}__std`" for c in numeric)
        moments = wide.selectExpr(f"stack({len(numeric)}, {stack}) AS (feature, mean, std)")
        med = exact_quantiles(df, [], numeric, 0.5).select(F.col("measure").alias("feature"),
                                                             F.col("value").alias("median"))
        parts.append(moments.join(med, "feature", "left")
                            .select("feature", F.lit("numeric").alias("kind"), "median", "mean", "std",
                                    F.lit(None).cast("string").alias("mode")))
    for c in categorical:
        m = mode_per_group(df.withColumn("_all", F.lit(1)), "_all", c, "mode")
        parts.append(m.select(F.lit(c).alias("feature"), F.lit("categorical").alias("kind"),
                              F.lit(None).cast("double").alias("median"),
                              F.lit(None).cast("double").alias("mean"),
                              F.lit(None).cast("double").alias("std"),
                              F.col("mode").cast("string").alias("mode")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def dataset_profile(df: DataFrame, date_col: str | None = None, entity: str | None = None,
                    label: str | None = None) -> DataFrame:
    """One-row dataset profile (A5, G15): rows, columns, duplicate rows,
    missing cells, date range, distinct entities, label rate.

    Everything is one aggregate except the duplicate count, a second
    aggregate over the distinct full rows.
    """
    cols = df.columns
    missing = sum((F.count_if(F.col(f"`{c}`").isNull()) for c in cols), F.lit(0).cast("long"))
    aggs = [F.count(F.lit(1)).alias("rows"), F.lit(len(cols)).alias("cols"),
            missing.cast("long").alias("missing_values")]
    if date_col:
        aggs += [F.min(date_col).alias("min_date"), F.max(date_col).alias("max_date")]
    if entity:
        aggs.append(F.count_distinct(entity).alias("distinct_entities"))
    if label:
        aggs.append(F.avg(F.col(label).cast("double")).alias("label_rate"))
    base = df.agg(*aggs)
    distinct_rows = df.distinct().agg(F.count(F.lit(1)).alias("_d")).scalar()
    return base.withColumn("duplicate_rows", F.col("rows") - distinct_rows)
