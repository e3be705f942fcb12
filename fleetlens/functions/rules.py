"""Scalar business rules as Column expressions (JVM-side, codegen friendly).

Every function takes and returns ``Column`` objects so it can be used inside
``select``/``withColumns`` of any plan, batch or streaming.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the source application's rules.
# Support-plan weights: basic 1.0, standard 1.2, premium 1.5, critical 2.0,
# any other plan 1.0.  Hardware weight 1 + 0.25*gpu + 0.15*managed.
# Capacity weight 1 + clamp(capacity, 0, 100) / 200.  Spend floor 10.
# Risk levels: >= 0.5 critical, >= threshold high, >= 0.1 medium, else low.
# Anomaly margin levels: >= 0.1 critical, >= 0.03 high, >= 0 medium, else low.
# Anomaly context multipliers: 1.6, 1.35, 1.15, 1.0 on the same margins.
# Segment multipliers: name contains "temperature" 1.25, "stockage" 1.15.
# ---------------------------------------------------------------------------
PLAN_WEIGHTS = {"basic": 1.0, "standard": 1.2, "premium": 1.5, "critical": 2.0}
DEFAULT_PLAN_WEIGHT = 1.0
GPU_WEIGHT = 0.25
MANAGED_WEIGHT = 0.15
SPEND_FLOOR = 10.0
RISK_CRITICAL = 0.5
RISK_MEDIUM = 0.1
SEVERITY_MARGINS = ((0.1, "critical"), (0.03, "high"), (0.0, "medium"))
ANOMALY_MULTIPLIERS = ((0.1, 1.6), (0.03, 1.35), (0.0, 1.15))
SEGMENT_MULTIPLIERS = (("temperature", 1.25), ("stockage", 1.15))


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_divide(num, den) -> Column:
    """num / den, 0.0 when the denominator is null or <= 0."""
    num, den = _c(num), _c(den)
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(F.lit(0.0))


def flag(cond: Column) -> Column:
    """Boolean condition -> 0/1 int; NULL counts as 0 like a pandas comparison."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def at_least(x, threshold: float) -> Column:
    return flag(_c(x) >= F.lit(threshold))


def null_if_infinite(x) -> Column:
    """±inf -> NULL."""
    x = _c(x)
    return F.when(x.isin(float("inf"), float("-inf")), F.lit(None).cast("double")).otherwise(x)


def plan_weight(plan) -> Column:
    """Support-plan weight from a case-insensitive plan name."""
    p = F.lower(_c(plan).cast("string"))
    expr = F.lit(DEFAULT_PLAN_WEIGHT)
    for name, w in reversed(list(PLAN_WEIGHTS.items())):
        expr = F.when(p == F.lit(name), F.lit(w)).otherwise(expr)
    return expr


def business_value(spend, plan, has_gpu, is_managed, capacity) -> Column:
    """max(spend,10) x plan weight x (1+.25 gpu+.15 managed) x (1+clamp(cap,0,100)/200).

    Missing inputs take the request defaults: spend 10, plan basic, flags 0,
    capacity 0.
    """
    spend_v = F.greatest(F.coalesce(_c(spend).cast("double"), F.lit(SPEND_FLOOR)), F.lit(SPEND_FLOOR))
    hw = (F.lit(1.0)
          + F.lit(GPU_WEIGHT) * F.coalesce(_c(has_gpu).cast("int"), F.lit(0))
          + F.lit(MANAGED_WEIGHT) * F.coalesce(_c(is_managed).cast("int"), F.lit(0)))
    cap = F.least(F.greatest(F.coalesce(_c(capacity).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(100.0))
    pressure = F.lit(1.0) + cap / F.lit(200.0)
    return spend_v * plan_weight(F.coalesce(_c(plan), F.lit("basic"))) * hw * pressure


def decision(score, threshold) -> Column:
    """score >= threshold -> 1 else 0."""
    return flag(_c(score) >= _c(threshold) if not isinstance(threshold, (int, float)) else _c(score) >= F.lit(threshold))


def risk_level(prob, threshold) -> Column:
    """critical / high / medium / low; the order of tests matters."""
    p = _c(prob)
    t = F.lit(threshold) if isinstance(threshold, (int, float)) else _c(threshold)
    return (F.when(p >= F.lit(RISK_CRITICAL), F.lit("critical"))
            .when(p >= t, F.lit("high"))
            .when(p >= F.lit(RISK_MEDIUM), F.lit("medium"))
            .otherwise(F.lit("low")))


def anomaly_severity(score, threshold) -> Column:
    """Severity from the margin score - threshold."""
    t = F.lit(threshold) if isinstance(threshold, (int, float)) else _c(threshold)
    margin = _c(score) - t
    expr = F.lit("low")
    for bound, name in reversed(SEVERITY_MARGINS):
        expr = F.when(margin >= F.lit(bound), F.lit(name)).otherwise(expr)
    return expr


def anomaly_multiplier(score, threshold) -> Column:
    """Context multiplier for the ranking annotation."""
    t = F.lit(threshold) if isinstance(threshold, (int, float)) else _c(threshold)
    margin = _c(score) - t
    expr = F.lit(1.0)
    for bound, m in reversed(ANOMALY_MULTIPLIERS):
        expr = F.when(margin >= F.lit(bound), F.lit(m)).otherwise(expr)
    return expr


def segment_multiplier(profile_name) -> Column:
    """1.25 if the name mentions temperature, 1.15 for storage, else 1.0."""
    name = F.coalesce(_c(profile_name), F.lit(""))
    expr = F.lit(1.0)
    for word, m in reversed(SEGMENT_MULTIPLIERS):
        expr = F.when(name.contains(word), F.lit(m)).otherwise(expr)
    return expr


def clip_round(pred) -> tuple[Column, Column]:
    """Non-negative prediction and its half-even rounded integer."""
    clipped = F.greatest(_c(pred).cast("double"), F.lit(0.0))
    return clipped, F.bround(clipped, 0).cast("int")


def prediction_interval(pred, mae) -> tuple[Column, Column]:
    """(max(p - mae, 0), p + mae)."""
    p = _c(pred)
    m = F.lit(mae) if isinstance(mae, (int, float)) else _c(mae)
    return F.greatest(p - m, F.lit(0.0)), p + m


def calendar(date_col, start) -> dict[str, Column]:
    """Monday=0 weekday, day of month, days since ``start``."""
    d = _c(date_col)
    s = F.to_date(F.lit(start)) if isinstance(start, str) else _c(start)
    return {
        "day_of_week": F.weekday(d),
        "day_of_month": F.dayofmonth(d),
        "days_since_start": F.datediff(d, s),
    }


def obs_pressure(cpu, ram, disk, temp, net_in, net_out, capacity) -> dict[str, Column]:
    """Observation-level pressure features."""
    cpu, ram, disk, temp = _c(cpu), _c(ram), _c(disk), _c(temp)
    net_in, net_out, capacity = _c(net_in), _c(net_out), _c(capacity)
    return {
        "cpu_ram_pressure": cpu * ram / F.lit(100.0),
        "thermal_pressure": temp * cpu / F.lit(100.0),
        "network_total_gb": net_in + net_out,
        "network_balance_gb": net_in - net_out,
        "utilization_pressure": (cpu + ram + disk + capacity) / F.lit(4.0),
    }


def server_pressure(cpu, ram, disk, temp, net_in, net_out) -> dict[str, Column]:
    """Server-profile variants: 3-way utilisation mean, thermal x cpu, total traffic."""
    cpu, ram, disk, temp = _c(cpu), _c(ram), _c(disk), _c(temp)
    return {
        "utilization_pressure": (cpu + ram + disk) / F.lit(3.0),
        "thermal_cpu_pressure": temp * cpu / F.lit(100.0),
        "network_total_gb": _c(net_in) + _c(net_out),
    }


def region_interactions(capacity, latency, rack_temp, maintenance, power) -> dict[str, Column]:
    """Region-day interactions."""
    capacity, latency, rack_temp = _c(capacity), _c(latency), _c(rack_temp)
    return {
        "infra_pressure": (capacity + latency + rack_temp) / F.lit(3.0),
        "maintenance_latency_interaction": _c(maintenance) * latency,
        "capacity_power_interaction": capacity * _c(power),
    }


# ---------------------------------------------------------------------------
# Readable feature labels shown in explanations.
# ---------------------------------------------------------------------------
FEATURE_LABELS = {
    "cpu_util_pct": "CPU usage",
    "ram_util_pct": "RAM usage",
    "disk_util_pct": "disk usage",
    "temperature_c": "server temperature",
    "net_in_gb": "incoming network traffic",
    "net_out_gb": "outgoing network traffic",
    "network_total_gb": "total network traffic",
    "network_balance_gb": "network traffic imbalance",
    "capacity_used_pct": "capacity usage",
    "support_tickets": "support tickets",
    "scheduled_maintenance": "scheduled maintenance",
    "thermal_pressure": "thermal pressure",
    "cpu_ram_pressure": "CPU/RAM pressure",
    "utilization_pressure": "global utilization pressure",
    "power_usage_mw": "power usage",
    "network_latency_ms": "network latency",
    "is_managed": "managed server flag",
    "has_gpu": "GPU flag",
    "contract_months": "contract duration",
    "monthly_spend_eur": "monthly spend",
}


def readable_label(feature) -> Column:
    """Strip an encoder prefix ``xxx__``; known names map to a label, else ``_`` -> space."""
    clean = F.regexp_replace(_c(feature), r"^.*?__", "")
    mapping = F.create_map(*[F.lit(x) for kv in FEATURE_LABELS.items() for x in kv])
    return F.coalesce(F.element_at(mapping, clean), F.regexp_replace(clean, "_", " "))


def value_direction(value, reference, numeric: bool = True) -> Column:
    """above/below/near_normal for numbers, usual/unusual_category otherwise."""
    v, r = _c(value), _c(reference)
    if numeric:
        return (F.when(v > r, F.lit("above_normal"))
                .when(v < r, F.lit("below_normal"))
                .otherwise(F.lit("near_normal")))
    return F.when(v == r, F.lit("usual_category")).otherwise(F.lit("unusual_category"))


def impact_direction(impact) -> Column:
    return F.when(_c(impact) >= 0, F.lit("increases_prediction")).otherwise(F.lit("decreases_prediction"))


# Sentence templates of the explanation texts.
INCIDENT_SENTENCE = ("Le modele estime un risque incident de %s %%. "
                     "Les facteurs qui expliquent le plus ce score sont: %s.")
INCIDENT_FALLBACK = ("Aucun facteur dominant n'a ete identifie; "
                     "le risque vient de la combinaison globale des signaux.")
SUPPORT_SENTENCE = "La prevision est de %s tickets. Les facteurs les plus influents sont: %s."
SUPPORT_FALLBACK = ("Aucun facteur dominant n'a ete identifie; "
                    "la prevision vient de la combinaison globale des signaux regionaux.")
ANOMALY_SENTENCE = ("This server is flagged mainly because these signals differ from normal "
                    "behavior: %s.")
ANOMALY_FALLBACK = ("No single feature dominates this anomaly score; "
                    "the alert comes from the combined server profile.")
SEGMENT_SENTENCE = "Ce serveur est classe dans le profil '%s'%s. Raison principale: %s."
SEGMENT_CONFIDENCE = " avec une probabilite de cluster de %s %%"


def fixed(x, digits: int = 2) -> Column:
    """Fixed-point text of a double, rounded from its exact binary value like
    Python's ``f"{x:.2f}"`` (``format_string('%.2f')`` rounds the shortest
    decimal form half-up instead, which differs near ties)."""
    return F.regexp_replace(F.format_number(_c(x).cast("double"), digits), ",", "")


def incident_sentence(labels, probability) -> Column:
    """Top-3 labels + probability in percent, fallback text when no label."""
    labels = _c(labels)
    drivers = F.array_join(F.slice(labels, 1, 3), ", ")
    return F.when(F.coalesce(F.size(labels), F.lit(0)) <= 0, F.lit(INCIDENT_FALLBACK)).otherwise(
        F.format_string(INCIDENT_SENTENCE, fixed(_c(probability) * F.lit(100.0), 2), drivers))


def support_sentence(labels, prediction) -> Column:
    labels = _c(labels)
    drivers = F.array_join(F.slice(labels, 1, 3), ", ")
    return F.when(F.coalesce(F.size(labels), F.lit(0)) <= 0, F.lit(SUPPORT_FALLBACK)).otherwise(
        F.format_string(SUPPORT_SENTENCE, fixed(prediction, 2), drivers))


def anomaly_sentence(labels) -> Column:
    labels = _c(labels)
    drivers = F.array_join(F.slice(labels, 1, 3), ", ")
    return F.when(F.coalesce(F.size(labels), F.lit(0)) <= 0, F.lit(ANOMALY_FALLBACK)).otherwise(
        F.format_string(ANOMALY_SENTENCE, drivers))


def segment_sentence(profile_name, driver, confidence) -> Column:
    conf = F.when(_c(confidence).isNull(), F.lit("")).otherwise(
        F.format_string(SEGMENT_CONFIDENCE, fixed(_c(confidence) * F.lit(100.0), 1)))
    return F.format_string(SEGMENT_SENTENCE, F.coalesce(_c(profile_name), F.lit("profil inconnu")),
                           conf, F.coalesce(_c(driver), F.lit("aucun ecart dominant")))


def fingerprint(*cols: str) -> Column:
    """First 12 hex chars of SHA-256 over a key-sorted JSON of the inputs.

    The canonical text is ours (Spark's ``to_json``), so equal inputs give
    equal fingerprints inside this library; it is not byte-equal to Python's
    ``json.dumps``.
    """
    names = sorted(cols)
    return F.substring(F.sha2(F.to_json(F.struct(*[F.col(c) for c in names])), 256), 1, 12)
