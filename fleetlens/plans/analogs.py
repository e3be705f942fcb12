"""Fleet-shaped views derived from the driver tables.

The library's operators take column names as parameters; these views give
them fleet-shaped inputs built from the driver's parquet tables so every
registered query reads real tables and grows with them:

* ``observations``  (E)  events as per-entity observations
* ``usage``         (U)  E with daily-usage style measures
* ``incidents``     (IN) error events as an incident log
* ``servers``       (SPINE) customer + nation + region as the entity dimension
* ``entity_day``    (ED) E rolled up per (entity, date)
* ``group_day``     (GP) E rolled up per (event_type, date): a dense panel
* ``region_day``    (RD) lineitem + supplier + nation per (region, ship date)
* ``scored``        (SC) labels + documents as (key, day, y, score)

The same definitions exist as SQL text in ``oracle_views`` for the DuckDB
oracle; keep the two in step.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.sources.tables import Tables

# Fixed values of the analog mapping (ours, documented in FIXTURES.md):
# incident severity by duration: < 25 low, < 75 medium, < 150 high, else critical;
# component by k % 3: 0 disk, 1 network, 2 hypervisor;
# support plan by market segment: AUTOMOBILE Basic, BUILDING standard,
# FURNITURE PREMIUM, HOUSEHOLD critical, other enterprise (weight 1.0).
SEVERITY_BOUNDS = ((25.0, "low"), (75.0, "medium"), (150.0, "high"))
COMPONENTS = ("disk", "network", "hypervisor")
SEGMENT_PLANS = (("AUTOMOBILE", "Basic"), ("BUILDING", "standard"),
                 ("FURNITURE", "PREMIUM"), ("HOUSEHOLD", "critical"))


def observations(t: Tables) -> DataFrame:
    ev = t.events
    return ev.select(
        "event_id",
        F.col("user_id").alias("server_id"),
        F.to_date("ts").alias("date"),
        "ts",
        "event_type",
        "value",
        F.get_json_object("props", "$.k").try_cast("int").alias("k"),
    )


def usage(t: Tables) -> DataFrame:
    e = observations(t)
    v, k = F.col("value"), F.col("k").cast("double")
    return e.select(
        "event_id", "server_id", "date", "ts", "event_type",
        (v % F.lit(100.0)).alias("cpu_util_pct"),
        k.alias("ram_util_pct"),
        ((v * F.lit(3.0)) % F.lit(100.0)).alias("disk_util_pct"),
        (F.lit(20.0) + v % F.lit(60.0)).alias("temperature_c"),
        (v / F.lit(10.0)).alias("net_in_gb"),
        (k / F.lit(10.0)).alias("net_out_gb"),
        F.when(F.col("event_type") == "error", F.lit(0)).otherwise(F.lit(1)).alias("backup_success"),
        ((v * F.lit(7.0)) % F.lit(100.0)).alias("capacity_used_pct"),
    )


def incidents(t: Tables) -> DataFrame:
    e = observations(t).filter(F.col("event_type") == "error")
    v, k = F.col("value"), F.col("k")
    sev = F.lit("critical")
    for bound, name in reversed(SEVERITY_BOUNDS):
        sev = F.when(v < F.lit(bound), F.lit(name)).otherwise(sev)
    comp = F.element_at(F.array(*[F.lit(c) for c in COMPONENTS]), (k % 3 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("incident_id"),
        "server_id", "date",
        v.alias("duration_minutes"),
        sev.alias("severity"),
        comp.alias("component"),
        (k % 2).alias("customer_visible"),
        F.when(v >= 100.0, 1).otherwise(0).alias("sla_breach"),
        F.when(k % 5 == 0, 0).otherwise(1).alias("root_cause_known"),
    )


def servers(t: Tables) -> DataFrame:
    c, n, r = t.customer, t.nation, t.region
    plan = F.lit("enterprise")
    for seg, p in reversed(SEGMENT_PLANS):
        plan = F.when(F.col("c_mktsegment") == seg, F.lit(p)).otherwise(plan)
    # nation (25 rows) and region (5 rows) are fixed-size dimensions.
    return (c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey, "left")
             .join(F.broadcast(r), F.col("n_regionkey") == r.r_regionkey, "left")
             .select(
                 F.col("c_custkey").alias("server_id"),
                 F.col("c_custkey").alias("customer_id"),
                 F.col("r_name").alias("region"),
                 F.col("n_name").alias("country"),
                 F.col("c_mktsegment").alias("segment"),
                 plan.alias("support_plan"),
                 F.col("c_acctbal").alias("monthly_spend_eur"),
                 (F.col("c_nationkey") % 2).alias("has_gpu"),
                 F.when(F.col("c_custkey") % 3 == 0, 1).otherwise(0).alias("is_managed"),
                 (F.col("c_acctbal") / F.lit(50.0)).alias("capacity_used_pct"),
             ))


def entity_day(t: Tables) -> DataFrame:
    e = observations(t)
    return e.groupBy("server_id", "date").agg(
        F.count(F.lit(1)).alias("n_obs"),
        F.sum("value").alias("value_sum"),
        F.max("value").alias("value_max"),
        F.avg("value").alias("value_avg"),
        F.sum(F.when(F.col("event_type") == "error", 1).otherwise(0)).alias("n_error"),
    )


def group_day(t: Tables) -> DataFrame:
    e = observations(t)
    return e.groupBy(F.col("event_type").alias("region"), "date").agg(
        F.count(F.lit(1)).alias("support_tickets"),
        F.avg("value").alias("network_latency_ms"),
        (F.max("value") / F.lit(5.0)).alias("capacity_used_pct"),
        (F.sum("value") / F.lit(1000.0)).alias("power_usage_mw"),
        F.avg("k").alias("avg_rack_temperature_c"),
    ).withColumn("scheduled_maintenance",
                 F.when(F.weekday("date") >= 5, 1).otherwise(0))


def region_day_lines(t: Tables) -> DataFrame:
    """lineitem x supplier x nation at line grain: (region key, ship date, measures)."""
    li, s, n = t.lineitem, t.supplier, t.nation
    # supplier is 1/60 of lineitem in TPC-H proportions; AQE picks broadcast or
    # shuffle at runtime from its real size, so no hint here.
    return (li.join(s, li.l_suppkey == s.s_suppkey)
              .join(F.broadcast(n), F.col("s_nationkey") == n.n_nationkey)
              .select(F.col("n_regionkey").alias("region"),
                      F.to_date("l_shipdate").alias("date"),
                      F.col("l_suppkey").alias("server_id"),
                      "l_quantity", "l_extendedprice", "l_discount", "l_tax"))


def scored(t: Tables) -> DataFrame:
    lab, doc = t.labels, t.documents
    return (lab.join(doc.select("doc_id", "n_chars"), "doc_id")
               .select(F.col("doc_id").alias("key"),
                       (F.col("doc_id") % 16).alias("day"),
                       F.col("toxic").alias("y"),
                       (F.col("n_chars") / (F.col("n_chars") + F.lit(1000.0))).alias("score")))


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select("vec_id", "embedding", F.col("label").alias("cluster"))
