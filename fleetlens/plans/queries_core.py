"""Core registered queries: feature tables and the intervention ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import features as FT
from fleetlens.operators.ranking import prioritize
from fleetlens.plans import analogs as A
from fleetlens.plans.oracle_views import sql_with
from fleetlens.plans.base import r, register
from fleetlens.sources.tables import Tables

# ---------------------------------------------------------------------------
# shared SQL fragments
# ---------------------------------------------------------------------------
BV_SQL = """GREATEST(COALESCE(monthly_spend_eur, 10.0::DOUBLE), 10.0::DOUBLE)
  * (CASE lower(COALESCE(support_plan, 'basic')) WHEN 'basic' THEN 1.0::DOUBLE WHEN 'standard' THEN 1.2::DOUBLE
          WHEN 'premium' THEN 1.5::DOUBLE WHEN 'critical' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END)
  * (1.0::DOUBLE + 0.25::DOUBLE * COALESCE(has_gpu, 0) + 0.15::DOUBLE * COALESCE(is_managed, 0))
  * (1.0::DOUBLE + LEAST(GREATEST(COALESCE(capacity_used_pct, 0.0::DOUBLE), 0.0::DOUBLE), 100.0::DOUBLE) / 200.0::DOUBLE)"""


def incident_probability(n_incidents) -> F.Column:
    """Rule score used where no trained model is in the loop: n / (n + 5)."""
    n = F.col(n_incidents) if isinstance(n_incidents, str) else n_incidents
    return n.cast("double") / (n.cast("double") + F.lit(5.0))


# ---------------------------------------------------------------------------
# R5 intervention ranking (flagship)
# ---------------------------------------------------------------------------
def intervention_ranking(spark: SparkSession, sf_dir: str, n: int = 50) -> DataFrame:
    t = Tables(spark, sf_dir)
    srv = A.servers(t)
    inc = A.incidents(t).groupBy("server_id").agg(F.count(F.lit(1)).alias("incident_count"))
    cand = FT.spine_fill(srv, inc, "server_id", {"incident_count": 0}) \
        .withColumn("incident_probability", incident_probability("incident_count"))
    return prioritize(cand, n, keep=["segment", "support_plan", "incident_count"])


register("r5_intervention_ranking", sql_with(["INC", "SRV"], f"""
, C AS (
  SELECT s.*, COALESCE(i.incident_count, 0) AS incident_count
  FROM SRV s LEFT JOIN (SELECT server_id, COUNT(*) AS incident_count FROM INC GROUP BY server_id) i
  ON s.server_id = i.server_id),
P AS (
  SELECT server_id, segment, support_plan, incident_count,
         CAST(incident_count AS DOUBLE) / (CAST(incident_count AS DOUBLE) + 5.0::DOUBLE) AS incident_probability,
         {BV_SQL} AS business_value
  FROM C),
T AS (
  SELECT *, incident_probability * business_value AS priority_score FROM P
  ORDER BY priority_score DESC, server_id LIMIT 50)
SELECT server_id, segment, support_plan, incident_count,
       {r('incident_probability')} AS incident_probability, {r('business_value')} AS business_value,
       {r('priority_score')} AS priority_score,
       ROW_NUMBER() OVER (ORDER BY priority_score DESC, server_id) AS rank
FROM T"""))(intervention_ranking)


# ---------------------------------------------------------------------------
# R5 with J9 + B24: the three model outputs gathered per server, anomaly and
# segment as context columns with their multipliers
# ---------------------------------------------------------------------------
ANOMALY_THRESHOLD = 0.3


def ranking_with_context(spark: SparkSession, sf_dir: str, n: int = 50) -> DataFrame:
    from fleetlens.operators import clustering as CL
    from fleetlens.operators.joins import gather_scores, profile_lookup
    from fleetlens.plans.queries_cluster import segment_clusters
    t = Tables(spark, sf_dir)
    srv = A.servers(t)
    inc = A.incidents(t).groupBy("server_id").agg(
        F.count(F.lit(1)).alias("incident_count"),
        (F.max("duration_minutes") / F.lit(500.0)).alias("anomaly_score"))
    names = CL.name_profiles(CL.cluster_profile(segment_clusters(spark, sf_dir)))
    seg = profile_lookup(srv.select("server_id", F.col("segment").alias("cluster")), names, "cluster",
                         ["profile_name"]).select("server_id", F.col("profile_name").alias("segment_profile"))
    cand = gather_scores(srv, [inc, seg], ["server_id"]).fillna({"incident_count": 0, "anomaly_score": 0.0})
    cand = cand.withColumn("incident_probability", incident_probability("incident_count"))
    return prioritize(cand, n, anomaly_score="anomaly_score", anomaly_threshold=ANOMALY_THRESHOLD,
                      segment_profile="segment_profile")


def _context_sql() -> str:
    from fleetlens.plans.queries_cluster import _names_sql
    head = _names_sql().rsplit("\nSELECT PF.cluster", 1)[0]
    return head + f"""
, NM AS (SELECT PF.cluster, COALESCE(BE.label, 'serveurs standard') AS profile_name
         FROM PF LEFT JOIN (SELECT * FROM BE WHERE rn = 1) BE ON PF.cluster = BE.cluster),
IC AS (SELECT server_id, COUNT(*) AS incident_count, MAX(duration_minutes) / 500.0::DOUBLE AS anomaly_score
       FROM INC GROUP BY server_id),
C AS (SELECT S.*, COALESCE(IC.incident_count, 0) AS incident_count, COALESCE(IC.anomaly_score, 0.0) AS anomaly_score,
             COALESCE(NM.profile_name, 'profil inconnu') AS segment_profile
      FROM SRV S LEFT JOIN IC ON S.server_id = IC.server_id LEFT JOIN NM ON S.segment = NM.cluster),
P AS (SELECT server_id, anomaly_score, segment_profile,
             CAST(incident_count AS DOUBLE) / (CAST(incident_count AS DOUBLE) + 5.0::DOUBLE) AS incident_probability,
             {BV_SQL} AS business_value FROM C),
T AS (SELECT *, incident_probability * business_value AS priority_score FROM P
      ORDER BY priority_score DESC, server_id LIMIT 50)
SELECT server_id, {r('incident_probability')} AS incident_probability, {r('business_value')} AS business_value,
  {r('anomaly_score')} AS anomaly_score, anomaly_score >= {ANOMALY_THRESHOLD} AS is_anomaly,
  CASE WHEN anomaly_score - {ANOMALY_THRESHOLD} >= 0.1 THEN 'critical' WHEN anomaly_score - {ANOMALY_THRESHOLD} >= 0.03 THEN 'high'
       WHEN anomaly_score - {ANOMALY_THRESHOLD} >= 0 THEN 'medium' ELSE 'low' END AS anomaly_severity,
  CASE WHEN anomaly_score - {ANOMALY_THRESHOLD} >= 0.1 THEN 1.6 WHEN anomaly_score - {ANOMALY_THRESHOLD} >= 0.03 THEN 1.35
       WHEN anomaly_score - {ANOMALY_THRESHOLD} >= 0 THEN 1.15 ELSE 1.0 END::DOUBLE AS anomaly_context_multiplier,
  segment_profile,
  CASE WHEN segment_profile LIKE '%temperature%' THEN 1.25 WHEN segment_profile LIKE '%stockage%' THEN 1.15
       ELSE 1.0 END::DOUBLE AS segmentation_context_multiplier,
  {r('priority_score')} AS priority_score,
  ROW_NUMBER() OVER (ORDER BY priority_score DESC, server_id) AS rank
FROM T"""


def _register_context():
    from fleetlens.plans.base import register as reg
    reg("r5_j9_ranking_with_context", sql_with(["U", "INC", "SRV"], _context_sql()))(ranking_with_context)
