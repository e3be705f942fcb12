"""Registered clustering queries.

Driver analog: the server feature table with the market segment as the
cluster id (a deterministic, SQL-reproducible assignment), and the
embedding vectors with their label as cluster.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.operators import clustering as CL
from fleetlens.operators import features as FT
from fleetlens.operators.joins import profile_lookup
from fleetlens.operators.silhouette import silhouette_euclidean
from fleetlens.plans import analogs as A
from fleetlens.plans.oracle_views import sql_with
from fleetlens.plans.queries_features import server_features_cte
from fleetlens.plans.base import half_away_round, r, register
from fleetlens.sources.tables import Tables


def segment_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = Tables(spark, sf_dir)
    ft = FT.server_feature_table(A.servers(t), A.usage(t), A.incidents(t))
    return ft.withColumn("cluster", F.col("segment"))


def _profile_sql() -> str:
    cols = ", ".join(f"AVG({c}) AS {c}" for c in CL.PROFILE_COLUMNS)
    return server_features_cte() + f", PF AS (SELECT segment AS cluster, COUNT(server_id) AS server_count, {cols} FROM FT GROUP BY segment)\n"


@register("g10_cluster_profile", sql_with(["U", "INC", "SRV"], _profile_sql() + "SELECT cluster, server_count, " +
                                          ", ".join(f"{r(c)} AS {c}" for c in CL.PROFILE_COLUMNS) + " FROM PF"))
def g10_cluster_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CL.cluster_profile(segment_clusters(spark, sf_dir))


def _names_sql() -> str:
    rules = " UNION ALL ".join(
        f"SELECT '{c}' AS col, '{lbl}' AS label, {g}::DOUBLE AS min_gap" for c, lbl, g in CL.PROFILE_RULES)
    vals = " UNION ALL ".join(
        f"SELECT cluster, '{c}' AS col, {c}::DOUBLE AS value, (SELECT AVG({c}) FROM PF)::DOUBLE AS mean FROM PF"
        for c, _, _ in CL.PROFILE_RULES)
    return _profile_sql() + f"""
, RU AS ({rules}),
VA AS ({vals}),
GA AS (SELECT VA.cluster, VA.col, RU.label, RU.min_gap, VA.value - VA.mean AS gap FROM VA JOIN RU ON VA.col = RU.col),
OK AS (SELECT *, gap / min_gap AS ratio FROM GA WHERE gap >= min_gap),
BE AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY cluster ORDER BY ratio DESC, gap DESC, col DESC, label DESC) AS rn FROM OK)
SELECT PF.cluster, COALESCE(BE.label, '{CL.STANDARD_NAME}') AS profile_name,
       CASE WHEN BE.label IS NULL THEN '{CL.STANDARD_DRIVER}'
            ELSE printf('%s (+%.2f vs moyenne clusters)', BE.col, BE.gap) END AS profile_driver
FROM PF LEFT JOIN (SELECT * FROM BE WHERE rn = 1) BE ON PF.cluster = BE.cluster"""


@register("r10_profile_names", sql_with(["U", "INC", "SRV"], _names_sql()))
def r10_profile_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return CL.name_profiles(CL.cluster_profile(segment_clusters(spark, sf_dir)))


@register("j8_profile_lookup", sql_with(["U", "INC", "SRV"], _names_sql().rsplit("\nSELECT PF.cluster", 1)[0] + """
, NM AS (SELECT PF.cluster, COALESCE(BE.label, 'serveurs standard') AS profile_name
         FROM PF LEFT JOIN (SELECT * FROM BE WHERE rn = 1) BE ON PF.cluster = BE.cluster
         WHERE PF.cluster <> 'MACHINERY')
SELECT S.server_id, S.segment AS cluster, COALESCE(NM.profile_name, 'profil inconnu') AS profile_name
FROM SRV S LEFT JOIN NM ON S.segment = NM.cluster"""))
def j8_profile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored profiles for every segment but one; that segment's servers get
    the default name."""
    sc = segment_clusters(spark, sf_dir)
    names = CL.name_profiles(CL.cluster_profile(sc)).filter(F.col("cluster") != "MACHINERY")
    assign = A.servers(Tables(spark, sf_dir)).select("server_id", F.col("segment").alias("cluster"))
    return profile_lookup(assign, names, "cluster", ["profile_name"])


# --- quality indices on the embedding vectors ---------------------------------------------------
EMV_SQL = """
, EMV AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label AS cluster FROM embeddings),
PX AS (SELECT vec_id, cluster, UNNEST(x) AS v, UNNEST(range(1, len(x) + 1)) AS pos FROM EMV),
CS AS (SELECT cluster, pos, SUM(v) AS s FROM PX GROUP BY cluster, pos),
CN AS (SELECT cluster, COUNT(*) AS n, SUM(list_inner_product(x, x)) AS q FROM EMV GROUP BY cluster),
X2 AS (SELECT vec_id, list_inner_product(x, x) AS x2 FROM EMV)
"""


@register("v10_silhouette_sq", sql_with([], EMV_SQL + f"""
, DOTS AS (SELECT PX.vec_id, CS.cluster AS c, SUM(PX.v * CS.s) AS dot FROM PX JOIN CS ON PX.pos = CS.pos GROUP BY PX.vec_id, CS.cluster),
D AS (SELECT DOTS.vec_id, DOTS.c, CN.n, (CN.n * X2.x2 - 2.0 * DOTS.dot + CN.q) / CN.n AS d
      FROM DOTS JOIN CN ON DOTS.c = CN.cluster JOIN X2 ON DOTS.vec_id = X2.vec_id),
P AS (SELECT EMV.vec_id,
        MAX(CASE WHEN D.c = EMV.cluster THEN D.d * D.n / (D.n - 1) END) AS a,
        MAX(CASE WHEN D.c = EMV.cluster THEN D.n END) AS na,
        MIN(CASE WHEN D.c <> EMV.cluster THEN D.d END) AS b
      FROM EMV JOIN D ON EMV.vec_id = D.vec_id GROUP BY EMV.vec_id),
S AS (SELECT CASE WHEN na <= 1 THEN 0.0 WHEN a < b THEN 1.0 - a / b WHEN a > b THEN b / a - 1.0 ELSE 0.0 END AS s FROM P)
SELECT {r('CASE WHEN (SELECT COUNT(*) FROM CN) < 2 THEN -1.0 ELSE AVG(s) END', 4)} AS silhouette FROM S"""))
def v10_silhouette_sq(spark: SparkSession, sf_dir: str) -> DataFrame:
    em = A.vectors(Tables(spark, sf_dir))
    return CL.silhouette_sq(em, "embedding", "cluster").select(half_away_round(F.col("silhouette"), 4).alias("silhouette"))


@register("v10_silhouette_euclidean", sql_with([], f"""
, EMV AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, label AS cluster FROM embeddings),
PD AS (SELECT p.vec_id, p.cluster AS own, q.cluster, SUM(list_distance(p.x, q.x)) AS d, COUNT(*) AS n
       FROM EMV p, EMV q GROUP BY p.vec_id, p.cluster, q.cluster),
AB AS (SELECT vec_id, MAX(CASE WHEN cluster = own THEN n END) AS n,
              MAX(CASE WHEN cluster = own THEN d / GREATEST(n - 1, 1) END) AS a, MIN(CASE WHEN cluster <> own THEN d / n END) AS b
       FROM PD GROUP BY vec_id)
SELECT {r('AVG(CASE WHEN n <= 1 THEN 0.0 ELSE (b - a) / GREATEST(a, b) END)', 5)} AS silhouette FROM AB"""))
def v10_silhouette_euclidean(spark: SparkSession, sf_dir: str) -> DataFrame:
    em = A.vectors(Tables(spark, sf_dir))
    return silhouette_euclidean(em, "embedding", "cluster").select(half_away_round(F.col("silhouette"), 5).alias("silhouette"))


@register("v11_v13_cluster_indices", sql_with([], EMV_SQL + f"""
, CEN AS (SELECT cluster, pos, s / (SELECT n FROM CN WHERE CN.cluster = CS.cluster) AS c FROM CS),
DPT AS (SELECT PX.vec_id, PX.cluster, SQRT(SUM((PX.v - CEN.c) * (PX.v - CEN.c))) AS d
        FROM PX JOIN CEN ON PX.cluster = CEN.cluster AND PX.pos = CEN.pos GROUP BY PX.vec_id, PX.cluster),
SK AS (SELECT cluster, AVG(d) AS s_k FROM DPT GROUP BY cluster),
CC AS (SELECT a.cluster AS ca, b.cluster AS cb, SQRT(SUM((a.c - b.c) * (a.c - b.c))) AS dc
       FROM CEN a JOIN CEN b ON a.pos = b.pos AND a.cluster <> b.cluster GROUP BY a.cluster, b.cluster),
RA AS (SELECT ca, MAX((s1.s_k + s2.s_k) / dc) AS rmax FROM CC JOIN SK s1 ON CC.ca = s1.cluster JOIN SK s2 ON CC.cb = s2.cluster GROUP BY ca),
GM AS (SELECT pos, SUM(s) / (SELECT SUM(n) FROM CN) AS g FROM CS GROUP BY pos),
BW AS (SELECT SUM(CN.n * t.dd) AS between_ss FROM CN JOIN (SELECT CEN.cluster, SUM((CEN.c - GM.g) * (CEN.c - GM.g)) AS dd
        FROM CEN JOIN GM ON CEN.pos = GM.pos GROUP BY CEN.cluster) t ON CN.cluster = t.cluster),
WI AS (SELECT SUM(CN.q - CN.n * t.cc) AS within_ss FROM CN JOIN (SELECT cluster, SUM(c * c) AS cc FROM CEN GROUP BY cluster) t
        ON CN.cluster = t.cluster),
K AS (SELECT COUNT(*) AS k, SUM(n) AS nn FROM CN)
SELECT k AS n_clusters, {r('(SELECT AVG(rmax) FROM RA)', 4)} AS davies_bouldin,
       {r('CASE WHEN within_ss = 0 THEN 1.0 ELSE (between_ss / (k - 1)) / (within_ss / (nn - k)) END', 4)} AS calinski_harabasz,
       {r('within_ss', 4)} AS inertia
FROM K, BW, WI"""))
def v11_v13_cluster_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    em = A.vectors(Tables(spark, sf_dir))
    out = CL.davies_bouldin_calinski(em, "embedding", "cluster")
    return out.select("n_clusters", *[half_away_round(F.col(c), 4).alias(c) for c in
                                      ("davies_bouldin", "calinski_harabasz", "inertia")])
