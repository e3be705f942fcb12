"""Intervention ranking (R5) and the sort/limit operators it uses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import rules as R
from fleetlens.operators.topk import top_n
from fleetlens.operators.windows import rank_enumerate

# Fixed value: default length of the daily intervention list.
DEFAULT_TOP_N = 50


def prioritize(candidates: DataFrame, n: int = DEFAULT_TOP_N, key: str = "server_id",
               probability: str = "incident_probability",
               spend: str = "monthly_spend_eur", plan: str = "support_plan",
               has_gpu: str = "has_gpu", is_managed: str = "is_managed",
               capacity: str = "capacity_used_pct",
               anomaly_score: str | None = None, anomaly_threshold=None,
               segment_profile: str | None = None,
               keep: Sequence[str] = ()) -> DataFrame:
    """priority = probability x business value; top n by priority (key breaks
    ties); rank 1..n (R5 with B25, B24, S3, E8).

    Anomaly and segment outputs are context columns with their multipliers;
    they annotate the row and never change the score.  The top-n is a
    TakeOrderedAndProject (bounded heap per partition), and only its n rows
    are numbered.
    """
    value = R.business_value(spend, plan, has_gpu, is_managed, capacity)
    cols = [F.col(key), *[F.col(c) for c in keep],
            F.col(probability).cast("double").alias("incident_probability"),
            value.alias("business_value")]
    if anomaly_score:
        cols += [F.col(anomaly_score).alias("anomaly_score"),
                 (F.col(anomaly_score) >= F.lit(anomaly_threshold)).alias("is_anomaly"),
                 R.anomaly_severity(anomaly_score, anomaly_threshold).alias("anomaly_severity"),
                 R.anomaly_multiplier(anomaly_score, anomaly_threshold).alias("anomaly_context_multiplier")]
    if segment_profile:
        cols += [F.col(segment_profile).alias("segment_profile"),
                 R.segment_multiplier(segment_profile).alias("segmentation_context_multiplier")]
    scored = candidates.select(*cols).withColumn(
        "priority_score", F.col("incident_probability") * F.col("business_value"))
    order = [F.col("priority_score").desc(), F.col(key).asc()]
    return rank_enumerate(top_n(scored, order, n), order)


def prioritize_scored(scored: DataFrame, anomaly_threshold: float, n: int = DEFAULT_TOP_N, key: str = "server_id",
                      date: str = "date") -> DataFrame:
    """The response of a prioritisation from three models (R5, J9): rows that carry
    incident_probability, anomaly_score, segment_cluster and segment_profile beside the inputs of
    the business value.  Ties in priority go to the smaller key; a negative ``n`` or no rows give none."""
    value = R.business_value("monthly_spend_eur", "support_plan", "has_gpu", "is_managed", "capacity_used_pct")
    rows = scored.select(
        key, date, F.col("incident_probability"), value.alias("business_value"), "anomaly_score",
        (F.col("anomaly_score") >= F.lit(anomaly_threshold)).alias("is_anomaly"),
        R.anomaly_multiplier("anomaly_score", anomaly_threshold).alias("anomaly_context_multiplier"),
        "segment_cluster", "segment_profile", R.segment_multiplier("segment_profile").alias("segmentation_context_multiplier"))
    rows = rows.withColumn("priority_score", F.col("incident_probability") * F.col("business_value"))
    order = [F.col("priority_score").desc(), F.col(key).asc()]
    return rank_enumerate(top_n(rows, order, n), order)


def latest_rows(df: DataFrame, n: int, date_col: str = "date",
                tiebreak: Sequence[str] = ("server_id",)) -> DataFrame:
    """The n most recent rows, ties by the tiebreak columns."""
    return top_n(df, [F.col(date_col).desc(), *[F.col(c).asc() for c in tiebreak]], n)
