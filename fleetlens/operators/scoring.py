"""Batch scoring post-processing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def minmax_normalize(df: DataFrame, score: str, out: str = "norm_score") -> DataFrame:
    """(s - min) / (max - min), 0 when constant (B30).  min and max are two
    numbers of one aggregate, read once and applied as literals."""
    row = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    lo, hi = F.lit(row["lo"]).cast("double"), F.lit(row["hi"]).cast("double")
    return df.withColumn(out, F.when(hi - lo == 0, F.lit(0.0)).otherwise((F.col(score) - lo) / (hi - lo)))
