"""Exact top-k per group that tolerates a hot group.

``row_number() <= k`` over ``PARTITION BY g`` is planned by Spark (3.5+) as
``WindowGroupLimit(Partial)`` *before* the shuffle and
``WindowGroupLimit(Final)`` after it: every map task forwards at most k rows
per group, so a group holding a third of all rows still reaches its final
task as at most ``k x map tasks`` rows.  The function only fixes the idiom
(filter on the rank directly above the window, total order with a
tiebreak) so that optimisation always applies.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, group_cols: Sequence[str], order: Sequence[Column],
                    k: int, rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k within each group by ``order`` (which must be a total order)."""
    k = max(int(k), 0)
    w = Window.partitionBy(*group_cols).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).filter(F.col(rank_col) <= F.lit(k))


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """Global top-n (S3/S4): ``orderBy().limit()`` plans as TakeOrderedAndProject,
    a per-partition bounded heap merged once; negative n gives no rows."""
    return df.orderBy(*order).limit(max(int(n), 0))
