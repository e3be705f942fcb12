"""Dataset splits and samples.

Random splits are hash based: a row's side depends only on its key and the
seed, so it is stable under repartitioning and task re-runs (unlike
``randomSplit``, whose result depends on partition layout).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators.topk import top_n

SCALE = 10000


def _keys(key) -> list[Column]:
    return [F.col(k) for k in ([key] if isinstance(key, str) else key)]


def hash_unit(key: str | Sequence[str], seed: int = 42) -> Column:
    """Deterministic bucket in [0, 10000) from the key and the seed."""
    return F.pmod(F.xxhash64(*_keys(key), F.lit(seed)), F.lit(SCALE))


def temporal_split(df: DataFrame, date_col: str, cut: str) -> tuple[DataFrame, DataFrame]:
    """(date < cut, date >= cut) -- both filters reach the Parquet scan (B2)."""
    d = F.to_date(F.lit(cut))
    return df.filter(F.col(date_col) < d), df.filter(F.col(date_col) >= d)


def hash_split(df: DataFrame, key, test_frac: float = 0.2, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(train, test) with test = hash bucket < test_frac."""
    u = hash_unit(key, seed)
    cut = F.lit(int(round(test_frac * SCALE)))
    return df.filter(u >= cut), df.filter(u < cut)


def stratified_split(df: DataFrame, key, label: str, test_frac: float = 0.2,
                     seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Per-class hash split (P2): every class is cut at the same hash bucket,
    so each class keeps ``test_frac`` of its rows in expectation.  No window
    over a class (a class can be half the data), no sampling state."""
    u = hash_unit([*([key] if isinstance(key, str) else key), label], seed)
    cut = F.lit(int(round(test_frac * SCALE)))
    return df.filter(u >= cut), df.filter(u < cut)


def sample_n(df: DataFrame, n: int, key, seed: int = 42) -> DataFrame:
    """Deterministic n-row sample without replacement (P3): the n smallest
    hashes -- a bounded per-partition heap merged once (TakeOrderedAndProject)."""
    return top_n(df.withColumn("_h", F.xxhash64(*_keys(key), F.lit(seed))),
                 [F.col("_h"), *_keys(key)], n).drop("_h")


def kfold(df: DataFrame, key, k: int = 3, seed: int = 42, fold_col: str = "fold") -> DataFrame:
    """Shuffled K-fold id in [0, k) (P4), usable as ``CrossValidator(foldCol=)``."""
    return df.withColumn(fold_col, F.pmod(F.xxhash64(*_keys(key), F.lit(seed)), F.lit(k)).cast("int"))


def time_blocks(df: DataFrame, date_col: str = "date", k: int = 3, block_col: str = "block") -> DataFrame:
    """Expanding-window time folds (P5): the distinct dates are cut into k+1
    ordered blocks of near-equal date count; fold i trains on blocks < i and
    tests on block i (i = 1..k).  Whole dates stay in one block.

    The distinct-date table is one row per calendar day, so ranking it in
    one task is bounded by the time span; whether it is broadcast back is
    left to its measured size.
    """
    dates = df.select(date_col).distinct()
    blocks = dates.withColumn(block_col, F.ntile(k + 1).over(Window.orderBy(date_col)) - 1)
    return df.join(blocks, date_col)


def time_fold(df_blocks: DataFrame, i: int, block_col: str = "block") -> tuple[DataFrame, DataFrame]:
    return df_blocks.filter(F.col(block_col) < i), df_blocks.filter(F.col(block_col) == i)


def stratified_split_exact(df: DataFrame, key, label: str, test_frac: float = 0.2, seed: int = 42,
                           bits: int = 10) -> tuple[DataFrame, DataFrame]:
    """Per-class exact split (P2): in every class the ``round(test_frac * n_c)``
    rows with the smallest key hash form the test side.

    A class can be half the data, so no window runs over a whole class: the
    64-bit hash is uniform, its top ``bits`` bits cut each class into 2^bits
    equal hash ranges (deterministic, no sampling).  Range counts (classes x
    2^bits rows, broadcast) show which ranges lie wholly before or after the
    cut; only the one range holding the cut is ranked.
    """
    h = F.xxhash64(*_keys(key), F.lit(seed))
    d = df.withColumn("_h", h).withColumn("_bk", F.shiftright(F.col("_h"), 64 - bits))
    cnt = d.groupBy(label, "_bk").agg(F.count(F.lit(1)).alias("_c"))
    cnt = (cnt.withColumn("_cum", F.sum("_c").over(Window.partitionBy(label).orderBy("_bk")))
              .withColumn("_n", F.sum("_c").over(Window.partitionBy(label)))
              .withColumn("_k", F.round(F.col("_n") * F.lit(float(test_frac))).cast("long"))
              .withColumn("_prev", F.col("_cum") - F.col("_c")))
    # classes x 2^bits rows: bounded by the parameter, broadcast
    # NULL is a class of its own
    cnt = cnt.select(F.col(label).alias("_class"), F.col("_bk").alias("_range"), "_prev", "_cum", "_k")
    d = d.join(F.broadcast(cnt), F.col(label).eqNullSafe(F.col("_class")) & (F.col("_bk") == F.col("_range"))) \
        .drop("_class", "_range")
    cut = (F.col("_prev") < F.col("_k")) & (F.col("_k") < F.col("_cum"))
    whole = d.filter(~cut).withColumn("_test", F.col("_cum") <= F.col("_k"))
    part = d.filter(cut)
    part = part.withColumn("_test", F.col("_prev") + F.row_number().over(
        Window.partitionBy(label, "_bk").orderBy("_h", *_keys(key))) <= F.col("_k"))
    out = whole.unionByName(part).drop("_h", "_bk", "_prev", "_cum", "_k")
    return out.filter(~F.col("_test")).drop("_test"), out.filter(F.col("_test")).drop("_test")
