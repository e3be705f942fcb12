"""History features over ordered observations.

All history columns of one call share a single ``WindowSpec`` so Catalyst
plans one shuffle on the key and one sort for every lag/rolling column.
Frames end at the previous row: the current value never leaks into its own
history features.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.operators.topk import top_k_per_group


#: before every chunk of dated rows
NO_DATE_CHUNK = -10 ** 12


def _feature_columns(cols, lags, mean_windows, std_window, max_window, diff, w) -> dict[str, Column]:
    new: dict[str, Column] = {}
    for c in cols:
        x = F.col(c)
        for n in lags:
            new[f"{c}_lag{n}"] = F.lag(x, n).over(w)
        if diff:
            new[f"{c}_diff1"] = x - F.lag(x, 1).over(w)
        for m in mean_windows:
            new[f"{c}_rolling_mean_{m}"] = F.avg(x).over(w.rowsBetween(-m, -1))
        if std_window:
            new[f"{c}_rolling_std_{std_window}"] = F.stddev_samp(x).over(w.rowsBetween(-std_window, -1))
        if max_window:
            new[f"{c}_rolling_max_{max_window}"] = F.max(x).over(w.rowsBetween(-max_window, -1))
    return new


def _is_time(df: DataFrame, col: str) -> bool:
    return isinstance(df.schema[col].dataType, (T.DateType, T.TimestampType, T.TimestampNTZType))


def history_features(df: DataFrame, key: str | Sequence[str], order: Sequence[str],
                     cols: Sequence[str], lags: Sequence[int] = (1, 7),
                     mean_windows: Sequence[int] = (3, 7), std_window: int | None = 7,
                     max_window: int | None = 7, diff: bool = True,
                     skew_safe: bool = True, chunk_days: int = 7,
                     hot_share: float | None = None, min_hot_rows: int = 100_000) -> DataFrame:
    """Per column: ``lag{n}`` (E1), ``diff1`` = x - lag1 (E2), ``rolling_mean_{w}`` over
    the previous w rows (E3, >= 1 row), ``rolling_std_{w}`` sample std (E4, >= 2 rows,
    else NULL), ``rolling_max_{w}`` (E5).

    ``skew_safe`` (default) splits hot keys so that no key's history runs in
    a single task: see ``chunked_window``.  It applies when the leading
    ``order`` column is a date or timestamp.
    """
    keys = [key] if isinstance(key, str) else list(key)
    reach = max([*lags, *mean_windows, std_window or 0, max_window or 0, 1])

    def make(w):
        return _feature_columns(cols, lags, mean_windows, std_window, max_window, diff, w)

    if skew_safe and order and _is_time(df, order[0]):
        return chunked_window(df, keys, list(order), make, back=reach, fwd=0,
                              chunk_days=chunk_days, hot_share=hot_share, min_hot_rows=min_hot_rows)
    w = Window.partitionBy(*keys).orderBy(*[F.col(o) for o in order])
    return df.withColumns(make(w))


def chunked_window(df: DataFrame, keys: Sequence[str], order: Sequence[str], make_cols,
                   back: int, fwd: int, chunk_days: int = 7, hot_share: float | None = None,
                   min_hot_rows: int = 100_000) -> DataFrame:
    """Row-frame window columns (``make_cols(window_spec) -> {name: Column}``)
    that look at most ``back`` rows behind and ``fwd`` rows ahead, exact, with
    hot keys split into time chunks.

    * A key is hot when it holds more than ``hot_share`` of all rows
      (default 1 / (4 x shuffle partitions)) and more than ``min_hot_rows``
      rows (smaller keys fit any task), so there are at most 1 / hot_share
      hot keys: that key set is read back and broadcast.  With no hot key
      the plain window runs.
    * Rows of a hot key are windowed per (key, chunk of ``chunk_days``
      days); other keys keep one window partition each.
    * A chunk needs the ``back`` rows before it and the ``fwd`` rows after
      it.  The last ``back`` (first ``fwd``) rows of every hot chunk -- a
      partial top-k -- are copied as halo rows into each later (earlier)
      chunk for which they are among those neighbours, found from per-chunk
      cumulative counts, so sparse chunks are handled exactly.  A chunk
      receives at most back^2 + fwd^2 halo rows.
    * Columns are computed over chunk + halo, then halo rows are dropped.
    """
    keys = list(keys)
    spark = df.sparkSession
    share = hot_share or 1.0 / (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    w_plain = Window.partitionBy(*keys).orderBy(*[F.col(o) for o in order])
    # Key sizes: one partial-aggregating pass gives the total and the
    # largest key; only when some key is hot is the (<= 1/share) hot-key
    # list read back.
    cnt = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    total, biggest = cnt.agg(F.sum("_n"), F.max("_n")).first()
    limit = max((total or 0) * share, min_hot_rows)
    if biggest is None or biggest <= limit:
        return df.withColumns(make_cols(w_plain))
    hot_rows_list = cnt.filter(F.col("_n") > F.lit(limit)).select(*keys).collect()
    hot = spark.createDataFrame(hot_rows_list, cnt.select(*keys).schema).withColumn("_hot", F.lit(True))
    d = df.join(F.broadcast(hot), keys, "left")
    day = F.datediff(F.to_date(F.col(order[0])), F.to_date(F.lit("1970-01-01")))
    # rows without a date sort first, so their chunk does too
    d = d.withColumn("_hot", F.coalesce("_hot", F.lit(False))).withColumn("_chunk", F.when(
        F.col("_hot"), F.coalesce(F.floor(day / F.lit(chunk_days)), F.lit(NO_DATE_CHUNK)))
        .otherwise(F.lit(0)).cast("long"))
    d = d.withColumn("_halo", F.lit(0))
    payload = [c for c in d.columns if c not in ("_chunk", "_halo")]

    hot_rows = d.filter("_hot")
    # chunk table: hot keys only, one row per (key, chunk) -- bounded by
    # (number of hot keys) x (time span / chunk_days)
    tab = hot_rows.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_c"))
    tab = tab.withColumn("_cum", F.sum("_c").over(Window.partitionBy(*keys).orderBy("_chunk")))
    dst = tab.select(*[F.col(k).alias(f"_t_{k}") for k in keys], F.col("_chunk").alias("_t"),
                     F.col("_cum").alias("_t_cum"), (F.col("_cum") - F.col("_c")).alias("_t_prev"))
    parts = [d]
    for n, asc in ((back, False), (fwd, True)):
        if n <= 0:
            continue
        o = [F.col(c).asc() if asc else F.col(c).desc() for c in order]
        edge = top_k_per_group(hot_rows, [*keys, "_chunk"], o, n, "_r")
        edge = edge.join(tab.select(*keys, "_chunk", "_c", "_cum"), [*keys, "_chunk"])
        same = [edge[k] == dst[f"_t_{k}"] for k in keys]
        if asc:   # head rows of a later chunk serve earlier chunks
            cond = same + [dst["_t"] < edge["_chunk"],
                           (edge["_cum"] - edge["_c"]) - dst["_t_cum"] <= F.lit(n) - edge["_r"]]
        else:     # tail rows of an earlier chunk serve later chunks
            cond = same + [dst["_t"] > edge["_chunk"],
                           dst["_t_prev"] - edge["_cum"] <= F.lit(n) - edge["_r"]]
        parts.append(edge.join(F.broadcast(dst), cond).select(
            *[F.col(c) for c in payload], F.col("_t").alias("_chunk"), F.lit(1).alias("_halo")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    w = Window.partitionBy(*keys, "_chunk").orderBy(*[F.col(o) for o in order])
    return both.withColumns(make_cols(w)).filter(F.col("_halo") == 0).drop("_chunk", "_halo", "_hot")


def lead_target(df: DataFrame, key: str | Sequence[str], order: Sequence[str], col: str,
                target: str, steps: int = 1, drop_last: bool = True, skew_safe: bool = True,
                chunk_days: int = 7, hot_share: float | None = None,
                min_hot_rows: int = 100_000) -> DataFrame:
    """Next-step value of ``col`` as ``target`` (E6); rows without one are dropped.
    Hot keys are split like ``history_features`` (forward halo)."""
    keys = [key] if isinstance(key, str) else list(key)

    def make(w):
        return {target: F.lead(F.col(col), steps).over(w)}

    if skew_safe and order and _is_time(df, order[0]):
        out = chunked_window(df, keys, list(order), make, back=0, fwd=steps,
                             chunk_days=chunk_days, hot_share=hot_share, min_hot_rows=min_hot_rows)
    else:
        out = df.withColumns(make(Window.partitionBy(*keys).orderBy(*[F.col(o) for o in order])))
    return out.dropna(subset=[target]) if drop_last else out


def rank_enumerate(df: DataFrame, order: Sequence[Column], rank_col: str = "rank") -> DataFrame:
    """1..n numbering of an already limited result.

    Only apply after ``limit(n)``: the window has no partition key, so it
    sees the n surviving rows in one task by design.
    """
    return df.withColumn(rank_col, F.row_number().over(Window.orderBy(*order)))
