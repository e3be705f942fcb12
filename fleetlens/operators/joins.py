"""Joins of the fleet model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.operators.features import assert_unique

# Fixed value: profile name used when a cluster has no stored profile.
UNKNOWN_PROFILE = "profil inconnu"


def assemble_fact(fact: DataFrame, dims: Sequence[tuple[DataFrame, list[str]]]) -> DataFrame:
    """Star assembly (J1): ``fact`` LEFT JOIN each dimension on its keys.

    Every dimension key is checked unique first (one aggregate over the key
    columns; a duplicate raises), so the result keeps
    exactly one row per fact row.  Dimension sizes are left to AQE: it
    broadcasts a side only after measuring it at runtime.
    """
    out = fact
    for dim, keys in dims:
        out = out.join(assert_unique(dim, keys), keys, "left")
    return out


def label_horizon(obs: DataFrame, events: DataFrame, key: str = "server_id",
                  date_col: str = "date", start: int = 1, end: int = 7,
                  label: str = "label") -> DataFrame:
    """label = 1 iff the entity has an event on day d+start .. d+end.

    Range condition turned into an equi-join: each event is expanded to the
    (end-start+1) observation dates it labels, de-duplicated, and joined on
    (key, date).  The expansion is a fixed factor of the event log, never a
    pair set, and the join is a plain hash/sort-merge equi-join.
    """
    offsets = F.sequence(F.lit(start), F.lit(end))
    hits = (events.select(key, date_col)
                  .distinct()
                  .select(key, F.explode(offsets).alias("_off"), F.col(date_col).alias("_ev"))
                  .select(key, F.date_sub(F.col("_ev"), F.col("_off")).alias(date_col))
                  .distinct()
                  .withColumn("_hit", F.lit(1)))
    return (obs.join(hits, [key, date_col], "left")
               .withColumn(label, F.coalesce(F.col("_hit"), F.lit(0)))
               .drop("_hit"))


def label_next_rows(obs: DataFrame, key: str, order: Sequence[str], flag_col: str,
                    rows: int = 7, label: str = "label", min_hot_rows: int = 100_000) -> DataFrame:
    """Observation-count variant of J6: any flagged row among the next ``rows``
    rows.  Hot keys are split into time chunks when the leading order column
    is a date (see ``windows.chunked_window``)."""
    from fleetlens.operators.windows import _is_time, chunked_window

    def make(w):
        return {label: F.coalesce(F.max(F.col(flag_col)).over(w.rowsBetween(1, rows)), F.lit(0))}

    if order and _is_time(obs, order[0]):
        return chunked_window(obs, [key], list(order), make, back=0, fwd=rows, min_hot_rows=min_hot_rows)
    return obs.withColumns(make(Window.partitionBy(key).orderBy(*[F.col(o) for o in order])))


def prev_day_join(panel: DataFrame, group: str = "region", date_col: str = "date",
                  cols: Sequence[str] = (), suffix: str = "_prev_day") -> DataFrame:
    """Attach the previous calendar day's values of ``cols``.

    The panel is shifted by one day and equi-joined on (group, date); a
    missing previous day gives NULLs.  Both sides are keyed the same way, so
    one shuffle serves the join.
    """
    prev = panel.select(F.col(group), F.date_add(F.col(date_col), 1).alias(date_col),
                        *[F.col(c).alias(f"{c}{suffix}") for c in cols])
    return panel.join(prev, [group, date_col], "left")


def prev_day_names(df: DataFrame, cols: Sequence[str], suffix: str = "_prev_day",
                   to_previous: bool = True) -> DataFrame:
    """Rename current-day columns to their ``_prev_day`` names or back (B18),
    e.g. to feed today's region metrics to a model trained on lagged ones."""
    mapping = ({c: f"{c}{suffix}" for c in cols} if to_previous
               else {f"{c}{suffix}": c for c in cols})
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def full_align(series: Sequence[DataFrame], key: str = "date") -> DataFrame:
    """Full outer alignment of several keyed series, missing -> 0."""
    out = series[0]
    for s in series[1:]:
        out = out.join(s, key, "full_outer")
    return out.fillna(0)


def profile_lookup(assignments: DataFrame, profiles: DataFrame, cluster: str = "cluster",
                   cols: Sequence[str] = ("profile_name", "profile_driver")) -> DataFrame:
    """cluster -> stored profile name/driver, default ``profil inconnu``.

    ``profiles`` has one row per cluster (k rows, k a model parameter), so
    the broadcast is bounded by the model, not by the data.
    """
    p = profiles.select(cluster, *cols)
    out = assignments.join(F.broadcast(p), cluster, "left")
    if "profile_name" in cols:
        out = out.withColumn("profile_name", F.coalesce(F.col("profile_name"), F.lit(UNKNOWN_PROFILE)))
    return out


def gather_scores(base: DataFrame, others: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Per-(entity, date) outputs of several models side by side."""
    out = base
    for o in others:
        out = out.join(o, list(keys), "left")
    return out
