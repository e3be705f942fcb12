"""Structured Streaming form of the daily pipeline (re-aim; the reference has
no streaming).

Observations arrive as files.  A watermarked one-day tumbling aggregate per entity is emitted
once its day is closed (append mode, bounded state); a second stream reads those days, holds
the last ``HISTORY`` of each entity in keyed state and gives each new one its lags and rolling
statistics; each
micro-batch of closed days is ranked into the day's intervention list with the same column
rules as the batch plan (``foreachBatch``).  Sinks and checkpoints live in the shared folder
named by ``spark.checkpoint.dir``.

A bounded replay ends with days that no watermark has closed.  ``flush`` computes them from
the source once the stream has stopped: no row of an open day has been dropped, so the result
equals what the stream would have emitted.  Rows that came later than ``delay`` allows are
dropped by the watermark and counted.

Defined cases: rows without a time are in no day; a day without rows is not emitted; an empty
source gives empty outputs.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from fleetlens.functions import rules as R
from fleetlens.operators.topk import top_k_per_group
from fleetlens.operators.windows import history_features
from fleetlens.session import checkpoint_dir, cut_lineage

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
DAILY_SCHEMA = "date date, server_id long, n_obs long, n_error long, value_sum double"
RANK_SCHEMA = "date date, server_id long, incident_probability double, business_value double, priority_score double, rank int"
#: closed days of an entity that the state holds
HISTORY = 7
#: groups of entities with one state each: a fixed number, as states outlive a batch
HISTORY_GROUPS = 512
HISTORY_COLUMNS = ("value_sum_lag1", "value_sum_lag7", "value_sum_diff1", "value_sum_rolling_mean_3",
                   "value_sum_rolling_mean_7", "value_sum_rolling_std_7", "value_sum_rolling_max_7")
HISTORY_SCHEMA = DAILY_SCHEMA + "".join(f", {c} double" for c in HISTORY_COLUMNS)


@dataclass(frozen=True)
class Replay:
    """Where a bounded replay has put its outputs, and how many rows came too late."""

    daily: str
    ranking: str
    history: str
    late_rows: int


def daily_entity(events: DataFrame) -> DataFrame:
    """Per (entity, day): observations, errors and the value sum."""
    e = events.select(F.col("user_id").alias("server_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value") \
        if "user_id" in events.columns else events
    return (e.groupBy(F.window("ts", "1 day").alias("w"), "server_id")
             .agg(F.count(F.lit(1)).alias("n_obs"),
                  F.sum(R.flag(F.col("event_type") == "error")).cast("long").alias("n_error"),
                  F.sum("value").alias("value_sum"))
             .select(F.to_date(F.col("w.start")).alias("date"), "server_id", "n_obs", "n_error", "value_sum"))


def daily_entity_stream(events: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """``daily_entity`` of a stream, each day emitted when the watermark, ``delay`` behind the
    latest event, has passed its end."""
    e = events.select(F.col("user_id").alias("server_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return daily_entity(e.withWatermark("ts", delay))


def rank_day(batch: DataFrame, servers: DataFrame, n: int) -> DataFrame:
    """Per closed day: priority = error share x business value, top n per day."""
    j = batch.join(servers, "server_id", "left")
    prob = F.col("n_error") / (F.col("n_error") + F.lit(5.0))
    value = R.business_value("monthly_spend_eur", "support_plan", "has_gpu", "is_managed", "capacity_used_pct")
    scored = j.select("date", "server_id", prob.alias("incident_probability"), value.alias("business_value"))
    scored = scored.withColumn("priority_score", F.col("incident_probability") * F.col("business_value"))
    return top_k_per_group(scored, ["date"], [F.col("priority_score").desc(), F.col("server_id").asc()], n)


def _history_rows(values: np.ndarray, place: np.ndarray) -> dict[str, np.ndarray]:
    """The history columns of days that lie by entity and date; ``place``: how many days of its entity lie before a day."""
    back, known = np.zeros((HISTORY, len(values))), np.zeros((HISTORY, len(values)), bool)  # oldest first
    for n in range(1, HISTORY + 1):
        known[-n] = place >= n
        back[-n, n:] = values[:-n]
    back[~known] = 0.0

    def mean(n: int) -> np.ndarray:
        days = known[-n:].sum(0)
        return np.where(days > 0, back[-n:].sum(0) / np.maximum(days, 1), np.nan)

    days, week = known.sum(0), mean(HISTORY)
    gaps = np.where(known, (back - week) ** 2, 0.0).sum(0)
    first = back[HISTORY - np.maximum(days, 1), np.arange(len(values))]
    largest = np.fmax.reduce(np.where(known, back, -np.inf))
    lag1 = np.where(known[-1], back[-1], np.nan)
    columns = (lag1, np.where(known[-7], back[-7], np.nan), values - lag1, mean(3), week,
               np.where(days > 1, np.sqrt(gaps / np.maximum(days - 1, 1)), np.nan),
               np.where((days > 0) & ~np.isnan(first), largest, np.nan))
    return dict(zip(HISTORY_COLUMNS, columns))


def history_stream(daily: DataFrame) -> DataFrame:
    """Closed days with their history columns: the state holds the last ``HISTORY`` sums of each entity.
    Days close in order, so a batch's days follow those in the state.  A state is that of a group of
    entities, computed side by side: a call for every entity costs more than its days."""
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        days = pd.concat(list(batches))
        ids, sums = (np.asarray(v, t) for v, t in zip(state.get, (np.int64, float))) if state.exists else (np.zeros(0, np.int64), np.zeros(0))
        # the days in the state lie by entity and date, before those of the batch
        days = days.sort_values("date", kind="stable")
        entity = np.concatenate([ids, days["server_id"].to_numpy(np.int64)])
        values = np.concatenate([sums, days["value_sum"].to_numpy(float)])
        order = np.argsort(entity, kind="stable")
        entity, values = entity[order], values[order]
        place = np.arange(len(entity)) - np.searchsorted(entity, entity)
        after = np.searchsorted(entity, entity, side="right") - np.arange(len(entity))
        last = after <= HISTORY
        state.update((entity[last].tolist(), values[last].tolist()))
        new = order >= len(ids)
        rows = {c: v[new] for c, v in _history_rows(values, place).items()}
        yield days.iloc[order[new] - len(ids)].drop(columns="_group").assign(**rows, _none=key[0] < 0)

    none = F.col("server_id").isNull()
    grouped = daily.withColumns({"_group": F.when(none, F.lit(-1)).otherwise(F.pmod(F.xxhash64("server_id"), F.lit(HISTORY_GROUPS)).cast("int")),
                                 "server_id": F.coalesce("server_id", F.lit(0).cast("long"))})
    rows = grouped.groupBy("_group").applyInPandasWithState(
        step, HISTORY_SCHEMA + ", _none boolean", "ids array<long>, sums array<double>", "append", GroupStateTimeout.NoTimeout)
    return rows.withColumn("server_id", F.when(~F.col("_none"), F.col("server_id"))).drop("_none")


def _sink(path: str, make=lambda batch: batch):
    """One output folder an epoch, overwritten: a batch that runs again replaces its own output."""
    def write(batch: DataFrame, epoch: int) -> None:
        make(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return write


def _run(stream: DataFrame, sinks, checkpoint: str):
    q = (stream.writeStream.outputMode("append").foreachBatch(sinks)
               .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except Exception as e:  # no epoch was written
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def replay_daily(spark: SparkSession, source_dir: str, servers: DataFrame, n: int = 50, out_root: str | None = None,
                 file_glob: str = "*.parquet", delay: str = "0 seconds", files_per_trigger: int = 1,
                 flush: bool = True) -> Replay:
    """Process every file of ``source_dir`` that matches ``file_glob``, then flush the open days."""
    root = out_root or f"{checkpoint_dir(spark).rstrip('/')}/fleetlens-stream-{uuid.uuid4().hex}"
    out = Replay(f"{root}/daily", f"{root}/ranking", f"{root}/history", 0)
    servers = cut_lineage(servers)

    events = (spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
                   .option("pathGlobFilter", file_glob).parquet(source_dir))

    def both(batch: DataFrame, epoch: int) -> None:
        _sink(out.daily)(batch, epoch)
        written = spark.read.schema(DAILY_SCHEMA).parquet(f"{out.daily}/epoch={epoch}")
        _sink(out.ranking, lambda b: rank_day(b, servers, n))(written, epoch)

    q = _run(daily_entity_stream(events, delay), both, f"{root}/_daily")
    late = sum(op.get("numRowsDroppedByWatermark", 0) for p in q.recentProgress for op in p["stateOperators"])
    mark = (q.lastProgress or {}).get("eventTime", {}).get("watermark")
    # a second stream reads what the first has written: its files come in the order of their epochs
    if not _read(spark, out.daily, DAILY_SCHEMA).isEmpty():
        closed_days = spark.readStream.schema(DAILY_SCHEMA).option("recursiveFileLookup", "true").parquet(out.daily)
        _run(history_stream(closed_days), _sink(out.history), f"{root}/_history")
    if flush:
        batch = spark.read.schema(EVENT_SCHEMA).option("pathGlobFilter", file_glob).parquet(source_dir)
        day_end = F.to_date("ts").cast("timestamp") + F.expr("INTERVAL 1 DAY")
        closed = F.lit(mark).cast("timestamp") if mark else F.lit(None).cast("timestamp")
        rest = cut_lineage(daily_entity(batch.where(F.coalesce(day_end > closed, F.lit(True)) & F.col("ts").isNotNull())))
        _sink(out.daily)(rest, "flush")
        _sink(out.ranking, lambda b: rank_day(b, servers, n))(rest, "flush")
        # no open day looks further back than the last closed days of its entity
        before = top_k_per_group(_read(spark, out.history, HISTORY_SCHEMA).select(*rest.columns), ["server_id"],
                                 [F.col("date").desc()], HISTORY).drop("rank").withColumn("_open", F.lit(0))
        days = before.unionByName(rest.withColumn("_open", F.lit(1)))
        h = history_features(days, "server_id", ["date"], ["value_sum"])
        _sink(out.history)(h.where("_open = 1").select(*rest.columns, *HISTORY_COLUMNS), "flush")
    return Replay(out.daily, out.ranking, out.history, late)


def run_daily_stream(spark: SparkSession, source_dir: str, servers: DataFrame, n: int = 50,
                     out_root: str | None = None, file_glob: str = "*.parquet") -> tuple[str, str]:
    """The closed days alone: paths of the daily aggregates and the rankings."""
    out = replay_daily(spark, source_dir, servers, n, out_root, file_glob, flush=False)
    return out.daily, out.ranking
