"""Structured Streaming daily windows: closed days only, ranking per day."""

import os
import tempfile

from pyspark.sql import functions as F

from fleetlens.streaming.daily import replay_daily, run_daily_stream


def test_daily_stream_closed_days(spark):
    src = tempfile.mkdtemp(prefix="fleetlens-src-")
    rows = [(1, "2024-01-01 10:00:00", 7, "error", 5.0, "{}"), (2, "2024-01-01 11:00:00", 7, "view", 1.0, "{}"),
            (3, "2024-01-02 09:00:00", 8, "error", 2.0, "{}"), (4, "2024-01-03 08:00:00", 7, "view", 3.0, "{}")]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.to_timestamp_ntz("ts")).coalesce(1).write.parquet(os.path.join(src, "part"))
    servers = spark.createDataFrame([(7, 100.0, "basic", 0, 0, 0.0), (8, 50.0, "premium", 1, 0, 0.0)],
                                    "server_id long, monthly_spend_eur double, support_plan string, "
                                    "has_gpu int, is_managed int, capacity_used_pct double")
    agg, rank = run_daily_stream(spark, os.path.join(src, "part"), servers, n=1,
                                 out_root=tempfile.mkdtemp(prefix="fleetlens-out-"))
    got = sorted((str(r.date), r.server_id, r.n_obs, r.n_error) for r in spark.read.parquet(agg).drop("epoch").collect())
    # 2024-01-03 is still open (watermark = last event time)
    assert got == [("2024-01-01", 7, 2, 1), ("2024-01-02", 8, 1, 1)]
    top = sorted((str(r.date), r.server_id) for r in spark.read.parquet(rank).drop("epoch").collect())
    assert top == [("2024-01-01", 7), ("2024-01-02", 8)]


def _file(spark, folder, rows):
    """One more file, later than those before it."""
    df = spark.createDataFrame([(i, t, u, k, v, "{}") for i, t, u, k, v in rows],
                               "event_id long, ts string, user_id long, event_type string, value double, props string")
    df.withColumn("ts", F.to_timestamp_ntz("ts")).coalesce(1).write.mode("append").parquet(folder)


def test_late_rows_over_several_files_flush_and_history(spark):
    src = os.path.join(tempfile.mkdtemp(prefix="fleetlens-src-"), "events")
    day = lambda d, h=1: f"2024-01-{d:02d} {h:02d}:00:00"
    _file(spark, src, [(i, day(i), 7, "view", float(i)) for i in range(1, 6)])
    _file(spark, src, [(10, day(4, 5), 7, "error", 100.0), (11, day(7), 8, "view", 2.0)])      # one day late: within two days
    _file(spark, src, [(12, day(1, 9), 7, "error", 50.0), (13, day(2, 9), 8, "view", 1.0), (14, day(9), 7, "view", 9.0)])
    servers = spark.createDataFrame([(7, 100.0, "basic", 0, 0, 0.0)], "server_id long, monthly_spend_eur double, "
                                    "support_plan string, has_gpu int, is_managed int, capacity_used_pct double")
    out = replay_daily(spark, src, servers, out_root=tempfile.mkdtemp(prefix="fleetlens-out-"), delay="2 days")
    got = {(r.date.day, r.server_id): (r.n_obs, r.value_sum) for r in spark.read.parquet(out.daily).collect()}
    assert out.late_rows == 2  # rows 12 and 13 came after their days had closed
    assert got == {(1, 7): (1, 1.0), (2, 7): (1, 2.0), (3, 7): (1, 3.0), (4, 7): (2, 104.0), (5, 7): (1, 5.0), (7, 8): (1, 2.0), (9, 7): (1, 9.0)}
    h = {(r.date.day, r.server_id): r for r in spark.read.parquet(out.history).collect()}
    assert h.keys() == got.keys()
    assert h[5, 7].value_sum_lag1 == 104.0 and abs(h[5, 7].value_sum_rolling_mean_3 - 109.0 / 3) < 1e-12
    assert h[9, 7].value_sum_rolling_max_7 == 104.0 and h[9, 7].value_sum_diff1 == 4.0
    assert spark.read.parquet(out.ranking).where("date = '2024-01-09'").count() == 1


def test_entities_share_the_states_of_their_groups(spark, monkeypatch):
    """Two groups for six entities, one of them null, over several batches: each keeps its own days."""
    from fleetlens.operators.windows import history_features
    from fleetlens.streaming import daily as D
    monkeypatch.setattr(D, "HISTORY_GROUPS", 2)
    src = os.path.join(tempfile.mkdtemp(prefix="fleetlens-src-"), "events")
    for first in (1, 6, 11):
        _file(spark, src, [(d * 10 + i, f"2024-01-{d:02d} 01:00:00", u, "view", float(d * d + i)) for d in range(first, first + 5)
                           for i, u in enumerate((1, 2, 3, 4, 5, None)) if (d + i) % 4])
    servers = spark.createDataFrame([(1, 100.0, "basic", 0, 0, 0.0)], "server_id long, monthly_spend_eur double, "
                                    "support_plan string, has_gpu int, is_managed int, capacity_used_pct double")
    out = replay_daily(spark, src, servers, out_root=tempfile.mkdtemp(prefix="fleetlens-out-"))
    assert out.late_rows == 0
    rows = lambda df: {(r.date.day, r.server_id): [round(r[c], 9) if r[c] is not None and r[c] == r[c] else None for c in D.HISTORY_COLUMNS]
                       for r in df.collect()}
    want = rows(history_features(D.daily_entity(spark.read.parquet(src)), "server_id", ["date"], ["value_sum"]))
    assert rows(spark.read.schema(D.HISTORY_SCHEMA).parquet(out.history)) == want and len(want) > 60
