"""Selection by refined grids against the plain aggregate."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetlens.operators.quantiles import quantile_columns


def _plain(df, keys, cols, q):
    return df.groupBy(*keys).agg(*[F.percentile(F.col(c), F.lit(q)).alias(f"{c}_q") for c in cols])


def _same(a, b, keys):
    key = lambda r: tuple((r[k] is not None, r[k]) for k in keys)
    a, b = ({key(r): r.asDict() for r in d.collect()} for d in (a, b))
    assert a.keys() == b.keys()
    for k in a:
        for c, v in a[k].items():
            w = b[k][c]
            assert v == w or (v is not None and w is not None and (math.isclose(v, w, rel_tol=1e-12, abs_tol=1e-12)
                                                                   or (math.isnan(v) and math.isnan(w)))), (k, c, v, w)


@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.9, 1.0])
def test_equal_to_the_aggregate_on_duplicates_nulls_and_skew(spark, q):
    rng = np.random.default_rng(11)
    rows = []
    for key, n in (("hot", 1500), ("cold", 40), (None, 300), ("nulls", 200)):
        for i in range(n):
            wide = float(10.0 ** rng.integers(-200, 200)) * (1 if i % 3 else -1)
            rows.append((key, 7.0 if i % 3 == 0 else float(rng.integers(0, 5)), wide, None if key == "nulls" or i % 4 else float(rng.normal()), 1.0))
    df = spark.createDataFrame(rows, "k string, dup double, wide double, some double, one double").repartition(6)
    cols = ["dup", "wide", "some", "one"]
    got = quantile_columns(df, ["k"], cols, q, "_q", buckets=8, bucket_rows=30)
    _same(_plain(df, ["k"], cols, q), got, ["k"])
    _same(_plain(df, [], cols, q), quantile_columns(df, [], cols, q, "_q", bucket_rows=50), [])


def test_nan_counts_as_the_largest(spark):
    df = spark.createDataFrame([(float(i),) for i in range(60)] + [(float("nan"),)] * 20, "x double")
    for q in (0.5, 0.9):
        v = quantile_columns(df, [], ["x"], q, "", bucket_rows=5).first()["x"]
        want = np.sort(np.r_[np.arange(60.0), np.full(20, np.nan)])
        h = q * 79
        assert v == want[int(h)] * (math.ceil(h) - h) + want[math.ceil(h)] * (h - int(h)) or math.isnan(v) and q == 0.9


def test_no_window_and_no_row_per_measure(spark):
    df = spark.createDataFrame([(i % 2, float(i)) for i in range(400)], "k int, x double")
    plan = quantile_columns(df, ["k"], ["x"], 0.5, "_q", bucket_rows=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Generate" not in plan


def test_keys_that_look_like_state(spark):
    df = spark.createDataFrame([("a", i % 3, float(i)) for i in range(100)], "x0 string, v0 int, n0 double")
    got = quantile_columns(df, ["x0", "v0"], ["n0"], 0.5, "_q", bucket_rows=5)
    _same(_plain(df, ["x0", "v0"], ["n0"], 0.5), got, ["x0", "v0"])


def test_many_groups_are_dealt_out_once_a_pass(spark, monkeypatch):
    """Past the broadcast limit rows go to their group's task and are aggregated there; large groups stay apart."""
    from fleetlens.operators import quantiles as Q
    monkeypatch.setattr(Q, "BROADCAST_GROUPS", 3)
    monkeypatch.setattr(Q, "HOT_ROWS", 100)
    passes = []
    gathered = Q._Selection.gathered
    monkeypatch.setattr(Q._Selection, "gathered", lambda self, cells, make: passes.append((self.groups, gathered(self, cells, make))) or passes[-1][1])
    rows = [(i % 9 if i % 9 else None, float(i * 37 % 501)) for i in range(450)] + [(1, float(i % 13)) for i in range(200)]
    df = spark.createDataFrame(rows, "k int, x double").repartition(5)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _same(_plain(df, ["k"], ["x"], 0.9), quantile_columns(df, ["k"], ["x"], 0.9, "_q", buckets=4, bucket_rows=10), ["k"])
        plans = {n: d._jdf.queryExecution().executedPlan().toString() for n, d in passes if "Join" in d._jdf.queryExecution().executedPlan().toString()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plans.keys() == {1, 8}  # the large group, and the others
    assert "SortMergeJoin" in plans[8] and plans[8].count("Exchange hashpartitioning") == 2  # the two sides of the join
