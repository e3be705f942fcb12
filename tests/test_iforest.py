"""Isolation forest: samples against all rows, walks and scores against a plain reading."""

import math

import numpy as np
import xxhash

from fleetlens.operators import iforest as I


def _table(spark, n, d=3, seed=1):
    x = np.random.default_rng(seed).normal(size=(n, d))
    return x, spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").repartition(5)


def test_samples_are_the_smallest_hashes_of_all_rows(spark):
    from pyspark.sql import functions as F
    _, df = _table(spark, 3000)
    got = {}
    for r in I.tree_samples(df, "x", ["id"], n_trees=7, sample_size=16).collect():
        got.setdefault(r["tree"], set()).add(r["id"])
    base = df.select("id", F.xxhash64("id", F.col("x").cast("array<double>")).alias("b"))
    for t in range(7):
        rows = base.select("id", F.xxhash64("b", F.lit(t), F.lit(42)).alias("h")).collect()
        assert got[t] == {i for _, i in sorted((r["h"], r["id"]) for r in rows)[:16]}


def test_a_cut_that_finds_too_few_is_repaired(spark, monkeypatch):
    _, df = _table(spark, 2000)
    want = {(r["tree"], r["id"]) for r in I.tree_samples(df, "x", ["id"], 5, 32).collect()}
    monkeypatch.setattr(I, "HASHES", 2.0 ** 60)  # the cut now lies near the smallest hash
    assert {(r["tree"], r["id"]) for r in I.tree_samples(df, "x", ["id"], 5, 32).collect()} == want


def _plain_path(row, tree):
    i = 0
    while tree["feature"][i] >= 0:
        i = tree["left"][i] if row[tree["feature"][i]] < tree["threshold"][i] else tree["right"][i]
    return tree["path"][i]


def test_scores_follow_the_trees_and_find_outliers(spark):
    x, df = _table(spark, 400)
    far = spark.createDataFrame([(1000, [30.0, -30.0, 30.0]), (1001, None), (1002, [1.0, None, 2.0])], "id long, x array<double>")
    both = df.unionByName(far)
    trees = I.tree_samples(both, "x", ["id"], 20, 64)
    forest = I.iforest_fit(both, "x", "id", n_trees=20, sample_size=64)
    assert trees.count() == 20 * 64 and forest.sizes == [64] * 20
    out = {r["id"]: r for r in I.iforest_score(both, forest, "x", ["id"]).collect()}
    assert out[1001].anomaly_score is None and out[1002].mean_path is None and len(out) == 403
    assert max(out, key=lambda i: out[i].anomaly_score or 0) == 1000
    ends = [*forest.roots[1:], len(forest.feature)]
    single = [{"feature": forest.feature[a:b], "threshold": forest.threshold[a:b], "left": forest.left[a:b] - a,
               "right": forest.right[a:b] - a, "path": forest.path[a:b]} for a, b in zip(forest.roots, ends)]
    for i in (0, 7, 99):
        mean = np.mean([_plain_path(x[i], t) for t in single])
        assert abs(out[i].mean_path - mean) < 1e-12
        assert abs(out[i].anomaly_score - 2 ** (-mean / I.average_path(64))) < 1e-12


def test_growth_stops_at_depth_single_rows_and_equal_rows():
    f, _, _, _, path = I._grow(np.zeros((5, 2)), np.random.default_rng(0), 8)
    assert f == [-1] and path == [I.average_path(5)]
    f, _, left, right, path = I._grow(np.arange(8.0)[:, None], np.random.default_rng(0), 2)
    assert max(path) <= 2 + I.average_path(8) and all(a != b for a, b, x in zip(left, right, f) if x >= 0)


def test_few_rows_repeated_keys_and_empty(spark):
    _, df = _table(spark, 10)
    twice = df.unionByName(df)
    forest = I.iforest_fit(twice, "x", "id", n_trees=4, sample_size=64)
    assert forest.sizes == [20] * 4
    empty = df.where("false")
    assert I.iforest_score(empty, I.iforest_fit(empty, "x", "id", 4), "x", ["id"]).collect() == []
    assert math.isclose(I.average_path(2), 1.0) and I.average_path(1) == 0.0 and xxhash.VERSION
