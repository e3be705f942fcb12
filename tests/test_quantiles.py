"""Exact distributed quantiles against NumPy (aggregate and rank paths)."""

import numpy as np

from fleetlens.operators.quantiles import exact_quantiles, quantile_columns


def _rows():
    rng = np.random.default_rng(7)
    rows = []
    for k, n in (("hot", 900), ("cold", 7), ("one", 1)):
        for _ in range(n):
            rows.append((k, float(rng.integers(0, 50)), float(rng.normal())))
    return rows


def test_quantiles_match_numpy_both_paths(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "k string, a double, b double")
    for bucket_rows in (10_000, 20):       # aggregate path / rank path for "hot"
        for q in (0.5, 0.9):
            out = {r.k: r for r in quantile_columns(df, ["k"], ["a", "b"], q, "_q", buckets=8,
                                                    bucket_rows=bucket_rows).collect()}
            for k in ("hot", "cold", "one"):
                for m, idx in (("a", 1), ("b", 2)):
                    vals = np.array([r[idx] for r in rows if r[0] == k])
                    assert abs(out[k][f"{m}_q"] - np.quantile(vals, q)) < 1e-9


def test_global_rank_path_and_long_form(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (5.0,), (9.0,), (None,)], "x double")
    assert abs(quantile_columns(df, [], ["x"], 0.9, "_p90", bucket_rows=2, buckets=2).first().x_p90 - 7.8) < 1e-12
    assert abs(quantile_columns(df, [], ["x"], 0.9, "_p90").first().x_p90 - 7.8) < 1e-12
    r = exact_quantiles(df, [], ["x"], 0.5).first()
    assert r.measure == "x" and abs(r.value - 3.5) < 1e-12
