"""Exact Euclidean silhouette against all pairs."""

import numpy as np
import pytest

from fleetlens.operators import silhouette as S


def _brute(x, c):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    out = []
    for i in range(len(x)):
        own = (c == c[i])
        if own.sum() == 1:
            out.append(0.0)
            continue
        a = d[i, own].sum() / (own.sum() - 1)
        b = min(d[i, c == o].mean() for o in set(c) if o != c[i])
        out.append(0.0 if max(a, b) == 0 else (b - a) / max(a, b))
    return np.mean(out)


def _df(spark, x, c):
    return spark.createDataFrame([([float(v) for v in r], k) for r, k in zip(x, c)], "x array<double>, c string").repartition(5)


@pytest.mark.parametrize("shift", [0.0, 1e5])
def test_equal_to_all_pairs(spark, monkeypatch, shift):
    monkeypatch.setattr(S, "BLOCK", 9)
    monkeypatch.setattr(S, "GROUP", 4)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(150, 3)) + shift
    x[20:40] = x[3]  # repeated rows
    c = np.array([*"abcd"] * 37 + ["e", "a"])
    got = S.silhouette_euclidean(_df(spark, x, c), "x", "c").first()[0]
    assert abs(got - _brute(x, c)) < 1e-9


def test_defined_cases(spark):
    one = lambda rows: S.silhouette_euclidean(spark.createDataFrame(rows, "x array<double>, c int"), "x", "c").first()[0]
    assert one([]) is None and one([([1.0], 1), ([2.0], 1)]) == -1.0 and one([([1.0], 1), ([2.0], 2)]) == -1.0
    assert one([([1.0], 1), ([1.0], 2), ([1.0], 1)]) == 0.0
    rows = [([0.0], 1), ([0.1], 1), ([5.0], 2), ([5.1], 2)]
    assert abs(one(rows) - one([*rows, (None, 1), ([float("nan")], 2), ([3.0], None)])) < 1e-12
