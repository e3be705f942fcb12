"""Jacobi-Davidson whitening against a dense eigensolver."""

import numpy as np
import pytest

from fleetlens.llm import jacobi_davidson as J


def dense(x):
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(0)
    c = (fit - 1_000_000) - (s - 1_000_000 * n) / n
    e, u = np.linalg.eigh(c.T @ c / n)
    return n, s, e[::-1], u[:, ::-1]


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, id int, x string")


def test_agrees_with_a_dense_solver(spark):
    rng = np.random.default_rng(3)
    m = rng.standard_normal((400, 30)) * np.linspace(0.2, 2, 30)
    rows = [(i, [float(np.float32(v)) for v in r], 1, "c") for i, r in enumerate(m)] + [
        (0, [float(np.float32(v)) for v in m[0]], 2, "c"), (900, None, 1, "c"), (901, [None] * 30, 1, "c"),
        (902, [float("nan")] * 30, 1, "c"), (903, [float("inf")] + [0.0] * 29, 1, "c"), (904, [], 1, "c")]
    out = J.whiten(table(spark, rows), k=16).toPandas()
    x = np.floor(64 * np.array([r[1] or [0.0] * 30 for r in rows if r[0] not in (900, 901, 902, 903)])).astype(np.int64) + 1_000_000
    n, s, e, u = dense(x)
    assert set(out.vec_id) == {*range(400), 904} and len(out) == 16 * 402 and set(out.n) == {n}
    one = out.drop_duplicates("vec_id").set_index("vec_id")
    ids = [*range(400), 0, 904]
    assert (one.loc[ids].deviation.to_numpy() == ((n * x - s) ** 2).sum(1)).all()
    assert np.allclose(out.groupby("component").explained.first(), e[:16] / e.sum(), rtol=1e-12)
    assert out.identity_error.max() < 1e-9
    got = out.drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    want = ((x - 1_000_000) - (s - 1_000_000 * n) / n) @ u[:, :16] / np.sqrt(e[:16])
    assert np.minimum(np.abs(got - want).max(0), np.abs(got + want).max(0)).max() < 1e-9


def test_low_rank_few_rows_and_empty(spark):
    rows = [(i, [float(i % 4), 2.0 * (i % 4), 1.0], 1, "c") for i in range(12)]
    out = J.whiten(table(spark, rows), k=16).toPandas()
    assert set(out.component) == {1} and len(out) == 12 and set(out.n) == {4}
    assert abs(out.explained.iloc[0] - 1) < 1e-12
    assert J.whiten(table(spark, rows[:1]), k=16).collect() == []  # one distinct vector has no component
    empty = J.whiten(table(spark, []), k=16)
    assert empty.collect() == [] and empty.columns[0] == "vec_id"


@pytest.mark.parametrize("dim,values", [(120, np.geomspace(1, 1e-9, 120)), (60, np.r_[np.full(20, 3.0), np.linspace(1, .1, 40)])])
def test_leading_pairs_with_restarts_and_multiple_values(dim, values):
    q = np.linalg.qr(np.random.default_rng(5).standard_normal((dim, dim)))[0]
    a = (q * values) @ q.T
    e, u = J.leading_pairs(lambda v: a @ v, dim, 16)
    assert np.allclose(e, np.sort(values)[::-1][:16], rtol=1e-6, atol=1e-13)
    assert np.linalg.norm(a @ u - u * e, axis=0).max() < 1e-13 * values.max() * 10
    assert np.allclose(u.T @ u, np.eye(16), atol=1e-12)


def test_minres_solves_indefinite_systems():
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((20, 20)))[0]
    a = (q * np.r_[np.linspace(-2, -1, 10), np.linspace(1, 3, 10)]) @ q.T
    b = rng.standard_normal((20, 3))
    x = J.minres(lambda v: a @ v, b, 20)
    assert np.abs(a @ x - b).max() < 2e-2
