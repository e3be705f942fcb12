"""Extremely randomised trees: growth against a plain reading, stability, quality."""

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from fleetlens.operators.extratrees import ExtraTrees, _uniform


def _rows(spark, n=400, d=5, seed=2):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).round(3)
    x[:, 3] = 1.0
    y = 3.0 * x[:, 0] - 2.0 * (x[:, 1] > 0) + rng.normal(size=n) * 0.1
    df = spark.createDataFrame([(i, [float(v) for v in r], float(t)) for i, (r, t) in enumerate(zip(x, y))], "id int, a array<double>, label double")
    return x, y, df.withColumn("features", array_to_vector("a"))


def _plain_tree(x, y, tree, few, depth, min_leaf, seed):
    """One tree by the definition, recursively."""
    def node(rows, key, level):
        value = y[rows].mean()
        if level == depth or len(rows) < 2 * min_leaf or y[rows].var() <= 1e-12:
            return value
        k = np.full(x.shape[1], key, np.uint64)
        cand = np.sort(np.argsort(_uniform(k, np.arange(x.shape[1]), seed, 0), kind="stable")[:few])
        best = None
        for f in cand:
            low, high = x[rows, f].min(), x[rows, f].max()
            cut = low + _uniform(np.uint64([key]), np.array([f]), seed, 1)[0] * (high - low)
            left = rows[x[rows, f] <= cut]
            if low == high or len(left) < min_leaf or len(rows) - len(left) < min_leaf:
                continue
            right = np.setdiff1d(rows, left)
            gain = y[left].sum() ** 2 / len(left) + y[right].sum() ** 2 / len(right)
            if best is None or gain > best[0] + 1e-9 * abs(gain):
                best = (gain, f, cut, left, right)
        if best is None:
            return value
        base, place = key >> 32 << 32, key & 0xFFFFFFFF
        return best[1], best[2], node(best[3], base | 2 * place, level + 1), node(best[4], base | 2 * place + 1, level + 1)
    return node(np.arange(len(x)), tree << 32 | 1, 0)


def _walk(t, row):
    while isinstance(t, tuple):
        t = t[2] if row[t[0]] <= t[1] else t[3]
    return t


def test_forest_is_the_plain_one_and_does_not_depend_on_the_layout(spark):
    x, y, df = _rows(spark)
    grown = [ExtraTrees(n_trees=6, max_depth=4, feature_share=0.6, min_leaf=10).fit(df.repartition(p)) for p in (1, 7)]
    assert all((grown[0].trees.feature == m.trees.feature).all() and np.allclose(grown[0].trees.value, m.trees.value) for m in grown)
    plain = [_plain_tree(x, y, t, 3, 4, 10, 42) for t in range(6)]
    got = {r.id: r.prediction for r in grown[1].transform(df).select("id", "prediction").collect()}
    for i in range(0, 400, 13):
        assert abs(got[i] - np.mean([_walk(t, x[i]) for t in plain])) < 1e-9


def test_quality_weights_and_probabilities(spark):
    _, y, df = _rows(spark, 800)
    model = ExtraTrees(n_trees=60, max_depth=6, min_leaf=5).fit(df.where("id < 600"))
    err = model.transform(df.where("id >= 600")).agg(F.avg(F.abs(F.col("label") - F.col("prediction")))).first()[0]
    assert err < 0.45 * np.abs(y[600:] - y[:600].mean()).mean()
    cls = df.withColumn("label", (F.col("label") > 0).cast("int")).withColumn("w", F.lit(2.0))
    probs = ExtraTrees(n_trees=30, max_depth=4, weight="w", probability=True).fit(cls).transform(cls)
    assert probs.where("score < 0 or score > 1").count() == 0
    assert probs.agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0] > 0.85


def test_defined_cases(spark):
    _, _, df = _rows(spark, 50)
    assert ExtraTrees(n_trees=3).fit(df.where("false")).transform(df).where("prediction is not null").count() == 0
    broken = df.withColumn("label", F.when(F.col("id") < 40, F.col("label")))
    model = ExtraTrees(n_trees=3, min_leaf=30).fit(broken)  # too few rows to split
    mean = df.where("id < 40").agg(F.avg("label")).first()[0]
    assert model.transform(df).where(F.abs(F.col("prediction") - mean) > 1e-9).count() == 0
    lost = df.withColumn("features", F.when(F.col("id") > 0, F.col("features")))
    assert model.transform(lost).where("prediction is null").select("id").collect() == [(0,)]
