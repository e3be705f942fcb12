"""History windows exclude the current row."""

from fleetlens.operators.windows import history_features, lead_target


def test_rolling_previous_rows(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(4)], "g string, t int, x double")
    out = history_features(df, "g", ["t"], ["x"], lags=(1,), mean_windows=(7,), std_window=7, max_window=7)
    rows = out.orderBy("t").collect()
    assert [r.x_rolling_mean_7 for r in rows] == [None, 0.0, 0.5, 1.0]
    std = [r.x_rolling_std_7 for r in rows]
    assert std[0] is None and std[1] is None
    assert abs(std[2] - 0.7071067811865476) < 1e-12 and abs(std[3] - 1.0) < 1e-12
    assert [r.x_rolling_max_7 for r in rows] == [None, 0.0, 1.0, 2.0]
    assert [r.x_diff1 for r in rows] == [None, 1.0, 1.0, 1.0]


def test_lead_drops_last(spark):
    df = spark.createDataFrame([("a", i, i * 10) for i in range(3)], "g string, t int, x int")
    out = lead_target(df, "g", ["t"], "x", "y").orderBy("t").collect()
    assert [(r.t, r.y) for r in out] == [(0, 10), (1, 20)]


def test_skew_safe_equals_plain_with_sparse_chunks(spark):
    import datetime as dt
    import random
    rnd = random.Random(3)
    rows = []
    base = dt.date(2024, 1, 1)
    # one hot key with gaps (some 7-day chunks hold 0-2 rows), plus cold keys
    for i in range(120):
        if rnd.random() < 0.6 or 40 <= i < 60:
            rows.append(("hot", base + dt.timedelta(days=i), i, float(rnd.randint(0, 9))))
    for k in ("a", "b"):
        for i in range(0, 30, 3):
            rows.append((k, base + dt.timedelta(days=i), 1000 + i, float(i)))
    df = spark.createDataFrame(rows, "k string, d date, t int, x double")
    args = dict(lags=(1, 7), mean_windows=(3, 7), std_window=7, max_window=7)
    plain = history_features(df, "k", ["d", "t"], ["x"], skew_safe=False, **args)
    safe = history_features(df, "k", ["d", "t"], ["x"], skew_safe=True, hot_share=0.3, min_hot_rows=0, **args)
    cols = plain.columns
    a = sorted(tuple(r) for r in plain.select(*cols).collect())
    b = sorted(tuple(r) for r in safe.select(*cols).collect())
    assert len(a) == len(b)
    for ra, rb in zip(a, b):
        for va, vb in zip(ra, rb):
            assert (va is None and vb is None) or va == vb or abs(va - vb) < 1e-9


def test_skew_safe_lead_and_next_rows_equal_plain(spark):
    import datetime as dt
    import random
    from fleetlens.operators.joins import label_next_rows
    rnd = random.Random(5)
    base = dt.date(2024, 1, 1)
    rows = [("hot", base + dt.timedelta(days=i), i, float(i), int(rnd.random() < 0.1))
            for i in range(100) if rnd.random() < 0.5 or 30 <= i < 45]
    rows += [("c", base + dt.timedelta(days=i), 500 + i, float(i), 0) for i in range(0, 20, 4)]
    df = spark.createDataFrame(rows, "k string, d date, t int, x double, f int")
    a = sorted(tuple(r) for r in lead_target(df, "k", ["d", "t"], "x", "y", steps=2, skew_safe=False).collect())
    b = sorted(tuple(r) for r in lead_target(df, "k", ["d", "t"], "x", "y", steps=2, hot_share=0.3,
                                              min_hot_rows=0).collect())
    assert a == b and len(a) == len(rows) - 4
    plain = df.withColumns({"_i": df.t})  # int order -> plain window path
    c = sorted(tuple(r) for r in label_next_rows(plain, "k", ["_i"], "f", 3).drop("_i").collect())
    e = sorted(tuple(r) for r in label_next_rows(df, "k", ["d", "t"], "f", 3, min_hot_rows=0).collect())
    assert c == e
