"""Range label join (J6), previous-day join (J7), profile lookup."""

from pyspark.sql import functions as F

from fleetlens.operators import joins as J


def _dates(spark, rows, schema):
    return spark.createDataFrame(rows, schema).withColumn("date", F.to_date("date"))


def test_label_horizon_days(spark):
    obs = _dates(spark, [(1, f"2024-01-{d:02d}") for d in (2, 3, 9, 10)], "server_id int, date string")
    inc = _dates(spark, [(1, "2024-01-10")], "server_id int, date string")
    out = J.label_horizon(obs, inc).orderBy("date").collect()
    assert [r.label for r in out] == [0, 1, 1, 0]


def test_label_next_rows(spark):
    obs = spark.createDataFrame([(1, t, f) for t, f in enumerate([0, 0, 1, 0])], "k int, t int, f int")
    out = J.label_next_rows(obs, "k", ["t"], "f", 1).orderBy("t").collect()
    assert [r.label for r in out] == [0, 1, 0, 0]


def test_prev_day_join_calendar_gap(spark):
    p = _dates(spark, [("r", "2024-01-01", 1), ("r", "2024-01-02", 2), ("r", "2024-01-04", 4)],
               "region string, date string, v int")
    out = J.prev_day_join(p, cols=["v"]).orderBy("date").collect()
    assert [r.v_prev_day for r in out] == [None, 1, None]


def test_profile_lookup_default(spark):
    a = spark.createDataFrame([(1, 0), (2, 7)], "server_id int, cluster int")
    p = spark.createDataFrame([(0, "x", "d")], "cluster int, profile_name string, profile_driver string")
    out = {r.server_id: r.profile_name for r in J.profile_lookup(a, p).collect()}
    assert out == {1: "x", 2: "profil inconnu"}


def test_prev_day_names_round_trip(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    there = J.prev_day_names(df, ["a"])
    assert there.columns == ["a_prev_day", "b"]
    assert J.prev_day_names(there, ["a"], to_previous=False).columns == ["a", "b"]
