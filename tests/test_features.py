"""Aggregations and feature-table joins."""

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import features as FT


def test_p90_linear(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (5.0,), (9.0,)], "x double")
    assert abs(df.agg(FT.percentile("x", 0.9)).first()[0] - 7.8) < 1e-12


def test_mode_tie_smallest(spark):
    df = spark.createDataFrame([("a", 3), ("a", 1), ("a", 3), ("a", 1)], "k string, v int")
    assert FT.mode_per_group(df, "k", "v").first()["v_mode"] == 1


def test_assert_unique_fails_on_duplicate(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception):
        FT.assert_unique(df, ["k"]).collect()
    ok = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    assert FT.assert_unique(ok, ["k"]).count() == 2


def test_spine_keeps_all_and_fills(spark):
    spine = spark.createDataFrame([(1,), (2,)], "server_id int")
    inc = spark.createDataFrame([(1, "2024-01-05", 10.0, "high", "disk", 1, 0, 1)],
                                "server_id int, date string, duration_minutes double, severity string, "
                                "component string, customer_visible int, sla_breach int, root_cause_known int"
                                ).withColumn("date", F.to_date("date"))
    prof = FT.incident_profile(inc, "2024-01-10")
    out = {r.server_id: r for r in FT.spine_fill(spine, prof, "server_id", FT.INCIDENT_DEFAULTS).collect()}
    assert out[1].incident_count == 1 and out[1].days_since_last_incident == 5
    assert out[1].recent30_high_severity_count == 1 and out[1].disk_incident_count == 1
    assert out[2].incident_count == 0 and out[2].days_since_last_incident == 999


def test_empty_incident_log_same_plan(spark):
    spine = spark.createDataFrame([(1,), (2,)], "server_id int")
    inc = spark.createDataFrame([], "server_id int, date date, duration_minutes double, severity string, "
                                    "component string, customer_visible int, sla_breach int, root_cause_known int")
    out = FT.spine_fill(spine, FT.incident_profile(inc, "2024-01-10"), "server_id", FT.INCIDENT_DEFAULTS)
    assert sorted(r.days_since_last_incident for r in out.collect()) == [999, 999]


def test_dataset_profile_duplicates(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None)], "k int, v string")
    r = FT.dataset_profile(df).first()
    assert (r.rows, r.cols, r.missing_values, r.duplicate_rows) == (3, 2, 1, 1)


def test_feature_columns_by_type(spark):
    from fleetlens.operators.transforms import feature_columns
    df = spark.createDataFrame([(1, 2.0, "a", "x")], "server_id int, v double, seg string, key string")
    assert feature_columns(df, exclude=["server_id", "key"]) == (["v"], ["seg"])


def test_stratified_split_exact_counts(spark):
    from fleetlens.operators.splits import stratified_split_exact
    rows = [(i, 1 if i % 7 == 0 else 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, y int")
    tr, te = stratified_split_exact(df, "id", "y", 0.2, bits=4)
    n1 = sum(1 for _, y in rows if y == 1)
    n0 = len(rows) - n1
    got = {r.y: r["count"] for r in te.groupBy("y").count().collect()}
    assert got == {1: round(0.2 * n1), 0: round(0.2 * n0)}
    assert tr.count() + te.count() == len(rows)
    assert tr.join(te, "id").count() == 0


def test_hash_splits_stable_under_repartition(spark):
    from fleetlens.operators import splits as SP
    df = spark.createDataFrame([(i, i % 3) for i in range(500)], "id long, y int")
    a = sorted(r.id for r in SP.hash_split(df, "id", 0.2)[1].collect())
    b = sorted(r.id for r in SP.hash_split(df.repartition(7), "id", 0.2)[1].collect())
    assert a == b and 50 < len(a) < 150
    assert SP.sample_n(df, 37, "id").count() == 37
    assert sorted(sorted(r.id for r in SP.sample_n(df.repartition(5), 37, "id").collect())) == \
        sorted(r.id for r in SP.sample_n(df, 37, "id").collect())
    folds = {r.fold for r in SP.kfold(df, "id", 3).collect()}
    assert folds == {0, 1, 2}


def test_time_blocks_keep_dates_whole(spark):
    from fleetlens.operators import splits as SP
    df = spark.createDataFrame([(i, f"2024-01-{1 + i % 12:02d}") for i in range(120)], "id int, d string") \
        .withColumn("date", F.to_date("d"))
    b = SP.time_blocks(df, "date", 3)
    per_date = b.groupBy("date").agg(F.countDistinct("block").alias("nb")).agg(F.max("nb")).first()[0]
    assert per_date == 1
    assert sorted(r.block for r in b.select("block").distinct().collect()) == [0, 1, 2, 3]
    tr, te = SP.time_fold(b, 2)
    assert tr.agg(F.max("date")).first()[0] < te.agg(F.min("date")).first()[0]


def test_assemble_fact_keeps_fact_rows(spark):
    from fleetlens.operators.joins import assemble_fact
    fact = spark.createDataFrame([(1, 10), (2, 10), (3, 99)], "id int, d int")
    dim = spark.createDataFrame([(10, "x")], "d int, name string")
    out = assemble_fact(fact, [(dim, ["d"])])
    assert out.count() == 3
    dup = spark.createDataFrame([(10, "x"), (10, "y")], "d int, name string")
    with pytest.raises(Exception):
        assemble_fact(fact, [(dup, ["d"])]).count()


def test_modes_of_several_columns(spark):
    from fleetlens.operators.features import modes_per_group
    df = spark.createDataFrame([(1, "b", 3), (1, "a", 3), (1, None, 1), (2, None, 9), (1, "a", None)], "k int, s string, n int")
    out = {r.k: (r.s, r.n) for r in modes_per_group(df, "k", ["s", "n"]).collect()}
    assert out == {1: ("a", "3"), 2: (None, "9")}
