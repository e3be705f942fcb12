"""Size-dependent paths agree with the plain ones on NULLs and early dates."""

import datetime

from pyspark.sql import functions as F

from fleetlens.operators.quantiles import quantile_columns
from fleetlens.operators.splits import stratified_split_exact
from fleetlens.operators.windows import lead_target


def test_hot_window_before_1970_and_without_dates(spark):
    day = datetime.date(1969, 12, 1)
    rows = [("h", day + datetime.timedelta(days=i), i, float(i * i % 7)) for i in range(60)]
    rows += [("h", None, -1, 3.0), ("s", day, 0, 1.0), ("s", None, -1, 2.0)]
    df = spark.createDataFrame(rows, "k string, d date, i int, v double")
    plain = lead_target(df, "k", ["d", "i"], "v", "t", skew_safe=False)
    hot = lead_target(df, "k", ["d", "i"], "v", "t", hot_share=0.1, min_hot_rows=1)
    assert sorted(plain.select("k", "i", "t").collect()) == sorted(hot.select("k", "i", "t").collect())


def test_rank_quantiles_keep_groups_without_values(spark):
    df = spark.createDataFrame([("h", None), ("h", None), ("s", 2.0), ("s", 4.0), (None, 1.0)], "k string, v double")
    key = lambda r: (r[0] or "", r[1] or 0)
    plain = quantile_columns(df, ["k"], ["v"], 0.5, "_q").collect()
    ranked = quantile_columns(df, ["k"], ["v"], 0.5, "_q", bucket_rows=1).collect()
    assert sorted(map(tuple, plain), key=key) == sorted(map(tuple, ranked), key=key)
    empty = df.where("k = 'h'").select("v")
    assert quantile_columns(empty, [], ["v"], 0.5, "_q", bucket_rows=1).collect()[0][0] is None


def test_exact_split_keeps_null_labels(spark):
    df = spark.range(100).withColumn("y", F.when(F.col("id") % 4 > 0, F.col("id") % 2))
    train, test = stratified_split_exact(df, "id", "y", 0.2)
    assert train.count() + test.count() == 100 and test.where("y is null").count() == 5
