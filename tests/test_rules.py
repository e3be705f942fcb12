"""Hand vectors for the scalar rules (risk level, severity, value, rounding, calendar)."""

from pyspark.sql import functions as F

from fleetlens.functions import rules as R


def col(spark, rows, schema, expr):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_risk_level_deployed_threshold(spark):
    # medium is unreachable when the threshold is below 0.1
    out = col(spark, [(0.6,), (0.12,), (0.05,), (0.01,)], "p double", R.risk_level("p", 0.0437))
    assert out == ["critical", "high", "high", "low"]


def test_risk_level_final_threshold(spark):
    out = col(spark, [(0.3,), (0.15,), (0.05,)], "p double", R.risk_level("p", 0.2127))
    assert out == ["high", "medium", "low"]


def test_anomaly_severity_and_multiplier(spark):
    rows = [(0.2,), (0.05,), (0.0,), (-0.1,)]
    assert col(spark, rows, "s double", R.anomaly_severity("s", 0.0)) == ["critical", "high", "medium", "low"]
    assert col(spark, rows, "s double", R.anomaly_multiplier("s", 0.0)) == [1.6, 1.35, 1.15, 1.0]


def test_business_value(spark):
    rows = [(100.0, "premium", 1, 0, 50.0), (5.0, "Critical", 0, 1, 150.0), (None, None, None, None, None)]
    out = col(spark, rows, "s double, p string, g int, m int, c double",
              R.business_value("s", "p", "g", "m", "c"))
    assert abs(out[0] - 234.375) < 1e-9
    assert abs(out[1] - 34.5) < 1e-9
    assert abs(out[2] - 10.0) < 1e-9


def test_half_even_rounding_and_clip(spark):
    clipped, rounded = R.clip_round("p")
    out = spark.createDataFrame([(2.5,), (3.5,), (-1.0,)], "p double").select(clipped, rounded).collect()
    assert [r[1] for r in out] == [2, 4, 0]
    assert out[2][0] == 0.0


def test_weekday_monday_zero(spark):
    cal = R.calendar("d", "2026-01-01")
    r = spark.createDataFrame([("2026-01-01",)], "d string").select(
        F.to_date("d").alias("d")).select(*[v.alias(k) for k, v in cal.items()]).first()
    assert (r.day_of_week, r.day_of_month, r.days_since_start) == (3, 1, 0)


def test_safe_divide(spark):
    out = col(spark, [(2.0, 0.0), (2.0, 4.0), (2.0, None)], "n double, d double", R.safe_divide("n", "d"))
    assert out == [0.0, 0.5, 0.0]


def test_readable_label_and_direction(spark):
    out = col(spark, [("num__cpu_util_pct",), ("cat__some_thing",), ("days_since_start",)], "f string",
              R.readable_label("f"))
    assert out == ["CPU usage", "some thing", "days since start"]
    d = col(spark, [(2.0, 1.0), (1.0, 2.0), (1.0, 1.0)], "v double, r double", R.value_direction("v", "r"))
    assert d == ["above_normal", "below_normal", "near_normal"]


def test_fixed_point_text_matches_python(spark):
    vals = [23.185, 2.675, 0.125, 1234.5678]
    out = col(spark, [(v,) for v in vals], "x double", R.fixed("x", 2))
    assert out == [f"{v:.2f}" for v in vals]
