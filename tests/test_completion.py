"""Completion in dependency order."""

import pytest

from fleetlens.operators import completion as C


def test_levels_values_and_missing_columns(spark):
    spec = {"c": "b * 2", "b": "a + 1", "a": "0", "alone": "5"}
    assert C.dependency_levels(spec) == [["a", "alone"], ["b"], ["c"]]
    df = spark.createDataFrame([(1, None, 7.0), (2, 4.0, None)], "id int, a double, c double")
    rows = {r.id: r for r in C.complete(df, spec).collect()}
    assert (rows[1].a, rows[1].b, rows[1].c) == (0.0, 1.0, 7.0) and (rows[2].a, rows[2].b, rows[2].c, rows[2].alone) == (4.0, 5.0, 10.0, 5.0)
    with pytest.raises(ValueError):
        C.dependency_levels({"a": "b", "b": "a"})


def test_server_profile_of_one_observation(spark):
    df = spark.createDataFrame([(1, 90.0, 75.0, 0, None), (2, None, None, 40, 3.0)],
                               "id int, cpu_util_pct double, temperature_c double, observation_count int, incident_count double")
    r = {x.id: x for x in C.complete_server_profile(df).collect()}
    assert len(C.server_profile_spec()) > 75
    assert (r[1].cpu_util_pct_p90, r[1].cpu_util_pct_std, r[1].high_cpu_day_rate, r[1].observation_count) == (90.0, 0.0, 1.0, 1.0)
    assert r[1].days_since_last_incident == 30.0 and r[1].thermal_cpu_pressure_max == 67.5 and r[1].backup_failure_rate == 0.0
    assert (r[2].incident_rate, r[2].recent30_incident_rate, r[2].days_since_last_incident) == (0.075, 0.1, 40.0)


def test_the_callers_calendar_wins(spark):
    import datetime
    df = spark.createDataFrame([(datetime.date(2026, 1, 1), None), (datetime.date(2026, 1, 2), 0)], "date date, day_of_week int")
    rows = C.complete(df, C.calendar_spec("date", "2026-01-01"), "int").orderBy("date").collect()
    assert [(x.day_of_week, x.day_of_month, x.days_since_start) for x in rows] == [(3, 1, 0), (0, 2, 1)]
