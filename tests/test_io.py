"""Sources and sinks (A1-A4, A6) on throw-away files."""

import os
import tempfile

import pytest

from fleetlens.sources import io as IO
from fleetlens.sources.requests import parse_requests, split_valid


def test_csv_strict_dates_and_missing_path(spark):
    d = tempfile.mkdtemp(prefix="fleetlens-io-")
    good = os.path.join(d, "good.csv")
    bad = os.path.join(d, "bad.csv")
    with open(good, "w") as f:
        f.write("date,server_id,v\n2026-01-01,s1,1.5\n2026-01-02,s2,2.5\n")
    with open(bad, "w") as f:
        f.write("date,server_id,v\n2026-13-45,s1,1.5\n")
    schema = "date date, server_id string, v double"
    assert IO.read_table(spark, good, schema, fmt="csv").count() == 2
    with pytest.raises(Exception):
        IO.read_table(spark, bad, schema, fmt="csv").collect()
    with pytest.raises(Exception):
        IO.read_table(spark, os.path.join(d, "absent.csv"), schema, fmt="csv").collect()


def test_write_partitioned_and_metadata_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="fleetlens-io-")
    df = spark.createDataFrame([("2026-01-01", 1), ("2026-01-02", 2)], "date string, v int")
    IO.write_table(df, os.path.join(d, "t"), partition_by=["date"])
    assert sorted(r.v for r in IO.read_table(spark, os.path.join(d, "t")).collect()) == [1, 2]
    IO.save_metadata(spark, {"threshold": 0.0437, "model_type": "GBT"}, os.path.join(d, "m"))
    assert IO.load_metadata(spark, os.path.join(d, "m"))["threshold"] == 0.0437
    assert IO.load_metadata(spark, os.path.join(d, "none")) == {}


def test_requests_defaults_extras_and_quarantine(spark):
    df = spark.createDataFrame([(1, '{"k": 5, "extra": "x"}'), (2, '{"top_n": 3}'), (3, "not json")],
                               "id int, body string")
    p = parse_requests(df, "body", {"k": "int", "top_n": "int"}, defaults={"top_n": 50},
                       required=["k"], keep=["id"])
    ok, bad = split_valid(p)
    assert [(r.id, r.k, r.top_n) for r in ok.collect()] == [(1, 5, 50)]
    assert sorted(r.id for r in bad.collect()) == [2, 3]


def test_missing_model_raises(spark):
    from fleetlens.operators.models import load_model
    with pytest.raises(Exception):
        load_model(os.path.join(tempfile.mkdtemp(prefix="fleetlens-io-"), "absent"))


def test_partitioned_sink_makes_few_files_a_value(spark, tmp_path):
    import glob

    from fleetlens.sources.io import read_table, write_table
    df = spark.range(3000).selectExpr("id", "case when id % 3 = 0 then 'hot' else concat('d', id % 5) end as d").repartition(8)
    write_table(df, str(tmp_path / "t"), partition_by=["d"])
    assert all(len(glob.glob(f"{v}/*.parquet")) <= 2 for v in glob.glob(str(tmp_path / "t" / "d=*")))
    assert read_table(spark, str(tmp_path / "t")).groupBy("d").count().count() == df.select("d").distinct().count()
