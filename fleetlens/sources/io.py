"""Table, metadata and model sources/sinks (A1-A4)."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def read_table(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
               fmt: str = "parquet", date_format: str = "yyyy-MM-dd") -> DataFrame:
    """Scan with an explicit schema (A1).  CSV is read FAILFAST so a malformed
    row or a bad date aborts the job, like a strict parse; a missing path
    fails at analysis."""
    r = spark.read
    if schema is not None:
        r = r.schema(schema)
    if fmt == "csv":
        r = r.option("header", "true").option("mode", "FAILFAST").option("dateFormat", date_format)
    return r.format(fmt).load(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (),
                mode: str = "overwrite") -> None:
    """Table sink (A2): parquet/csv(header)/json, optional partition columns.  Rows are first
    brought together by them, so a value makes few files, and a value that holds much of
    the table is split over tasks (a rebalance, not one task a value)."""
    if partition_by:
        df = df.hint("rebalance", *partition_by)
    w = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        w = w.option("header", "true")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def save_metadata(spark: SparkSession, meta: dict, path: str) -> None:
    """Registry entry as a one-row JSON table (A3)."""
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(meta, default=str)]))
    df.coalesce(1).write.mode("overwrite").json(path)


def load_metadata(spark: SparkSession, path: str) -> dict:
    """The registry entry, or ``{}`` when it does not exist (A3)."""
    try:
        rows = spark.read.json(path).toJSON().take(1)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return json.loads(rows[0]) if rows else {}
