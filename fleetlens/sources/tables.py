"""Parquet table access for the fleet and driver tables.

Reads are lazy: Catalyst prunes columns and pushes filters into the scan of
whatever the caller's plan actually uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)


class Tables:
    """``Tables(spark, dir).events`` -> DataFrame over ``dir/events.parquet``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")
        self._frames: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        # one relation (and one file listing) per table; every use in a plan
        # shares it
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(f"{self.root}/{name}.parquet")
        return self._frames[name]

    def __getitem__(self, name: str) -> DataFrame:
        return getattr(self, name)
