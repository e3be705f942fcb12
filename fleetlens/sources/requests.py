"""Request-batch source (A6): rows carrying JSON payloads -> typed features.

``from_json`` with an explicit schema (extra fields are ignored), defaults by
``coalesce``, and a ``_valid`` flag for rows missing a required field, so the
caller can route the two sides (``filter``) without a second read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def parse_requests(df: DataFrame, json_col: str, fields: dict[str, str],
                   defaults: dict | None = None, required: Sequence[str] = (),
                   keep: Sequence[str] = ()) -> DataFrame:
    schema = T.StructType([T.StructField(n, T._parse_datatype_string(t)) for n, t in fields.items()])
    parsed = df.select(*keep, F.from_json(F.col(json_col), schema).alias("_r"))
    defaults = defaults or {}
    valid = F.lit(True)
    for n in required:
        valid = valid & F.col(f"_r.{n}").isNotNull()
    cols = [F.coalesce(F.col(f"_r.{n}"), F.lit(defaults[n])).alias(n) if n in defaults
            else F.col(f"_r.{n}").alias(n) for n in fields]
    return parsed.select(*keep, *cols, valid.alias("_valid"))


def split_valid(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, quarantined rows)."""
    return parsed.filter(F.col("_valid")).drop("_valid"), parsed.filter(~F.col("_valid")).drop("_valid")
