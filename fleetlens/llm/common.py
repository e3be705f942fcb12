"""Helpers that the corpus operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from fleetlens.session import checkpoint_dir

#: a word: a run of anything but the ASCII white space characters
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def crc_mod(column: str, k: int) -> Column:
    """crc32 of the value as text, modulo ``k`` (a null counts as the empty text)."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.pmod(F.crc32(text.cast("binary")), F.lit(k))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def words_in(c: Column) -> Column:
    """Number of words, 0 for null."""
    return F.coalesce(F.regexp_count(c, F.lit(WORD)), F.lit(0)).cast("long")


def kept(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as a Parquet table into the shared scratch folder and read it
    back: cuts the lineage and survives the loss of any executor."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def mix64(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser (the public splitmix64 constants)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def squeeze(a: np.ndarray) -> bytes:
    """An integer array as compressed byte planes (small or sorted-delta values shrink)."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(planes).tobytes())


def stretch(b: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    planes = raw.reshape(np.dtype(dtype).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(dtype).ravel()


def squeeze_sorted(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys, stored as differences."""
    return squeeze(np.diff(keys, prepend=np.uint64(0)))


def stretch_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(stretch(b, np.uint64), dtype=np.uint64)


def map_texts(rows: DataFrame, text_col: str, fields: list[T.StructField],
              make: Callable[[], Callable[[list], list]], step: int = 256) -> DataFrame:
    """Replace ``text_col`` by new columns computed from lists of at most ``step``
    texts; every other column passes through untouched.  ``make()`` runs once a task
    and returns the function from texts to column values."""
    rest = [f for f in rows.schema.fields if f.name != text_col]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for whole in batches:
            for a in range(0, whole.num_rows, step):
                b = whole.slice(a, step)
                new = compute(b.column(text_col).to_pylist())
                arrays = [b.column(f.name) for f in rest] + [
                    pa.array(v, kind) for v, kind in zip(new, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, names=[f.name for f in [*rest, *fields]])

    return rows.mapInArrow(run, T.StructType([*rest, *fields]))
