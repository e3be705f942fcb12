"""Exact deduplication: group by a 128-bit content hash, then compare bytes.

One aggregation on (hash, text) both groups and compares: the shuffle hashes
the 128-bit digest, equality of the text column compares the bytes, and equal
texts meet already in the map-side partial aggregate, so a group that holds a
third of all rows arrives as one row per task.  A text never travels more than
once.  Different texts under one hash are found by counting texts per hash;
only then are the rows of those hashes matched on their bytes.

Defined cases: a null text counts as the empty text; a null id sorts below
every id; rows that repeat an id and a text are one group's members like any
others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import kept


def md5_128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                keep: str = "max", hash128: Callable[[Column], Column] = md5_128) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``keep`` is ``min`` or ``max``: which id of a group stays.  ``hash128`` can
    be replaced (tests use a hash that collides on purpose).
    """
    pick = {"min": F.min, "max": F.max}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("_id"), text.alias("_t"), hash128(text).alias("_h"))
    texts = rows.groupBy("_h", "_t").agg(pick("_id").alias("_keep"), F.count(F.lit(1)).alias("_n"))
    by_hash = kept(texts.groupBy("_h").agg(
        F.count(F.lit(1)).alias("_texts"), pick("_keep").alias("_keep"), F.sum("_n").alias("_n")),
        "dedup-groups")
    narrow = rows.select("_id", "_h", F.sha2(F.col("_t").cast("binary"), 256).alias("_sha"))
    out = narrow.join(by_hash.where("_texts = 1").drop("_texts"), "_h")
    collided = by_hash.where("_texts > 1").select("_h")
    if not collided.isEmpty():  # different texts under one hash: match on the bytes
        again = rows.join(collided, "_h", "left_semi")
        groups = again.groupBy("_h", "_t").agg(pick("_id").alias("_keep"),
                                               F.count(F.lit(1)).alias("_n"))
        out = out.unionByName(again.join(groups, ["_h", "_t"]).select(
            "_h", "_id", F.sha2(F.col("_t").cast("binary"), 256).alias("_sha"), "_keep", "_n"))
    return out.select(F.col("_id").alias(id_col), F.col("_keep").alias("keep_id"),
                      F.col("_n").cast("long").alias("group_size"),
                      F.col("_id").eqNullSafe(F.col("_keep")).alias("kept"),
                      F.col("_sha").alias("text_sha256"))


def keep_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   keep: str = "max") -> DataFrame:
    """The rows that stay, with all their columns: one row per distinct text.

    The whole row rides along in the same aggregation, so nothing is joined
    back.  Of rows that repeat the kept id, the one that sorts highest (lowest)
    in its other columns stays.
    """
    pick = {"min": F.min, "max": F.max}[keep]
    text = F.coalesce(F.col(text_col), F.lit(""))
    rest = [c for c in docs.columns if c != text_col]
    order = [id_col, *[c for c in rest if c != id_col]]
    row = F.struct(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(order)],
                   F.col(text_col).isNull().alias("_null"))
    groups = docs.select(md5_128(text).alias("_h"), text.alias("_t"), row.alias("_row")) \
        .groupBy("_h", "_t").agg(pick("_row").alias("_row"))
    return groups.select(*[
        F.when(F.col("_row._null"), F.lit(None).cast("string")).otherwise(F.col("_t")).alias(c)
        if c == text_col else F.col(f"_row._{order.index(c)}").alias(c) for c in docs.columns])
