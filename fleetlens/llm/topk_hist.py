"""Exact top-k inner-product search by distributed histogram selection.

Queries are dealt into blocks of a bounded size, candidates are packed into
blocks, and every (query block, candidate block) pair is scored by one matrix
product.  No pass emits scores: a pass counts, for each query, how many scores
fall into each bin of the interval that is known to hold its k-th value; the
counts are summed over all blocks, the interval shrinks to one bin, and after
log(range) passes it is a single integer, the exact k-th value.  A last pass
emits the scores above it and, of those equal to it, the k smallest ids of each
block, so ties of any number stay bounded.  Per-query state lives in a table
that is rewritten between passes; the driver only counts passes.

Defined cases: vectors that are null or hold null or non-finite components take
no part; shorter vectors count as padded with zeros; an id that repeats among
the queries is one query (its smallest vector), and rows with a query's own id
are not its candidates; with fewer than k candidates all are returned; an empty
table gives an empty result.  Scores are exact integers (beyond 64 bits they
saturate).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import kept

QUERY_BLOCK, CANDIDATE_BLOCK, STRIPE, BINS = 1024, 8192, 2048, 128
RESULT = "query_id long, rank int, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, v array<long>) of the vectors that take part."""
    v = F.col(vec_col)
    ok = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)
                                  & (F.abs(x.cast("double")) < float("inf")))
    return vectors.where(F.coalesce(ok, F.lit(False)) & F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double"))).alias("v"))


def inner(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer products: float64 while every sum stays below 2^53."""
    most = np.abs(q.astype(float)).max(initial=0) * np.abs(c.astype(float)).max(initial=0) * q.shape[1]
    if most < 2.0 ** 53:
        return (q.astype(float) @ c.T.astype(float)).astype(np.int64)
    if most < 2.0 ** 62:
        return q @ c.T
    exact = q.astype(object) @ c.T.astype(object)
    return np.clip(exact, -2 ** 63, 2 ** 63 - 1).astype(np.int64)


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows into blocks of at most CANDIDATE_BLOCK vectors."""
    for b in batches:
        for a in range(0, len(b), CANDIDATE_BLOCK):
            part = b.iloc[a:a + CANDIDATE_BLOCK]
            yield pd.DataFrame({"ids": [part["id"].to_numpy()], "vs": [np.concatenate(part["v"].to_list())]})


def _stripes(row, dim: int):
    """(query ids, candidate ids, scores with own rows masked out) of one pair, in stripes."""
    qid, cid = np.asarray(row.qids, np.int64), np.asarray(row.ids, np.int64)
    q = np.asarray(row.qvs, np.int64).reshape(len(qid), dim)
    c = np.asarray(row.vs, np.int64).reshape(len(cid), dim)
    for a in range(0, len(cid), STRIPE):
        ids = cid[a:a + STRIPE]
        yield qid, ids, inner(q, c[a:a + STRIPE]), qid[:, None] != ids[None, :]


def _counts(dim: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                lo, hi = np.asarray(row.lo, np.int64), np.asarray(row.hi, np.int64)
                width = -((lo - hi) // BINS)
                total = np.zeros(len(lo) * BINS, np.int64)
                for _, _, s, other in _stripes(row, dim):
                    inside = other & (s >= lo[:, None]) & (s < hi[:, None])
                    who, _ = np.nonzero(inside)
                    total += np.bincount(who * BINS + (s[inside] - lo[who]) // width[who],
                                         minlength=len(total))
                at = np.flatnonzero(total)
                yield pd.DataFrame({"qb": row.qb, "pos": (at // BINS).astype(np.int32),
                                    "bin": (at % BINS).astype(np.int32), "n": total[at]})
    return run


def _hits(dim: int, k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for row in b.itertuples():
                kth = np.asarray(row.lo, np.int64)
                for qid, ids, s, other in _stripes(row, dim):
                    order = np.argsort(ids, kind="stable")
                    ids, s, other = ids[order], s[:, order], other[:, order]
                    tie = other & (s == kth[:, None])
                    tie &= np.cumsum(tie, axis=1) <= k  # the k smallest ids of the stripe
                    who, col = np.nonzero(tie | (other & (s > kth[:, None])))
                    yield pd.DataFrame({"query_id": qid[who], "vec_id": ids[col], "score": s[who, col]})
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id",
          vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Each query's k highest scores against all other rows: query_id, rank, vec_id, score."""
    spark = vectors.sparkSession
    raw = vectors.withColumn("_is_query", F.coalesce(is_query, F.lit(False)))
    points = quantised(raw, id_col, vec_col, scale)
    asks = quantised(raw.where("_is_query"), id_col, vec_col, scale).groupBy("id").agg(F.min("v").alias("v"))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    size = points.agg(F.max(F.size("v")).alias("dim"), F.max(norm).alias("norm")).first()
    n_asks = asks.count()
    if not size.dim or not n_asks:
        return spark.createDataFrame([], RESULT)
    dim = int(size.dim)
    most = min(int(math.sqrt(size.norm) ** 2 * 1.0001) + 1, 2 ** 62)  # |score| <= most, by Cauchy-Schwarz
    pad = F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))).alias("v")
    blocks = math.ceil(n_asks / QUERY_BLOCK)
    q = asks.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("qb"), "id", pad) \
        .groupBy("qb").agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("rows")) \
        .select("qb", F.col("rows.id").alias("qids"), F.flatten("rows.v").alias("qvs"))
    q = kept(q, "topk-queries")
    c = kept(points.select("id", pad).mapInPandas(_packed, "ids array<long>, vs array<long>"), "topk-blocks")
    pairs = c.withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) \
        .withColumn("qb", F.col("qb").cast("long"))
    state = q.select("qb", F.posexplode("qids").alias("pos", "qid")).select(
        "qb", "pos", F.lit(-most).cast("long").alias("lo"), F.lit(most + 1).cast("long").alias("hi"),
        F.lit(0).cast("long").alias("above"))

    def joined(state: DataFrame) -> DataFrame:
        s = state.groupBy("qb").agg(F.sort_array(F.collect_list(F.struct("pos", "lo", "hi"))).alias("s"))
        return pairs.join(q.join(s.select("qb", F.col("s.lo").alias("lo"), F.col("s.hi").alias("hi")), "qb"), "qb")

    span = 2 * most + 1
    down = Window.partitionBy("qb", "pos").orderBy(F.col("bin").desc())
    while span > 1:
        hist = joined(state).mapInPandas(_counts(dim), "qb long, pos int, bin int, n long") \
            .groupBy("qb", "pos", "bin").agg(F.sum("n").alias("n")) \
            .withColumn("cum", F.sum("n").over(down.rowsBetween(Window.unboundedPreceding, 0)))
        held = hist.join(state, ["qb", "pos"]).where(F.col("above") + F.col("cum") >= k) \
            .groupBy("qb", "pos").agg(F.max("bin").alias("bin"), F.min("cum").alias("cum"),
                                      F.max_by("n", "bin").alias("n"))
        width = F.expr(f"(hi - lo + {BINS - 1}) div {BINS}")
        low = F.col("lo") + F.col("bin") * width
        # no bin holds the k-th value where there are fewer than k scores: everything stays in
        state = kept(state.join(held, ["qb", "pos"], "left").select(
            "qb", "pos", F.coalesce(low, F.lit(-most - 1)).cast("long").alias("lo"),
            F.coalesce(F.least(F.col("hi"), low + width), F.lit(-most)).cast("long").alias("hi"),
            (F.col("above") + F.coalesce(F.col("cum") - F.col("n"), F.lit(0))).alias("above")), "topk-state")
        span = -(-span // BINS)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    hits = joined(state).mapInPandas(_hits(dim, k), "query_id long, vec_id long, score long")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")
