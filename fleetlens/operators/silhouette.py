"""Exact Euclidean silhouette (V10), block against block.

Every point needs its mean distance to each cluster, so all pairs are measured, but none leaves
the task that measures it: rows are packed into blocks, blocks are dealt into about the square
root of their number of groups, and each pair of groups meets once (every block travels
to that many tasks, not to every block).  A task gives, per point and cluster, the sum of
distances to the rows it holds; an aggregate adds the tasks' sums, and the rest is
arithmetic on points x clusters rows.

Defined cases: a cluster of one row scores 0; fewer than two clusters, or as many as rows,
give -1 (the squared form's convention); rows with a null cluster or a null or non-finite vector take no
part; no rows give null.  Vectors must have equal lengths.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.session import cut_lineage

#: rows of a block, most blocks of a group, rows measured at once
BLOCK, GROUP, STEP = 1024, 32, 256


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances; the expanded form, and the plain one where it cancels."""
    a_sq, b_sq = (a * a).sum(1)[:, None], (b * b).sum(1)[None, :]
    d2 = a_sq + b_sq - 2.0 * (a @ b.T)
    close = np.nonzero(d2 <= 1e-6 * (a_sq + b_sq))
    d2[close] = ((a[close[0]] - b[close[1]]) ** 2).sum(1)
    return np.sqrt(np.maximum(d2, 0.0))


def point_silhouettes(df: DataFrame, vec: str, cluster: str = "cluster") -> DataFrame:
    """``cluster``, ``s``: the silhouette of every point."""
    x = F.col(vec).cast("array<double>")
    ok = F.col(cluster).isNotNull() & x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < math.inf))
    rows = df.where(F.coalesce(ok, F.lit(False))).select(F.col(cluster).alias("_c"), x.alias("_x"))
    sizes = {r["_c"]: r["n"] for r in rows.groupBy("_c").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a cluster
    names = sorted(sizes)
    n, k = sum(sizes.values()), len(names)
    if n == 0 or k < 2 or k >= n:
        score = None if n == 0 else -1.0
        return rows.select(F.col("_c").alias("cluster"), F.lit(score).cast("double").alias("s"))
    code = {c: i for i, c in enumerate(names)}

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), BLOCK):
                p = pdf.iloc[a:a + BLOCK]
                yield pd.DataFrame({"c": [p["_c"].map(code).to_numpy(np.int32).tobytes()],
                                    "x": [np.stack(p["_x"].to_numpy()).astype(float).tobytes()]})

    blocks = rows.mapInPandas(pack, "c binary, x binary").withColumn("b", F.monotonically_increasing_id())
    blocks = cut_lineage(blocks)
    count = blocks.count()
    groups = max(1, math.ceil(math.sqrt(count)), math.ceil(count / GROUP))
    g = blocks.withColumn("g", F.pmod(F.xxhash64("b"), F.lit(groups)))
    others = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long")))
    left = g.withColumn("h", others)
    right = g.withColumnRenamed("g", "h").withColumn("g", others)

    def sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for one in left.itertuples(index=False):
            c = np.frombuffer(one.c, np.int32)
            a = np.frombuffer(one.x).reshape(len(c), -1)
            total = np.zeros((len(c), k))
            for two in right.itertuples(index=False):
                e = np.frombuffer(two.c, np.int32)
                member = (e[:, None] == np.arange(k)).astype(float)
                b = np.frombuffer(two.x).reshape(len(e), -1)
                for s in range(0, len(a), STEP):
                    total[s:s + STEP] += distances(a[s:s + STEP], b) @ member
            out.append(pd.DataFrame({"b": one.b, "pos": np.arange(len(c), dtype=np.int32), "own": c, "d": list(total)}))
        return pd.concat(out) if out else pd.DataFrame({"b": [], "pos": [], "own": [], "d": []})

    parts = left.groupBy("g", "h").cogroup(right.groupBy("g", "h")).applyInPandas(sums, "b long, pos int, own int, d array<double>")
    point = parts.groupBy("b", "pos", "own").agg(*[F.sum(F.get("d", F.lit(i))).alias(f"d{i}") for i in range(k)])
    size = F.array(*[F.lit(float(sizes[c])) for c in names])
    total = F.array(*[f"d{i}" for i in range(k)])
    own, own_n = F.get(total, F.col("own")), F.get(size, F.col("own"))
    a = own / F.greatest(own_n - 1, F.lit(1.0))
    means = F.zip_with(total, size, lambda s, m: s / m)
    b = F.array_min(F.filter(F.transform(means, lambda v, i: F.when(i != F.col("own"), v)), lambda v: v.isNotNull()))
    s = F.when(own_n <= 1, F.lit(0.0)).when(F.greatest(a, b) == 0, F.lit(0.0)).otherwise((b - a) / F.greatest(a, b))
    labels = F.array(*[F.lit(c) for c in names])
    return point.select(F.get(labels, F.col("own")).alias("cluster"), s.alias("s"))


def silhouette_euclidean(df: DataFrame, vec: str, cluster: str = "cluster") -> DataFrame:
    """One row: the mean over all points."""
    return point_silhouettes(df, vec, cluster).agg(F.avg("s").alias("silhouette"))
