"""Isolation forest (M11) over all rows, as Spark jobs.

1. **Samples.**  Tree ``t`` takes the ``sample_size`` rows of the whole table with the
   smallest (hash of row and tree, key).  A row meets a tree only if that hash lies
   below a cut derived from the row count, set so that a tree expects well more rows
   than it needs: about ``n_trees * sample_size`` pairs leave the scan whatever the
   table's size.  A tree that still has too few below the cut (or a table of few rows)
   is sampled again without it, so the result never depends on the cut.
2. **Growth.**  ``applyInPandas`` grows one tree a group of at most ``sample_size`` rows.
   A node holds its feature, threshold and children; a leaf holds its path length,
   depth + c(rows).
3. **Scores.**  The forest (at most trees x 2 * ``sample_size`` nodes, as flat arrays)
   goes to the tasks; a block of rows walks all trees at once, one step of depth a
   time.  The score is ``2 ** (-mean path / c(sample size))``, in (0, 1].

Rows whose vector is null or holds a null take no part in growing and get a null
score; rows that repeat a key and a vector have one hash and are taken together
as far as the sample goes.  An empty table grows no tree, and scores nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.session import cut_lineage

#: rows that walk the forest at once
BLOCK = 512
HASHES = 2.0 ** 64


def average_path(n: float) -> float:
    """c(n): average path length of an unsuccessful search in a binary tree of n rows."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + np.euler_gamma) - 2.0 * (n - 1.0) / n


def _rows(df: DataFrame, vec: str, keys: Sequence[str]) -> DataFrame:
    x = F.col(vec).cast("array<double>")
    return df.select(*keys, F.when(~F.exists(x, lambda v: v.isNull()), x).alias("_x"))


def tree_samples(df: DataFrame, vec: str, keys: Sequence[str], n_trees: int = 300,
                 sample_size: int = 256, seed: int = 42) -> DataFrame:
    """tree, keys, ``_h``, ``_x``: each tree's rows, the smallest (hash, keys) of all rows."""
    keys = list(keys)
    rows = _rows(df, vec, keys).where(F.col("_x").isNotNull()) \
        .withColumn("_base", F.xxhash64(*keys, "_x"))
    n = rows.count()

    def pairs(trees: Sequence[int], cut: int | None) -> DataFrame:
        all_of = F.transform(F.array(*[F.lit(t) for t in trees]) if len(trees) < n_trees else
                             F.sequence(F.lit(0), F.lit(n_trees - 1)),
                             lambda t: F.struct(t.cast("int").alias("tree"), F.xxhash64("_base", t.cast("int"), F.lit(seed)).alias("_h")))
        some = all_of if cut is None else F.filter(all_of, lambda p: p["_h"] < F.lit(cut))
        smallest = Window.partitionBy("tree").orderBy("_h", *keys)
        return rows.select(*keys, "_x", F.explode(some).alias("_p")).select("_p.tree", *keys, "_p._h", "_x") \
            .withColumn("_r", F.row_number().over(smallest)).where(F.col("_r") <= sample_size).drop("_r")

    share = (sample_size + 8 * math.sqrt(sample_size) + 32) / max(n, 1)
    if share >= 0.5:
        return pairs(range(n_trees), None)
    found = cut_lineage(pairs(range(n_trees), int(-HASHES / 2 + share * HASHES)))
    full = {r["tree"] for r in found.groupBy("tree").count().where(F.col("count") == sample_size).collect()}
    short = [t for t in range(n_trees) if t not in full]
    return found if not short else found.where(~F.col("tree").isin(short)).unionByName(pairs(short, None))


def _grow(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> tuple[list, list, list, list, list]:
    """Flat arrays of one tree: feature (-1 for a leaf), threshold, children, path length."""
    feature, threshold, left, right, path = [], [], [], [], []
    open_ = [(np.arange(len(x)), 0, None, False)]
    while open_:
        rows, depth, parent, is_right = open_.pop()
        i = len(feature)
        if parent is not None:
            (right if is_right else left)[parent] = i
        feature.append(-1), threshold.append(0.0), left.append(i), right.append(i)
        path.append(depth + average_path(len(rows)))
        if depth >= max_depth or len(rows) <= 1:
            continue
        low, high = x[rows].min(0), x[rows].max(0)
        wide = np.flatnonzero(high > low)
        if not len(wide):
            continue
        f = int(rng.choice(wide))
        t = float(rng.uniform(low[f], high[f]))
        inside = x[rows, f] < t
        feature[i], threshold[i] = f, t
        open_ += [(rows[~inside], depth + 1, i, True), (rows[inside], depth + 1, i, False)]
    return feature, threshold, left, right, path


class Forest:
    """All trees' nodes in five flat arrays; ``roots`` is where each tree begins."""

    def __init__(self, trees: Sequence, sample_size: int):
        at = np.cumsum([0, *[len(t["feature"]) for t in trees]])
        self.roots = at[:-1].astype(np.int32)
        join = lambda c, kind: np.concatenate([np.asarray(t[c], kind) for t in trees]) if trees else np.zeros(0, kind)
        self.feature, self.threshold, self.path = join("feature", np.int32), join("threshold", float), join("path", float)
        shift = np.repeat(self.roots, np.diff(at))
        self.left, self.right = join("left", np.int32) + shift, join("right", np.int32) + shift
        self.unit = average_path(sample_size)
        self.depth = max((t["depth"] for t in trees), default=0)
        self.sizes = [t["n"] for t in trees]

    def mean_path(self, x: np.ndarray) -> np.ndarray:
        node = np.tile(self.roots, (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[node]
            # a leaf is its own child on both sides
            node = np.where(x[row, np.maximum(f, 0)] < self.threshold[node], self.left[node], self.right[node])
        return self.path[node].mean(1)

    def score(self, mean_path: np.ndarray) -> np.ndarray:
        return 2.0 ** (-mean_path / self.unit) if self.unit else np.ones_like(mean_path)


TREE = "tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, path array<double>, depth int, n int"


def iforest_fit(df: DataFrame, vec: str, key: str | Sequence[str], n_trees: int = 300,
                sample_size: int = 256, seed: int = 42) -> Forest:
    keys = [key] if isinstance(key, str) else list(key)
    max_depth = math.ceil(math.log2(max(sample_size, 2)))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        t = int(pdf["tree"].iloc[0])
        x = np.stack(pdf.sort_values(["_h", *keys])["_x"].to_numpy()).astype(np.float64)
        arrays = _grow(x, np.random.default_rng([seed, t]), max_depth)
        return pd.DataFrame({"tree": [t], **{c: [a] for c, a in zip(("feature", "threshold", "left", "right", "path"), arrays)},
                             "depth": [max_depth], "n": [len(x)]})

    trees = tree_samples(df, vec, keys, n_trees, sample_size, seed).groupBy("tree").applyInPandas(grow, TREE)
    rows = trees.orderBy("tree").collect()  # bounded: n_trees x 2 * sample_size nodes
    return Forest(rows, min(sample_size, max((r["n"] for r in rows), default=0)))


def iforest_score(df: DataFrame, forest: Forest, vec: str, keys: Sequence[str],
                  out: str = "anomaly_score") -> DataFrame:
    """keys, ``mean_path`` and the score of every row."""
    held = df.sparkSession.sparkContext.broadcast(forest)
    keys = list(keys)
    schema = T.StructType([*df.select(*keys).schema.fields, T.StructField("mean_path", T.DoubleType()),
                           T.StructField(out, T.DoubleType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f = held.value
        for pdf in batches:
            for a in range(0, len(pdf), BLOCK):
                part = pdf.iloc[a:a + BLOCK]
                known = part["_x"].notna().to_numpy()
                path = np.full(len(part), np.nan)
                if known.any() and len(f.roots):
                    path[known] = f.mean_path(np.stack(part["_x"].to_numpy()[known]).astype(np.float64))
                yield part[keys].assign(**{"mean_path": path, out: f.score(path)})

    return _rows(df, vec, keys).mapInPandas(run, schema).withColumns(
        {c: F.when(~F.isnan(c), F.col(c)) for c in ("mean_path", out)})
