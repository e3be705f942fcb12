"""Extremely randomised trees (M4, M8), grown level by level as Spark jobs.

All trees grow together.  A level takes two passes over the rows:

1. each task walks its rows down every tree and gives, per open node and candidate feature (a
   random share of the features, drawn per node), the least and the largest value; an aggregate
   makes them the node's own;
2. per node and candidate a threshold is drawn uniformly between the two (from the seed, the
   tree, the node and the feature alone), each task counts and sums the labels on the left of
   it, and the candidate that lowers the weighted variance most becomes the split.

Without resampling every tree sees every row, as in the reference's forests.  Random numbers
depend on no row and no partition, and nodes on sums alone, so a forest is the same however
the rows are laid out (up to the rounding of sums).  Only the nodes, at most
2 ** (depth + 1) a tree, come to the driver.

For classes 0 and 1 the weighted variance is half the Gini impurity, and a leaf's mean the
probability, so one forest serves both.  Defined cases: a null or NaN label or feature drops the row
from fitting; a node stays a leaf at the depth limit, with too few rows, with one label value, or
when no candidate divides it; without rows a forest predicts null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.session import cut_lineage

#: rows that a task walks at once
BLOCK = 256


class Trees:
    """Flat arrays of all nodes, trees one after another."""

    def __init__(self, trees: int, width: int):
        self.trees, self.width = trees, width
        self.feature = np.full(trees, -1, np.int32)
        self.threshold = np.full(trees, np.inf)
        self.left, self.right = np.arange(trees, dtype=np.int32), np.arange(trees, dtype=np.int32)
        self.value = np.full(trees, np.nan)
        self.key = np.arange(trees, dtype=np.uint64) * np.uint64(1 << 32) + np.uint64(1)  # tree, place in the tree
        self.depth = 0

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(rows, trees): the node that each row reaches in each tree."""
        at = np.tile(np.arange(self.trees, dtype=np.int32), (len(x), 1))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            at = np.where(x[row, np.maximum(f, 0)] <= self.threshold[at], self.left[at], self.right[at])
        return at

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.value[self.leaves(x)].mean(1)

    def split(self, node: int, feature: int, threshold: float) -> None:
        n = len(self.feature)
        self.feature[node], self.threshold[node], self.left[node], self.right[node] = feature, threshold, n, n + 1
        grow = lambda a, v: np.append(a, np.array([v, v], a.dtype))
        self.feature, self.threshold, self.value = grow(self.feature, -1), grow(self.threshold, np.inf), grow(self.value, np.nan)
        self.left, self.right = np.append(self.left, np.int32([n, n + 1])), np.append(self.right, np.int32([n, n + 1]))
        tree, place = int(self.key[node]) >> 32, int(self.key[node]) & 0xFFFFFFFF
        self.key = np.append(self.key, np.array([tree << 32 | 2 * place, tree << 32 | 2 * place + 1], np.uint64))


def _uniform(key: np.ndarray, feature: np.ndarray, seed: int, purpose: int) -> np.ndarray:
    """One number in [0, 1) for each (node, feature), by a bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = key * np.uint64(0x9E3779B97F4A7C15) + feature.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9) \
            + np.uint64(seed * 4 + purpose) * np.uint64(0x94D049BB133111EB)
        for _ in range(2):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
    return (x >> np.uint64(11)).astype(float) / 2.0 ** 53


def _entries(features: str) -> Column:
    return F.when(F.col(features).isNotNull(), vector_to_array(features))


class ExtraTrees:
    """``fit(rows)`` of ``features`` (vector), ``label`` and an optional weight column."""

    def __init__(self, n_trees: int = 400, max_depth: int = 5, feature_share: float = 0.6, min_leaf: int = 10,
                 seed: int = 42, features: str = "features", label: str = "label", weight: str | None = None,
                 probability: bool = False):
        self.n_trees, self.max_depth, self.share, self.min_leaf, self.seed = n_trees, max_depth, feature_share, min_leaf, seed
        self.features, self.label, self.weight, self.probability = features, label, weight, probability

    def fit(self, df: DataFrame) -> "ExtraTreesModel":
        w = F.col(self.weight).cast("double") if self.weight else F.lit(1.0)
        rows = cut_lineage(df.select(_entries(self.features).alias("x"), F.col(self.label).cast("double").alias("y"), w.alias("w")).where(
            F.col("y").isNotNull() & ~F.isnan("y") & F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v))))
        width = rows.agg(F.max(F.size("x"))).first()[0]
        trees = Trees(self.n_trees, width or 0)
        if not width:
            return ExtraTreesModel(trees, self)
        few = max(1, int(self.share * width))
        open_ = np.arange(self.n_trees)
        for level in range(self.max_depth + 1):
            # candidates of a node: the ``few`` features of smallest random number
            draw = _uniform(np.repeat(trees.key[open_], width), np.tile(np.arange(width), len(open_)), self.seed, 0).reshape(-1, width)
            cand = np.sort(np.argsort(draw, axis=1, kind="stable")[:, :few], axis=1)
            ranges = _ranges(rows, trees, open_, cand)
            node_stats = {int(n): s for n, s in ranges["nodes"].items()}
            for n, (count, total, wy, _) in node_stats.items():
                trees.value[n] = wy / total
            busy = [i for i, n in enumerate(open_) if int(n) in node_stats and _may_split(node_stats[int(n)], self.min_leaf)]
            if level == self.max_depth or not busy:
                break
            open_, cand = open_[busy], cand[busy]
            low, high = ranges["low"][busy], ranges["high"][busy]
            u = _uniform(np.repeat(trees.key[open_], few), cand.ravel(), self.seed, 1).reshape(cand.shape)
            cut = low + u * (high - low)
            cut = np.where(cut >= high, low, cut)
            left = _lefts(rows, trees, open_, cand, cut)
            chosen = []
            for i, n in enumerate(open_):
                best = _best(left[i], node_stats[int(n)], low[i] < high[i], self.min_leaf)
                if best is not None:
                    chosen.append((int(n), int(cand[i, best]), float(cut[i, best])))
            if not chosen:
                break
            first = len(trees.feature)
            for split in chosen:
                trees.split(*split)
            trees.depth = level + 1
            open_ = np.arange(first, len(trees.feature))
        return ExtraTreesModel(trees, self)


def _may_split(stats: tuple, min_leaf: int) -> bool:
    count, total, wy, wyy = stats
    return count >= 2 * min_leaf and wyy / total - (wy / total) ** 2 > 1e-12 * max(1.0, wyy / total)


def _best(left: np.ndarray, stats: tuple, divides: np.ndarray, min_leaf: int) -> int | None:
    """The candidate with the smallest weighted variance of both sides; ties to the first."""
    count, total, wy, wyy = stats
    n, w, s = left[:, 0], left[:, 1], left[:, 2]
    ok = divides & (n >= min_leaf) & (count - n >= min_leaf) & (w > 0) & (total - w > 0)
    if not ok.any():
        return None
    with np.errstate(divide="ignore", invalid="ignore"):
        # the sum of squares is the node's own whatever the split: compare what the means explain
        gain = np.where(ok, s * s / w + (wy - s) ** 2 / (total - w), -np.inf)
    # sums of different task orders differ by rounding: nearly equal gains go to the first
    return int(np.flatnonzero(gain >= gain.max() - 1e-9 * abs(gain.max()))[0])


def _summed(rows: DataFrame, make, ddl: str, aggregates: list) -> list:
    """One grouped aggregate of what each task makes of its rows, by ``slot``."""
    names = [f.name for f in T.StructType.fromDDL(ddl)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            for a in range(0, b.num_rows, BLOCK):
                part = b.slice(a, BLOCK)
                x = np.asarray(part.column("x").flatten(), float).reshape(part.num_rows, -1)
                held = make(x, part.column("y").to_numpy(False), part.column("w").to_numpy(False), held)
        if held is not None:
            slots = np.flatnonzero(held[0].ravel() > 0)  # the count comes first
            yield pa.RecordBatch.from_pydict(dict(zip(names, [slots, *(h.ravel()[slots] for h in held)])))

    return rows.mapInArrow(run, ddl).groupBy("slot").agg(*aggregates).collect()


def _ranges(rows: DataFrame, trees: Trees, open_: np.ndarray, cand: np.ndarray) -> dict:
    """Least and largest value of every candidate, and count, weight and label sums of every node."""
    place = np.full(len(trees.feature), -1, np.int64)
    place[open_] = np.arange(len(open_))
    shape = (len(open_), cand.shape[1] + 1)  # the last column holds the node's own sums

    def make(x, y, w, held):
        if held is None:
            held = [np.zeros(shape), np.full(shape, np.inf), np.full(shape, -np.inf), np.zeros(shape), np.zeros(shape), np.zeros(shape)]
        at = place[trees.leaves(x)]
        row, tree = np.nonzero(at >= 0)
        node = at[row, tree]
        np.add.at(held[0], node, 1.0)
        values = x[row[:, None], cand[node]]
        np.minimum.at(held[1][:, :-1], node, values)
        np.maximum.at(held[2][:, :-1], node, values)
        for h, v in zip(held[3:], (w, w * y, w * y * y)):
            h[:, -1] += np.bincount(node, weights=v[row], minlength=len(open_))
        return held

    out = _summed(rows, make, "slot long, n double, low double, high double, w double, wy double, wyy double",
                  [F.sum("n"), F.min("low"), F.max("high"), F.sum("w"), F.sum("wy"), F.sum("wyy")])
    low, high, nodes = np.zeros(cand.shape), np.zeros(cand.shape), {}
    for slot, n, lo, hi, w, wy, wyy in out:
        i, j = divmod(slot, shape[1])
        if j == shape[1] - 1:
            if w > 0:
                nodes[open_[i]] = (n, w, wy, wyy)
        else:
            low[i, j], high[i, j] = lo, hi
    return {"low": low, "high": high, "nodes": nodes}


def _lefts(rows: DataFrame, trees: Trees, open_: np.ndarray, cand: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """(node, candidate, 3): count, weight and label sum of the rows at most at the threshold."""
    place = np.full(len(trees.feature), -1, np.int64)
    place[open_] = np.arange(len(open_))

    def make(x, y, w, held):
        held = [np.zeros(cand.shape) for _ in range(3)] if held is None else held
        at = place[trees.leaves(x)]
        row, tree = np.nonzero(at >= 0)
        node = at[row, tree]
        goes = x[row[:, None], cand[node]] <= cut[node]
        for h, v in zip(held, (np.ones(len(y)), w, w * y)):
            np.add.at(h, node, goes * v[row][:, None])
        return held

    out = np.zeros((*cand.shape, 3))
    for slot, n, w, wy in _summed(rows, make, "slot long, n double, w double, wy double", [F.sum("n"), F.sum("w"), F.sum("wy")]):
        out[divmod(slot, cand.shape[1])] = (n, w, wy)
    return out


class ExtraTreesModel:
    def __init__(self, trees: Trees, params: ExtraTrees):
        self.trees, self.params = trees, params

    def transform(self, df: DataFrame) -> DataFrame:
        """``prediction``, or ``score`` (a probability) and ``prediction`` for a classifier; null features give null."""
        held = df.sparkSession.sparkContext.broadcast(self.trees)
        rest = df.columns
        rows = df.withColumn("_x", _entries(self.params.features))
        vec = self.params.features
        carried = [c for c in rest if c != vec]
        rows = rows.select(*[f"`{c}`" for c in carried], "_x")
        schema = T.StructType([*rows.schema.fields, T.StructField("_out", T.DoubleType())])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            t = held.value
            for whole in batches:
                for a in range(0, whole.num_rows, BLOCK):
                    b = whole.slice(a, BLOCK)
                    x = np.array([r if r is not None else [math.nan] * t.width for r in b.column("_x").to_pylist()], float)
                    y = t.predict(x) if t.width else np.full(len(x), math.nan)
                    y = np.where(np.isnan(x).any(1) if t.width else True, math.nan, y)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(y)], names=[*b.schema.names, "_out"])

        out = rows.mapInArrow(run, schema).drop("_x").withColumn("_out", F.when(~F.isnan("_out"), F.col("_out")))
        if not self.params.probability:
            return out.withColumnRenamed("_out", "prediction")
        return out.withColumnRenamed("_out", "score").withColumn("prediction", (F.col("score") >= 0.5).cast("double"))
