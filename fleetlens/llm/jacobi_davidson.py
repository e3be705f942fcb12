"""Embedding whitening by block Jacobi-Davidson on distributed covariance products.

Vectors become exact integers, each distinct one counts once (the fit list) and lies
in blocks in a written table.  The covariance is never formed: a product with a
narrow matrix is one job over the blocks, each task sums (x - mean)((x - mean)'U) over
its own rows, and Spark adds the tasks' sums by row of the result.

The wanted eigenpairs are sought together.  A search space is projected
(Rayleigh-Ritz); leading Ritz pairs whose residual has reached double precision are
locked, in falling order of their values; for each of the others the correction
equation (I - QQ')(V - theta I)(I - QQ') t = -r, with Q the locked and the current Ritz
vectors, is solved by a few steps of MINRES.  All of them step together, so a step is
one job whatever their number.  Corrections widen the search space, which restarts
from its leading Ritz vectors when it is full.  The driver holds matrices of
(dimension x search space) and no rows.

Defined cases: rows whose vector is null or holds a null or non-finite entry are
dropped; shorter vectors count as padded with zeros; rows that repeat an id or a
vector are all returned.  Components whose eigenvalue is no more than rounding (rank
below ``k``, one distinct vector) cannot be whitened and are not returned; an empty
table gives an empty result.  ``deviation`` is null where it exceeds 64 bits.  Columns
beyond id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from fleetlens.llm.common import kept

#: vectors of a block, rows projected at once
BLOCK, STEP = 4096, 1024
#: MINRES steps of a correction, rounds without convergence that end the search
INNER, ROUNDS = 6, 200
#: a residual counts as rounding below this many units of the largest eigenvalue
PRECISION = 64 * np.finfo(float).eps


def integer_vectors(vectors: DataFrame, id_col: str, vec_col: str, scale: float, shift: int) -> DataFrame:
    """(id, x array<long>) of the rows that remain, x = floor(scale * entry) + shift."""
    v = F.col(vec_col)
    ok = v.isNotNull() & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    return vectors.where(F.coalesce(ok, F.lit(False))).select(
        F.col(id_col).alias("id"),
        F.transform(v, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")) + F.lit(shift)).alias("x"))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    values = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(values.flatten(), np.int64).reshape(len(values), dim)


class Fit:
    """The blocks of the fit list, its size and sums, and products with its covariance."""

    def __init__(self, points: DataFrame, dim: int, width: int):
        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for a in range(0, b.num_rows, BLOCK):
                    x = _matrix(b.slice(a, BLOCK).column("x"), dim)
                    yield pa.RecordBatch.from_pydict({"x": [x.tobytes()], "n": [len(x)]})

        self.dim, self.width = dim, width
        self.blocks = kept(points.select("x").distinct().mapInArrow(pack, "x binary, n long"), "whiten-blocks")

        def sums(x: np.ndarray) -> np.ndarray:
            return x.sum(0)[:, None]

        self.n = self.blocks.agg(F.sum("n")).first()[0] or 0
        self.sums = self._added(sums, 1, "long")[:, 0] if self.n else np.zeros(dim, np.int64)
        # the mean in two parts: an integer, subtracted exactly, and a remainder below 1
        self.base = np.array([int(s) // self.n for s in self.sums], np.int64) if self.n else self.sums
        self.rest = np.array([int(s) - self.n * int(b) for s, b in zip(self.sums, self.base)], np.int64)
        self.part = self.rest / max(self.n, 1)

    def _added(self, of: Callable[[np.ndarray], np.ndarray], width: int, kind: str) -> np.ndarray:
        """The sum over all blocks of a matrix of the fit's dimension x ``width``."""
        dim = self.dim

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for b in batches:
                for raw in b.column("x").to_pylist():
                    y = of(np.frombuffer(raw, np.int64).reshape(-1, dim))
                    total = y if total is None else total + y
            if total is not None:
                yield pa.RecordBatch.from_pydict({"i": np.arange(len(total), dtype=np.int32),
                                                  "v": pa.array(list(total), pa.list_(pa.int64() if kind == "long" else pa.float64()))})

        parts = self.blocks.select("x").mapInArrow(run, f"i int, v array<{kind}>")
        rows = parts.groupBy("i").agg(*[F.sum(F.get("v", F.lit(j))).alias(f"v{j}") for j in range(width)]).collect()
        return np.array([r[1:] for r in sorted(rows)], np.int64 if kind == "long" else float)

    def product(self, u: np.ndarray) -> np.ndarray:
        """Covariance times ``u``; columns go in groups of the same width."""
        base, part = self.base, self.part
        out = []
        for a in range(0, u.shape[1], self.width):
            some = np.zeros((self.dim, self.width))
            some[:, :min(self.width, u.shape[1] - a)] = u[:, a:a + self.width]

            def centred(x: np.ndarray, some: np.ndarray = some) -> np.ndarray:
                c = (x - base) - part
                return c.T @ (c @ some)

            out.append(self._added(centred, self.width, "double") / self.n)
        return np.hstack(out)[:, :u.shape[1]]

    def gram(self, w: np.ndarray) -> np.ndarray:
        """Covariance of the vectors projected on the columns of ``w``, about their own mean."""
        base, part, m = self.base, self.part, w.shape[1]

        def squares(x: np.ndarray) -> np.ndarray:
            z = ((x - base) - part) @ w
            return np.vstack([z.T @ z, z.sum(0)[None, :]])

        total = self._added(squares, m, "double") / self.n
        return total[:m] - np.outer(total[m], total[m])

    def trace(self) -> float:
        base, part = self.base, self.part

        def squares(x: np.ndarray) -> np.ndarray:
            c = (x - base) - part
            return (c * c).sum(0)[:, None]

        return float(self._added(squares, 1, "double").sum() / self.n)


def _orthonormal(new: np.ndarray, old: np.ndarray) -> np.ndarray:
    """The part of ``new`` that ``old`` does not hold, as orthonormal columns."""
    size = np.linalg.norm(new, axis=0)
    new = new[:, size > 0] / size[size > 0]
    for _ in range(2):
        new = new - old @ (old.T @ new)
    u, s, _ = np.linalg.svd(new, full_matrices=False)
    u = u[:, s > 1e-8]
    u = u - old @ (old.T @ u)
    return np.linalg.qr(u)[0] if u.shape[1] else u


def minres(apply: Callable[[np.ndarray], np.ndarray], b: np.ndarray, steps: int) -> np.ndarray:
    """Columns x of least |b - Ax| over ``steps`` Lanczos vectors, all columns at once."""
    beta = np.linalg.norm(b, axis=0)
    safe = lambda v: np.where(np.abs(v) > 0, v, 1.0)
    v_old, v = np.zeros_like(b), b / safe(beta)
    x, d1, d2 = np.zeros_like(b), np.zeros_like(b), np.zeros_like(b)
    left, last = beta.copy(), np.zeros_like(beta)
    c1 = c2 = np.ones_like(beta)
    s1 = s2 = np.zeros_like(beta)
    first = beta.max(initial=0.0)
    for _ in range(steps):
        w = apply(v)
        a = (v * w).sum(0)
        w = w - a * v - last * v_old
        after = np.linalg.norm(w, axis=0)
        eps, rest = s2 * last, c2 * last  # the two older rotations, then a new one
        delta, gamma = c1 * rest + s1 * a, c1 * a - s1 * rest
        rho = np.hypot(gamma, after)
        c, s = np.where(rho > 0, gamma / safe(rho), 1.0), np.where(rho > 0, after / safe(rho), 0.0)
        d = (v - delta * d1 - eps * d2) / safe(rho)
        x = x + np.where(rho > 0, c * left, 0.0) * d
        left = -s * left
        d2, d1 = d1, d
        c2, s2, c1, s1 = c1, s1, c, s
        v_old, v, last = v, w / safe(after), after
        if np.abs(left).max(initial=0.0) <= 1e-3 * first or not after.any():
            break
    return x


def leading_pairs(product: Callable[[np.ndarray], np.ndarray], dim: int, k: int, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    k = min(k, dim)
    most = min(dim, max(4 * k, k + 24))
    basis = _orthonormal(np.random.default_rng(seed).standard_normal((dim, min(dim, k + 4))), np.zeros((dim, 0)))
    image = product(basis)
    for _ in range(ROUNDS):
        h = basis.T @ image
        values, y = np.linalg.eigh((h + h.T) / 2)
        values, y = values[::-1], y[:, ::-1]
        ritz, away = basis @ y[:, :k], image @ y[:, :k] - (basis @ y[:, :k]) * values[:k]
        scale = max(abs(values[0]), np.finfo(float).tiny)
        open_ = np.linalg.norm(away, axis=0) > PRECISION * scale
        if not open_.any():
            return values[:k], ritz
        locked = int(np.argmax(open_))  # those before the first open pair
        if basis.shape[1] + (k - locked) > most:
            keep = min(basis.shape[1], max(k + 4, most // 2))
            basis, image = basis @ y[:, :keep], image @ y[:, :keep]
        todo = np.flatnonzero(open_)
        theta = values[todo]
        away = away[:, todo] - ritz @ (ritz.T @ away[:, todo])

        def corrected(v: np.ndarray, q: np.ndarray = ritz, theta: np.ndarray = theta) -> np.ndarray:
            w = product(v) - v * theta
            return w - q @ (q.T @ w)

        t = minres(corrected, -away, INNER)
        new = _orthonormal(t, basis)
        if not new.shape[1]:  # the space holds the corrections already: fresh directions, or it is whole
            new = _orthonormal(np.random.default_rng(seed + basis.shape[1]).standard_normal((dim, k)), basis)
        if new.shape[1]:
            basis, image = np.hstack([basis, new]), np.hstack([image, product(new)])
        else:  # rounding is left: products of the Ritz vectors themselves
            basis = np.linalg.qr(basis @ y)[0]
            image = product(basis)
            h = basis.T @ image
            values, y = np.linalg.eigh((h + h.T) / 2)
            return values[::-1][:k], (basis @ y[:, ::-1])[:, :k]
    raise ArithmeticError(f"{ROUNDS} rounds without convergence")


def whiten(vectors: DataFrame, k: int = 16, id_col: str = "vec_id", vec_col: str = "embedding",
           scale: float = 64.0, shift: int = 1_000_000) -> DataFrame:
    """Per remaining row and component: id, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    points = integer_vectors(vectors, id_col, vec_col, scale, shift)
    kind = points.schema["id"].dataType
    schema = T.StructType([T.StructField(id_col, kind), *T.StructType.fromDDL(
        "component int, n long, deviation long, whitened double, explained double, identity_error double").fields])
    dim = points.agg(F.max(F.size("x"))).first()[0]
    if not dim:
        return spark.createDataFrame([], schema)
    zero = F.lit(shift).cast("long")
    points = points.select("id", F.concat("x", F.array_repeat(zero, F.lit(dim) - F.size("x"))).alias("x"))
    fit = Fit(points, dim, min(k, dim))
    trace = fit.trace()
    values, axes = leading_pairs(fit.product, dim, k) if trace > 0 else (np.zeros(0), np.zeros((dim, 0)))
    real = values > dim * np.finfo(float).eps * max(values.max(initial=0.0), 0.0)
    values, axes = values[real], axes[:, real]
    if not len(values):
        return spark.createDataFrame([], schema)
    w = axes / np.sqrt(values)
    error = float(np.abs(fit.gram(w) - np.eye(len(values))).max())
    n, base, part, rest, m = fit.n, fit.base, fit.part, fit.rest, len(values)
    explained = values / trace

    def deviations(x: np.ndarray) -> list:
        d = x - base
        most = n * float(np.abs(d).max(initial=0)) + float(np.abs(rest).max(initial=0))
        if dim * most * most < 2.0 ** 62:
            d = n * d - rest
            return (d * d).sum(1).tolist()
        exact = ((n * d.astype(object) - rest.astype(object)) ** 2).sum(1)
        return [v if v < 2 ** 63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, STEP):
                b = whole.slice(a, STEP)
                x = _matrix(b.column("x"), dim)
                z = ((x - base) - part) @ w
                each = pa.array(np.repeat(np.arange(len(x)), m))
                yield pa.RecordBatch.from_arrays([
                    b.column("id").take(each), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * m, n, np.int64)), pa.array(deviations(x), pa.int64()).take(each),
                    pa.array(z.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * m, error)),
                ], schema=pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema.fields]))

    return points.mapInArrow(run, schema)
