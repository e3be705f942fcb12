"""Exact quantiles that never put a whole group in one task.

``percentile()`` keeps, per group, a map of every distinct value, merged in one
task: for a hot group, or a global median over the whole table, that task holds all
distinct values of the column.  Groups of at most ``bucket_rows`` rows take it; in
larger ones the values at ranks floor(h) and ceil(h), h = q (n - 1), are selected by
refinement, all measures and groups side by side:

1. one aggregate lays ``buckets`` + 1 grid values over each open interval (a bounded
   sketch; any grid gives the exact answer), and picks the two that should enclose
   the ranks;
2. a second aggregate counts exactly how many values lie below, on, between, on and
   above those two.  A rank that falls on one of them is found, whatever number of rows
   repeat it; the others lie in one open interval, which replaces the last;
3. when no interval holds more than ``bucket_rows`` values these are sorted and the
   ranks picked.

An interval loses both its enclosing values and about all but 2 of ``buckets`` parts of
the rest a round, so rounds grow with the logarithm of the largest group.  Every pass is
one grouped aggregate with partial sums: a row is never copied per measure, and no rank
is assigned to any row.

Defined cases: nulls do not count; a group without values gets null; NaN counts as
the largest value; null group keys are groups like any other; without keys an empty
table gives one row of nulls.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.session import cut_lineage

#: groups under refinement whose state (a few numbers a measure) is broadcast
BROADCAST_GROUPS = 10_000
#: rows of a group that are refined where they lie, even among more groups than that
HOT_ROWS = 1_000_000
NAN = float("nan")


def quantile_columns(df: DataFrame, keys: Sequence[str], cols: Sequence[str], q: float,
                     suffix: str, buckets: int = 64, bucket_rows: int = 200_000,
                     accuracy: int = 1000, max_group_rows: int | None = None) -> DataFrame:
    """keys + ``{col}{suffix}``: the exact linear-interpolated ``q`` quantile of
    every column per group of ``keys`` (``keys=[]``: one global row).

    Groups of at most ``bucket_rows`` rows use Spark's exact ``percentile`` aggregate in
    one pass (its value map is then bounded by ``bucket_rows``); larger ones are refined
    as in the module docstring.  ``max_group_rows``, when the caller already knows the
    largest group size, skips the size check.
    """
    keys, cols, q = list(keys), list(cols), float(q)

    def plain(d: DataFrame) -> DataFrame:
        return d.groupBy(*keys).agg(*[F.percentile(F.col(c).cast("double"), F.lit(q)).alias(f"{c}{suffix}")
                                      for c in cols])

    if max_group_rows is not None and max_group_rows <= bucket_rows:
        return plain(df)
    # one column, never null: joins on it match null keys, and aggregates by it need no other shuffle
    group = F.struct(*[F.col(f"`{k}`").alias(f"g{i}") for i, k in enumerate(keys)] or [F.lit(0).alias("g0")])
    cells = df.select(group.alias("_g"), *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)])
    big = cut_lineage(cells.groupBy("_g").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > bucket_rows))
    n = big.count()
    if not n:
        return plain(df)
    parts = [big]
    if n > BROADCAST_GROUPS:
        # their rows are dealt out by group, so the largest groups go the other way
        largest = [r["_n"] for r in big.orderBy(F.desc("_n")).select("_n").limit(BROADCAST_GROUPS).collect() if r["_n"] > HOT_ROWS]
        if largest:
            hot = F.col("_n") > max(HOT_ROWS, largest[-1] if len(largest) == BROADCAST_GROUPS else 0)
            parts = [big.where(hot), big.where(~hot)]
    found = [_Selection(cells, len(cols), q, buckets, bucket_rows, accuracy, part.select("_g"), part.count()).run() for part in parts]
    out = reduce(DataFrame.unionByName, found).select(
        *[F.col(f"_g.g{i}").alias(k) for i, k in enumerate(keys)],
        *[F.col(f"q{i}").alias(f"{c}{suffix}") for i, c in enumerate(cols)])
    return plain(_matched(df.withColumn("_g", group), big.select("_g"), n, "left_anti").drop("_g")).unionByName(out) if keys else out


def exact_quantiles(df: DataFrame, keys: Sequence[str], cols: Sequence[str], q: float,
                    **kw) -> DataFrame:
    """Long form of ``quantile_columns``: (keys..., measure, value)."""
    keys = list(keys)
    wide = quantile_columns(df, keys, cols, q, "__q", **kw)
    stack = ", ".join(f"'{c}', `{c}__q`" for c in cols)
    return wide.selectExpr(*[f"`{k}`" for k in keys], f"stack({len(cols)}, {stack}) AS (measure, value)")


def _matched(left: DataFrame, right: DataFrame, groups: int, how: str) -> DataFrame:
    """Equi-join by group; ``right`` has one row for each of ``groups``."""
    named = right.withColumnRenamed("_g", "_k")
    side = F.broadcast(named) if groups <= BROADCAST_GROUPS else named
    return left.join(side, F.col("_g") == F.col("_k"), how).drop("_k")


class _Selection:
    """Ranks of every (group, measure).  State columns of measure i: ``n`` values, ``lo`` and ``hi``
    the ranks, ``lov`` and ``hiv`` their values once found, ``a`` and ``b`` the open interval that
    holds the others (null: no bound), ``under`` the values not above ``a``, ``mid`` those inside."""

    def __init__(self, cells: DataFrame, width: int, q: float, buckets: int, most: int,
                 accuracy: int, big: DataFrame, groups: int):
        self.width, self.q, self.groups = width, q, groups
        self.buckets, self.most, self.accuracy = max(2, buckets), max(1, most), accuracy
        # read twice a round
        self.cells = cut_lineage(_matched(cells, big, groups, "left_semi"))

    def each(self, make) -> dict[str, Column]:
        return {f"{name}{i}": c for i in range(self.width) for name, c in make(i).items()}

    def with_state(self, state: DataFrame, names: Sequence[str]) -> DataFrame:
        cols = [f"{n}{i}" for i in range(self.width) for n in names]
        return _matched(self.cells, state.select("_g", *cols), self.groups, "inner")

    def gathered(self, cells: DataFrame, make) -> DataFrame:
        return cells.groupBy("_g").agg(*[c.alias(n) for n, c in self.each(make).items()])

    def joined(self, state: DataFrame, more: DataFrame) -> DataFrame:
        return _matched(state, more, self.groups, "inner")

    @staticmethod
    def inside(i: int) -> Column:
        v, a, b = (F.col(f"{c}{i}") for c in "vab")
        return v.isNotNull() & ~F.isnan(v) & F.coalesce(v > a, F.lit(True)) & F.coalesce(v < b, F.lit(True)) & (F.col(f"mid{i}") > 0)

    def start(self) -> DataFrame:
        sizes = self.gathered(self.cells, lambda i: {"n": F.count(f"v{i}"), "nan": F.count(F.when(F.isnan(f"v{i}"), 1))})

        def ranks(i: int) -> dict[str, Column]:
            h = (F.col(f"n{i}") - 1) * F.lit(self.q)
            return {"h": h, "lo": F.floor(h), "hi": F.ceil(h)}

        def state(i: int) -> dict[str, Column]:
            real, none = F.col(f"n{i}") - F.col(f"nan{i}"), F.lit(None).cast("double")
            value = lambda rank: F.when((F.col(f"n{i}") > 0) & (F.col(f"{rank}{i}") >= real), F.lit(NAN))  # noqa: E731  NaN sorts last
            return {"lov": value("lo"), "hiv": value("hi"), "a": none, "b": none, "under": F.lit(0).cast("long"),
                    "mid": F.when(F.col(f"lo{i}") < real, real).otherwise(0).cast("long")}

        return cut_lineage(sizes.withColumns(self.each(ranks)).withColumns(self.each(state)))

    def enclosed(self, state: DataFrame) -> DataFrame:
        """``x`` and ``y``: two values of the interval that should enclose the ranks."""
        grid = F.array(*[F.lit(j / self.buckets) for j in range(self.buckets + 1)])
        wide = self.with_state(state, ("a", "b", "mid"))
        grids = self.gathered(wide, lambda i: {"g": F.percentile_approx(F.when(self.inside(i), F.col(f"v{i}")), grid, self.accuracy)})

        def pick(i: int) -> dict[str, Column]:
            low, high = F.coalesce(F.col(f"lov{i}").isNull().cast("int"), F.lit(0)), F.col(f"hiv{i}").isNull()
            first = F.when(low == 1, F.col(f"lo{i}")).otherwise(F.col(f"hi{i}")) - F.col(f"under{i}")
            last = F.when(high, F.col(f"hi{i}")).otherwise(F.col(f"lo{i}")) - F.col(f"under{i}")
            share = lambda rank: rank * self.buckets / F.greatest(F.col(f"mid{i}"), F.lit(1))
            return {"x": F.get(f"g{i}", F.greatest(F.floor(share(first)), F.lit(0)).cast("int")),
                    "y": F.get(f"g{i}", F.least(F.ceil(share(last + 1)), F.lit(self.buckets)).cast("int"))}

        return cut_lineage(self.joined(state, grids).withColumns(self.each(pick)).drop(*[f"g{i}" for i in range(self.width)]))

    def refined(self, state: DataFrame) -> DataFrame:
        state = self.enclosed(state)
        wide = self.with_state(state, ("a", "b", "mid", "x", "y"))

        def zones(i: int) -> dict[str, Column]:
            v, x, y, here = F.col(f"v{i}"), F.col(f"x{i}"), F.col(f"y{i}"), self.inside(i)
            return {"c1": F.count_if(here & (v < x)), "c2": F.count_if(here & (v == x)),
                    "c3": F.count_if(here & (v > x) & (v < y)), "c4": F.count_if(here & (v == y) & (x < y)),
                    "c5": F.count_if(here & (v > y))}

        counted = self.joined(state, self.gathered(wide, zones))

        def after(i: int) -> dict[str, Column]:
            """Ranks at which each zone ends."""
            out, end = {}, F.col(f"under{i}")
            for z in ("c1", "c2", "c3", "c4", "c5"):
                end = end + F.col(f"{z}{i}")
                out[f"e{z[1]}"] = end
            return out

        def moved(i: int) -> dict[str, Column]:
            e1, e2, e3, e4, e5 = (F.col(f"e{z}{i}") for z in range(1, 6))
            x, y, under, busy = F.col(f"x{i}"), F.col(f"y{i}"), F.col(f"under{i}"), F.col(f"mid{i}") > 0

            def value(rank: str) -> Column:
                r = F.col(f"{rank}{i}")
                return F.coalesce(F.col(f"{rank}v{i}"), F.when(busy & (r >= e1) & (r < e2), x),
                                  F.when(busy & (r >= e3) & (r < e4), y))

            lov, hiv = value("lo"), value("hi")
            rank = F.when(lov.isNull(), F.col(f"lo{i}")).when(hiv.isNull(), F.col(f"hi{i}"))  # what is still sought
            zone = lambda one, three, five: F.when(rank < e1, one).when(rank < e3, three).otherwise(five)
            return {"lov": lov, "hiv": hiv, "a": zone(F.col(f"a{i}"), x, y), "b": zone(x, y, F.col(f"b{i}")),
                    "under": zone(under, e2, e4),
                    "mid": F.when(busy & rank.isNotNull(), zone(e1 - under, e3 - e2, e5 - e4)).otherwise(0).cast("long")}

        spent = [f"{c}{i}" for i in range(self.width) for c in ("x", "y", *[f"{z}{k}" for z in "ce" for k in range(1, 6)])]
        return cut_lineage(counted.withColumns(self.each(after)).withColumns(self.each(moved)).drop(*spent))

    def run(self) -> DataFrame:
        state = self.start()
        largest = F.max(F.greatest(F.lit(0), *[F.col(f"mid{i}") for i in range(self.width)]))
        while (state.agg(largest).first()[0] or 0) > self.most:
            state = self.refined(state)
        rest = self.gathered(self.with_state(state, ("a", "b", "mid")),
                             lambda i: {"s": F.sort_array(F.collect_list(F.when(self.inside(i), F.col(f"v{i}"))))})

        def value(i: int) -> dict[str, Column]:
            at = lambda rank: F.coalesce(F.col(f"{rank}v{i}"), F.get(
                f"s{i}", (F.col(f"{rank}{i}") - F.col(f"under{i}")).cast("int")))
            h, low, high = F.col(f"h{i}"), F.col(f"lo{i}"), F.col(f"hi{i}")
            return {"q": F.when(low == high, at("lo")).otherwise((high - h) * at("lo") + (h - low) * at("hi"))}

        return self.joined(state, rest).withColumns(self.each(value)).select(
            "_g", *[f"q{i}" for i in range(self.width)])
