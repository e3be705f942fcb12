"""Perturbation of any fitted scorer (R8), in long form; ``rowexplain`` keeps scores inside the row.

One Spark job per explanation, never a loop of jobs: every row is expanded
against its feature list (``explode`` of literals: a fixed factor, the number
of features), each copy has one feature replaced by its reference value,
the whole expanded frame is scored by one ``scorer`` call (any DataFrame ->
DataFrame function that adds ``score``, e.g. a fitted PipelineModel's
``transform`` plus a probability extraction), and the impacts are ranked per
row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetlens.functions import rules as R
from fleetlens.operators.topk import top_k_per_group

Scorer = Callable[[DataFrame], DataFrame]


def linear_scorer(weights: dict[str, float], bias: float = 0.0, out: str = "score") -> Scorer:
    """score = bias + sum(w * x), in the given feature order."""
    def score(df: DataFrame) -> DataFrame:
        expr = F.lit(float(bias))
        for f, w in weights.items():
            expr = expr + F.lit(float(w)) * F.col(f).cast("double")
        return df.withColumn(out, expr)
    return score


def _pick(feature: Column, values: dict[str, Column]) -> Column:
    expr = F.lit(None).cast("double")
    for f, v in values.items():
        expr = F.when(feature == F.lit(f), v.cast("double")).otherwise(expr)
    return expr


def perturbation_explain(df: DataFrame, keys: Sequence[str], features: Sequence[str], scorer: Scorer,
                         reference: dict[str, Column | float] | None = None, top_n: int = 5,
                         positive_only: bool = False, method: str = "permutation_fallback",
                         numeric_direction: bool = False, carry: Sequence[str] = ()) -> DataFrame:
    """Long table (keys, rank, feature, label, value, reference, impact,
    abs_impact, direction, method) of the ``top_n`` features per row.

    * ``reference=None``: each feature is set to 0 (R6); impacts ranked by
      |impact|, direction = increases/decreases_prediction.
    * ``reference={f: value}`` with ``positive_only=True``: the R7 form --
      only impacts > 0 are kept, ranked by impact, direction is the value
      against its reference (above/below/near_normal, B27).

    ``carry`` columns ride along unchanged (inputs the scorer needs that are
    not explained, e.g. categoricals).
    """
    keys = list(keys)
    refs = {f: (F.lit(0.0) if reference is None else
                (F.lit(float(reference[f])) if isinstance(reference[f], (int, float)) else reference[f]))
            for f in features}
    carry = [c for c in carry if c not in features and c not in keys]
    base = scorer(df.select(*keys, *features, *carry)).withColumnRenamed("score", "_base")
    exp = base.select(*keys, *features, *carry, "_base",
                      F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    feat = F.col("feature")
    exp = exp.withColumns({"_value": _pick(feat, {f: F.col(f) for f in features}),
                           "_ref": _pick(feat, refs)})
    pert = exp.withColumns({f: F.when(feat == F.lit(f), refs[f].cast("double")).otherwise(F.col(f).cast("double"))
                            for f in features})
    scored = scorer(pert)
    imp = scored.select(*keys, "feature", F.col("_value").alias("value"), F.col("_ref").alias("reference"),
                        (F.col("_base") - F.col("score")).alias("impact"))
    imp = imp.withColumn("abs_impact", F.abs("impact"))
    if positive_only:
        imp = imp.filter(F.col("impact") > 0)
        order = [F.col("impact").desc(), F.col("feature").asc()]
    else:
        order = [F.col("abs_impact").desc(), F.col("feature").asc()]
    ranked = top_k_per_group(imp, keys, order, top_n, "rank")
    direction = (R.value_direction("value", "reference") if numeric_direction
                 else R.impact_direction("impact"))
    return ranked.select(*keys, "rank", "feature", R.readable_label("feature").alias("label"),
                         "value", "reference", "impact", "abs_impact", direction.alias("direction"),
                         F.lit(method).alias("method"))
