"""Evaluation queries over scored rows ``(key, date, y, score)``.

Everything is an aggregate over the scored table; nothing is collected.

Curve metrics (average precision, ROC-AUC, the PR curve, best-F1
threshold) need running sums over scores in descending order.  A single
unpartitioned window would put every row in one task, so the curve is
built in three steps:

1. collapse to one row per distinct score (partial aggregation, so a score
   shared by a third of the rows becomes one row before the shuffle);
2. range-partition the distinct scores into contiguous buckets, tag each
   row with its bucket and checkpoint (the bucket ids are then fixed, also
   when a task is re-run after an executor loss);
3. running sums inside each bucket plus the totals of all higher buckets
   (a table of ``buckets`` rows, broadcast).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.functions import rules as R
from fleetlens.operators.topk import top_k_per_group
from fleetlens.operators.quantiles import exact_quantiles
from fleetlens.session import cut_lineage, scalars

# Threshold used when the curve is empty; daily top-K list.
EMPTY_CURVE_THRESHOLD = 0.5
TOP_K_VALUES = (50, 100, 250, 500)


def _div(n: Column, d: Column) -> Column:
    """n / d, 0.0 when d is 0 or NULL (zero_division=0)."""
    return F.when(d > 0, n.cast("double") / d.cast("double")).otherwise(F.lit(0.0))


def _pred(score: str, threshold) -> Column:
    t = F.lit(threshold) if isinstance(threshold, (int, float)) else threshold
    return R.flag(F.col(score) >= t)


def binary_metrics(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Accuracy, precision, recall, F1 of the positive class; 0 when undefined (V1)."""
    yy, pp = F.col(y), F.col(pred)
    c = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(R.flag((yy == 1) & (pp == 1))).alias("tp"),
        F.sum(R.flag((yy == 0) & (pp == 1))).alias("fp"),
        F.sum(R.flag((yy == 1) & (pp == 0))).alias("fn"),
        F.sum(R.flag((yy == 0) & (pp == 0))).alias("tn"),
    )
    prec = _div(F.col("tp"), F.col("tp") + F.col("fp"))
    rec = _div(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select(
        _div(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
        prec.alias("precision"), rec.alias("recall"),
        _div(F.lit(2.0) * prec * rec, prec + rec).alias("f1"),
        F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"),
        F.col("fn").cast("long").alias("fn"), F.col("tn").cast("long").alias("tn"),
    )


def confusion_matrix(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Counts per (actual, predicted) with both classes present (V2)."""
    return (df.groupBy(F.col(y).alias("actual"))
              .pivot(pred, [0, 1]).count()
              .select("actual", F.coalesce(F.col("0"), F.lit(0)).cast("long").alias("pred_0"),
                      F.coalesce(F.col("1"), F.lit(0)).cast("long").alias("pred_1")))


def classification_report(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Per-class precision/recall/F1/support plus macro and weighted averages (V3).

    Long table: (label, precision, recall, f1, support).
    """
    yy, pp = F.col(y), F.col(pred)
    counts = df.agg(*[c.alias(f"{n}{cls}") for cls in (0, 1) for n, c in (
        ("tp", F.count_if((yy == cls) & (pp == cls))), ("pp", F.count_if(pp == cls)), ("support", F.count_if(yy == cls)))])
    for cls in (0, 1):  # one row from here on
        tp, p, s = (F.col(f"{n}{cls}") for n in ("tp", "pp", "support"))
        counts = counts.withColumns({f"precision{cls}": _div(tp, p), f"recall{cls}": _div(tp, s)})
        p, q = F.col(f"precision{cls}"), F.col(f"recall{cls}")
        counts = counts.withColumn(f"f1{cls}", _div(F.lit(2.0) * p * q, p + q))
    total = F.col("support0") + F.col("support1")
    names = ("precision", "recall", "f1")

    def line(label: str, of) -> Column:
        return F.struct(F.lit(label).alias("label"), *[of(n).alias(n) for n in names], (
            F.col(f"support{label}") if label in "01" else total).cast("long").alias("support"))

    lines = [line(str(cls), lambda n, cls=cls: F.col(f"{n}{cls}")) for cls in (0, 1)]
    lines.append(line("macro avg", lambda n: (F.col(f"{n}0") + F.col(f"{n}1")) / 2))
    lines.append(line("weighted avg", lambda n: _div(F.col(f"{n}0") * F.col("support0") + F.col(f"{n}1") * F.col("support1"), total)))
    return counts.select(F.inline(F.array(*lines)))


def score_curve(df: DataFrame, score: str = "score", y: str = "y",
                buckets: int | None = None) -> DataFrame:
    """One row per distinct score, descending (V6): threshold, pos, neg at that
    score, cumulative tp/fp at ``score >= threshold``, precision, recall.

    See the module docstring for the distributed running sum.
    """
    spark = df.sparkSession
    d = df.groupBy(F.col(score).alias("threshold")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"),
        F.sum((F.lit(1) - F.col(y)).cast("long")).alias("neg"))
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = (d.repartitionByRange(n, F.col("threshold").desc())
          .withColumn("_b", F.spark_partition_id()))
    d = cut_lineage(d)
    tot = d.groupBy("_b").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    off = tot.select("_b",
                     F.coalesce(F.sum("_bp").over(before), F.lit(0)).alias("_tp0"),
                     F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_fp0"))
    # ``off`` has one row per bucket: its size is the bucket count, not the data.
    run = (Window.partitionBy("_b").orderBy(F.col("threshold").desc())
           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total_pos = d.agg(F.sum("pos")).scalar()
    cur = (d.join(F.broadcast(off), "_b")
            .withColumn("tp", F.col("_tp0") + F.sum("pos").over(run))
            .withColumn("fp", F.col("_fp0") + F.sum("neg").over(run)))
    return cur.select(
        "threshold", "pos", "neg", "tp", "fp",
        _div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.when(total_pos > 0, F.col("tp") / total_pos).otherwise(F.lit(1.0)).alias("recall"))


def curve_metrics(curve: DataFrame) -> DataFrame:
    """Average precision (V4: sum of (R_n - R_n-1) P_n, ties grouped), ROC-AUC
    (V5: trapezoid over distinct scores = Mann-Whitney with mid-ranks) and the
    best-F1 threshold (V7: lowest threshold among equal F1; 0.5 on an empty
    curve) from a ``score_curve`` table -- one aggregate."""
    f1 = _div(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    c = curve.withColumn("f1", f1)
    best = F.max_by(F.struct("threshold", "precision", "recall", "f1"),
                    F.struct(F.col("f1"), -F.col("threshold")))
    agg = c.agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        F.sum(F.col("pos") * F.col("precision")).alias("_ap"),
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / F.lit(2.0))).alias("_auc"),
        best.alias("_best"))
    return agg.select(
        _div(F.col("_ap"), F.col("P")).alias("average_precision"),
        F.when((F.col("P") > 0) & (F.col("N") > 0),
               F.col("_auc") / (F.col("P").cast("double") * F.col("N").cast("double"))).alias("roc_auc"),
        F.coalesce(F.col("_best.threshold"), F.lit(EMPTY_CURVE_THRESHOLD)).alias("best_threshold"),
        F.coalesce(F.col("_best.precision"), F.lit(0.0)).alias("best_precision"),
        F.coalesce(F.col("_best.recall"), F.lit(0.0)).alias("best_recall"),
        F.coalesce(F.col("_best.f1"), F.lit(0.0)).alias("best_f1"),
    )


def regression_metrics(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """MAE, RMSE, R2 = 1 - SSE/SST, safe_mape = mean(|e| / max(y, 1)) (V8)."""
    e = F.col(pred) - F.col(y)
    # SST = n * population variance: Spark's numerically stable moment
    # aggregate, in the same single pass as the error sums
    a = df.agg(F.avg(F.abs(e)).alias("mae"),
               F.sqrt(F.avg(e * e)).alias("rmse"),
               F.sum(e * e).alias("_sse"),
               (F.var_pop(F.col(y).cast("double")) * F.count(F.col(y))).alias("_sst"),
               F.avg(F.abs(e) / F.greatest(F.col(y).cast("double"), F.lit(1.0))).alias("safe_mape"),
               F.count(F.lit(1)).alias("n"))
    return a.select("mae", "rmse",
                    F.when(F.col("_sst") > 0, F.lit(1.0) - F.col("_sse") / F.col("_sst"))
                     .otherwise(F.lit(0.0)).alias("r2"),
                    "safe_mape", "n")


def topk_capture(df: DataFrame, day: str = "date", key: str = "key", y: str = "y",
                 score: str = "score", ks: Sequence[int] = TOP_K_VALUES) -> DataFrame:
    """Daily top-K capture (V9): per day the K best scores (ties by key); per K the
    selected, captured and total positives, capture rate, precision@K and the
    mean daily capture over days with at least one positive.

    One ranking for max(K) (partial top-k before the shuffle), then every K is
    a conditional aggregate over the <= max(K) survivors per day; the days meet their
    totals where both are partitioned by day.
    """
    rows = cut_lineage(df.select(day, key, y, score))  # read for the ranking and for the totals
    ranked = top_k_per_group(rows, [day], [F.col(score).desc(), F.col(key).asc()], max(ks), "_rank")
    hit = F.col(y).cast("long")
    # the ranking is partitioned by day already: its counts need no shuffle of their own
    daily = ranked.groupBy(day).agg(*[F.count_if(F.col("_rank") <= k).alias(f"s{k}") for k in ks],
                                    *[F.sum(F.when(F.col("_rank") <= k, hit)).alias(f"h{k}") for k in ks])
    j = daily.join(rows.groupBy(day).agg(F.sum(hit).alias("positives")), day, "left")
    each = j.select("positives", F.inline(F.array(*[F.struct(F.lit(int(k)).alias("top_k_per_day"), F.col(f"s{k}").alias("selected"),
                                                             F.col(f"h{k}").alias("hits")) for k in ks])))
    out = each.groupBy("top_k_per_day").agg(
        F.sum("selected").cast("long").alias("selected_total"),
        F.sum("hits").cast("long").alias("captured_incidents"),
        F.sum("positives").cast("long").alias("total_incidents"),
        F.avg(F.when(F.col("positives") > 0, F.col("hits") / F.col("positives"))).alias("mean_daily_capture_rate"))
    return out.select(
        "top_k_per_day", "selected_total", "captured_incidents", "total_incidents",
        F.try_divide(F.col("captured_incidents").cast("double"), F.col("total_incidents")).alias("capture_rate"),
        F.try_divide(F.col("captured_incidents").cast("double"), F.col("selected_total")).alias("precision_at_k"),
        "mean_daily_capture_rate")


def score_histogram(df: DataFrame, score: str = "score", label: str = "y", bins: int = 50) -> DataFrame:
    """Counts per (label, equal-width bin) between the global min and max score."""
    row = df.agg(F.min(score).alias("lo"), F.max(score).alias("hi")).first()
    if row["lo"] is None:
        return df.select(F.col(label).alias("label"), F.lit(0).alias("bin"), F.lit(0).cast("long").alias("count"),
                         F.lit(0.0).alias("bin_low")).limit(0)
    lo, hi = F.lit(float(row["lo"])), F.lit(float(row["hi"]))
    width = (hi - lo) / F.lit(float(bins))
    b = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((F.col(score) - lo) / width).cast("int"), F.lit(bins - 1)))
    return (df.groupBy(F.col(label).alias("label"), b.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
              .withColumn("bin_low", lo + F.col("bin") * F.when(hi == lo, F.lit(0.0)).otherwise(width)))


def contamination(df: DataFrame, y: str = "y", floor: float = 0.001) -> float:
    """max(label rate, 0.001) (G13).  A model parameter: one scalar read back
    to the driver, as the quantile below and the LOF offset need a constant."""
    v = df.agg(F.greatest(F.avg(F.col(y).cast("double")), F.lit(floor))).first()[0]
    return float(v) if v is not None else floor


def score_threshold(train: DataFrame, score: str, contamination_value: float) -> Column:
    """Linear quantile of training scores at 1 - contamination (G14), as a
    scalar subquery Column (exact, by rank: ``operators.quantiles``)."""
    return exact_quantiles(train, [], [score], 1.0 - contamination_value).select("value").scalar()


def anomaly_evaluation(train: DataFrame, test: DataFrame, score: str = "score", y: str = "y",
                       contamination_value: float | None = None) -> DataFrame:
    """Threshold from the training quantile, then predicted rate, P/R/F1, AP, AUC.

    ``contamination_value`` overrides the label rate of ``train`` (the
    deployed model takes it from the whole training window while the
    threshold comes from the fit rows' scores).

    Every part is a one-row aggregate; they are put side by side with scalar
    subqueries, not joins."""
    cont = contamination(train, y) if contamination_value is None else float(contamination_value)
    thr_v = exact_quantiles(train, [], [score], 1.0 - cont).first()["value"]
    thr = F.lit(thr_v).cast("double")
    pred = test.withColumn("pred", _pred(score, thr))
    bm = binary_metrics(pred, y, "pred")
    cm = curve_metrics(score_curve(test, score, y))
    rates = pred.agg(F.avg(F.col("pred").cast("double")).alias("predicted_anomaly_rate"),
                     F.avg(F.col(y).cast("double")).alias("test_anomaly_rate"))
    b = scalars(bm.select("precision", "recall", "f1"))
    c = scalars(cm.select("average_precision", "roc_auc"))
    return rates.select(
        thr.alias("threshold"), F.lit(cont).alias("contamination"),
        "predicted_anomaly_rate", "test_anomaly_rate",
        b["precision"].alias("precision"), b["recall"].alias("recall"), b["f1"].alias("f1"),
        c["average_precision"].alias("average_precision"), c["roc_auc"].alias("roc_auc"))


def positive_rates(parts: dict[str, DataFrame], y: str = "y") -> DataFrame:
    """Positive rate of each named part (G16), one row per part."""
    out = None
    for name, d in parts.items():
        r = d.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("rows"),
                  F.avg(F.col(y).cast("double")).alias("positive_rate"))
        out = r if out is None else out.unionByName(r)
    return out


def leaderboard(results: Sequence[DataFrame], metric: str, secondary: str | None = None,
                secondary_desc: bool = False) -> DataFrame:
    """Union of per-model result rows (U1) ordered by metric desc, then the
    secondary metric, then model name (S2), with a ``winner`` flag on the
    first row (S6, V16).  One row per model: the ordering window is tiny."""
    out = results[0]
    for res in results[1:]:
        out = out.unionByName(res, allowMissingColumns=True)
    order = [F.col(metric).desc_nulls_last()]
    if secondary:
        order.append(F.col(secondary).desc_nulls_last() if secondary_desc else F.col(secondary).asc_nulls_last())
    order.append(F.col("model").asc())
    return (out.withColumn("winner", F.row_number().over(Window.orderBy(*order)) == 1)
               .orderBy(*order))
