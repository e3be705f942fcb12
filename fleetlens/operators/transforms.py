"""Feature transforms.

Fitted statistics are one aggregate over the training frame; the handful of
numbers per feature (median, mean, std) is read back as model state -- its
size is the feature count, not the data -- and applied as column
expressions, so the transform stays inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.feature import (PCA, OneHotEncoder, StringIndexer, UnivariateFeatureSelector,
                                VarianceThresholdSelector, VectorAssembler, VectorSlicer)
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def feature_columns(df: DataFrame, exclude: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) column names by type."""
    num, cat = [], []
    for f in df.schema.fields:
        if f.name in exclude:
            continue
        if isinstance(f.dataType, NUMERIC) and not isinstance(f.dataType, T.BooleanType):
            num.append(f.name)
        elif isinstance(f.dataType, T.StringType):
            cat.append(f.name)
    return num, cat


def fit_median(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Exact median per column (F1); Spark's ``Imputer`` median is approximate."""
    if not cols:
        return {}
    from fleetlens.operators.quantiles import exact_quantiles
    got = {r["measure"]: r["value"] for r in exact_quantiles(df, [], list(cols), 0.5).collect()}
    return {c: (float(got[c]) if got.get(c) is not None else 0.0) for c in cols}


def fit_mode(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """Most frequent value per categorical column, ties -> smallest (F2)."""
    out = {}
    for c in cols:
        r = (df.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
               .agg(F.min_by(F.col(c), F.struct(-F.col("n"), F.col(c))).alias("m")).first())
        out[c] = r["m"] if r and r["m"] is not None else ""
    return out


def fit_scaler(df: DataFrame, cols: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population std per column (F3); zero std -> 1 (sklearn
    ``StandardScaler``; Spark's uses the sample std)."""
    if not cols:
        return {}
    aggs = []
    for c in cols:
        x = F.col(c).cast("double")
        aggs += [F.avg(x).alias(f"{c}__m"), F.stddev_pop(x).alias(f"{c}__s")]
    row = df.agg(*aggs).first()
    out = {}
    for c in cols:
        m = row[f"{c}__m"] or 0.0
        s = row[f"{c}__s"]
        out[c] = (float(m), float(s) if s not in (None, 0.0) else 1.0)
    return out


def apply_fill(df: DataFrame, values: dict) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in values.items()})


def apply_scaler(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, (m, s) in params.items()})


class TabularPreprocessor:
    """Median impute + population scale numerics, mode impute + one-hot
    categoricals (unknown -> all zeros), assemble to ``features`` (F1-F6, F11).

    ``fit`` reads statistics once; ``transform`` is column expressions plus a
    fitted ``PipelineModel`` for the string indexing / encoding.
    """

    def __init__(self, numeric: Sequence[str], categorical: Sequence[str] = (),
                 drop_first: bool = False, output: str = "features"):
        self.numeric = list(numeric)
        self.categorical = list(categorical)
        self.drop_first = drop_first
        self.output = output

    def fit(self, df: DataFrame) -> "TabularPreprocessor":
        self.medians = fit_median(df, self.numeric)
        filled = apply_fill(df, self.medians)
        self.scale = fit_scaler(filled, self.numeric)
        self.modes = fit_mode(df, self.categorical)
        stages = []
        enc_cols = []
        if self.categorical:
            idx = [f"{c}__idx" for c in self.categorical]
            stages.append(StringIndexer(inputCols=self.categorical, outputCols=idx,
                                        stringOrderType="alphabetAsc", handleInvalid="keep"))
            enc_cols = [f"{c}__oh" for c in self.categorical]
            stages.append(OneHotEncoder(inputCols=idx, outputCols=enc_cols, dropLast=True))
        stages.append(VectorAssembler(inputCols=self.numeric + enc_cols, outputCol=self.output,
                                      handleInvalid="keep"))
        prepared = apply_fill(filled, self.modes)
        self.pipeline = Pipeline(stages=stages).fit(prepared)
        self.feature_names = self._names()
        return self

    def _names(self) -> list[str]:
        names = [f"num__{c}" for c in self.numeric]
        for st in self.pipeline.stages:
            if hasattr(st, "labelsArray"):
                for c, labels in zip(self.categorical, st.labelsArray):
                    names += [f"cat__{c}_{v}" for v in labels]
        return names

    def transform(self, df: DataFrame) -> DataFrame:
        out = apply_scaler(apply_fill(df, self.medians), self.scale)
        out = apply_fill(out, self.modes)
        out = self.pipeline.transform(out)
        if self.drop_first and self.categorical:
            out = drop_first_slots(out, self.output, len(self.numeric), self.category_sizes())
        return out

    def stages(self, input_cols: Sequence[str]) -> list:
        """The fitted preprocessing as Spark ML stages, so preprocessing and
        model save and load as one ``PipelineModel`` (A4): a ``SQLTransformer``
        carrying the fitted medians, moments and modes as literals, then the
        fitted indexer / encoder / assembler (and the drop-first slicer)."""
        from pyspark.ml.feature import SQLTransformer

        def num(v: float) -> str:
            return f"CAST('{float(v)!r}' AS DOUBLE)"

        exprs = []
        for c in input_cols:
            q = f"`{c}`"
            if c in self.scale:
                m, s = self.scale[c]
                exprs.append(f"(COALESCE(CAST({q} AS DOUBLE), {num(self.medians[c])}) - {num(m)}) / {num(s)} AS {q}")
            elif c in self.modes:
                mode = str(self.modes[c]).replace("'", "\\'")
                exprs.append(f"COALESCE({q}, '{mode}') AS {q}")
            else:
                exprs.append(q)
        out = [SQLTransformer(statement=f"SELECT {', '.join(exprs)} FROM __THIS__"), *self.pipeline.stages]
        if self.drop_first and self.categorical:
            keep, pos = list(range(len(self.numeric))), len(self.numeric)
            for size in self.category_sizes():
                keep += list(range(pos + 1, pos + size))
                pos += size
            out.append(VectorSlicer(inputCol=self.output, outputCol=f"{self.output}__df", indices=keep))
        return out

    def category_sizes(self) -> list[int]:
        st = self.pipeline.stages[0]
        return [len(x) for x in st.labelsArray] if hasattr(st, "labelsArray") else []


def drop_first_slots(df: DataFrame, col: str, n_numeric: int, sizes: Sequence[int]) -> DataFrame:
    """One-hot drop-first (F5): remove the first slot of every categorical block."""
    keep = list(range(n_numeric))
    pos = n_numeric
    for s in sizes:
        keep += list(range(pos + 1, pos + s))
        pos += s
    return (VectorSlicer(inputCol=col, outputCol=f"{col}__df", indices=keep).transform(df)
            .drop(col).withColumnRenamed(f"{col}__df", col))


def variance_filter(df: DataFrame, col: str = "features", out: str = "features_var") -> DataFrame:
    """Drop zero-variance slots."""
    return VarianceThresholdSelector(varianceThreshold=0.0, featuresCol=col, outputCol=out).fit(df).transform(df)


def select_k_best(df: DataFrame, k: int, col: str = "features", label: str = "label",
                  out: str = "features_k") -> DataFrame:
    """ANOVA-F top-k selection (F8)."""
    sel = UnivariateFeatureSelector(featuresCol=col, outputCol=out, labelCol=label,
                                    selectionMode="numTopFeatures")
    sel.setFeatureType("continuous").setLabelType("categorical").setSelectionThreshold(k)
    return sel.fit(df).transform(df)


def pca_by_variance(df: DataFrame, share: float, col: str = "features", out: str = "features_pca"):
    """Smallest k whose explained variance reaches ``share`` (F9); returns (model, k)."""
    dim = len(df.select(col).first()[0])
    full = PCA(k=dim, inputCol=col, outputCol=out).fit(df)
    cum, k = 0.0, dim
    for i, v in enumerate(full.explainedVariance.toArray()):
        cum += float(v)
        if cum >= share - 1e-12:
            k = i + 1
            break
    return PCA(k=k, inputCol=col, outputCol=out).fit(df), k


def pca_coordinates(df: DataFrame, key: str, cluster: str, col: str = "features") -> DataFrame:
    """2-D PCA coordinates per entity with its cluster (F10): the data behind
    the scatter plot."""
    from pyspark.ml.functions import vector_to_array
    m = PCA(k=2, inputCol=col, outputCol="_p").fit(df)
    p = m.transform(df).withColumn("_a", vector_to_array("_p"))
    return p.select(key, F.col("_a")[0].alias("x"), F.col("_a")[1].alias("y"), cluster)
