"""Regression and classification pipelines and their evaluation; descents are in ``descent``."""

from __future__ import annotations

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, Bucketizer, StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.vector import dot
from tessera.operators.blocks import pack
from tessera.operators.descent import descend, newton  # noqa: F401
from tessera.storage import discard, materialise


def assembled(columns: list[str], standardise: bool = True) -> list:
    steps = [VectorAssembler(inputCols=columns, outputCol="raw", handleInvalid="skip")]
    return [*steps, StandardScaler(inputCol="raw", outputCol="features", withMean=standardise, withStd=True)]


def regressor(kind: str, label: str = "label", seed: int = 42, **more):
    """linear, ridge, forest (50 trees of depth 8) or boosted (100 trees of depth 5)."""
    if kind == "linear":
        return LinearRegression(labelCol=label, **more)
    if kind == "ridge":
        return LinearRegression(labelCol=label, **{"regParam": 0.1, "elasticNetParam": 0.0, **more})
    if kind == "forest":
        return RandomForestRegressor(labelCol=label, seed=seed, **{"numTrees": 50, "maxDepth": 8, **more})
    if kind == "boosted":
        return GBTRegressor(labelCol=label, seed=seed, **{"maxIter": 100, "maxDepth": 5, **more})
    raise ValueError(f"unknown regressor {kind!r}")


#: Quantile bins a column of what trees learn from (Spark's own number), and the shares that rows of one cell of bins are dealt to.
BINS, SHARES = 32, 8


def _fit_trees(df: DataFrame, columns: list[str], kind: str, label: str, **more) -> PipelineModel:
    """Trees over cells: rows that lie in the same quantile bin of every column, which no split tells apart.

    A cell goes into the fit as ``SHARES`` rows (by a hash of the row) with their number as weight and their mean
    label; squared errors within a cell are the same for every tree. All rows are read, for the bins' edges and
    for the cells; what the rounds read grows with the cells, not the rows. A forest's samples are drawn of these
    shares. Rows with a null among the columns or without a label are left out.
    """
    bins = [f"__bin_{c}" for c in columns]
    known = df.dropna(subset=[*columns, label]).select(*[F.col(c).cast("double").alias(c) for c in columns], F.col(label).cast("double").alias(label))
    edges = known.approxQuantile(columns, [k / BINS for k in range(1, BINS)], 1 / (8 * BINS))
    # a value that many rows have is an edge once; without any edge there is one at 0, which Bucketizer needs
    splits = [[-np.inf, *(sorted({x for x in e if np.isfinite(x)}) or [0.0]), np.inf] for e in edges]
    binned = Bucketizer(inputCols=columns, outputCols=bins, splitsArray=splits, handleInvalid="skip")
    share = F.pmod(F.xxhash64(*columns, label), F.lit(SHARES)).alias("share")
    cells = binned.transform(known).groupBy(*bins, share).agg(F.avg(label).alias(label), F.count(F.lit(1)).cast("double").alias("weight"))
    stages = [VectorAssembler(inputCols=bins, outputCol="features"), regressor(kind, label, **{"maxBins": BINS + 2, **more}).setWeightCol("weight")]
    # groups come in no fixed order, and the order of rows decides a forest's samples
    cells = materialise(cells.orderBy(*bins, "share"), "cells", few=True)
    try:
        return PipelineModel([binned, *Pipeline(stages=stages).fit(cells.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))).stages])
    finally:
        discard(cells)


def train(df: DataFrame, columns: list[str], kind: str, label: str = "label", path: str | None = None, **more) -> PipelineModel:
    if kind in ("forest", "boosted"):
        model = _fit_trees(df, columns, kind, label, **more)
    else:
        model = Pipeline(stages=[*assembled(columns), regressor(kind, label, **more)]).fit(df)
    if path:
        model.write().overwrite().save(path)
    return model


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def regression_report(predicted: DataFrame, label: str = "label", tolerance: float = 10.0) -> DataFrame:
    """One row: rmse, mae, r2, and the share of predictions within the tolerance."""
    e = F.col("prediction") - F.col(label)
    stats = predicted.agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        F.avg(F.when(F.abs(e) <= tolerance, 1.0).otherwise(0.0)).alias("accuracy"),
        (1 - F.sum(e * e) / F.nullif(F.var_pop(label) * F.count(label), F.lit(0.0))).alias("r2"),
    )
    return stats


def train_test_verdict(train_rows: DataFrame, test_rows: DataFrame, columns: list[str], components: int, label: str = "label") -> dict:
    """PCA and regression fitted on one table and judged on another."""
    steps = [VectorAssembler(inputCols=columns, outputCol="raw"), PCA(k=components, inputCol="raw", outputCol="features"), LinearRegression(labelCol=label)]
    model = Pipeline(stages=steps).fit(train_rows)
    a, b = (regression_report(model.transform(t), label).first() for t in (train_rows, test_rows))
    good = b["r2"] > 0.7 and b["rmse"] < 1.5 * a["rmse"]
    return {"train_rmse": a["rmse"], "test_rmse": b["rmse"], "test_r2": b["r2"], "verdict": "good" if good else "fair" if b["r2"] > 0.5 else "poor"}


def components_for(df: DataFrame, columns: list[str], share: float = 0.9, default: int = 100) -> int:
    """The fewest principal components with that share of the variance; ``default`` if none reaches it."""
    raw = VectorAssembler(inputCols=columns, outputCol="raw").transform(df)
    sums = np.cumsum(PCA(k=len(columns), inputCol="raw", outputCol="p").fit(raw).explainedVariance.toArray())
    at = np.flatnonzero(sums >= share)
    return int(at[0]) + 1 if len(at) else default


def modal_class(df: DataFrame, column: str):
    """The most frequent value; the smallest of several."""
    return df.groupBy(column).count().orderBy(F.desc("count"), column).first()[0]


def one_vs_rest(df: DataFrame, column: str, positive=None) -> DataFrame:
    """Adds label: 1.0 where ``column`` has the positive (default: modal) class."""
    positive = modal_class(df, column) if positive is None else positive
    return df.withColumn("label", (F.col(column) == F.lit(positive)).cast("double"))


def accuracy(predicted: DataFrame, label: str = "label") -> DataFrame:
    return predicted.agg(F.avg((F.col("prediction") == F.col(label)).cast("double")).alias("accuracy"))


def logistic(df: DataFrame, features: str = "features", label: str = "label", ridge: float = 0.0) -> np.ndarray:
    """Logistic regression weights (intercept last) by Newton steps over an array<double> column; see ``descent.newton``."""
    packed = pack(df, F.col(features), F.col(label))
    try:
        return newton(packed, ridge)
    finally:
        packed.discard()


def classify_vectors(df: DataFrame, weights: np.ndarray, features: str = "features") -> DataFrame:
    """Adds prediction: 1.0 where the weighted sum of an array<double> column, and the intercept, is above 0."""
    w = F.array(*[F.lit(float(x)) for x in weights[:-1]])
    return df.withColumn("prediction", (dot(F.col(features), w) + F.lit(float(weights[-1])) > 0).cast("double"))


def gradient(df: DataFrame, columns: list[str], weights: np.ndarray, label: str = "label") -> tuple[np.ndarray, int]:
    """Summed logistic gradient (intercept last) and the number of rows: one aggregation."""
    z = F.lit(float(weights[-1]))
    for c, w in zip(columns, weights, strict=False):
        z = z + F.col(c) * float(w)
    err = 1 / (1 + F.exp(-z)) - F.col(label)
    sums = [F.sum(err * F.col(c)).alias(f"g{i}") for i, c in enumerate(columns)] + [F.sum(err).alias("g"), F.count(F.lit(1)).alias("n")]
    row = df.agg(*sums).first()
    return np.array([float(row[i] or 0.0) for i in range(len(columns) + 1)]), row["n"]


def classify_with(df: DataFrame, columns: list[str], weights: np.ndarray) -> DataFrame:
    z = F.lit(float(weights[-1]))
    for c, w in zip(columns, weights, strict=False):
        z = z + F.col(c) * float(w)
    return df.withColumn("prediction", (z > 0).cast("double"))


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns less their mean, by their population deviation; a constant column becomes 0."""
    stats = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns]).first()
    out = [F.lit(0.0).alias(c) if not stats[f"s_{c}"] else ((F.col(c) - stats[f"m_{c}"]) / stats[f"s_{c}"]).alias(c) for c in columns]
    return df.select(*out, *[c for c in df.columns if c not in columns])
