"""Pooled machine-learning models over feature frames.

One model serves all series (their ``level`` is a feature).  Training reads the rows where
they are; the driver holds coefficients, trees and scores only.  Trees grow on one binned
table (``trees``), linear models come from Gram sums (``linear``), both for all folds at
once; Huber regression is Spark ML's.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.trees import Spec
from . import linear, trees
from .analogs import nearest_neighbours
from .scheduling import side_by_side

SEED = 42


def assemble(df: DataFrame, features: Sequence[str], nulls: str = "zero") -> DataFrame:
    """A ``raw`` vector of the named features; nulls become 0 or drop the row."""
    names = list(features)
    doubles = df.withColumns({c: F.col(c).cast("double") for c in names})
    filled = doubles.fillna(0.0, names) if nulls == "zero" else doubles.dropna(subset=names)
    return VectorAssembler(inputCols=names, outputCol="raw").transform(filled)


def fit_scaler(df: DataFrame, kind: str):
    """``robust`` centres on the median and divides by the quartile range; ``standard``
    uses mean and sample deviation."""
    if kind == "robust":
        return linear.robust_scalers(df)[0]
    return StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True).fit(df)


def huber(epsilon: float = 1.35, alpha: float = 1e-4) -> LinearRegression:
    return LinearRegression(labelCol="y", loss="huber", epsilon=epsilon, regParam=alpha, standardization=False)


#: Kinds whose models are trees.
TREES = ("gbt", "forest", "extra_trees", "adaboost")


def tree_spec(kind: str, settings: Mapping) -> Spec:
    """A tree model's settings as the kernel takes them."""
    x = dict(settings)
    seed = x.pop("seed", SEED)
    if kind == "adaboost":
        return Spec("median", x.pop("rounds", 50), x.pop("max_depth", 3), x.pop("rate", 1.0), 0.0, seed=seed)
    rows = x.pop("minInstancesPerNode", 1)
    if kind == "gbt":
        return Spec(
            "sum", x["maxIter"], x["maxDepth"], x["stepSize"], rows, row_share=x.get("subsamplingRate", 1.0),
            column_share=float(x.get("featureSubsetStrategy", 1.0)), seed=seed,
        )
    return Spec(
        "mean", x["numTrees"], x["maxDepth"], 1.0, rows, bootstrap=kind == "forest", random_cuts=kind == "extra_trees", seed=seed
    )


class Linear:
    """A fitted linear rule over the ``features`` vector; with a covariance of the weights
    also the predictive deviation ``prediction_sd``, from the distance to the ``centre`` of
    the training rows."""

    def __init__(self, weights, intercept: float, cov=None, noise: float = 0.0, centre=None):
        self.weights, self.intercept, self.cov, self.noise = weights, intercept, cov, noise
        self.centre = np.zeros(len(weights)) if centre is None else centre

    def transform(self, df: DataFrame) -> DataFrame:
        x = vector_to_array("features")
        w = F.array(*[F.lit(float(v)) for v in self.weights])
        dot = F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        out = df.withColumn("prediction", dot + self.intercept)
        if self.cov is None:
            return out
        # One literal, which Catalyst folds: the rows of the covariance, one after the other.
        mean = F.array(*[F.lit(float(v)) for v in self.centre])
        x = F.zip_with(x, mean, lambda a, b: a - b)
        flat = F.split(F.lit(",".join(repr(float(v)) for v in np.ravel(self.cov))), ",").cast("array<double>")
        d = len(self.weights)

        def through(v, i):
            row = F.zip_with(F.slice(flat, i * d + 1, F.lit(d)), x, lambda a, b: a * b)
            return v * F.aggregate(row, F.lit(0.0), lambda s, p: s + p)

        spread = F.aggregate(F.transform(x, through), F.lit(float(self.noise)), lambda s, v: s + v)
        return out.withColumn("prediction_sd", F.sqrt(F.greatest(spread, F.lit(0.0))))


def fit_linear(df: DataFrame, scale, models: Mapping[str, tuple[str, Mapping]]) -> dict[str, Linear]:
    """Linear models on the ``features`` that ``scale`` makes of ``raw``, from one pass over the rows."""
    if not models:
        return {}
    m = linear.moments(df.withColumn("fold", F.lit(0)))[0]
    x = scale if isinstance(scale, linear.Scaler) else m.scaler()
    return {name: Linear(*linear.solved(m, x, *spec)) for name, spec in models.items()}


def fit_model(df: DataFrame, kind: str, settings: Mapping):
    """Fit one model on rows with ``raw``, ``features`` (scaled or not) and ``y``; trees also need
    ``series_id`` and ``ds``."""
    if kind in TREES:
        return trees.fit(df, {kind: tree_spec(kind, settings)})[kind]
    if kind in linear.KINDS:
        plain = df.drop("raw").withColumnRenamed("features", "raw")
        m = linear.moments(plain.withColumn("fold", F.lit(0)))[0]
        none = linear.Scaler(np.zeros(len(m.around) - 1), np.ones(len(m.around) - 1))
        return Linear(*linear.solved(m, none, kind, settings))
    return huber(**settings).fit(df)


def neighbours(train: DataFrame, wanted: DataFrame, settings: Mapping) -> DataFrame:
    """Nearest neighbours on the scaled ``features`` vector."""
    arrays = [d.withColumn("_x", vector_to_array("features")) for d in (train, wanted)]
    return nearest_neighbours(*arrays, "_x", **settings)


def fold_ids(df: DataFrame, k: int, day: str = "ds") -> DataFrame:
    """Expanding-window folds over the days of the panel: the last ``k`` blocks of
    ``days // (k + 1)`` days are test folds 1..k, everything earlier is fold 0; with no
    more than ``k`` days there is only fold 0.

    Cutting by day keeps all series on the same side of a cut.  The day table has one
    row per calendar day, so numbering it in one place is bounded.
    """
    days = df.select(day).distinct()
    order, whole = Window.partitionBy(F.lit(1)).orderBy(day), Window.partitionBy(F.lit(1))
    n = F.count(F.lit(1)).over(whole)
    size = F.floor(n / (k + 1))
    into = F.row_number().over(order) - 1 - (n - k * size)
    fold = F.when(into < 0, 0).otherwise(F.floor(into / size) + 1).cast("int")
    return df.join(days.select(day, fold.alias("fold")), day)


def split_kinds(models: Mapping[str, tuple[str, Mapping]]) -> tuple[dict, dict, dict]:
    """Tree models (as specs), linear ones, and all others."""
    grown = {m: tree_spec(*spec) for m, spec in models.items() if spec[0] in TREES}
    solved = {m: spec for m, spec in models.items() if spec[0] in linear.KINDS}
    return grown, solved, {m: spec for m, spec in models.items() if m not in grown and m not in solved}


def ts_cv(
    df: DataFrame, models: Mapping[str, tuple[str, Mapping]], k: int, scale: str = "robust", parallelism: int = 8
) -> DataFrame:
    """Scores ``(model, fold, mae)`` of expanding-window validation on rows with ``raw``,
    ``y`` and ``ds``.  The scaler is fitted inside each fold.  All trees of all folds grow
    together, all linear models come from one pass; what is left runs side by side."""
    if df.isEmpty():
        raise ValueError("no rows to validate on")
    folds, kept = fold_ids(df, k).persist(), []
    grown, solved, others = split_kinds(models)
    try:
        if folds.where(F.col("fold") == k).isEmpty():
            raise ValueError(f"{k} folds need more than {k} days")

        def prepare(fold):
            train, test = folds.filter(F.col("fold") < fold), folds.filter(F.col("fold") == fold)
            prep = fit_scaler(train, scale)
            kept.append(prep.transform(train).persist())
            return kept[-1], prep.transform(test)

        def one(job):
            fold, name = job
            kind, settings = others[name]
            train, test = prepared[fold]
            if kind == "knn":
                asked = test.withColumnRenamed("ds", "target_ds")
                found = neighbours(train, asked, settings)
                scored = found.withColumnRenamed("yhat", "prediction").join(
                    asked.select("series_id", "target_ds", "y"), ["series_id", "target_ds"]
                )
            else:
                scored = fit_model(train, kind, settings).transform(test)
            err = scored.agg(F.avg(F.abs(F.col("prediction") - F.col("y"))).alias("mae"))
            return name, fold, err.first()["mae"]

        spark, every = df.sparkSession, range(1, k + 1)
        prepared = side_by_side(spark, {f: lambda f=f: prepare(f) for f in every} if others else {}, parallelism)
        work = {f"{m}-{f}": lambda job=(f, m): [one(job)] for f in every for m in others}
        if solved:
            work["linear"] = lambda: linear.validate(folds, solved, k, scale).collect()
        if grown:
            work["trees"] = lambda: trees.validate(folds, grown, k).collect()
        scores = [tuple(row) for rows in side_by_side(spark, work, parallelism).values() for row in rows]
    finally:
        for rows in (folds, *kept):
            rows.unpersist()
    return df.sparkSession.createDataFrame(scores, "model string, fold int, mae double")


def fit_all(df: DataFrame, models: Mapping[str, tuple[str, Mapping]], scale: str = "robust", parallelism: int = 8):
    """Fit the scaler and every model on rows with ``raw`` and ``y`` (nearest neighbours have
    nothing to fit).  Returns ``(scaler, {name: model})``."""
    prep = fit_scaler(df, scale)
    grown, solved, others = split_kinds(models)
    rows = prep.transform(df).persist()
    try:
        work = {m: lambda m=m, spec=spec: {m: fit_model(rows, *spec)} for m, spec in others.items() if spec[0] != "knn"}
        work |= {"linear": lambda: fit_linear(df, prep, solved), "trees": lambda: trees.fit(df, grown)}
        fitted = {m: model for got in side_by_side(df.sparkSession, work, parallelism).values() for m, model in got.items()}
    finally:
        rows.unpersist()
    return prep, {m: fitted[m] for m in models if m in fitted}


def score(prep, models: Mapping, rows: DataFrame, floor: str = "clamp") -> DataFrame:
    """Long predictions of every model for rows with ``raw``; below zero is raised to
    zero (``clamp``) or left out (``drop``).  Models that know their predictive deviation
    give a band of 1.96 of it."""
    out, none = prep.transform(rows), F.lit(None).cast("double")
    each = []
    for name, model in models.items():
        out = model.transform(out).withColumnRenamed("prediction", f"ML_{name}")
        half = none
        if "prediction_sd" in out.columns:
            out = out.withColumnRenamed("prediction_sd", f"ML_{name}_sd")
            half = 1.96 * F.col(f"ML_{name}_sd")
        y = F.col(f"ML_{name}")
        each.append(F.struct(F.lit(f"ML_{name}").alias("model"), y.alias("yhat"), (y - half).alias("lo"), (y + half).alias("hi")))
    long = out.select("series_id", "target_ds", F.explode(F.array(*each)).alias("p")).select("series_id", "target_ds", "p.*")
    if floor == "clamp":
        long = long.withColumn("yhat", F.greatest(F.lit(0.0), F.col("yhat")))
    else:
        long = long.filter((F.col("yhat") > 0) & ~F.isnan("yhat"))
    return long.withColumn("family", F.lit("ml"))


def summarise(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model").agg(F.avg("mae").alias("mae"), F.stddev_pop("mae").alias("std"))


def mae_weights(summary: DataFrame) -> DataFrame:
    """Weight ``1 / (mae + 1)``, adding up to one over the models."""
    inverse = 1 / (F.col("mae") + 1)
    return summary.withColumn("weight", inverse / F.sum(inverse).over(Window.partitionBy(F.lit(1))))


def top_models(summary: DataFrame, n: int = 5) -> DataFrame:
    return summary.orderBy("mae", "model").limit(n)


def leaderboard(summary: DataFrame) -> DataFrame:
    """Models from best to worst with their weight in percent."""
    out = mae_weights(summary).withColumn("weight", F.col("weight") * 100)
    return out.select("model", "mae", "std", "weight").orderBy("mae", "model")


def weighted_ensemble(p: DataFrame, weights: DataFrame, renormalise: bool = True) -> DataFrame:
    """Weighted mean and spread over the models of each target.  Weights are taken
    relative to the models present unless ``renormalise`` is off."""
    x = p.join(weights.select("model", "weight"), "model")
    total: Column = F.sum(F.col("yhat") * F.col("weight"))
    value = F.try_divide(total, F.sum("weight")) if renormalise else total
    return x.groupBy("series_id", "target_ds").agg(
        value.alias("yhat"), F.stddev_pop("yhat").alias("std"), F.count("yhat").alias("model_count")
    )


def with_ensemble(p: DataFrame, weights: DataFrame, name: str) -> DataFrame:
    """The predictions plus one row per target with their weighted mean, in one pass."""
    ids = ["series_id", "target_ds"]
    x = p.join(weights.select("model", "weight"), "model", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    g = x.groupBy(*ids).agg(
        F.collect_list(F.struct("model", "yhat")).alias("all"),
        F.try_divide(F.sum(F.col("yhat") * F.col("weight")), F.sum("weight")).alias("mean"),
    )
    rows = F.concat("all", F.array(F.struct(F.lit(name).alias("model"), F.col("mean").alias("yhat"))))
    none = F.lit(None).cast("double")
    return g.select(*ids, F.explode(rows).alias("r")).select(
        *ids, "r.*", none.alias("lo"), none.alias("hi"), F.lit("ml").alias("family")
    ).filter(F.col("yhat").isNotNull())


def union_all(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
