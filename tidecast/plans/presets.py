"""The feature sets and model settings of each forecast version."""

from __future__ import annotations

# row lags, rolling windows and statistics (None = full windows), EMA spans and kind,
# differences, group statistics, cyclic parts, month edges, extra calendar flags
FEATURES = {
    "enhanced": dict(
        lags=(1, 2, 3, 4, 5, 6, 7, 14, 21, 28, 30, 56, 60, 84, 90, 364, 365),
        rolling=(3, 5, 7, 14, 21, 30, 60), stats=("mean", "std", "min", "max", "median"), min_periods=1,
        ema=(3, 7, 14, 21, 30), adjust=False, diffs=(1, 7), pct=(1, 7),
        groups=(("weekday", ("mean", "std")), ("month", ("mean", "std")), ("week_of_month", ("mean",)),
                ("weekday month", ("mean",))),
        cyclic={"month": 12, "weekday": 7, "day": 31, "quarter": 4}, edges=(3, 28),
        calendar=("year", "month", "day", "weekday", "week_of_year", "week_of_month", "quarter", "day_of_year"),
        flags=("day", "quarter", "special"), trend=False, same_weekday=False, nulls="zero",
    ),
    "hybrid": dict(
        lags=(1, 2, 3, 5, 7, 14, 21, 28, 30, 56, 60, 84, 90, 364, 365),
        rolling=(3, 5, 7, 14, 21, 30, 60), stats=("mean", "std", "min", "max"), min_periods=1,
        ema=(3, 7, 14, 21, 30), adjust=False, diffs=(1, 7), pct=(1, 7),
        groups=(("weekday", ("mean", "std")), ("month", ("mean",))),
        cyclic={"month": 12, "weekday": 7, "day": 31}, edges=(3, 28),
        calendar=("year", "month", "day", "weekday", "week_of_year", "week_of_month", "quarter", "day_of_year"),
        flags=("day", "special"), trend=False, same_weekday=False, nulls="zero",
    ),
    "optimized": dict(
        lags=(1, 7, 14, 28, 365), rolling=(7, 14, 30), stats=("mean", "std"), min_periods=1,
        ema=(7, 14), adjust=False, diffs=(), pct=(),
        groups=(("weekday", ("mean",)), ("month", ("mean",))),
        cyclic={"month": 12, "weekday": 7}, edges=(3, 28),
        calendar=("year", "month", "day", "weekday", "week_of_year", "week_of_month", "quarter", "day_of_year"),
        flags=("day",), trend=False, same_weekday=False, nulls="zero",
    ),
    "complete": dict(
        lags=(1, 2, 3, 7, 14, 21, 28), rolling=(7, 14, 21, 30), stats=("mean", "std", "min", "max"), min_periods=None,
        ema=(7, 14, 21), adjust=True, diffs=(1, 7), pct=(), groups=(), cyclic={}, edges=(5, 25),
        calendar=("weekday", "month", "day", "week_of_month", "day_of_year", "quarter"),
        flags=("day",), trend=True, same_weekday=True, nulls="drop",
    ),
}

# model: (kind, settings).  Native boosting libraries and histogram boosting are all
# presets of Spark's own histogram-binned gradient boosting; a share of columns is drawn
# anew at every node there, not once per tree.
MODELS = {
    "enhanced": {
        "LightGBM": ("gbt", dict(maxIter=500, stepSize=0.05, maxDepth=8, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=20)),
        "XGBoost": ("gbt", dict(maxIter=500, stepSize=0.05, maxDepth=6, subsamplingRate=0.8, featureSubsetStrategy="0.8")),
        "CatBoost": ("gbt", dict(maxIter=500, stepSize=0.05, maxDepth=6)),
        "RandomForest": ("forest", dict(numTrees=300, maxDepth=15, featureSubsetStrategy="all", minInstancesPerNode=2)),
        "Ridge": ("ridge", dict(alpha=1.0)),
        "GradientBoosting": ("gbt", dict(maxIter=300, stepSize=0.05, maxDepth=5, subsamplingRate=0.8, minInstancesPerNode=2)),
        "ExtraTrees": ("extra_trees", dict(numTrees=300, maxDepth=15, minInstancesPerNode=2)),
        "HistGradientBoosting": ("gbt", dict(maxIter=300, stepSize=0.05, maxDepth=10, minInstancesPerNode=20)),
        "Lasso": ("lasso", dict(alpha=0.1)),
        "ElasticNet": ("elastic_net", dict(alpha=0.1, l1_ratio=0.5)),
        "BayesianRidge": ("bayesian_ridge", {}),
        "KNN": ("knn", dict(k=10, weights="distance")),
        "AdaBoost": ("adaboost", dict(rounds=100, rate=0.1)),
    },
    "optimized": {
        "LightGBM": ("gbt", dict(maxIter=300, stepSize=0.08, maxDepth=6, subsamplingRate=0.8, featureSubsetStrategy="0.8", minInstancesPerNode=20)),
        "XGBoost": ("gbt", dict(maxIter=300, stepSize=0.08, maxDepth=5, subsamplingRate=0.8, featureSubsetStrategy="0.8")),
        "CatBoost": ("gbt", dict(maxIter=300, stepSize=0.08, maxDepth=5)),
        "HistGB": ("gbt", dict(maxIter=200, stepSize=0.08, maxDepth=8, minInstancesPerNode=20)),
        "RandomForest": ("forest", dict(numTrees=200, maxDepth=12, featureSubsetStrategy="all", minInstancesPerNode=3)),
        "ExtraTrees": ("extra_trees", dict(numTrees=200, maxDepth=12, minInstancesPerNode=3)),
        "Ridge": ("ridge", dict(alpha=1.0)),
        "BayesianRidge": ("bayesian_ridge", {}),
        "ElasticNet": ("elastic_net", dict(alpha=0.1, l1_ratio=0.5)),
    },
    "complete": {
        "Ridge": ("ridge", dict(alpha=1.0)),
        "Lasso": ("lasso", dict(alpha=0.1)),
        "ElasticNet": ("elastic_net", dict(alpha=0.1, l1_ratio=0.5)),
        "BayesianRidge": ("bayesian_ridge", {}),
        "HuberRegressor": ("huber", {}),
        "RandomForest": ("forest", dict(numTrees=100, maxDepth=10, featureSubsetStrategy="all")),
        "GradientBoosting": ("gbt", dict(maxIter=100, stepSize=0.1, maxDepth=5)),
        "ExtraTrees": ("extra_trees", dict(numTrees=100, maxDepth=10)),
        "AdaBoost": ("adaboost", dict(rounds=50, rate=1.0)),
        "KNN": ("knn", dict(k=5, weights="uniform")),
        "HistGradientBoosting": ("gbt", dict(maxIter=100, stepSize=0.1, maxDepth=6, minInstancesPerNode=20)),
        "LightGBM": ("gbt", dict(maxIter=100, stepSize=0.1, maxDepth=5, minInstancesPerNode=20)),
        "XGBoost": ("gbt", dict(maxIter=100, stepSize=0.3, maxDepth=5)),
        "CatBoost": ("gbt", dict(maxIter=100, stepSize=0.03, maxDepth=5)),
    },
}
# Autoregressive orders (p, d, q), and with seasonal (P, D, Q, period).
ORDERS = ((1, 0, 0), (1, 1, 0), (1, 1, 1), (2, 1, 1), (2, 1, 2), (0, 1, 1))
SEASONAL = (((1, 1, 1), (1, 1, 1, 7)), ((1, 1, 1), (0, 1, 1, 7)), ((2, 1, 1), (1, 1, 0, 7)))

MODELS["hybrid"] = MODELS["enhanced"]

SPLITS = {"enhanced": 5, "hybrid": 5, "optimized": 3, "complete": 3}
SCALER = {"enhanced": "robust", "hybrid": "robust", "optimized": "robust", "complete": "standard"}
