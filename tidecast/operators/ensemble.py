"""Blending of long predictions ``(series_id, target_ds, model, family, yhat)`` and the
intervals, scores and noon adjustment that follow.

A target has as many rows as there are models, so each grouping here is small; the
machine-learning side carries the family ``ml``.  ``combine``, what is made of it and
``category_summary`` also take one row per target with the list of its ``models``
(``asof.forecast_dates``), and then group nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import array_mean, array_sum, careful_sum, trimmed_mean

IDS = ["series_id", "target_ds"]

# A category holds the models whose name contains one of these texts.
CATEGORIES = {
    "moving_average": ("MA_", "EMA_", "WMA", "TMA"),
    "seasonal": ("Weekday", "Month", "WeekOf"),
    "previous_year": ("PrevYear",),
    "smoothing": ("ExpSmooth", "Holt"),
    "arima": ("ARIMA", "SARIMA"),
    "fourier": ("Prophet",),
    "decomposition": ("STL",),
    "regression": ("Regression", "Ridge", "Bayes", "Huber"),
    "estimate": ("Bayes_Posterior", "Bootstrap"),
    "robust": ("Median", "Trim", "KDE"),
}

# Weights of the four analog forecasts, and of both sides of each blend.
ANALOG_WEIGHTS = {"similar": 0.35, "pattern": 0.20, "prev_year": 0.25, "trend": 0.20}
BLENDS = {
    "hybrid": ("median", 0.60, "median", 0.40),
    "optimized": ("mean", 0.65, "median", 0.35),
    "complete": ("median", 0.40, "median", 0.60),
}
NOON_SHARE = {"enhanced": 0.35, "hybrid": 0.35, "optimized": 0.30, "statistical": 0.30, "complete": 0.25}
DEFAULT_NOON_RATIO = 0.45


def valid(p: DataFrame) -> DataFrame:
    y = F.col("yhat")
    return p.filter(y.isNotNull() & (y > 0) & ~F.isnan(y) & (F.abs(y) != float("inf")))


STATS = ["model_count", "mean", "median", "std", "trimmed", "iqr_mean", "p_low", "p_high"]


def values_of(take) -> Column:
    """The forecasts of the ``models`` that are taken, in ascending order."""
    return F.sort_array(F.transform(F.filter("models", take), lambda m: m["yhat"]))


def quantile_of(ordered: Column, q: float) -> Column:
    """``percentile`` of a list in ascending order; null if it is empty."""
    place = (F.size(ordered) - 1) * F.lit(float(q))
    low, high = F.floor(place).cast("int"), F.ceil(place).cast("int")
    a, b = F.get(ordered, low), F.get(ordered, high)
    return F.when(a == b, a).otherwise((high - place) * a + (place - low) * b)


def combine(p: DataFrame, rule: str = "statistical") -> DataFrame:
    """Everything a forecast takes from its models, in one aggregation: mean, median,
    trimmed mean, mean inside the quartiles, spread and outer percentiles, and the blend
    ``yhat`` of the machine-learning and statistical centres (the one side that exists
    if the other is missing; ``statistical`` is the plain median)."""
    # Sums go over sorted values and lose nothing, so they do not depend on the order in which the rows came.
    def careful_mean(a: Column) -> Column:
        return F.try_divide(careful_sum(a), F.size(a))

    outer = (0.025, 0.25, 0.75, 0.975)
    ml_stat, ml_weight, stat_stat, stat_weight = BLENDS.get(rule, ("median", 0.0, "median", 1.0))
    if "models" in p.columns:
        centre = {"mean": careful_mean, "median": lambda a: quantile_of(a, 0.5)}
        g = p.select(
            *IDS, values_of(lambda m: F.lit(True)).alias("v"), values_of(lambda m: m["family"] == "ml").alias("_ml"),
            values_of(lambda m: m["family"] != "ml").alias("_stat"),
        ).select(
            *IDS, F.size("v").cast("bigint").alias("model_count"), quantile_of(F.col("v"), 0.5).alias("median"),
            F.array(*[quantile_of(F.col("v"), x) for x in outer]).alias("q"), "v",
            centre[ml_stat](F.col("_ml")).alias("ml"), centre[stat_stat](F.col("_stat")).alias("stat"),
        )
    else:
        centre = {
            "mean": lambda c: careful_mean(F.sort_array(F.collect_list(c))), "median": lambda c: F.percentile(c, F.lit(0.5))
        }
        is_ml, y = F.col("family") == "ml", F.col("yhat")
        g = p.groupBy(*IDS).agg(
            F.count(y).alias("model_count"), centre["median"](y).alias("median"),
            F.percentile(y, F.array(*[F.lit(x) for x in outer])).alias("q"),
            F.sort_array(F.collect_list(y)).alias("v"),
            centre[ml_stat](F.when(is_ml, y)).alias("ml"),
            centre[stat_stat](F.when(~is_ml, y)).alias("stat"),
        )
    # Around the least value, so that equal values have no spread.
    g = g.withColumn("_off", F.transform("v", lambda x: x - F.get("v", F.lit(0)))).withColumn("_m", array_mean(F.col("_off")))
    spread = F.sqrt(array_mean(F.transform("_off", lambda x: (x - F.col("_m")) * (x - F.col("_m")))))
    inner = F.filter("v", lambda x: (x >= F.get("q", F.lit(1))) & (x <= F.get("q", F.lit(2))))
    both = F.col("ml") * ml_weight + F.col("stat") * stat_weight
    return g.select(
        *IDS, "model_count", careful_mean(F.col("v")).alias("mean"), "median", spread.alias("std"),
        trimmed_mean(F.col("v"), 0.1, ordered=True).alias("trimmed"),
        F.coalesce(F.try_divide(array_sum(inner), F.size(inner)), "median").alias("iqr_mean"),
        F.get("q", F.lit(0)).alias("p_low"), F.get("q", F.lit(3)).alias("p_high"), "ml", "stat",
        (F.col("median") if rule == "statistical" else F.coalesce(both, "ml", "stat")).alias("yhat"),
    )


def ensemble_stats(p: DataFrame) -> DataFrame:
    return combine(p).select(*IDS, *STATS)


def category_summary(
    p: DataFrame, rules: Mapping[str, Sequence[str]] = CATEGORIES, exclusive: bool = False
) -> DataFrame:
    """Median and number of models per category.  By name a model may be in several;
    ``exclusive`` uses its family instead."""
    def hit(model, texts):
        found = F.lit(False)
        for t in texts:
            found = found | model.contains(t)
        return found

    def named(texts):
        return lambda m: hit(m["model"], texts)

    if "models" in p.columns:
        if exclusive:
            lists = F.transform(F.array_distinct("models.family"), lambda f: F.struct(
                f.alias("category"), values_of(lambda m: m["family"] == f).alias("v")))
        else:
            lists = F.array(*[
                F.struct(F.lit(c).alias("category"), values_of(named(texts)).alias("v"))
                for c, texts in rules.items()
            ])
        parts = p.select(*IDS, F.explode(F.array(lists)).alias("_c")).select(*IDS, F.explode("_c").alias("_c"))
        return parts.filter(F.size("_c.v") > 0).select(
            *IDS, "_c.category", quantile_of(F.col("_c.v"), 0.5).alias("median"), F.size("_c.v").cast("bigint").alias("n_models"))
    if exclusive:
        tagged = p.withColumn("category", F.col("family"))
    else:
        tags = F.array_compact(F.array(*[F.when(hit(F.col("model"), texts), c) for c, texts in rules.items()]))
        tagged = p.withColumn("category", F.explode(tags))
    return tagged.groupBy(*IDS, "category").agg(
        F.percentile("yhat", F.lit(0.5)).alias("median"), F.count("yhat").alias("n_models")
    )


def blend(p: DataFrame, rule: str) -> DataFrame:
    """``yhat`` per target by one of ``BLENDS``, with both sides."""
    return combine(p, rule).select(*IDS, "ml", "stat", "yhat")


def blend_fixed(analogs: DataFrame, ml: DataFrame | None = None) -> DataFrame:
    """Fixed weights over the four analog forecasts, then 65/35 with the ML ensemble
    ``(.., yhat, std)`` where there is one; ``uncertainty`` is the spread over the mean
    of all values, ``std`` the spread of the ML models."""
    one = {name: F.max(F.when(F.col("model") == name, F.col("yhat"))).alias(f"_{name}") for name in ANALOG_WEIGHTS}
    g = analogs.groupBy(*IDS).agg(*one.values(), F.sort_array(F.collect_list("yhat")).alias("v"))
    # Added up in one order, however the rows came: four equal whole numbers then have that very mean.
    parts = [F.coalesce(F.col(f"_{name}") * w, F.lit(0.0)) for name, w in ANALOG_WEIGHTS.items()]
    g = g.select(*IDS, reduce(lambda a, b: a + b, parts).alias("stat"), "v")
    if ml is None:
        none = F.lit(None).cast("double")
        g = g.withColumns({"ml": none, "std": none})
    else:
        g = g.join(ml.select(*IDS, F.col("yhat").alias("ml"), "std"), IDS, "left")
    values = F.when(F.col("ml").isNull(), F.col("v")).otherwise(F.concat("v", F.array("ml")))
    g = g.withColumn("v", values).withColumn("_m", array_sum(F.col("v")) / F.size("v"))
    spread = F.sqrt(array_sum(F.transform("v", lambda x: (x - F.col("_m")) * (x - F.col("_m")))) / F.size("v"))
    return g.select(
        *IDS, "ml", "stat", "std",
        F.coalesce(F.col("ml") * 0.65 + F.col("stat") * 0.35, "stat").alias("yhat"),
        (spread / (F.col("_m") + 1e-8)).alias("uncertainty"),
    )


def noon_ratio(h: DataFrame, default: float = DEFAULT_NOON_RATIO) -> DataFrame:
    """Mean share of the day's total seen by noon, over days where both are positive."""
    if "partial_y" not in h.columns:
        return h.groupBy("series_id").agg(F.lit(default).alias("ratio"))
    ok = (F.col("partial_y") > 0) & (F.col("y") > 0)
    share = F.when(ok, F.try_divide("partial_y", "y"))
    return h.groupBy("series_id").agg(F.coalesce(F.avg(share), F.lit(default)).alias("ratio"))


def noon_adjust(forecast: DataFrame, actuals: DataFrame, ratios: DataFrame, keep: float) -> DataFrame:
    """Mix the forecast with the total implied by the count at noon
    ``(series_id, target_ds, noon)``; targets without a positive count are unchanged."""
    out = forecast.join(actuals.select(*IDS, "noon"), IDS, "left").join(ratios, "series_id", "left")
    ratio = F.coalesce("ratio", F.lit(DEFAULT_NOON_RATIO))
    implied = F.try_divide("noon", ratio)
    mixed = F.col("yhat") * keep + implied * (1 - keep)
    use = (F.col("noon") > 0) & (ratio > 0)
    return out.withColumn("yhat", F.when(use, mixed).otherwise(F.col("yhat"))).drop("noon", "ratio")


def interval(df: DataFrame, kind: str) -> DataFrame:
    """Add ``lo`` and ``hi`` around ``yhat``: ``percentile`` needs ``p_low, p_high``;
    ``sigma`` needs ``std``; ``relative`` takes 8 % and averages it with ``std`` if known."""
    y = F.col("yhat")
    if kind == "percentile":
        return df.withColumns({"lo": F.col("p_low"), "hi": F.col("p_high")})
    if kind == "sigma":
        half = 1.96 * F.col("std")
    else:
        own = y * 0.08
        has = F.col("std") > 1e-9
        half = 1.96 * F.when(has, (own + F.col("std")) / 2).otherwise(own)
    return df.withColumns({"lo": F.greatest(F.lit(0.0), y - half), "hi": y + half})


def _ladder(value: Column, steps: Sequence[tuple[float, int]], last: int) -> Column:
    out = F.lit(last)
    for bound, score in reversed(steps):
        out = F.when(value < bound, score).otherwise(out)
    return out


def confidence_cv(df: DataFrame, rule: str = "statistical") -> DataFrame:
    """Score from the coefficient of variation (in percent) of the models."""
    scores = (95, 85, 75, 65) if rule == "statistical" else (90, 80, 70, 60)
    cv = F.try_divide("std", "mean") * 100
    steps = list(zip((5.0, 10.0, 15.0), scores))
    return df.withColumns({"cv": cv, "confidence_score": _ladder(cv, steps, scores[3])})


def confidence_mape(accuracy: DataFrame) -> DataFrame:
    """Score from the mean absolute error in percent of past forecasts."""
    score = F.when(F.col("mae_pct").isNull(), 68).otherwise(
        _ladder(F.col("mae_pct"), [(5.0, 88), (10.0, 78)], 68)
    )
    return accuracy.withColumn("confidence_score", score)


def final_record(df: DataFrame, *extra: str) -> DataFrame:
    """The record handed out: whole numbers, cut towards zero."""
    return df.select(
        *IDS, F.col("yhat").cast("bigint").alias("final_prediction"),
        F.col("lo").cast("bigint").alias("pred_lower"), F.col("hi").cast("bigint").alias("pred_upper"),
        "confidence_score", *extra,
    )
