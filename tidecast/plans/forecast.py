"""Whole forecasts: history and targets in, one record per target out.

Five versions: ``statistical`` (no machine learning), ``complete``, ``hybrid``,
``optimized`` and ``enhanced`` (analogs plus machine learning, with a ledger).
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analogs, baselines, diagnostics, ensemble, estimates, feedback, lagreg, learners, smoothing
from ..operators.asof import Recipe, eligible_targets, forecast_asof, forecast_by_keys
from ..operators.features import exponential_mean
from ..operators.packed import fit_each
from ..session import ensure_checkpoint_dir
from .features import feature_frame, model_features, serving_rows
from .presets import FEATURES, MODELS, SCALER, SPLITS

IDS = ["series_id", "target_ds"]
MIN_OBS = {"statistical": 14, "complete": 14, "optimized": 14, "hybrid": 30}



def window_part(h: DataFrame, targets: DataFrame, version: str) -> DataFrame:
    """Every forecast that needs only the last known day: one pass, one as-of."""
    if version == "optimized":
        rows = exponential_mean(h, [7], True, "EMA_")
        recipes = [baselines.sma_recipe((7, 14), False), baselines.ema_recipe([7]), baselines.wma_recipe()]
    elif version == "hybrid":
        rows = exponential_mean(diagnostics.with_remainder(h), [7, 14], False, "EMA_")
        level = diagnostics.decompose_recipe()
        level = Recipe(level.family, level.state, {"STL_Level": level.models["STL_Level"]})
        recipes = [baselines.sma_recipe((7, 14, 30), False), baselines.ema_recipe((7, 14)), baselines.wma_recipe(), level]
    else:
        rows = lagreg.with_changes(exponential_mean(diagnostics.with_remainder(h), [7, 14, 21], True, "EMA_"))
        split = diagnostics.decompose_recipe()
        split = Recipe(split.family, split.state, {m: split.models[m] for m in ("STL_Trend", "STL_Combined")})
        recipes = [
            baselines.sma_recipe(require_full=version == "complete"), baselines.wma_recipe(),
            baselines.ema_recipe(), baselines.tma_recipe(), baselines.bayes_recipe(), baselines.median_recipe(),
            baselines.trim_recipe(), baselines.trend_change_recipe(), estimates.bootstrap_recipe(),
            lagreg.first_order_recipe(), split,
        ]
    return forecast_asof(rows, targets, recipes)


def seasonal_part(h: DataFrame, targets: DataFrame, version: str) -> list[DataFrame]:
    """Forecasts among days with the target's calendar keys."""
    recent = baselines.weekday_recent_recipe((4,) if version in ("hybrid", "optimized") else (4, 8))
    groups = [(["weekday"], [baselines.mean_so_far("Weekday_Mean", ["weekday"]), recent])]
    if version in ("statistical", "complete"):
        groups += [
            (keys, [baselines.mean_so_far(model, keys)])
            for model, keys in (
                ("Month_Mean", ["month"]), ("Weekday_Month_Mean", ["weekday", "month"]),
                ("WeekOfMonth_Mean", ["week_of_month"]),
            )
        ]
    keys = ["weekday"] if len(groups) == 1 else ["weekday", "month", "week_of_month"]
    known, wanted = (baselines.with_keys(x, keys, day) for x, day in ((h, "ds"), (targets.select(*IDS), "target_ds")))
    return [forecast_by_keys(known, wanted, groups)]


def previous_year_part(h: DataFrame, targets: DataFrame, version: str) -> list[DataFrame]:
    """Previous-year lookups from one join on the thirteen days around a year ago."""
    near = baselines.prev_year_days(h, targets, range(359, 372))
    values = {"PrevYear_SameDay": baselines.same_day_value()}
    if version != "optimized":
        values["PrevYear_SameWeekday"] = baselines.same_weekday_value(fallback=version == "hybrid")
    if version == "statistical":
        values["PrevYear_Nearby"] = baselines.nearby_value()
    if version in ("statistical", "complete"):
        near = near.join(baselines.year_to_date(h, targets), IDS)
        values["PrevYear_GrowthAdj"] = baselines.growth_value(baselines.same_day_value())
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), v.alias("yhat")) for m, v in values.items()]))
    long = near.select(*IDS, rows.alias("_p")).select(
        *IDS, "_p.*", F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"),
        F.lit("previous_year").alias("family"),
    ).filter(F.col("yhat").isNotNull())
    parts = [long]
    if version in ("statistical", "complete"):
        parts.append(baselines.prev_year_month_mean(h, targets))
    return parts


def fitted_part(h: DataFrame, targets: DataFrame, version: str) -> list[DataFrame]:
    """Models fitted per series: one packing, all kernels over it."""
    if version == "optimized":
        return [fit_each(h, targets, [], walks=[smoothing.smooth_kernel("holt")])]
    if version == "hybrid":
        walks = [smoothing.smooth_kernel(k) for k in ("ses", "holt", "hw_add")]
        kernels = [lagreg.ar_kernel(((1, 1, 1), (2, 1, 2))), lagreg.seasonal_ar_kernel(lagreg.SEASONAL[:1])]
        return [fit_each(h, targets, [*kernels, lagreg.fourier_kernel()], walks)]
    walks = [smoothing.smooth_kernel(k) for k in smoothing.KINDS]
    kernels = [lagreg.ar_kernel(), lagreg.seasonal_ar_kernel(), lagreg.fourier_kernel(), estimates.kde_kernel()]
    parts = [fit_each(h, targets, kernels, walks)]
    if version == "statistical":
        parts.append(lagreg.lag_regression(h, targets))
    return parts


def statistical_predictions(h: DataFrame, targets: DataFrame, version: str = "statistical") -> DataFrame:
    """All statistical models of a version in long form, for targets with enough history.

    Which targets have enough takes a pass over the history; its answer is written once
    and read by every part."""
    ensure_checkpoint_dir(h.sparkSession)
    t = eligible_targets(h, targets.select(*IDS).distinct(), MIN_OBS[version]).select(*IDS).checkpoint()
    return learners.union_all([
        window_part(h, t, version), *seasonal_part(h, t, version),
        *previous_year_part(h, t, version), *fitted_part(h, t, version),
    ])


@dataclass
class Trained:
    """Fitted models of a version with their validation scores (model, fold, mae) and
    summary (model, mae, std); ``rows`` are kept in the executors until ``release``."""

    version: str
    prep: object
    models: Mapping
    specs: Mapping
    scores: DataFrame | None
    summary: DataFrame | None
    rows: DataFrame

    def release(self) -> None:
        self.rows.unpersist()


# Fixed value: with fewer feature rows there is no machine learning.
LEAST_ROWS = 50


def train(
    h: DataFrame, version: str, models: Mapping | None = None, holidays: DataFrame | None = None,
    validate: bool = True, parallelism: int = 8,
) -> Trained | None:
    """Features, validation and fitting over the whole panel.  ``complete`` trains
    without validation; ``optimized`` keeps the five best models.  None with fewer than
    ``LEAST_ROWS`` feature rows, which ``forecast`` takes as no machine learning."""
    specs = dict(models or MODELS[version])
    frame = feature_frame(h, version, holidays)
    rows = learners.assemble(frame, model_features(version), FEATURES[version]["nulls"]).select(
        "series_id", "ds", "y", "raw"
    ).persist()
    if rows.count() < LEAST_ROWS:
        rows.unpersist()
        return None
    scores = summary = None
    if validate and version != "complete":
        scores = learners.ts_cv(rows, specs, SPLITS[version], SCALER[version], parallelism)
        summary = learners.summarise(scores)
        if version == "optimized":
            keep = [r["model"] for r in learners.top_models(summary).collect()]  # at most five names
            specs = {m: s for m, s in specs.items() if m in keep}
    prep, fitted = learners.fit_all(rows, specs, SCALER[version], parallelism)
    return Trained(version, prep, fitted, specs, scores, summary, rows)


def ml_predictions(
    trained: Trained, h: DataFrame, targets: DataFrame, mode: str = "asof", holidays: DataFrame | None = None
) -> DataFrame:
    version = trained.version
    rows = serving_rows(h, targets, version, mode, holidays)
    served = learners.assemble(rows, model_features(version), FEATURES[version]["nulls"])
    floor = "drop" if version == "complete" else "clamp"
    parts = [learners.score(trained.prep, trained.models, served, floor)] if trained.models else []
    for name, (kind, settings) in trained.specs.items():
        if kind == "knn":
            found = learners.neighbours(trained.prep.transform(trained.rows), trained.prep.transform(served), settings)
            parts.append(found.withColumn("model", F.lit(f"ML_{name}")))
    return learners.union_all(parts)


def ensemble_weights(trained: Trained) -> DataFrame:
    """Weights by validation error, equal where there was no validation."""
    if trained.summary is None:
        names = [(f"ML_{m}", 1.0) for m in trained.specs]
        return trained.rows.sparkSession.createDataFrame(names, "model string, weight double")
    return learners.mae_weights(trained.summary).withColumn("model", F.concat(F.lit("ML_"), "model"))


def ml_ensemble(trained: Trained, predictions: DataFrame) -> DataFrame:
    return learners.weighted_ensemble(predictions, ensemble_weights(trained))


def _as_model(df: DataFrame, name: str) -> DataFrame:
    none = F.lit(None).cast("double")
    return df.select(*IDS, F.lit(name).alias("model"), "yhat", none.alias("lo"), none.alias("hi"), F.lit("ml").alias("family"))


def _noon(df: DataFrame, h: DataFrame, actuals: DataFrame | None, version: str) -> DataFrame:
    if actuals is None:
        return df
    return ensemble.noon_adjust(df, actuals, ensemble.noon_ratio(h), ensemble.NOON_SHARE[version])


def forecast(
    h: DataFrame, targets: DataFrame, version: str = "statistical", trained: Trained | None = None,
    ledger: DataFrame | None = None, actuals: DataFrame | None = None, holidays: DataFrame | None = None,
) -> DataFrame:
    """One record per target: blend, corrections from the ledger, noon adjustment,
    interval and score, in the order of the version."""
    if version == "enhanced":
        return _enhanced(h, targets, trained, ledger, actuals, holidays)
    p = statistical_predictions(h, targets, version)
    if trained is not None and version != "statistical":
        ml = ml_predictions(trained, h, targets, holidays=holidays)
        if version == "optimized":
            ml = _as_model(ml_ensemble(trained, ml), "ML")
        elif version == "hybrid":
            # the weighted ensemble stands among the models it came from
            ml = learners.with_ensemble(ml, ensemble_weights(trained), "ML_Ensemble")
        p = p.unionByName(ml)
    out = ensemble.combine(ensemble.valid(p), version)
    if ledger is not None:
        if version == "hybrid":
            out = feedback.apply_correction(out, feedback.detect_bias(ledger, 30))
        elif version == "optimized":
            out = out.join(feedback.tuner_correction(ledger), "series_id", "left").withColumn(
                "yhat", F.col("yhat") + F.coalesce("correction", F.lit(0.0))
            )
    out = _noon(out, h, actuals, version)
    if ledger is not None and version == "complete":
        out = feedback.memory_correction(out, ledger)
    out = ensemble.interval(out, "sigma" if version in ("hybrid", "optimized") else "percentile")
    if version == "optimized":
        out = out.withColumn("confidence_score", F.lit(70.0))
        if ledger is not None:
            out = out.join(feedback.accuracy_score(ledger), "series_id", "left").withColumn(
                "confidence_score", F.coalesce("score", "confidence_score")
            )
        return ensemble.final_record(out, "model_count")
    out = ensemble.confidence_cv(out, "hybrid" if version == "hybrid" else "statistical")
    return ensemble.final_record(out, "cv", "model_count")


def analog_predictions(h: DataFrame, targets: DataFrame) -> DataFrame:
    """The four analog forecasts; a target without one gets the mean of its history."""
    p = learners.union_all([
        analogs.similar_days(h, targets), analogs.pattern_match(h, targets),
        analogs.prev_year_trend(h, targets), analogs.recent_trend(h, targets),
    ])
    return analogs.with_fallback(p, h, targets, list(ensemble.ANALOG_WEIGHTS))


def _enhanced(h, targets, trained, ledger, actuals, holidays) -> DataFrame:
    ml = ml_ensemble(trained, ml_predictions(trained, h, targets, holidays=holidays)) if trained else None
    out = ensemble.blend_fixed(analog_predictions(h, targets), ml)
    if ledger is None:
        out = out.withColumns({"correction": F.lit(0.0), "mae_pct": F.lit(None).cast("double")})
    else:
        out = feedback.apply_correction(out, feedback.detect_bias(ledger, 30))
        out = out.join(feedback.accuracy(ledger).select("series_id", "mae_pct"), "series_id", "left")
    out = ensemble.interval(_noon(out, h, actuals, "enhanced"), "relative")
    out = ensemble.confidence_mape(out)
    return ensemble.final_record(out, "uncertainty", "correction")


def backtest(h: DataFrame, years: int = 2) -> DataFrame:
    """Ledger rows of a corrected back-test over the last years."""
    return feedback.backtest_corrected(feedback.backtest_base(h, years))
