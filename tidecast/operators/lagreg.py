"""Regressions on a series' own past: autoregressions, Fourier trends, lag features."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.calendar import CALENDAR
from ..functions.columns import by_day
from ..plans.presets import ORDERS, SEASONAL
from .asof import Recipe, asof_attach, forecast_asof
from .features import lags
from .packed import FORECAST, as_predictions, deal, fit_each, spread

IDS = ["series_id", "target_ds"]

# The orders that are running least squares, and their names.
DIRECT = {(1, 0, 0): "ARIMA_100", (1, 1, 0): "ARIMA_110"}


def first_order_recipe(min_obs: int = 30) -> Recipe:
    """ARIMA_100 and ARIMA_110 as running least squares, without leaving Spark: the
    slope of each value on the one before, and of each change on the one before.
    Reads the columns ``_x, _d, _dx`` of ``with_changes``."""
    w = by_day()
    seen = w.rowsBetween(Window.unboundedPreceding, 0)
    state = {
        "_y": F.col("y"), "_d": F.col("_d"), "_n": F.row_number().over(w),
        "_b": F.regr_slope("y", "_x").over(seen), "_a": F.regr_intercept("y", "_x").over(seen),
        "_num": F.sum(F.col("_d") * F.col("_dx")).over(seen),
        "_den": F.sum(F.when(F.col("_d").isNotNull(), F.col("_dx") * F.col("_dx"))).over(seen),
    }
    enough = F.col("_n") >= min_obs
    return Recipe("arima", state, {
        "ARIMA_100": F.when(enough, F.col("_a") + F.col("_b") * F.col("_y")),
        "ARIMA_110": F.when(enough, F.col("_y") + F.try_divide("_num", "_den") * F.col("_d")),
    })


def with_changes(h: DataFrame) -> DataFrame:
    w = by_day()
    x = h.withColumn("_x", F.lag("y").over(w)).withColumn("_d", F.col("y") - F.col("_x"))
    return x.withColumn("_dx", F.lag("_d").over(w))


def first_order(h: DataFrame, targets: DataFrame, min_obs: int = 30) -> DataFrame:
    return forecast_asof(with_changes(h), targets, [first_order_recipe(min_obs)])


def ar_kernel(orders=ORDERS, min_obs: int = 30) -> tuple[Callable, str]:
    specs = [
        (f"ARIMA_{p}{d}{q}", d, 0, list(range(1, p + 1)), list(range(1, q + 1)))
        for p, d, q in orders if (p, d, q) not in DIRECT
    ]
    return kernels.arma(specs, min_obs), "arima"


def ar_forecast(h: DataFrame, targets: DataFrame, orders=ORDERS, min_obs: int = 30) -> DataFrame:
    """One-step forecasts of ARIMA type; first-order models stay in Spark, the others
    take two least-squares stages per series and target."""
    names = [DIRECT[o] for o in orders if o in DIRECT]
    direct = first_order(h, targets, min_obs).filter(F.col("model").isin(names))
    if len(names) == len(orders):
        return direct
    fitted = fit_each(h, targets, [ar_kernel(orders, min_obs)])
    return direct.unionByName(fitted) if names else fitted


def seasonal_ar_kernel(configs=SEASONAL, min_obs: int = 60) -> tuple[Callable, str]:
    def spread(short: int, long: int, s: int) -> list[int]:
        near = list(range(1, short + 1))
        far = [s * j for j in range(1, long + 1)]
        return sorted(near + far + [a + b for a in near for b in far])

    specs = [
        (f"SARIMA_{p}{d}{q}_{sp}{sd}{sq}", d, s * sd, spread(p, sp, s), spread(q, sq, s))
        for (p, d, q), (sp, sd, sq, s) in configs
    ]
    return kernels.arma(specs, min_obs), "arima"


def seasonal_ar_forecast(h: DataFrame, targets: DataFrame, configs=SEASONAL, min_obs: int = 60) -> DataFrame:
    """Seasonal ARIMA type on the series differenced once and over a week.  A factor at
    lag 1 and one at lag 7 multiply, which brings in lag 8."""
    return fit_each(h, targets, [seasonal_ar_kernel(configs, min_obs)])


def fourier_kernel(yearly_k: int = 10, weekly_k: int = 3, min_obs: int = 30) -> tuple[Callable, str]:
    return kernels.fourier(yearly_k, weekly_k, "Prophet", min_obs), "fourier"


def fourier_forecast(h: DataFrame, targets: DataFrame, yearly_k: int = 10, weekly_k: int = 3) -> DataFrame:
    """Linear trend, yearly and weekly Fourier terms by least squares, with a band."""
    return fit_each(h, targets, [fourier_kernel(yearly_k, weekly_k)])


def lag_regression(
    h: DataFrame, targets: DataFrame, kinds: Sequence[str] = ("ridge", "bayes", "huber"),
    min_obs: int = 30, min_rows: int = 20,
) -> DataFrame:
    """Ridge, Bayesian ridge (with band) and Huber regression on calendar parts, the
    position in the series and the values 1, 7 and 14 days back."""
    w = by_day()
    parts, back = ("weekday", "month", "week_of_month", "day_of_year"), (1, 7, 14)

    def vector(day, position, values):
        return F.array(*[c.cast("double") for c in (*[CALENDAR[p](day) for p in parts], position, *values)])

    rows = lags(h, back).withColumn("_i", F.row_number().over(w) - 1)
    train = rows.filter(F.col(f"lag_{max(back)}").isNotNull()).select(
        "series_id", F.unix_date("ds").alias("days"), "y",
        vector(F.col("ds"), F.col("_i"), [F.col(f"lag_{b}") for b in back]).alias("x"),
    )
    state = h.select(
        "series_id", "ds", F.row_number().over(w).alias("_n"),
        *[F.lag("y", b - 1).over(w).alias(f"_lag{b}") for b in back],
    )
    at = asof_attach(state, targets.select(*IDS)).filter(F.col("_n") >= min_obs)
    wanted = at.select(
        "series_id",
        F.struct(
            F.unix_date("target_ds").alias("day"),
            vector(F.col("target_ds"), F.col("_n"), [F.col(f"_lag{b}") for b in back]).alias("x"),
        ).alias("t"),
    )
    packed = spread(train, "series_id").groupBy("series_id").agg(
        F.sort_array(F.collect_list(F.struct("days", "y", "x"))).alias("r")
    ).join(wanted.groupBy("series_id").agg(F.collect_list("t").alias("targets")), "series_id")
    packed = packed.select("series_id", "r.days", "r.y", F.flatten("r.x").alias("x"), "targets")
    fn = kernels.chained([(kernels.lag_regression(list(kinds), min_rows), "regression")])
    return as_predictions(deal(packed).mapInPandas(fn, FORECAST))
