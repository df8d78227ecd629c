"""Descriptive statistics, tests and decomposition of each series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.calendar import calendar
from ..functions.columns import array_mean, array_sum, by_day
from ..functions.distributions import chi2_tail_even, t_quantile
from .asof import Recipe, forecast_asof
from .baselines import TAIL, last_values, recent_values
from .packed import pack, spread_sorts


def profile(h: DataFrame) -> DataFrame:
    """Moments per series, skewness and excess kurtosis with the small-sample correction."""
    m = h.groupBy("series_id").agg(
        F.count("y").alias("n"),
        F.avg("y").alias("mean"),
        F.percentile("y", F.lit(0.5)).alias("median"),
        F.stddev_samp("y").alias("std"),
        F.skewness("y").alias("g1"),
        F.kurtosis("y").alias("g2"),
    )
    n = F.col("n").cast("double")
    skew = F.when(n > 2, F.col("g1") * F.sqrt(n * (n - 1)) / (n - 2))
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.col("g2") + 6))
    return m.select(
        "series_id", "n", "mean", "median", "std",
        (F.try_divide("std", "mean") * 100).alias("cv_pct"),
        skew.alias("skew"), kurt.alias("kurtosis"),
    )


def adf(h: DataFrame) -> DataFrame:
    """Augmented Dickey-Fuller test with a constant, lag order by AIC; series with fewer
    than 20 days count as stationary."""
    schema = ("series_id string, adf_stat double, p_value double, lags int, "
              "critical_1pct double, critical_5pct double, stationary boolean")
    return pack(h, "y").mapInPandas(kernels.adf(), schema)


def _autocorrelations(h: DataFrame, nlags: int, least: int) -> DataFrame:
    """Per series: ``n`` and the array of lag-product sums over the sum of squares."""
    every = Window.partitionBy("series_id")
    x = h.select("series_id", "ds", (F.col("y") - F.avg("y").over(every)).alias("x"))
    x = x.withColumns({f"_l{k}": F.lag("x", k).over(by_day()) for k in range(1, nlags + 1)})
    sums = [F.sum(F.col("x") * F.col(f"_l{k}")) for k in range(1, nlags + 1)]
    total = F.sum(F.col("x") * F.col("x"))
    return (
        x.groupBy("series_id")
        .agg(F.count("x").alias("n"), F.array(*[F.try_divide(s, total) for s in sums]).alias("r"))
        .filter((F.col("n") >= least) & F.get("r", F.lit(0)).isNotNull())
    )


def acf(h: DataFrame, nlags: int = 20) -> DataFrame:
    """Autocorrelations at lags 0..nlags, series with at least ``nlags + 5`` days."""
    r = _autocorrelations(h, nlags, nlags + 5)
    full = F.concat(F.array(F.lit(1.0)), "r")
    return r.select("series_id", F.posexplode(full).alias("lag", "acf"))


def pacf(h: DataFrame, nlags: int = 20) -> DataFrame:
    """Partial autocorrelations from the bias-adjusted autocorrelations by the
    Durbin-Levinson recursion, folded over the lag array."""
    r = _autocorrelations(h, nlags, nlags + 5)
    adjusted = F.transform("r", lambda v, i: v * F.col("n") / (F.col("n") - i - 1))
    r = r.select("series_id", adjusted.alias("rho"))
    none = F.array().cast("array<double>")
    start = F.struct(none.alias("phi"), none.alias("out"))

    def dot(a: Column, b: Column) -> Column:
        return array_sum(F.zip_with(a, b, lambda x, y: x * y))

    def step(state: Column, k: Column) -> Column:
        phi, before = state["phi"], F.slice("rho", F.lit(1), k - 1)
        kk = F.try_divide(
            F.get("rho", k - 1) - dot(phi, F.reverse(before)), 1.0 - dot(phi, before)
        )
        inner = F.zip_with(phi, F.reverse(phi), lambda a, b: a - kk * b)
        return F.struct(
            F.concat(inner, F.array(kk)).alias("phi"), F.concat(state["out"], F.array(kk)).alias("out")
        )

    lags = F.sequence(F.lit(1), F.lit(nlags))
    full = F.concat(F.array(F.lit(1.0)), F.aggregate(lags, start, step)["out"])
    return r.select("series_id", F.posexplode(full).alias("lag", "pacf"))


def ljung_box(h: DataFrame, lags: int = 10) -> DataFrame:
    """Portmanteau test; with an even number of lags the tail is a finite sum."""
    r = _autocorrelations(h, lags, lags + 5)
    terms = F.transform("r", lambda v, i: v * v / (F.col("n") - i - 1))
    r = r.withColumn("lb_stat", F.col("n") * (F.col("n") + 2) * array_sum(terms))
    r = r.withColumn("p_value", chi2_tail_even(F.col("lb_stat"), lags))
    return r.select("series_id", "lb_stat", "p_value", (F.col("p_value") < 0.05).alias("autocorrelated"))


def iqr_bounds(h: DataFrame, k: float = 1.5) -> DataFrame:
    q = h.groupBy("series_id").agg(F.percentile("y", F.array(F.lit(0.25), F.lit(0.75))).alias("q"))
    q1, q3 = F.get("q", F.lit(0)), F.get("q", F.lit(1))
    return q.select("series_id", (q1 - k * (q3 - q1)).alias("lower"), (q3 + k * (q3 - q1)).alias("upper"))


def iqr_outliers(h: DataFrame, k: float = 1.5) -> DataFrame:
    """Each day with its bounds and whether it lies outside them."""
    outside = (F.col("y") < F.col("lower")) | (F.col("y") > F.col("upper"))
    return h.join(iqr_bounds(h, k), "series_id").withColumn("is_outlier", outside)


def iqr_outlier_summary(h: DataFrame, k: float = 1.5) -> DataFrame:
    found = iqr_outliers(h, k).groupBy("series_id", "lower", "upper")
    return found.agg(
        F.count_if("is_outlier").alias("n_outliers"),
        (F.count_if("is_outlier") / F.count("y") * 100).alias("pct_outliers"),
    )


def zscore_outliers(h: DataFrame, threshold: float = 3.0) -> DataFrame:
    every = Window.partitionBy("series_id")
    z = F.try_divide(F.col("y") - F.avg("y").over(every), F.stddev_pop("y").over(every))
    return h.withColumn("z", z).withColumn("is_outlier", F.coalesce(F.abs("z") > threshold, F.lit(False)))


def mean_ci(h: DataFrame, conf: float = 0.95) -> DataFrame:
    """t interval of the mean; a single value is its own interval."""
    m = h.groupBy("series_id").agg(
        F.count("y").alias("n"), F.avg("y").alias("mean"), F.stddev_samp("y").alias("sd")
    )
    half = F.coalesce(t_quantile(F.col("n") - 1, conf) * F.col("sd") / F.sqrt("n"), F.lit(0.0))
    return m.select("series_id", "mean", (F.col("mean") - half).alias("lo"), (F.col("mean") + half).alias("hi"))


def prediction_halfwidth(residuals: DataFrame, conf: float = 0.95) -> DataFrame:
    """Half-width of a prediction interval from ``(series_id, resid)``."""
    m = residuals.groupBy("series_id").agg(F.count("resid").alias("n"), F.stddev_pop("resid").alias("sd"))
    half = t_quantile(F.col("n") - 1, conf) * F.col("sd") * F.sqrt(1 + 1 / F.col("n"))
    return m.select("series_id", half.alias("halfwidth"))


def seasonal_profile(h: DataFrame) -> DataFrame:
    """Mean, deviation and count by weekday, month and week of month in one aggregation."""
    keys = ["weekday", "month", "week_of_month"]
    parts = calendar(h, parts=keys)
    name = F.concat(*[F.when(F.col(k).isNotNull(), k).otherwise("") for k in keys])
    sets = [[F.col("series_id"), F.col(k)] for k in keys]
    return (
        parts.groupingSets(sets, "series_id", *keys)
        .agg(F.avg("y").alias("mean"), F.stddev_samp("y").alias("std"), F.count("y").alias("n"))
        .select("series_id", name.alias("profile"), F.coalesce(*keys).alias("key"), "mean", "std", "n")
    )


def decompose(h: DataFrame, period: int = 7, robust: bool = False) -> DataFrame:
    """Centred moving mean, mean of what is left by phase (summing to zero), remainder.
    ``robust`` repeats it with bisquare weights from the first remainder."""
    w = by_day()
    half = period // 2
    near = w.rowsBetween(-half, period - 1 - half)
    every, phase = Window.partitionBy("series_id"), Window.partitionBy("series_id", "phase")

    def split(df: DataFrame, weight: Column) -> DataFrame:
        def wmean(c, over):
            return F.try_divide(F.sum(c * weight).over(over), F.sum(weight).over(over))

        df = df.withColumn("trend", F.coalesce(wmean(F.col("y"), near), F.avg("y").over(near)))
        df = df.withColumn("_left", F.col("y") - F.col("trend"))
        df = df.withColumn("_s", F.coalesce(wmean(F.col("_left"), phase), F.lit(0.0)))
        df = df.withColumn("seasonal", F.col("_s") - F.avg("_s").over(every))
        return df.withColumn("resid", F.col("y") - F.col("trend") - F.col("seasonal")).drop("_left", "_s")

    out = spread_sorts(h).withColumn("phase", ((F.row_number().over(w) - 1) % period).cast("int"))
    out = split(out, F.lit(1.0))
    if robust:
        scale = 6 * F.percentile(F.abs("resid"), F.lit(0.5)).over(every)
        u = F.coalesce(F.try_divide(F.abs("resid"), scale), F.lit(0.0))
        weight = F.when(u < 1, (1 - u * u) * (1 - u * u)).otherwise(0.0)
        out = split(out.withColumn("_w", weight), F.col("_w")).drop("_w")
    return out


def strength(decomposed: DataFrame) -> DataFrame:
    """Strength of trend and of season: the share of variance the remainder leaves."""
    def share(part):
        return F.greatest(
            F.lit(0.0), 1 - F.try_divide(F.var_pop("resid"), F.var_pop(F.col(part) + F.col("resid")))
        )

    return decomposed.groupBy("series_id").agg(
        share("trend").alias("trend_strength"), share("seasonal").alias("seasonal_strength")
    )


def with_remainder(h: DataFrame, period: int = 7) -> DataFrame:
    """History with its phase, the remainder from full centred frames and the mean
    remainder of its phase so far."""
    w, half = by_day(), period // 2
    rows = spread_sorts(h).withColumn("_phase", (F.row_number().over(w) - 1) % period)
    rows = rows.withColumn("_left", F.col("y") - F.avg("y").over(w.rowsBetween(-half, half)))
    same = by_day("_phase").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("_season", F.avg("_left").over(same))


def decompose_recipe(period: int = 7) -> Recipe:
    """Last trend plus its mean step over a period (``STL_Trend``), the same with the
    season of the coming day (``STL_Combined``) and the last trend with the season but
    without the step (``STL_Level``); on the columns of ``with_remainder``.

    The values equal a decomposition of only the days up to the last one: the trend of
    the last rows is re-taken over the rows that exist, the season of a phase is known
    from full frames only, and the centring sums the full part and those rows.
    """
    w, half = by_day(), period // 2
    tail = max(TAIL, 2 * period)

    def mean_back(first: int, last: int) -> Column:
        """Mean of the values ``first`` to ``last`` rows before the last one."""
        values = last_values(first + 1, tail)
        return array_mean(F.slice(values, 1, first - last + 1))

    # remainders of the last rows, whose frames end at the last known day
    edge = sum(mean_back(k, k) - mean_back(half + k, 0) for k in range(half))
    last, before = mean_back(half, 0), mean_back(half + period, period - half)
    count = F.row_number().over(w)
    settled = F.sum("_left").over(w.rowsBetween(Window.unboundedPreceding, -half))
    state = {
        "_tn": count, "_settled": F.coalesce(settled, F.lit(0.0)),
        "_phase_mean": F.lag("_season", period - 1).over(w), **recent_values(tail),
    }
    step = (last - before) / period
    season = F.col("_phase_mean") - (F.col("_settled") + edge) / F.col("_tn")
    enough = F.col("_tn") >= 2 * period
    return Recipe("decomposition", state, {
        "STL_Trend": F.when(enough, last + step),
        "STL_Combined": F.when(enough, last + step + season),
        "STL_Level": F.when(enough, last + season),
    })


def decompose_forecast(h: DataFrame, targets: DataFrame, period: int = 7, strict: bool = True) -> DataFrame:
    """Decomposition forecasts from the days before each target, or with
    ``strict=False`` from the end of the whole series."""
    rows, recipe = with_remainder(h, period), decompose_recipe(period)
    if strict:
        return forecast_asof(rows, targets, [recipe])
    end = h.groupBy("series_id").agg(F.date_add(F.max("ds"), 1).alias("_end"))
    at_end = forecast_asof(rows, end.withColumnRenamed("_end", "target_ds"), [recipe])
    return targets.select("series_id", "target_ds").join(at_end.drop("target_ds"), "series_id")
