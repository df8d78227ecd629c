"""Averages, seasonal means and previous-year lookups.

Each function returns ``(series_id, target_ds, model, yhat, lo, hi, family)``.  History
is strictly before the target unless ``strict=False``, which reproduces profiles taken
over the whole series.  The ``*_recipe`` functions hold the expressions, so that a plan
can run all of them in one pass.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import CALENDAR
from ..functions.columns import (
    array_dot,
    array_mean,
    array_median,
    array_sum,
    by_day,
    clip,
    last_of,
    one_model,
    trimmed_mean,
)
from ..functions.distributions import t_quantile
from .asof import Recipe, asof_attach, forecast_asof, windows as window_recipe
from .features import exponential_mean

IDS = ["series_id", "target_ds"]


def with_keys(df: DataFrame, keys: Sequence[str], day: str) -> DataFrame:
    return df.withColumns({k: CALENDAR[k](F.col(day)) for k in keys})


TAIL = 30


def recent_values(n: int = TAIL) -> dict[str, Column]:
    """State shared by every forecast from the last days: their values in date order.
    The forecasts themselves are then worked out for target rows only."""
    return {f"_tail{n}": F.collect_list("y").over(by_day().rowsBetween(-(n - 1), 0))}


def last_values(n: int, tail: int = TAIL) -> Column:
    return last_of(F.col(f"_tail{tail}"), n)


def sma_recipe(sizes=(3, 5, 7, 14, 21, 30), require_full: bool = True) -> Recipe:
    tail = max(TAIL, *sizes)
    models = {}
    for n in sizes:
        values = last_values(n, tail)
        mean = array_mean(values)
        models[f"SMA_{n}"] = F.when(F.size(values) >= n, mean) if require_full else mean
    return Recipe("moving_average", recent_values(tail), models)


def sma(h, targets, sizes=(3, 5, 7, 14, 21, 30), require_full: bool = True) -> DataFrame:
    return forecast_asof(h, targets, [sma_recipe(sizes, require_full)])


def wma_recipe(n: int = 7) -> Recipe:
    weights, tail = list(range(1, n + 1)), max(TAIL, n)
    value = array_dot(last_values(n, tail), weights) / sum(weights)
    return Recipe("moving_average", recent_values(tail), {f"WMA_{n}": value})


def wma(h, targets, n: int = 7) -> DataFrame:
    return forecast_asof(h, targets, [wma_recipe(n)])


def tma_recipe(n: int = 7) -> Recipe:
    """A mean of means is one triangular set of weights over 2n-1 rows."""
    rows = 2 * n - 1
    tail = max(TAIL, rows)
    value = array_dot(last_values(rows, tail), [min(i + 1, rows - i) for i in range(rows)]) / (n * n)
    return Recipe("moving_average", recent_values(tail), {f"TMA_{n}": value})


def tma(h, targets, n: int = 7) -> DataFrame:
    return forecast_asof(h, targets, [tma_recipe(n)])


def ema_recipe(spans=(7, 14, 21)) -> Recipe:
    """Reads the columns ``EMA_n`` that ``exponential_mean`` adds to the history."""
    return window_recipe("moving_average", {f"EMA_{s}": F.col(f"EMA_{s}") for s in spans})


def ema_forecast(h, targets, spans=(7, 14, 21), adjust: bool = True) -> DataFrame:
    return forecast_asof(exponential_mean(h, spans, adjust, "EMA_"), targets, [ema_recipe(spans)])


def mean_so_far(model: str, keys: Sequence[str]) -> Recipe:
    seen = by_day(*keys).rowsBetween(Window.unboundedPreceding, 0)
    return window_recipe("seasonal", {model: F.avg("y").over(seen)})


def keyed_forecast(h, targets, keys: Sequence[str], recipes: Sequence[Recipe]) -> DataFrame:
    """Recipes evaluated among the days that share the target's calendar keys."""
    return forecast_asof(
        with_keys(h, keys, "ds"), with_keys(targets.select(*IDS), keys, "target_ds"), recipes, keys
    )


def calendar_mean(h, targets, keys: Sequence[str], model: str, strict: bool = True) -> DataFrame:
    """Mean of the days sharing the target's calendar keys."""
    if strict:
        return keyed_forecast(h, targets, keys, [mean_so_far(model, keys)])
    profile = with_keys(h, keys, "ds").groupBy("series_id", *keys).agg(F.avg("y").alias("_m"))
    hit = with_keys(targets.select(*IDS), keys, "target_ds").join(profile, ["series_id", *keys])
    return one_model(hit, model, F.col("_m"), "seasonal")


def weekday_mean(h, targets, strict: bool = True) -> DataFrame:
    return calendar_mean(h, targets, ["weekday"], "Weekday_Mean", strict)


def month_mean(h, targets, strict: bool = True) -> DataFrame:
    return calendar_mean(h, targets, ["month"], "Month_Mean", strict)


def weekday_month_mean(h, targets) -> DataFrame:
    return calendar_mean(h, targets, ["weekday", "month"], "Weekday_Month_Mean")


def week_of_month_mean(h, targets, strict: bool = True) -> DataFrame:
    return calendar_mean(h, targets, ["week_of_month"], "WeekOfMonth_Mean", strict)


def weekday_recent_recipe(ks=(4, 8), conf: float = 0.95) -> Recipe:
    """Mean of the last ``k`` values on the weekday; the longest ``k`` carries a t
    interval once four values are known."""
    frames = {k: by_day("weekday").rowsBetween(-(k - 1), 0) for k in ks}
    widest = max(ks)
    state = {f"Weekday_Recent{k}": F.avg("y").over(frames[k]) for k in ks}
    models: dict = {m: F.col(m) for m in state}
    state |= {"_wn": F.count("y").over(frames[widest]), "_wsd": F.stddev_samp("y").over(frames[widest])}
    half = F.when(F.col("_wn") >= 4, t_quantile(F.col("_wn") - 1, conf) * F.col("_wsd") / F.sqrt("_wn"))
    mean = F.col(f"Weekday_Recent{widest}")
    models[f"Weekday_Recent{widest}"] = (mean, mean - half, mean + half)
    return Recipe("seasonal", state, models)


def weekday_recent(h, targets, ks=(4, 8), conf: float = 0.95) -> DataFrame:
    return keyed_forecast(h, targets, ["weekday"], [weekday_recent_recipe(ks, conf)])


def _days_back(targets: DataFrame, days: Sequence[int]) -> DataFrame:
    """Targets repeated for each look-back, ``ds`` being the day to look up."""
    back = F.explode(F.array(*[F.lit(d) for d in days])).alias("back")
    return targets.select(*IDS, back).withColumn("ds", F.date_sub("target_ds", F.col("back")))


def prev_year_days(h, targets, days: Sequence[int]) -> DataFrame:
    """Targets with the known days among some look-backs as ``near`` (a short array)."""
    hit = _days_back(targets, days).join(h.select("series_id", "ds", "y"), ["series_id", "ds"])
    return hit.groupBy(*IDS).agg(F.sort_array(F.collect_list(F.struct("ds", "back", "y"))).alias("near"))


def _value_at(back: int) -> Column:
    return F.get(F.filter("near", lambda p: p["back"] == back), F.lit(0))["y"]


def same_day_value() -> Column:
    return _value_at(365)


def same_weekday_value(fallback: bool = False) -> Column:
    """The value 364 days back; with ``fallback`` the first known day from three before
    to three after it (not the nearest one)."""
    if not fallback:
        return _value_at(364)
    around = F.filter("near", lambda p: p["back"].between(361, 367))
    return F.coalesce(_value_at(364), F.get(around, F.lit(0))["y"])


def nearby_value() -> Column:
    """Centre: first known day within three of the day 365 back; mean of the known days
    within three of that centre."""
    centre = F.get(F.filter("near", lambda p: p["back"].between(362, 368)), F.lit(0))["back"]
    kept = F.filter("near", lambda p: F.abs(p["back"] - centre) <= 3)
    return F.when(centre.isNotNull(), F.try_divide(array_sum(F.transform(kept, lambda p: p["y"])), F.size(kept)))


def prev_year_same_day(h, targets) -> DataFrame:
    return one_model(prev_year_days(h, targets, [365]), "PrevYear_SameDay", same_day_value(), "previous_year")


def prev_year_same_weekday(h, targets, fallback: bool = False) -> DataFrame:
    near = prev_year_days(h, targets, range(361, 368) if fallback else [364])
    return one_model(near, "PrevYear_SameWeekday", same_weekday_value(fallback), "previous_year")


def prev_year_nearby(h, targets) -> DataFrame:
    return one_model(prev_year_days(h, targets, range(359, 372)), "PrevYear_Nearby", nearby_value(), "previous_year")


def year_means(h: DataFrame, by_month: bool = False) -> DataFrame:
    keys = ["year", "month"] if by_month else ["year"]
    return with_keys(h, keys, "ds").groupBy("series_id", *keys).agg(F.avg("y").alias("mean"))


def prev_year_month_mean(h, targets) -> DataFrame:
    last_year = year_means(h, by_month=True).withColumn("year", F.col("year") + 1)
    hit = with_keys(targets.select(*IDS), ["year", "month"], "target_ds").join(
        last_year, ["series_id", "year", "month"]
    )
    return one_model(hit, "PrevYear_MonthMean", F.col("mean"), "previous_year")


def year_to_date(h: DataFrame, targets: DataFrame) -> DataFrame:
    """Targets with the strict mean of their own year so far (``this_year``), of all
    history (``overall``) and of the whole previous year (``last_year``); null if empty."""
    running = by_day().rowsBetween(Window.unboundedPreceding, 0)
    in_year = by_day("year").rowsBetween(Window.unboundedPreceding, 0)
    hy = with_keys(h, ["year"], "ds")
    state = hy.select(
        "series_id", "ds", F.col("year").alias("_year"),
        F.avg("y").over(in_year).alias("_ytd"), F.avg("y").over(running).alias("overall"),
    )
    at = asof_attach(state, targets.select(*IDS)).withColumn("year", F.year("target_ds"))
    last = year_means(h).select("series_id", (F.col("year") + 1).alias("year"), F.col("mean").alias("last_year"))
    return at.join(last, ["series_id", "year"], "left").select(
        *IDS, "overall", "last_year",
        F.when(F.col("_year") == F.col("year"), F.col("_ytd")).alias("this_year"),
    )


def growth_value(base: Column) -> Column:
    now, then = F.coalesce("this_year", "overall"), F.coalesce("last_year", "overall")
    return base * clip(F.when(then > 0, now / then).otherwise(1.0), 0.8, 1.3)


def prev_year_growth(h, targets) -> DataFrame:
    """Previous-year same day times the clipped growth of yearly means."""
    at = prev_year_days(h, targets, [365]).join(year_to_date(h, targets), IDS)
    return one_model(at, "PrevYear_GrowthAdj", growth_value(same_day_value()), "previous_year")


def bayes_recipe(recent: int = 14) -> Recipe:
    """Precision-weighted mean of all history and the last ``recent`` days."""
    seen, tail = by_day().rowsBetween(Window.unboundedPreceding, 0), max(TAIL, recent)
    state = {"_m0": F.avg("y").over(seen), "_v0": F.var_samp("y").over(seen), **recent_values(tail)}
    # mean and spread of the recent days in one fold (Welford), worked out once
    start = F.struct(F.lit(0.0).alias("n"), F.lit(0.0).alias("m"), F.lit(0.0).alias("s"))

    def step(a: Column, v: Column) -> Column:
        m = a["m"] + (v - a["m"]) / (a["n"] + 1)
        return F.struct((a["n"] + 1).alias("n"), m.alias("m"), (a["s"] + (v - a["m"]) * (v - m)).alias("s"))

    one = F.lit(1.0)
    derived = {"_recent": F.aggregate(last_values(recent, tail), start, step)}
    v1 = F.try_divide(F.col("_recent.s"), F.col("_recent.n") - 1)
    p0, p1 = F.try_divide(one, F.col("_v0")), F.try_divide(F.lit(float(recent)), v1)
    mean, half = (F.col("_m0") * p0 + F.col("_recent.m") * p1) / (p0 + p1), 1.96 / F.sqrt(p0 + p1)
    return Recipe("estimate", state, {"Bayes_Posterior": (mean, mean - half, mean + half)}, derived)


def bayes_posterior(h, targets, recent: int = 14) -> DataFrame:
    return forecast_asof(h, targets, [bayes_recipe(recent)])


def median_recipe(ns: Sequence[int] = (7, 14, 30)) -> Recipe:
    tail = max(TAIL, *ns)
    return Recipe("robust", recent_values(tail), {f"Median_{n}": array_median(last_values(n, tail)) for n in ns})


def recent_median(h, targets, ns=(7, 14, 30)) -> DataFrame:
    return forecast_asof(h, targets, [median_recipe(ns)])


def trim_recipe(cuts: Mapping[str, float] = {"10pct": 0.1, "20pct": 0.2}, n: int = 30) -> Recipe:
    """Trimmed means of the last ``n`` days."""
    tail = max(TAIL, n)
    models = {f"TrimMean_{k}": trimmed_mean(last_values(n, tail), p) for k, p in cuts.items()}
    return Recipe("robust", recent_values(tail), models)


def trim_mean(h, targets, cuts: Mapping[str, float] = {"10pct": 0.1, "20pct": 0.2}, n: int = 30) -> DataFrame:
    return forecast_asof(h, targets, [trim_recipe(cuts, n)])


def trend_change_recipe() -> Recipe:
    """Mean of the last week, raised or lowered by 2 % as its slope is above or below
    that of the week before.  The least-squares slope of seven equally spaced values is
    a fixed weighted sum."""
    weights = [k - 3 for k in range(7)]
    week, before = last_values(7), F.slice(last_values(14), 1, 7)
    slope, older = array_dot(week, weights), array_dot(before, weights)
    factor = F.when(slope > older, 1.02).when(slope < older, 0.98).otherwise(1.0)
    enough = F.size(last_values(14)) == 14
    return Recipe("robust", recent_values(), {"TrendChange_Adj": F.when(enough, array_mean(week) * factor)})


def trend_change(h, targets) -> DataFrame:
    return forecast_asof(h, targets, [trend_change_recipe()])
