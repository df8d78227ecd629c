"""Feature frames of each version, and the rows models are served from."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions.columns import by_day, null_inf
from ..operators import features as ft
from ..operators.asof import asof_attach
from ..operators.baselines import with_keys
from .presets import FEATURES


def _row_features(h: DataFrame, p: dict, ahead: int) -> DataFrame:
    """Features that come from the values before a row."""
    # widest last: the narrow rows go through the operators that need several passes
    out = ft.ema(h, p["ema"], p["adjust"], ahead=ahead)
    out = ft.rolling(out, p["rolling"], p["stats"], p["min_periods"], ahead)
    out = ft.lags(out, p["lags"], ahead)
    known = by_day().rowsBetween(Window.unboundedPreceding, ahead - 1)
    out = out.withColumn("level", F.avg("y").over(known))
    if p["trend"]:
        out = out.withColumn("trend", F.row_number().over(by_day()) - 1 + ahead)
    return out


def _date_features(df: DataFrame, p: dict, holidays: DataFrame | None) -> DataFrame:
    """Features that come from the date ``ds`` alone."""
    out = cal.calendar(df, parts=p["calendar"])
    if p["cyclic"]:
        out = cal.cyclic(out, p["cyclic"])
    out = cal.edge_flags(out, *p["edges"])
    for flags in p["flags"]:
        out = {"day": cal.day_flags, "quarter": cal.quarter_flags, "special": cal.special_periods}[flags](out)
    return cal.holiday_flag(out, holidays)


def feature_frame(
    h: DataFrame, version: str, holidays: DataFrame | None = None, leaky: bool = False
) -> DataFrame:
    """The features of a version for every day of history.  ``level``, the mean of the
    series so far, lets one model serve many series.  Features that contain the day's
    own total are added only on request."""
    p = FEATURES[version]
    out = _date_features(_row_features(h, p, 0), p, holidays)
    if p["same_weekday"]:
        out = ft.same_weekday_mean(out)
    if leaky:
        if p["diffs"]:
            out = ft.diff(out, p["diffs"])
        if p["pct"]:
            out = ft.pct_change(out, p["pct"])
        for keys, stats in p["groups"]:
            out = ft.group_stat(out, keys.split(), stats)
    return null_inf(out)


def serving_rows(
    h: DataFrame, targets: DataFrame, version: str, mode: str = "asof", holidays: DataFrame | None = None
) -> DataFrame:
    """One feature row per target, as of the last day before it.

    ``asof``: every value feature is what the row after the last known day would see, so
    a target equal to a history day gets that day's own features.  ``carry`` repeats the
    features of the last row itself and only replaces the date parts.
    """
    p, ids = FEATURES[version], ["series_id", "target_ds"]
    wanted = targets.select(*ids).distinct()
    if mode == "carry":
        at = asof_attach(feature_frame(h, version, holidays), wanted).filter(F.col("ds").isNotNull())
        replaced = [c for c in ("year", "month", "day", "weekday", "week_of_month") if c in at.columns]
        return at.withColumns({c: cal.CALENDAR[c](F.col("target_ds")) for c in replaced}).drop("ds", "y")
    state = _row_features(h.select("series_id", "ds", "y"), p, 1)
    at = asof_attach(state, wanted).filter(F.col("ds").isNotNull()).drop("ds", "y")
    out = _date_features(at.withColumn("ds", F.col("target_ds")), p, holidays).drop("ds")
    if p["same_weekday"]:
        four = by_day("weekday").rowsBetween(-3, 0)
        last = with_keys(h, ["weekday"], "ds").select(
            "series_id", "weekday", "ds", F.avg("y").over(four).alias("same_weekday_mean")
        )
        same = asof_attach(last, with_keys(wanted, ["weekday"], "target_ds"), ["weekday"])
        out = out.join(same.select(*ids, "same_weekday_mean"), ids, "left")
    return null_inf(out)


def model_features(version: str) -> list[str]:
    """Names of the features a model of this version trains on: no leaks, no year."""
    p = FEATURES[version]
    names = ["level", *[f"lag_{n}" for n in p["lags"]]]
    names += [f"rolling_{s}_{n}" for n in p["rolling"] for s in p["stats"]] + [f"ema_{s}" for s in p["ema"]]
    names += [c for c in p["calendar"] if c != "year"] + ["is_month_start", "is_month_end", "is_holiday"]
    names += [f"{c}_{f}" for c in p["cyclic"] for f in ("sin", "cos")]
    flags = {"day": ("is_weekend", "is_monday", "is_friday"), "quarter": ("is_quarter_start", "is_quarter_end"),
             "special": tuple(cal.SPECIAL_PERIODS)}
    names += [c for f in p["flags"] for c in flags[f]]
    return names + (["trend"] if p["trend"] else []) + (["same_weekday_mean"] if p["same_weekday"] else [])
