"""Streams over events and actuals; each gives the batch answer on the same rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..operators.ensemble import DEFAULT_NOON_RATIO, NOON_SHARE
from ..operators.feedback import FLOOR, MEMORY, RATE


def _instant(ts: str) -> Column:
    """A wall-clock time as the instant with that time in UTC: watermarks need an instant
    and day windows are cut in UTC, whatever the session's zone."""
    return F.from_utc_timestamp(F.col(ts).cast("timestamp"), F.current_timezone())


def daily_rollup_stream(
    events: DataFrame, ts: str, keys: Sequence[str], value: Column | None = None,
    cutoff_hour: int = 12, lateness: str = "1 day",
) -> DataFrame:
    """Daily totals and totals before ``cutoff_hour`` of a stream of facts.  Rows later
    than ``lateness`` are dropped; in append and update mode closed days leave the state."""
    amount = F.lit(1.0) if value is None else value.cast("double")
    x = events.select(
        F.concat_ws("|", *[F.col(k).cast("string") for k in keys]).alias("series_id"),
        _instant(ts).alias("at"), amount.alias("v"), F.when(F.hour(ts) < cutoff_hour, amount).alias("early"),
    )
    day = F.to_date(F.to_utc_timestamp(F.col("w.start"), F.current_timezone()))
    return (
        x.withWatermark("at", lateness)
        .groupBy(F.window("at", "1 day").alias("w"), "series_id")
        .agg(F.sum("v").alias("y"), F.coalesce(F.sum("early"), F.lit(0.0)).alias("partial_y"))
        .select("series_id", day.alias("ds"), "y", "partial_y")
    )


def noon_nowcast(totals: DataFrame, forecast: DataFrame, ratios: DataFrame, version: str = "enhanced") -> DataFrame:
    """Running day totals (a stream or a micro-batch) against the stored forecast and
    noon ratios: the total implied by the count so far, mixed with the forecast."""
    x = totals.select("series_id", F.col("ds").alias("target_ds"), F.col("partial_y").alias("noon"))
    x = x.join(forecast.select("series_id", "target_ds", "yhat"), ["series_id", "target_ds"])
    x = x.join(ratios, "series_id", "left")
    keep, ratio = NOON_SHARE[version], F.coalesce("ratio", F.lit(DEFAULT_NOON_RATIO))
    implied = F.try_divide(F.col("noon"), ratio)
    value = F.when((F.col("noon") > 0) & (ratio > 0), F.col("yhat") * keep + implied * (1 - keep))
    return x.select("series_id", "target_ds", "noon", F.coalesce(value, F.col("yhat")).alias("yhat"))


def running_bias(actuals: DataFrame) -> DataFrame:
    """Corrected forecasts as actuals ``(series_id, ds, base, y)`` arrive, each series'
    days in order: the state of a series is its last corrected errors.  Days of one
    micro-batch are put in order; a day that comes in a later batch than one after it
    joins the errors when it comes, and nothing that was given out changes."""
    return actuals.groupBy("series_id").applyInPandasWithState(
        kernels.running_correction(MEMORY, FLOOR, RATE),
        "series_id string, ds date, base double, y double, correction double",
        "errors array<double>", "append", "NoTimeout",
    )


def running_bias_in_order(actuals: DataFrame, lateness: str = "7 days", idle_days: int = 400) -> DataFrame:
    """Corrected forecasts of ``(series_id, ds, base, y)`` whose days may come in any order: the batch answer.

    A day waits until the watermark, ``lateness`` behind the newest day of the stream, has passed its end; then the days of
    its series are folded in order.  Days that come later still are dropped.  State is the last errors and the
    waiting days of a series, at most ``lateness`` of them; it leaves after ``idle_days`` without one."""
    # Whole days as instants in UTC, whatever the session's zone.
    marked = actuals.withColumn("at", F.timestamp_seconds(F.unix_date("ds") * 86400)).withWatermark("at", lateness)
    return marked.groupBy("series_id").applyInPandasWithState(
        kernels.ordered_correction(MEMORY, FLOOR, RATE, idle_days * 86_400_000),
        "series_id string, ds date, base double, y double, correction double",
        "errors array<double>, days array<long>, bases array<double>, ys array<double>, last long", "append", "EventTimeTimeout",
    )
