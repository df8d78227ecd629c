"""Forecasts from similar days, similar patterns and the year before.

Targets meet history per (series, slice of time): both sides are packed into one row per
slice, so a long or hot series spreads over its slices, pairs are never rows, and only the
best ``k`` of each slice travel on.  Similar days are scaled to what each target sees, so
there a series' targets are dealt over tasks, each with the series' days, which the
calendar bounds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.columns import by_day, clip, one_model, week_of_month
from .asof import asof_attach
from .baselines import IDS, with_keys, year_means, year_to_date
from .packed import deal, spread

# Weight of each calendar feature in the distance between two days.
DAY_WEIGHTS = {
    "weekday": 5.0, "month": 3.0, "week_of_month": 2.0, "is_month_start": 4.0, "is_month_end": 2.5,
    "month_sin": 2.0, "month_cos": 2.0, "weekday_sin": 3.0, "weekday_cos": 3.0,
}
SLICE = 512


def day_features(day: str) -> dict[str, Column]:
    month, weekday, dom = F.month(day), F.weekday(day), F.dayofmonth(day)
    m, w = month * (2 * math.pi / 12), weekday * (2 * math.pi / 7)
    out = {
        "weekday": weekday, "month": month, "week_of_month": week_of_month(F.col(day)),
        "is_month_start": (dom <= 3).cast("int"), "is_month_end": (dom >= 25).cast("int"),
        "month_sin": F.sin(m), "month_cos": F.cos(m), "weekday_sin": F.sin(w), "weekday_cos": F.cos(w),
    }
    return {k: c.cast("double") for k, c in out.items()}


def best(df: DataFrame, k: int, *order: Column) -> DataFrame:
    """The first ``k`` rows of each target."""
    rank = F.row_number().over(Window.partitionBy(*IDS).orderBy(*order))
    return df.withColumn("_k", rank).filter(F.col("_k") <= k).drop("_k")


def nearest(rows: DataFrame, wanted: DataFrame, k: int, kind: str, n_values: int) -> DataFrame:
    """Best ``k`` rows per target over all its slices.

    ``rows(series_id, _slice, key, x, v)``; ``wanted(series_id, target_ds, _slice, since,
    until, x, w)`` sees rows with ``since <= key < until``.  Gives ``key``, ``score`` and
    the carried values ``v0..``.
    """
    by = ["series_id", "_slice"]
    packed = spread(rows, *by).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct("key", "x", "v"))).alias("r"))
    asked = wanted.groupBy(*by).agg(
        F.collect_list(F.struct(F.unix_date("target_ds").alias("day"), "since", "until", "x", "w")).alias("targets")
    )
    both = packed.join(asked, by).select(
        "series_id", "r.key", F.flatten("r.x").alias("x"), F.flatten("r.v").alias("v"), "targets"
    )
    found = both.mapInPandas(
        kernels.slice_top_k(k, kind), "series_id string, day int, key int, score double, v array<double>"
    ).withColumn("target_ds", F.date_from_unix_date("day"))
    order = F.rint(F.col("score") * 1e9)
    return best(found, k, order, F.col("key")).select(
        *IDS, "key", "score", *[F.get("v", F.lit(i)).alias(f"v{i}") for i in range(n_values)]
    )


def vector(*columns: Column) -> Column:
    return F.array(*[c.cast("double") for c in columns])


def similar_days(h: DataFrame, targets: DataFrame, years: int = 3, k: int = 20) -> DataFrame:
    """Weighted mean of the ``k`` days nearest in calendar features, times the clipped
    growth of yearly means.

    A target sees the last ``years`` years, or all earlier days if those hold fewer than
    ten, and features are scaled to what it sees.  That scale moves with every target, so
    the search runs on the packed series; only the ``k`` days found come back as rows.
    """
    rows = h.select(
        "series_id", F.unix_date("ds").alias("key"), F.year("ds").alias("year"), "y",
        vector(*day_features("ds").values()).alias("x"),
    )
    packed = spread(rows, "series_id").groupBy("series_id").agg(
        F.sort_array(F.collect_list(F.struct("key", "year", "y", "x"))).alias("r")
    )
    cut = F.unix_date(F.add_months("target_ds", -12 * years))
    asked = targets.select(
        "series_id",
        F.struct(
            F.unix_date("target_ds").alias("day"), cut.alias("since"),
            vector(*day_features("target_ds").values()).alias("x"),
        ).alias("t"),
    ).groupBy("series_id").agg(F.collect_set("t").alias("targets"))
    whole = packed.join(asked, "series_id").select(
        "series_id", "r.key", "r.year", "r.y", F.flatten("r.x").alias("x"), "targets"
    )
    found = deal(whole).mapInPandas(
        kernels.similar(k, list(DAY_WEIGHTS.values())),
        "series_id string, day int, growth double, distance double, year int, y double",
    )
    weight = 1 / (F.col("distance") + 0.01)
    g = found.groupBy("series_id", "day", "growth").agg(
        (F.sum(F.col("y") * weight) / F.sum(weight)).alias("v"), F.avg("year").alias("_y")
    ).withColumn("target_ds", F.date_from_unix_date("day"))
    factor = clip(F.pow(1 + F.col("growth"), F.year("target_ds") - F.col("_y")), 0.7, 1.5)
    return one_model(g, "similar", F.col("v") * factor, "analog")


def pattern_match(h: DataFrame, targets: DataFrame, m: int = 7, k: int = 10, strict: bool = True) -> DataFrame:
    """The last ``m`` values against every earlier run of ``m`` values by correlation;
    weighted mean of what followed the ``k`` best, scaled to the recent level.

    ``strict`` uses only days before the target; otherwise runs after it count as well.
    A target with too short a history gets the mean of what is there.
    """
    w = by_day()
    before, upto = w.rowsBetween(-m, -1), w.rowsBetween(1 - m, 0)
    rows = h.select(
        "series_id", (F.row_number().over(w) - 1).cast("int").alias("key"), "y",
        F.collect_list("y").over(before).alias("x"), F.avg("y").over(before).alias("mean"),
    )
    runs = rows.filter(F.col("key") >= m).select(
        "series_id", F.floor(F.col("key") / SLICE).cast("int").alias("_slice"), "key",
        "x", vector(F.col("y"), F.col("mean")).alias("v"),
    )
    state = h.select(
        "series_id", "ds", F.row_number().over(w).alias("_n"),
        F.avg("y").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_all"),
        F.collect_list("y").over(upto).alias("x"), F.avg("y").over(upto).alias("t_mean"),
    )
    t = asof_attach(state, targets.select(*IDS).distinct())
    if strict:
        t = t.withColumn("_total", F.col("_n"))
    else:
        total = h.groupBy("series_id").agg(F.count("y").cast("int").alias("_total"), F.avg("y").alias("_mean"))
        t = t.join(total, "series_id").withColumn("_all", F.col("_mean"))
    # a run may not reach the last m + 1 days
    until = F.col("_total") - m - 1
    ready = (F.col("_n") >= m) & (F.col("_total") >= 3 * m) & (until > m)
    wanted = t.filter(ready).select(
        *IDS, "x", vector().alias("w"), F.lit(m).alias("since"), until.alias("until"),
        F.explode(F.sequence(F.lit(0), F.floor((until - 1) / SLICE).cast("int"))).alias("_slice"),
    )
    top = nearest(runs, wanted, k, "correlation", 2).join(t.select(*IDS, "t_mean"), IDS)
    weight = (1 - F.col("score")) / 2
    level = clip(F.col("t_mean") / (F.col("v1") + 1e-8), 0.5, 2.0)
    g = top.groupBy(*IDS).agg(
        F.coalesce(
            F.try_divide(F.sum(F.col("v0") * level * weight), F.sum(weight)), F.avg(F.col("v0") * level)
        ).alias("v")
    )
    at = t.select(*IDS, "_all").join(g, IDS, "left")
    return one_model(at, "pattern", F.coalesce("v", "_all"), "analog")


def prev_year_trend(h: DataFrame, targets: DataFrame, strict: bool = True) -> DataFrame:
    """Mean of the month a year ago times the clipped growth of yearly means; the mean
    of everything when that month is missing.  ``strict=False`` takes the target's
    whole year, days after it included."""
    t = targets.select(*IDS).distinct()
    if strict:
        means = year_to_date(h, t)
    else:
        years, everything = year_means(h), h.groupBy("series_id").agg(F.avg("y").alias("overall"))
        ty = t.withColumn("year", F.year("target_ds"))
        now = years.select("series_id", "year", F.col("mean").alias("this_year"))
        then = years.select("series_id", (F.col("year") + 1).alias("year"), F.col("mean").alias("last_year"))
        means = (ty.join(everything, "series_id").join(now, ["series_id", "year"], "left")
                 .join(then, ["series_id", "year"], "left").drop("year"))
    month = year_means(h, by_month=True).select(
        "series_id", (F.col("year") + 1).alias("year"), "month", F.col("mean").alias("_m")
    )
    at = with_keys(means, ["year", "month"], "target_ds").join(month, ["series_id", "year", "month"], "left")
    growth = F.coalesce(clip(F.try_divide("this_year", "last_year"), 0.8, 1.3), F.lit(1.0))
    yhat = F.coalesce(F.col("_m") * growth, F.col("overall"))
    return one_model(at, "prev_year", yhat, "analog")


def recent_trend(h: DataFrame, targets: DataFrame, strict: bool = True) -> DataFrame:
    """Mean of the target's weekday and month in earlier years (else of the weekday, else
    of recent days) times the clipped ratio of the last 30 days to all days."""
    t = with_keys(targets.select(*IDS).distinct(), ["weekday", "month", "year"], "target_ds")
    w = by_day()
    # 30 calendar days: targets stand in the same order with no value of their own
    both = h.select("series_id", "ds", "y", F.lit(None).cast("date").alias("target_ds")).unionByName(
        t.select("series_id", F.col("target_ds").alias("ds"), F.lit(None).cast("double").alias("y"), "target_ds")
    )
    days = Window.partitionBy("series_id").orderBy(F.unix_date("ds"))
    month_back = days.rangeBetween(-30, -1)
    recent = both.withColumns(
        {"_r": F.avg("y").over(month_back), "_c": F.count("y").over(month_back)}
    ).filter(F.col("target_ds").isNotNull()).select(*IDS, "_r", "_c")
    state = h.select(
        "series_id", "ds", F.avg("y").over(w.rowsBetween(-19, 0)).alias("_last20"),
        F.avg("y").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("_all"),
    )
    at = asof_attach(state, recent)
    hk = with_keys(h, ["weekday", "month", "year"], "ds")
    cells = hk.groupBy("series_id", "weekday", "month", "year").agg(F.sum("y").alias("s"), F.count("y").alias("n"))
    earlier = (
        t.join(cells.withColumnRenamed("year", "_y"), ["series_id", "weekday", "month"])
        .filter(F.col("_y") < F.col("year"))
        .groupBy(*IDS).agg((F.sum("s") / F.sum("n")).alias("_same"))
    )
    if strict:
        seen = by_day("weekday").rowsBetween(Window.unboundedPreceding, 0)
        wd = asof_attach(hk.select("series_id", "weekday", "ds", F.avg("y").over(seen).alias("_wd")),
                         t.select(*IDS, "weekday"), ["weekday"]).select(*IDS, "_wd")
        overall = F.col("_all")
    else:
        wd = t.join(cells.groupBy("series_id", "weekday").agg((F.sum("s") / F.sum("n")).alias("_wd")),
                    ["series_id", "weekday"], "left").select(*IDS, "_wd")
        at = at.join(h.groupBy("series_id").agg(F.avg("y").alias("_whole")), "series_id")
        overall = F.col("_whole")
    x = at.join(earlier, IDS, "left").join(wd, IDS, "left")
    now = F.when(F.col("_c") >= 5, F.col("_r")).otherwise(F.col("_last20"))
    ratio = F.coalesce(clip(F.try_divide(now, overall), 0.7, 1.5), F.lit(1.0))
    past = F.coalesce("_same", "_wd")
    yhat = F.when(now.isNull(), overall).otherwise(F.coalesce(past * ratio, now))
    return one_model(x, "trend", yhat, "analog")


def with_fallback(p: DataFrame, h: DataFrame, targets: DataFrame, models: Sequence[str], default: float | None = None) -> DataFrame:
    """Fill missing (target, model) rows with the mean of the days before the target and,
    where there are none, with ``default`` (null leaves the row out)."""
    seen = by_day().rowsBetween(Window.unboundedPreceding, 0)
    state = h.select("series_id", "ds", F.avg("y").over(seen).alias("_all"))
    full = asof_attach(state, targets.select(*IDS).distinct()).select(
        *IDS, F.explode(F.array(*[F.lit(m) for m in models])).alias("model"), "_all"
    )
    return full.join(p, [*IDS, "model"], "left").select(
        *IDS, "model", F.coalesce("yhat", "_all", F.lit(default).cast("double")).alias("yhat"), "lo", "hi",
        F.coalesce("family", F.lit("fallback")).alias("family"),
    ).filter(F.col("yhat").isNotNull())


def nearest_neighbours(
    train: DataFrame, wanted: DataFrame, features: Sequence[str] | str, k: int = 10, weights: str = "distance"
) -> DataFrame:
    """k nearest rows of the same series: ``train(series_id, ds, y, features...)`` against
    ``wanted(series_id, target_ds, features...)``; only rows before the target vote.
    ``features`` names columns or one array column.  An exact match outvotes everything
    when weighting by distance."""
    x = F.col(features) if isinstance(features, str) else vector(*[F.col(f) for f in features])
    rows = train.select(
        "series_id", F.year("ds").alias("_slice"), F.unix_date("ds").alias("key"), x.alias("x"),
        vector(F.col("y")).alias("v"),
    )
    first = train.groupBy("series_id").agg(F.year(F.min("ds")).alias("_first"))
    asked = wanted.join(first, "series_id").filter(F.col("_first") <= F.year("target_ds")).select(
        *IDS, F.explode(F.sequence("_first", F.year("target_ds"))).alias("_slice"),
        F.lit(-(2**31)).alias("since"), F.unix_date("target_ds").alias("until"),
        x.alias("x"), F.transform(x, lambda v: F.lit(1.0)).alias("w"),
    )
    top = nearest(rows, asked, k, "distance", 1)
    if weights == "uniform":
        value = F.avg("v0")
    else:
        near = F.when(F.col("score") > 0, 1 / F.col("score"))
        exact = F.avg(F.when(F.col("score") == 0, F.col("v0")))
        value = F.coalesce(exact, F.sum(F.col("v0") * near) / F.sum(near))
    return one_model(top.groupBy(*IDS).agg(value.alias("_v")), "KNN", F.col("_v"), "ml")
