"""Learning from past errors: bias, accuracy, corrections, back-test.

A ledger holds ``series_id, seq, prediction_date, final_prediction, actual_value, error,
error_pct, ...`` with ``error = prediction - actual``; ``seq`` is the insertion order.
Only the newest rows of a series matter, and Spark cuts to them before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.columns import by_day
from .packed import pack, spread_sorts

MEMORY, FLOOR, RATE = 10, 10.0, 0.7


def newest(ledger: DataFrame, n: int, order: str = "seq") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc(order)))
    return ledger.withColumn("_k", rank).filter(F.col("_k") <= n).drop("_k")


def retain(ledger: DataFrame, n: int = 100, order: str = "seq") -> DataFrame:
    """Keep the last ``n`` records of each series."""
    return newest(ledger, n, order)


def _completed(ledger: DataFrame) -> DataFrame:
    return ledger.filter(F.col("actual_value").isNotNull())


def detect_bias(ledger: DataFrame, n: int = 10) -> DataFrame:
    """Mean and spread of the last ``n`` errors with a known actual; biased when the mean
    exceeds both 10 and half the spread (three errors needed)."""
    g = newest(_completed(ledger), n).groupBy("series_id").agg(
        F.count("error").alias("sample_count"), F.avg("error").alias("bias"), F.stddev_samp("error").alias("std")
    )
    std = F.coalesce("std", F.lit(0.0))
    bound = F.when(std > 0, F.greatest(F.lit(FLOOR), 0.5 * std)).otherwise(F.lit(FLOOR))
    return g.filter(F.col("sample_count") >= 3).select(
        "series_id", "sample_count", "bias", std.alias("std"),
        (F.abs("bias") > bound).alias("detected"),
        F.when(F.col("bias") > 0, "over").otherwise("under").alias("direction"),
    )


def correction_rate(score: Column) -> Column:
    return F.when(score > 0.5, 0.3).when(score > 0.2, 0.5).otherwise(RATE)


def apply_correction(forecast: DataFrame, bias: DataFrame, special_day_score: str | None = None) -> DataFrame:
    """Take a detected bias off ``yhat``, less of it on special days."""
    score = F.col(special_day_score) if special_day_score else F.lit(0.0)
    joined = forecast.join(bias.select("series_id", "bias", "detected"), "series_id", "left")
    fix = F.when(F.coalesce("detected", F.lit(False)), -F.col("bias") * correction_rate(score)).otherwise(0.0)
    return joined.withColumn("correction", fix).withColumn(
        "yhat", F.col("yhat") + F.col("correction")
    ).drop("bias", "detected")


def accuracy(ledger: DataFrame) -> DataFrame:
    err = F.abs("error_pct")
    return _completed(ledger).groupBy("series_id").agg(
        F.count("actual_value").alias("total"), F.avg(F.abs("error")).alias("mae"), F.avg(err).alias("mae_pct"),
        F.percentile("error_pct", F.lit(0.5)).alias("median_error"),
        F.count_if(err <= 5).alias("within_5pct"), F.count_if(err <= 10).alias("within_10pct"),
    )


def tuner_correction(ledger: DataFrame) -> DataFrame:
    """Minus half the mean of the last ten errors once five records exist, else 0."""
    done = _completed(ledger)
    g = newest(done, 10).groupBy("series_id").agg(F.count("error").alias("n"), F.avg("error").alias("m"))
    return g.select("series_id", F.when(F.col("n") >= 5, F.col("m") * -0.5).otherwise(0.0).alias("correction"))


def accuracy_score(ledger: DataFrame) -> DataFrame:
    """100 minus twice the mean absolute error in percent over the last 30 records,
    within 0..100; 70 with fewer than three."""
    g = newest(_completed(ledger), 30).groupBy("series_id").agg(
        F.count("error_pct").alias("n"), F.avg(F.abs("error_pct")).alias("mape")
    )
    score = F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - F.col("mape") * 2))
    return g.select("series_id", F.when(F.col("n") >= 3, score).otherwise(70.0).alias("score"))


def memory_correction(forecast: DataFrame, ledger: DataFrame) -> DataFrame:
    """Scale ``yhat`` by the mean of the last ten relative errors ``(actual - predicted)
    / actual`` when it is beyond 2 %."""
    known = _completed(ledger).filter((F.col("actual_value") > 0) & (F.col("final_prediction") > 0))
    rel = (F.col("actual_value") - F.col("final_prediction")) / F.col("actual_value")
    g = newest(known.withColumn("_rel", rel), 10).groupBy("series_id").agg(F.avg("_rel").alias("_m"))
    fix = F.when(F.abs("_m") > 0.02, F.col("yhat") * F.col("_m")).otherwise(0.0)
    return (
        forecast.join(g, "series_id", "left")
        .withColumn("memory_correction", F.coalesce(fix, F.lit(0.0)))
        .withColumn("yhat", F.col("yhat") + F.col("memory_correction"))
        .drop("_m")
    )


def backtest_base(h: DataFrame, years: int = 2, min_obs: int = 30) -> DataFrame:
    """A forecast of every day of the last ``years`` from the days before it.

    ``p1``: mean of the same weekday and month (else of everything), ``p2``: the month a
    year ago (else p1), ``p3``: the last 30 days (else p1), blended .4/.4/.2.  All of it
    is windows on one shuffle; no day re-reads its history.
    """
    x = spread_sorts(h.select("series_id", "ds", "y")).select(
        "series_id", "ds", "y", F.weekday("ds").alias("_wd"), F.month("ds").alias("_mo"),
        F.year("ds").alias("_yr"), F.unix_date("ds").alias("_day"),
    )
    before = (Window.unboundedPreceding, -1)
    every = Window.partitionBy("series_id")
    month = Window.partitionBy("series_id", "_mo").orderBy("_yr").rangeBetween(-1, -1)
    days = Window.partitionBy("series_id").orderBy("_day").rangeBetween(-30, -1)
    x = x.withColumns(
        {
            "n_obs": F.row_number().over(by_day()) - 1,
            "_all": F.avg("y").over(by_day().rowsBetween(*before)),
            "p1": F.avg("y").over(by_day("_wd", "_mo").rowsBetween(*before)),
            "p2": F.avg("y").over(month),
            "p3": F.avg("y").over(days),
            "_end": F.max("ds").over(every),
            "_first": F.min("ds").over(every),
        }
    )
    start = F.greatest(F.date_sub("_end", 365 * years), F.date_add("_first", 90))
    p1 = F.coalesce("p1", "_all")
    x = x.filter((F.col("ds") >= start) & (F.col("n_obs") >= min_obs))
    x = x.select("series_id", "ds", "y", p1.alias("p1"), F.coalesce("p2", p1).alias("p2"),
                 F.coalesce("p3", p1).alias("p3"))
    return x.withColumn("base", F.col("p1") * 0.4 + F.col("p2") * 0.4 + F.col("p3") * 0.2)


def backtest_corrected(base: DataFrame) -> DataFrame:
    """Run the bias correction through a back-test in date order: each day is corrected
    from the last ten corrected errors.  Gives ledger rows (band 15 %, score 70); a day
    without sales has no error in percent."""
    x = pack(base, "base", "p1", "y").mapInPandas(
        kernels.sequential_correction(MEMORY, FLOOR, RATE),
        "series_id string, days int, base double, p1 double, y double, correction double",
    ).withColumn("ds", F.date_from_unix_date("days"))
    x = x.withColumn("final_prediction", F.col("base") + F.col("correction"))
    error = F.col("final_prediction") - F.col("y")
    return x.select(
        "series_id", F.col("ds").alias("prediction_date"), "final_prediction",
        (F.col("final_prediction") * 0.85).alias("pred_lower"), (F.col("final_prediction") * 1.15).alias("pred_upper"),
        F.lit(70).alias("confidence_score"), F.col("base").alias("ml_prediction"), F.col("p1").alias("stat_prediction"),
        F.col("y").alias("actual_value"), error.alias("error"), (F.try_divide(error, F.col("y")) * 100).alias("error_pct"),
        (F.col("correction") != 0).alias("bias_correction_applied"), F.col("correction").alias("bias_correction_amount"),
        F.unix_date("ds").cast("bigint").alias("seq"),
    )
