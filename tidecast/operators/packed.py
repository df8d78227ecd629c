"""One row per series: its days and values as arrays, and the dates wanted from it.

Used where a computation is sequential or needs a solver.  A history has one row per
series and day, so an array is bounded by the calendar however large the facts were;
series spread over the cluster by hash.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..session import planned_tasks

FORECAST = "series_id string, day int, model string, yhat double, lo double, hi double, family string"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash partition by key over the cluster's planned number of tasks.  Series are
    small in bytes and long in work, so they must not be merged into few tasks."""
    return df.repartition(planned_tasks(df.sparkSession), *keys)


#: Sorts of its rows that one task of several windows may hold at a time.
SORTS = 4


def spread_sorts(df: DataFrame) -> DataFrame:
    """Partition by series for windows of several orders, which sort and hold their rows side by side: so many times
    the planned tasks, so that all sorts of a task together are no more than one of a plain stage."""
    return df.repartition(SORTS * planned_tasks(df.sparkSession), "series_id")


def pack(h: DataFrame, *columns: str) -> DataFrame:
    """Arrays in date order: ``days`` (days since 1970) and one per column."""
    rows = spread(h.select("series_id", F.struct(F.unix_date("ds").alias("days"), *columns).alias("r")), "series_id")
    lists = rows.groupBy("series_id").agg(F.sort_array(F.collect_list("r")).alias("_rows"))
    return lists.select("series_id", *[F.col(f"_rows.{c}").alias(c) for c in ("days", *columns)])


def pack_rows(h: DataFrame) -> DataFrame:
    """``rows``: structs of ``ds`` and ``y`` in date order."""
    rows = spread(h.select("series_id", F.struct("ds", "y").alias("r")), "series_id")
    return rows.groupBy("series_id").agg(F.sort_array(F.collect_list("r")).alias("rows"))


def pack_targets(targets: DataFrame) -> DataFrame:
    days = F.sort_array(F.collect_set(F.unix_date("target_ds")))
    return targets.groupBy("series_id").agg(days.alias("targets"))


TARGETS_PER_TASK = 64


def deal(packed: DataFrame) -> DataFrame:
    """Split the targets of a packed series over several rows, each with the whole series,
    so that a series with many targets is worked on by many tasks."""
    first = F.explode(F.sequence(F.lit(1), F.size("targets"), F.lit(TARGETS_PER_TASK)))
    parts = packed.withColumn("_first", first)
    parts = parts.withColumn("targets", F.slice("targets", F.col("_first"), F.lit(TARGETS_PER_TASK)))
    return spread(parts, "series_id", "_first").drop("_first")


def fit_each(
    h: DataFrame, targets: DataFrame, kernels_by_family: Sequence[tuple[Callable, str]],
    walks: Sequence[tuple[Callable, str]] = (),
) -> DataFrame:
    """Run kernels over the packed series that have targets; forecasts in long form.

    ``kernels_by_family`` work per target, so many targets of a series are dealt over
    tasks; ``walks`` serve all targets of a series by one walk over its days, which is
    made once.  Both read the same packed rows."""
    packed = pack(h, "y").join(pack_targets(targets), "series_id")
    parts = []
    if kernels_by_family:
        parts.append(deal(packed).mapInPandas(kernels.chained(list(kernels_by_family)), FORECAST))
    if walks:
        parts.append(packed.mapInPandas(kernels.chained(list(walks)), FORECAST))
    return as_predictions(reduce(DataFrame.unionByName, parts))


def as_predictions(out: DataFrame) -> DataFrame:
    return out.select(
        "series_id", F.date_from_unix_date("day").alias("target_ds"), "model", "yhat", "lo", "hi", "family"
    )
