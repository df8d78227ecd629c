"""Lag, rolling, exponential and group features.

All row-based windows share one partitioning (``series_id``) and order (``ds``), so
Spark plans them behind a single shuffle; extra keys only cost a local sort.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import array_median, by_day, last_of
from .packed import spread

# Helpers travel with the jobs that use them; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

ROLLING = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}


def lags(h: DataFrame, ns: Sequence[int], ahead: int = 0) -> DataFrame:
    """Values ``n`` rows back.  With ``ahead=1`` each row gets what the row after it
    would see, which is the state a forecast starts from."""
    w = by_day()
    return h.withColumns({f"lag_{n}": F.lag("y", n - ahead).over(w) for n in ns})


def rolling(
    h: DataFrame,
    windows: Sequence[int],
    stats: Sequence[str] = ("mean", "std", "min", "max"),
    min_periods: int | None = 1,
    ahead: int = 0,
) -> DataFrame:
    """Statistics of the previous ``n`` rows; ``min_periods=None`` asks for a full window.

    Medians of all window lengths are taken from one list of the longest window, which
    costs a fraction of an exact percentile per frame.
    """
    out, medians = {}, {}
    for n in windows:
        frame = by_day().rowsBetween(ahead - n, ahead - 1)
        need = n if min_periods is None else min_periods

        def known(value, count):
            return F.when(count >= need, value) if need > 1 else value

        for s in stats:
            if s == "median":
                tail = last_of(F.col("_tail"), n)
                medians[f"rolling_median_{n}"] = known(array_median(tail), F.size(tail))
            else:
                out[f"rolling_{s}_{n}"] = known(ROLLING[s](F.col("y")).over(frame), F.count("y").over(frame))
    if medians:
        # taken first and dropped, so that the lists do not travel through the other windows
        longest = by_day().rowsBetween(ahead - max(windows), ahead - 1)
        h = h.withColumn("_tail", F.collect_list("y").over(longest)).withColumns(medians).drop("_tail")
    return h.withColumns(out)


def _frames(windows: Sequence[int], stats: Sequence[str], need: Mapping[int, int], y: np.ndarray, known: np.ndarray, place: np.ndarray) -> list:
    """Statistics of the values before each of the last ``len(place)`` rows; ``place`` counts its series' rows before it."""
    first, out = len(y) - len(place), {}

    def back(k: int) -> tuple[np.ndarray, np.ndarray]:
        """Values ``k`` rows back and which of them there are."""
        at = np.maximum(np.arange(first - k, len(y) - k), 0)
        return y[at], (place >= k) & known[at]

    n, total = np.zeros(len(place), np.int64), np.zeros(len(place))
    least, most = np.full(len(place), np.nan), np.full(len(place), -np.inf)
    for k in range(1, max(windows) + 1):
        v, has = back(k)
        n, total = n + has, total + np.where(has, v, 0.0)
        least, most = np.fmin(least, np.where(has, v, np.nan)), np.maximum(most, np.where(has, v, -np.inf))
        if k in windows:
            enough = n >= max(need[k], 1)
            mean = total / np.maximum(n, 1)
            out[k] = {"mean": (mean, enough), "min": (least, enough), "max": (most, enough)}
            if "std" in stats:
                spread = np.zeros(len(place))
                for j in range(1, k + 1):
                    v, has = back(j)
                    spread += np.where(has, (v - mean) ** 2, 0.0)
                out[k]["std"] = np.sqrt(spread / np.maximum(n - 1, 1)), enough & (n > 1)
    return [pa.array(out[w][s][0], mask=~out[w][s][1]) for w in windows for s in stats]


def rolling_apart(
    h: DataFrame, windows: Sequence[int], stats: Sequence[str] = ("mean", "std", "min", "max"), min_periods: int | None = 1
) -> DataFrame:
    """``rolling`` of whole columns of sorted days, a batch at a time with the longest window before it: for many long
    windows a small part of the work, but windows that follow have to deal and sort the rows again."""
    need = {n: n if min_periods is None else min_periods for n in windows}
    rows = spread(h, "series_id").sortWithinPartitions("series_id", "ds")
    names = [f"rolling_{s}_{n}" for n in windows for s in stats]
    keep, columns = max(windows), h.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, known, last, before = np.empty(0), np.empty(0, bool), None, 0
        for batch in filter(lambda b: b.num_rows, batches):
            column, series = batch.column(columns.index("y")), batch.column(columns.index("series_id"))
            y = np.concatenate((y, column.fill_null(0.0).to_numpy(zero_copy_only=False)))
            known = np.concatenate((known, column.is_valid().to_numpy(zero_copy_only=False)))
            # Rows of a series follow each other: a row's place counts from the first of its run.
            code = series.dictionary_encode().indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
            place = np.arange(len(code)) - np.repeat(starts, np.diff(np.append(starts, len(code))))
            if series[0].as_py() == last:
                place[: starts[1] if len(starts) > 1 else len(code)] += before
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *_frames(windows, stats, need, y, known, place)], names=[*columns, *names]
            )
            last, before, y, known = series[-1].as_py(), int(place[-1]) + 1, y[-keep:], known[-keep:]

    schema = T.StructType([*h.schema.fields, *(T.StructField(c, T.DoubleType()) for c in names)])
    return rows.mapInArrow(run, schema)


def _decay(span: int) -> float:
    return 1.0 - 2.0 / (span + 1.0)


def _block_groups(spans: Sequence[int]) -> list[tuple[int, list[int]]]:
    """Group spans that can share a block length: long enough that weights older than
    a block vanish in double precision, short enough that ``q**-length`` is finite."""
    groups: list[tuple[int, list[int]]] = []
    for span in sorted(set(spans), reverse=True):
        if span <= 1:
            raise ValueError("span must be above 1")
        q = _decay(span)
        if groups and groups[-1][0] * -math.log(q) < 600:
            groups[-1][1].append(span)
        else:
            groups.append((math.ceil(37 / -math.log(q)), [span]))
    return groups


def exponential_mean(h: DataFrame, spans: Sequence[int], adjust: bool, prefix: str) -> DataFrame:
    """Exponentially weighted mean up to and including each row.

    The recursion is linear, so it is taken in blocks of rows: inside a block a running
    sum of ``y * q**-j`` scaled back by ``q**j``, plus the decayed total at the end of
    the block before (older blocks weigh less than 1e-16).  Every frame is a running
    sum, O(1) per row, with no array and no per-row loop.
    """
    w = by_day()
    out = h.withColumn("_i", F.row_number().over(w) - 1)
    for size, group in _block_groups(spans):
        block = Window.partitionBy("series_id", "_b").orderBy("ds")
        running = block.rowsBetween(Window.unboundedPreceding, 0)
        earlier = w.rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumns(
            {"_b": F.floor(F.col("_i") / size), "_j": (F.col("_i") % size).cast("double")}
        )
        inside, total = {}, {}
        for span in group:
            q = F.lit(_decay(span))
            # without adjustment the first row stands for all of the past
            x = F.col("y") if adjust else F.when(
                F.col("_i") == 0, F.col("y") * ((span + 1.0) / 2.0)
            ).otherwise(F.col("y"))
            inside[f"_in{span}"] = F.sum(x * F.pow(q, -F.col("_j"))).over(running) * F.pow(q, F.col("_j"))
        out = out.withColumns(inside)
        ends = {
            f"_end{span}": F.last(
                F.when(F.col("_j") == size - 1, F.col(f"_in{span}")), ignorenulls=True
            ).over(earlier)
            for span in group
        }
        out = out.withColumns(ends)
        for span in group:
            q = F.lit(_decay(span))
            full = F.col(f"_in{span}") + F.coalesce(F.col(f"_end{span}"), F.lit(0.0)) * F.pow(
                q, F.col("_j") + 1
            )
            total[f"{prefix}{span}"] = (
                full * (1.0 - _decay(span)) / (1.0 - F.pow(q, (F.col("_i") + 1).cast("double")))
                if adjust
                else full * (2.0 / (span + 1.0))
            )
        out = out.withColumns(total).drop("_b", "_j", *inside, *ends)
    return out.drop("_i")


def ema(h: DataFrame, spans: Sequence[int], adjust: bool, prefix: str = "ema_", ahead: int = 0) -> DataFrame:
    """Exponentially weighted mean of the rows before each row."""
    out = exponential_mean(h, spans, adjust, prefix)
    if ahead:
        return out
    w = by_day()
    return out.withColumns({f"{prefix}{s}": F.lag(f"{prefix}{s}").over(w) for s in spans})


def diff(h: DataFrame, ns: Sequence[int]) -> DataFrame:
    w = by_day()
    return h.withColumns({f"diff_{n}": F.col("y") - F.lag("y", n).over(w) for n in ns})


def pct_change(h: DataFrame, ns: Sequence[int]) -> DataFrame:
    """Relative change; null where the earlier value is zero."""
    w = by_day()
    return h.withColumns(
        {f"pct_change_{n}": F.try_divide(F.col("y"), F.lag("y", n).over(w)) - 1 for n in ns}
    )


def group_stat(h: DataFrame, keys: Sequence[str], stats: Sequence[str] = ("mean",)) -> DataFrame:
    """Statistics of all rows of the series that share ``keys`` (includes the row itself)."""
    g = Window.partitionBy("series_id", *keys)
    name = "_".join(keys)
    return h.withColumns({f"{name}_{s}": ROLLING[s](F.col("y")).over(g) for s in stats})


def same_weekday_mean(h: DataFrame, n: int = 4) -> DataFrame:
    """Mean of the previous ``n`` values on the same weekday."""
    frame = Window.partitionBy("series_id", F.weekday("ds")).orderBy("ds").rowsBetween(-n, -1)
    return h.withColumn("same_weekday_mean", F.avg("y").over(frame))
