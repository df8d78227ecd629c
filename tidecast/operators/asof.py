"""Strict as-of attach: the newest history row before each target date."""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import CALENDAR
from ..functions.columns import array_mean, by_day, prediction
from .packed import spread

# Helpers travel with the jobs that use them; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def asof_attach(state: DataFrame, targets: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Targets plus the columns of the last ``state`` row with ``ds < target_ds`` and
    equal ``keys``; targets with no earlier row keep nulls.

    Both sides are unioned and read in date order, targets ahead of history on the
    same day, so the cost is one sort and not a join on an inequality.  The whole row
    travels as one struct: a null inside it is not replaced by an older value.
    """
    part = ["series_id", *keys]
    carried = [c for c in state.columns if c not in part]
    history = state.select(
        *part,
        F.col("ds").alias("_at"),
        F.lit(1).alias("_side"),
        F.struct(*carried).alias("_state"),
    )
    wanted = targets.select(
        *part,
        F.col("target_ds").alias("_at"),
        F.lit(0).alias("_side"),
        F.struct(*[c for c in targets.columns if c not in part]).alias("_target"),
    )
    both = wanted.unionByName(history, allowMissingColumns=True)
    order = Window.partitionBy(*part).orderBy("_at", "_side")
    before = order.rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.withColumn("_state", F.last("_state", ignorenulls=True).over(before))
        .filter(F.col("_side") == 0)
        .select(*part, "_target.*", *[F.col(f"_state.{c}").alias(c) for c in carried])
    )


def eligible_targets(h: DataFrame, targets: DataFrame, min_obs: int = 14) -> DataFrame:
    """Targets with at least ``min_obs`` earlier days, with that count and the last day."""
    state = h.select("series_id", "ds", F.row_number().over(by_day()).alias("n_obs"))
    return (
        asof_attach(state, targets)
        .withColumnRenamed("ds", "last_ds")
        .filter(F.col("n_obs") >= min_obs)
    )


@dataclass(frozen=True)
class Recipe:
    """Forecasts that only need the last known day: ``state`` is evaluated for every
    history day; on the state of that day, ``derived`` values shared by several models
    and then the ``models`` (value, or value with bounds)."""

    family: str
    state: Mapping[str, Column]
    models: Mapping[str, Column | tuple[Column, Column, Column]]
    derived: Mapping[str, Column] = field(default_factory=dict)


def windows(family: str, models: Mapping[str, Column]) -> Recipe:
    """Recipe of forecasts that are plain windows."""
    return Recipe(family, models, {m: F.col(m) for m in models})


def forecast_asof(
    h: DataFrame, targets: DataFrame, recipes: Sequence[Recipe], keys: Sequence[str] = ()
) -> DataFrame:
    """Run any number of recipes in one pass over history; ``keys`` must be columns of both sides.  Models without a
    value leave no row, so neither does a target with no earlier day.

    The states are wide and wanted of few days.  So only days and values are sorted; targets between them mark the
    last day before each, and of the states worked out in the same order just those of marked days go on."""
    state: dict[str, Column] = {}
    for r in recipes:
        state |= r.state
    part = ["series_id", *keys]
    wanted = targets.select(*part, F.col("target_ds").alias("ds"), F.lit(0).alias("_side"))
    both = wanted.unionByName(h.withColumn("_side", F.lit(1)), allowMissingColumns=True)
    order = Window.partitionBy(*part).orderBy("ds", "_side")
    day = F.when(F.col("_side") == 1, F.col("ds"))
    marked = both.withColumns({
        "_next": F.lead("_side").over(order),
        "_last": F.last(day, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)),
    })
    known = marked.filter(F.col("_side") == 1).select(
        *part, F.col("ds").alias("_last"), "_next", *[c.alias(n) for n, c in state.items()]
    ).filter(F.col("_next") == 0).drop("_next")
    asked = marked.filter(F.col("_side") == 0).select(*part, F.col("ds").alias("target_ds"), "_last")
    return _modelled(asked.join(known, [*part, "_last"]), recipes)


def forecast_by_keys(
    h: DataFrame, targets: DataFrame, groups: Sequence[tuple[Sequence[str], Sequence[Recipe]]]
) -> DataFrame:
    """Recipes of several sets of keys in one pass: ``h`` and ``targets`` have all key
    columns, both are put together once per series, and each set of keys takes its last
    known day by a sort of its own within the series.  State names must differ."""
    every = list(dict.fromkeys(k for keys, _ in groups for k in keys))
    states = [{n: c for r in recipes for n, c in r.state.items()} for _, recipes in groups]
    packs = [F.struct(*[c.alias(n) for n, c in s.items()]).alias(f"_state{i}") for i, s in enumerate(states)]
    known = h.select("series_id", *every, F.col("ds").alias("_at"), F.lit(1).alias("_side"), *packs)
    wanted = targets.select("series_id", *every, F.col("target_ds").alias("_at"), F.lit(0).alias("_side"))
    # One exchange by series serves the windows of all keys.
    at = wanted.unionByName(known, allowMissingColumns=True).repartition("series_id")
    for i, (keys, _) in enumerate(groups):
        before = Window.partitionBy("series_id", *keys).orderBy("_at", "_side").rowsBetween(Window.unboundedPreceding, 0)
        at = at.withColumn(f"_state{i}", F.last(f"_state{i}", ignorenulls=True).over(before))
    at = at.filter(F.col("_side") == 0).select(
        "series_id", F.col("_at").alias("target_ds"),
        *[F.col(f"_state{i}.{n}").alias(n) for i, s in enumerate(states) for n in s],
    )
    return _modelled(at, [r for _, recipes in groups for r in recipes])


def forecast_packed(
    packed: DataFrame, recipes: Sequence[Recipe], means: Mapping[str, Sequence[str]] = {}, back: Mapping[str, int] = {}
) -> DataFrame:
    """Forecasts of few targets from one row per series, with its ``rows`` (structs of ``ds`` and ``y`` in date order) and
    ``targets`` (dates), so that no day is sorted or moved again for a model.

    The state of the ``recipes`` is the last values alone (``recent_values``); ``means`` are of the known days that share
    the target's calendar keys, ``back`` looks up the day so many days before the target."""
    at = packed.select("series_id", "rows", F.explode("targets").alias("target_ds"))
    known = at.withColumn("_known", F.filter("rows", lambda r: r["ds"] < F.col("target_ds")))
    n, derived, models = F.size("_known"), {}, {}
    for tail in {name for r in recipes for name in r.state}:
        size = int(tail.removeprefix("_tail"))
        derived[tail] = F.when(n > 0, F.slice("_known", F.greatest(n - size + 1, F.lit(1)), F.lit(size))["y"])
    # Fewer keys first: days found for some keys are looked through for more.
    def on(keys: Sequence[str]):
        return lambda r: reduce(lambda a, b: a & b, [CALENDAR[k](r["ds"]) == CALENDAR[k](F.col("target_ds")) for k in keys])

    seen: dict[tuple[str, ...], str] = {(): "_known"}
    steps = [derived]
    for model, keys in sorted(means.items(), key=lambda m: len(m[1])):
        base = max((k for k in seen if set(k) <= set(keys)), key=len)
        name = f"_days{len(seen)}"
        steps.append({name: F.filter(seen[base], on([k for k in keys if k not in base]))})
        seen[tuple(keys)], models[model] = name, array_mean(F.col(name)["y"])
    for step in steps:
        known = known.withColumns(step) if step else known
    # The days are in order, and one row each.
    years = {m: F.get("_known.y", F.array_position("_known.ds", F.date_sub("target_ds", d)).cast("int") - 1) for m, d in back.items()}
    return _modelled(known, [*recipes, Recipe("seasonal", {}, models), Recipe("previous_year", {}, years)])


#: Calendar keys of days since 1970, as ``CALENDAR`` has them for dates.
NUMBERS = {
    "weekday": lambda day: (day + 3) % 7,
    "month": lambda day: day.astype("datetime64[D]").astype("datetime64[M]").astype(np.int64) % 12 + 1,
    "year": lambda day: day.astype("datetime64[D]").astype("datetime64[Y]").astype(np.int64) + 1970,
}
#: Days a task looks at together.
CHUNK = 262_144


def forecast_dates(
    h: DataFrame, dates: Sequence[dt.date], recipes: Sequence[Recipe], means: Mapping[str, Sequence[str]] = {},
    back: Mapping[str, int] = {},
) -> DataFrame:
    """Forecasts of the same few dates for every series, one row per series and date with its ``models`` (a list of
    structs); models without a value are left out, and so are dates without a model.

    Parameters as in ``forecast_packed``, keys being those of ``NUMBERS``.  The days are dealt and gathered by series
    once, in any order; a task takes some whole series at a time, sorts their days as numbers and finds the last values,
    the means and the looked-up days of all dates on whole columns."""
    tails = sorted({int(n.removeprefix("_tail")) for r in recipes for n in r.state})
    wanted = np.array([(x - dt.date(1970, 1, 1)).days for x in dates], np.int64)
    rows = spread(h.filter(F.col("y").isNotNull()).select("series_id", F.struct(F.unix_date("ds").alias("day"), "y").alias("r")), "series_id")
    lists = [f"_tail{n} array<double>" for n in tails]
    values = [f"{c}{i} double" for c, names in (("_mean", means), ("_back", back)) for i in range(len(names))]
    at = rows.groupBy("series_id").agg(F.collect_list("r").alias("rows")).mapInArrow(
        _known_before(wanted, tails, list(means.values()), list(back.values())),
        ", ".join([f"series_id {h.schema['series_id'].dataType.simpleString()}", "target_ds date", *lists, *values]))
    models = [
        Recipe("seasonal", {}, {m: F.col(f"_mean{i}") for i, m in enumerate(means)}),
        Recipe("previous_year", {}, {m: F.col(f"_back{i}") for i, m in enumerate(back)}),
    ]
    every = F.filter(F.array(*_structs([*recipes, *models])), lambda m: m["yhat"].isNotNull())
    # Generated, so that the filter does not work the models out anew.
    at = _derived(at, recipes).select("series_id", "target_ds", F.explode(F.array(every)).alias("models"))
    return at.filter(F.size("models") > 0)


def one_by_one(gathered: DataFrame) -> DataFrame:
    """The long form of ``forecast_dates``: a row per series, date and model."""
    return gathered.select("series_id", "target_ds", F.explode("models").alias("_p")).select("series_id", "target_ds", "_p.*")


def _known_before(wanted: np.ndarray, tails: Sequence[int], means: Sequence[Sequence[str]], back: Sequence[int]):
    """Per series and wanted day with an earlier one: the last values, means of the days of the same keys, values so many
    days back."""

    def states(series: pa.Array, rows: pa.ListArray) -> pa.RecordBatch:
        size = np.diff(rows.offsets.to_numpy())
        some, each = len(series), rows.flatten()
        day, y = each.field(0).to_numpy().astype(np.int64), each.field(1).to_numpy(zero_copy_only=False)
        # One number in the order of series and days; days are within 32 bits of 1970.
        number = lambda of, d: (of << 33) + d + (1 << 32)
        key = number(np.repeat(np.arange(some), size), day)
        if not (key[1:] > key[:-1]).all():
            order = np.argsort(key)
            key, day, y = key[order], day[order], y[order]
        at = number(np.arange(some)[:, None], wanted).ravel()
        end, first = np.searchsorted(key, at), np.repeat(np.cumsum(size) - size, len(wanted))
        kept = np.flatnonzero(end > first)
        end, first, then = end[kept], first[kept], at[kept]
        target = kept % len(wanted)
        out = [series.take(pa.array(kept // len(wanted))), pa.array(wanted[target].astype(np.int32)).cast(pa.date32())]
        for n in tails:
            length = np.minimum(end - first, n)
            offsets = np.concatenate(([0], np.cumsum(length)))
            place = np.arange(offsets[-1]) + np.repeat(end - offsets[1:], length)
            out.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(y[place])))
        parts = {k: NUMBERS[k](day) for keys in means for k in keys}
        of = np.repeat(np.arange(some), size)
        for keys in means:
            total, count = np.zeros((some, len(wanted))), np.zeros((some, len(wanted)), np.int64)
            for i, d in enumerate(wanted):
                same = reduce(np.logical_and, [parts[k] == NUMBERS[k](wanted[i:i + 1]) for k in keys], day < d)
                on = np.flatnonzero(same)
                # Added up in the order of days.
                total[:, i], count[:, i] = np.bincount(of[on], y[on], some), np.bincount(of[on], minlength=some)
            total, count = total.ravel()[kept], count.ravel()[kept]
            out.append(pa.array(total / np.maximum(count, 1), mask=count == 0))
        for days in back:
            place = np.minimum(np.searchsorted(key, then - days), len(key) - 1)
            out.append(pa.array(y[place], mask=key[place] != then - days))
        columns = [f"_tail{n}" for n in tails] + [f"_mean{i}" for i in range(len(means))] + [f"_back{i}" for i in range(len(back))]
        return pa.RecordBatch.from_arrays(out, names=["series_id", "target_ds", *columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            series, rows = batch.column("series_id"), batch.column("rows")
            ends, first = rows.offsets.to_numpy()[1:], 0
            while first < len(series):
                before = rows.offsets[first].as_py()
                last = max(int(np.searchsorted(ends, before + CHUNK, "right")), first + 1)
                yield states(series.slice(first, last - first), rows.slice(first, last - first))
                first = last

    return run


def _derived(at: DataFrame, recipes: Sequence[Recipe]) -> DataFrame:
    derived = {n: c for r in recipes for n, c in r.derived.items()}
    return at.withColumns(derived) if derived else at


def _structs(recipes: Sequence[Recipe]) -> list[Column]:
    return [
        F.struct(*prediction(m, *((v[0], r.family, v[1], v[2]) if isinstance(v, tuple) else (v, r.family))))
        for r in recipes for m, v in r.models.items()
    ]


def _modelled(at: DataFrame, recipes: Sequence[Recipe]) -> DataFrame:
    """The recipes' models on the attached states, in long form."""
    long = _derived(at, recipes).select("series_id", "target_ds", F.explode(F.array(*_structs(recipes))).alias("_p"))
    return long.select("series_id", "target_ds", "_p.*").filter(F.col("yhat").isNotNull())


def lookup(h: DataFrame, targets: DataFrame) -> DataFrame:
    """The history row at exactly the target date."""
    return targets.join(h.withColumnRenamed("ds", "target_ds"), ["series_id", "target_ds"])
