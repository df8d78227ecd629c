"""Estimates from the recent or same-weekday values of a target: density mode, resampling."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from .asof import Recipe, forecast_asof
from .baselines import TAIL, last_values, recent_values
from .packed import fit_each


def kde_kernel(points: int = 1000, least: int = 5) -> tuple[Callable, str]:
    return kernels.density_mode(points, least), "estimate"


def kde_mode(h: DataFrame, targets: DataFrame, points: int = 1000, least: int = 5) -> DataFrame:
    """Most likely value among the earlier days on the target's weekday (five or more)."""
    return fit_each(h, targets, [kde_kernel(points, least)])


def bootstrap_recipe(rounds: int = 1000, recent: int = 30, seed: int = 42) -> Recipe:
    """Mean and 2.5/97.5 percentiles of ``rounds`` resampled means of the last days.

    Positions come from a fixed generator, so a rerun or a retried task draws the same.
    """
    draw, tail = F.pandas_udf(kernels.bootstrap(rounds, seed), "yhat double, lo double, hi double"), max(TAIL, recent)
    values = F.coalesce(last_values(recent, tail), F.array().cast("array<double>"))
    bounds = tuple(F.col(f"_drawn.{c}") for c in ("yhat", "lo", "hi"))
    return Recipe("estimate", recent_values(tail), {"Bootstrap_Mean": bounds}, {"_drawn": draw(values)})


def bootstrap(h: DataFrame, targets: DataFrame, rounds: int = 1000, recent: int = 30, seed: int = 42) -> DataFrame:
    return forecast_asof(h, targets, [bootstrap_recipe(rounds, recent, seed)])
