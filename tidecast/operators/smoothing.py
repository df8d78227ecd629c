"""Exponential smoothing: the grid point with the least squared one-step error wins.

The objective is ours to state: start values come from the first days of the series,
parameters from a fixed grid, and ties go to the earlier grid point.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np
from pyspark.sql import DataFrame

from ..functions import kernels
from .packed import fit_each

FINE = [round(0.1 * i, 1) for i in range(1, 10)]
COARSE = [0.1, 0.3, 0.5, 0.7, 0.9]
# kind: model name, least rows, grid of (level, trend, season, damping)
KINDS = {
    "ses": ("ExpSmooth_Simple", 3, list(product([round(0.05 * i, 2) for i in range(1, 20)], [0.0], [0.0], [0.0]))),
    "holt": ("ExpSmooth_Holt", 5, list(product(FINE, FINE, [0.0], [1.0]))),
    "damped": ("ExpSmooth_Damped", 5, list(product(COARSE, COARSE, [0.0], [0.8, 0.9, 0.98]))),
    "hw_add": ("HoltWinters_Add", 14, list(product(COARSE, COARSE, COARSE, [1.0]))),
    "hw_mul": ("HoltWinters_Mul", 14, list(product(COARSE, COARSE, COARSE, [1.0]))),
}


def smooth_kernel(kind: str, period: int = 7) -> tuple[Callable, str]:
    model, least, grid = KINDS[kind]
    least = max(least, 2 * period if kind.startswith("hw") else 0)
    return kernels.smoothing(kind, model, np.array(grid), period, least), "smoothing"


def smooth(h: DataFrame, targets: DataFrame, kind: str, period: int = 7) -> DataFrame:
    """``ses``, ``holt``, ``damped``, ``hw_add`` or ``hw_mul``; history strictly before
    each target, all targets of a series served by one walk over its days."""
    return fit_each(h, targets, [], walks=[smooth_kernel(kind, period)])
