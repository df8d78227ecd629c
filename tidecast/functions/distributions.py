"""Student-t quantiles and chi-square tails as column expressions.

The t table for small degrees of freedom is built once by inverting the
t distribution numerically; beyond it the Cornish-Fisher series is exact to
better than 1e-9.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

TABLE_DOF = 60


def _t_cdf(x: float, dof: int) -> float:
    """Closed form for whole degrees of freedom (Abramowitz & Stegun 26.7.3-4)."""
    theta = math.atan(x / math.sqrt(dof))
    cos2 = math.cos(theta) ** 2
    if dof % 2:
        term, total = math.cos(theta), 0.0
        for j in range(1, dof - 1, 2):
            total += term
            term *= cos2 * (j + 1) / (j + 2)
        inner = 2 / math.pi * (theta + math.sin(theta) * total)
    else:
        term, total = 1.0, 0.0
        for j in range(1, dof, 2):
            total += term
            term *= cos2 * j / (j + 1)
        inner = math.sin(theta) * total
    return 0.5 + inner / 2


def normal_quantile(p: float) -> float:
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if math.erfc(-mid / math.sqrt(2)) / 2 < p else (lo, mid)
    return (lo + hi) / 2


@lru_cache(maxsize=None)
def t_table(conf: float) -> tuple[float, ...]:
    """Two-sided quantiles for 1..TABLE_DOF degrees of freedom."""
    p, out = (1 + conf) / 2, []
    for dof in range(1, TABLE_DOF + 1):
        lo, hi = 0.0, 1e4
        for _ in range(200):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if _t_cdf(mid, dof) < p else (lo, mid)
        out.append((lo + hi) / 2)
    return tuple(out)


def t_series(conf: float) -> tuple[float, list[float]]:
    """Normal quantile z and the coefficients of 1/dof, 1/dof^2, ... around it."""
    z = normal_quantile((1 + conf) / 2)
    return z, [
        (z**3 + z) / 4,
        (5 * z**5 + 16 * z**3 + 3 * z) / 96,
        (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384,
        (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160,
    ]


def t_quantile(dof: Column, conf: float = 0.95) -> Column:
    """Two-sided t quantile for a whole number of degrees of freedom; null below 1."""
    z, coefs = t_series(conf)
    tail = F.lit(z)
    for power, c in enumerate(coefs, start=1):
        tail = tail + F.try_divide(F.lit(c), F.pow(dof.cast("double"), F.lit(float(power))))
    small = F.array(*[F.lit(v) for v in t_table(conf)])
    return F.when(dof.between(1, TABLE_DOF), F.get(small, dof.cast("int") - 1)).when(
        dof > TABLE_DOF, tail
    )


def chi2_tail_even(x: Column, dof: int) -> Column:
    """P(X > x) for an even number of degrees of freedom, a finite sum."""
    if dof % 2:
        raise ValueError("dof must be even")
    half = x / 2
    total = F.lit(1.0)
    for i in range(1, dof // 2):
        total = total + F.pow(half, F.lit(float(i))) / F.lit(float(math.factorial(i)))
    return F.exp(-half) * total
