"""pandas and numpy give the same numbers."""

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidecast.functions import distributions, kernels
from tidecast.operators import baselines, diagnostics, features, lagreg, smoothing


@pytest.fixture(scope="module")
def frame(two_years):
    return two_years.filter("series_id = 'a'").toPandas().sort_values("ds").reset_index(drop=True)


def collected(df, *cols):
    return df.filter("series_id = 'a'").orderBy("ds").select(*cols).toPandas()


def test_rolling_and_median(two_years, frame):
    got = collected(features.rolling(two_years, (3, 30), ("mean", "std", "min", "max", "median")), "*")
    past = frame.y.shift(1)
    for n in (3, 30):
        for s in ("mean", "std", "min", "max", "median"):
            want = getattr(past.rolling(n, min_periods=1), s)()
            np.testing.assert_allclose(got[f"rolling_{s}_{n}"].astype(float), want, rtol=1e-9, atol=1e-9)


@pytest.mark.parametrize("adjust", [True, False])
def test_exponential_means_across_blocks(two_years, frame, adjust):
    spans = (3, 30, 200)
    got = collected(features.ema(two_years, spans, adjust), *[f"ema_{s}" for s in spans])
    for s in spans:
        want = frame.y.shift(1).ewm(span=s, adjust=adjust).mean()
        np.testing.assert_allclose(got[f"ema_{s}"].astype(float), want, rtol=1e-12)


def test_block_lengths_stay_finite():
    for size, group in features._block_groups([2, 3, 30, 365, 5000]):
        assert all(size * -math.log(features._decay(s)) < 700 for s in group)


def test_profile(two_years, frame):
    got = diagnostics.profile(two_years).filter("series_id = 'a'").first()
    assert got.skew == pytest.approx(frame.y.skew(), rel=1e-9)
    assert got.kurtosis == pytest.approx(frame.y.kurtosis(), rel=1e-9)
    assert got["median"] == pytest.approx(frame.y.median())


def test_t_quantiles_known_values():
    table = distributions.t_table(0.95)
    for dof, want in ((1, 12.706205), (2, 4.302653), (3, 3.182446), (7, 2.364624), (30, 2.042272), (60, 2.000298)):
        assert table[dof - 1] == pytest.approx(want, abs=1e-6)


def test_t_series_beyond_table(spark):
    got = spark.range(1).select(distributions.t_quantile(F.lit(120)).alias("a"), distributions.t_quantile(F.lit(61)).alias("b"),
                                distributions.t_quantile(F.lit(0)).alias("c")).first()
    assert got.a == pytest.approx(1.979930, abs=1e-6)
    assert got.b == pytest.approx(1.999624, abs=1e-6)
    assert got.c is None


def test_unit_root_tells_walk_from_noise():
    rng = np.random.default_rng(0)
    noise = rng.normal(size=500)
    assert kernels.adf_p_value(kernels.unit_root(noise)[0]) < 0.01
    assert kernels.adf_p_value(kernels.unit_root(np.cumsum(noise))[0]) > 0.05
    assert kernels.adf_p_value(-2.86) == pytest.approx(0.05, abs=0.002)
    assert kernels.adf_p_value(-3.43) == pytest.approx(0.01, abs=0.001)
    # both response surfaces meet where they are joined
    assert kernels.adf_p_value(-1.6099) == pytest.approx(kernels.adf_p_value(-1.6101), abs=2e-3)


def test_arma_recovers_its_own_process():
    rng, n = np.random.default_rng(1), 5000
    e, z = rng.normal(size=n), np.zeros(n)
    for t in range(1, n):
        z[t] = 0.6 * z[t - 1] + e[t] + 0.4 * e[t - 1]
    got = kernels.hannan_rissanen(z, [1], [1], True)
    assert got == pytest.approx(0.6 * z[-1] + 0.4 * e[-1], abs=0.15)


def test_differences_undo():
    y = np.arange(40.0) ** 2
    z, back = kernels.difference(y, 1, 7)
    nxt = (40.0**2 - 33.0**2) - (39.0**2 - 32.0**2)
    assert z[-1] + back != 0 and nxt + back == pytest.approx(40.0**2)


def test_fourier_equals_least_squares(two_years, frame, wanted):
    target = dt.date(2020, 11, 2)
    got = lagreg.fourier_forecast(two_years, wanted(("a", target), ("a", dt.date(2020, 6, 1))), 3, 2)
    got = got.filter(F.col("target_ds") == target).first()
    past = frame[frame.ds < target]
    days = np.array([(d - dt.date(1970, 1, 1)).days for d in past.ds])
    x = kernels.fourier_design(days, days[0], 3, 2)
    beta = np.linalg.lstsq(x, past.y.to_numpy(), rcond=None)[0]
    now = np.array([(target - dt.date(1970, 1, 1)).days])
    want = (kernels.fourier_design(now, days[0], 3, 2) @ beta)[0]
    sd = np.sqrt(np.sum((past.y - x @ beta) ** 2) / (len(past) - x.shape[1]))
    assert got.yhat == pytest.approx(want, rel=1e-6)
    assert got.hi - got.yhat == pytest.approx(1.96 * sd, rel=1e-6)


def _design(past, target):
    """Training matrix and serving row of the lag regression, straight from its definition."""
    def row(day, i, values):
        return [day.weekday(), day.month, (day.day - 1) // 7 + 1, day.timetuple().tm_yday, i,
                values[i - 1], values[i - 7], values[i - 14]]

    y, days = past.y.to_numpy(), list(past.ds)
    x = np.array([row(days[i], i, y) for i in range(14, len(y))], dtype=float)
    return x, y[14:], np.array(row(target, len(y), y), dtype=float)


def test_lag_regression_ridge_bayes_huber(two_years, frame, wanted):
    target = dt.date(2020, 10, 5)
    got = {r.model: r for r in lagreg.lag_regression(two_years, wanted(("a", target))).collect()}
    x, y, x0 = _design(frame[frame.ds < target], target)
    mean, sd = x.mean(axis=0), x.std(axis=0)
    xs, z = (x - mean) / sd, (x0 - mean) / sd
    w = np.linalg.solve(xs.T @ xs + np.eye(8), xs.T @ (y - y.mean()))
    assert got["Ridge_Regression"].yhat == pytest.approx(z @ w + y.mean(), rel=1e-8)
    # Bayesian ridge is a ridge fit whose penalty is the ratio of its two precisions
    bw, cov, noise, settled = kernels.bayes_ridge(xs.T @ xs, xs.T @ (y - y.mean()), np.sum((y - y.mean()) ** 2), len(y))
    assert got["BayesRidge"].yhat == pytest.approx(z @ bw + y.mean(), rel=1e-8)
    assert noise == pytest.approx(np.var(y - y.mean() - xs @ bw), rel=0.05)
    assert got["BayesRidge"].hi - got["BayesRidge"].yhat == pytest.approx(1.96 * np.sqrt(z @ cov @ z + noise), rel=1e-6)
    # the Huber fit is a minimum of its joint objective
    assert settled
    beta, sigma, settled = kernels.huber(xs, y)
    assert settled

    def loss(b, s):
        r = np.abs(y - xs @ b[:-1] - b[-1]) / s
        h = np.where(r <= 1.35, r**2, 2 * 1.35 * r - 1.35**2)
        return np.sum(s + h * s) + 1e-4 * np.sum(b[:-1] ** 2)

    best, rng = loss(beta, sigma), np.random.default_rng(0)
    for _ in range(50):
        assert loss(beta + rng.normal(0, 0.05, 9), sigma * (1 + rng.normal(0, 0.01))) >= best - 1e-6
    assert got["Huber_Regression"].yhat == pytest.approx(z @ beta[:-1] + beta[-1], rel=1e-5)


def test_density_mode(two_years, frame, wanted):
    from tidecast.operators import estimates

    target = dt.date(2020, 10, 5)
    got = estimates.kde_mode(two_years, wanted(("a", target))).first().yhat
    v = np.array([y for d, y in zip(frame.ds, frame.y) if d < target and d.weekday() == target.weekday()])
    x = np.linspace(v.min(), v.max(), 1000)
    bw = v.std(ddof=1) * len(v) ** -0.2
    want = x[np.argmax([np.exp(-0.5 * ((g - v) / bw) ** 2).sum() for g in x])]
    assert got == pytest.approx(want)


def test_smoothing_matches_plain_loop(two_years, frame, wanted):
    target = dt.date(2020, 6, 1)
    y = frame[frame.ds < target].y.to_numpy()
    best = (np.inf, None)
    for a, b, _, phi in smoothing.KINDS["damped"][2]:
        level, slope, sse = y[1], y[1] - y[0], 0.0
        for v in y[2:]:
            f = level + phi * slope
            sse += (v - f) ** 2
            new = a * v + (1 - a) * f
            slope, level = b * (new - level) + (1 - b) * phi * slope, new
        best = min(best, (sse, level + phi * slope), key=lambda p: p[0])
    got = smoothing.smooth(two_years, wanted(("a", target)), "damped").first().yhat
    assert got == pytest.approx(best[1], rel=1e-10)


def test_growth_and_leap_day(make, wanted):
    days = pd.date_range("2019-01-01", "2021-03-10")
    h = make({"a": [(d.date(), 100.0 if d.year == 2019 else 120.0 if d.year == 2020 else 180.0) for d in days]})
    t = wanted(("a", dt.date(2020, 12, 31)), ("a", dt.date(2021, 3, 1)))
    same = {r.target_ds: r.yhat for r in baselines.prev_year_same_day(h, t).collect()}
    assert same[dt.date(2020, 12, 31)] == 120.0  # 365 days before, across Feb 29, is Jan 1 2020
    grown = {r.target_ds: r.yhat for r in baselines.prev_year_growth(h, t).collect()}
    assert grown[dt.date(2021, 3, 1)] == pytest.approx(120.0 * 1.3)  # 1.5 clipped
