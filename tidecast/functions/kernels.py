"""Numeric helpers that run inside Arrow tasks.

Spark partitions, shuffles and orders the work; each helper gets the days and values of
some series as arrays (at most one value per calendar day) and returns plain rows.
"""

from __future__ import annotations

import datetime as dt
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle

# Ship these helpers with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SERIES_PER_BATCH = 64


def per_series(fn: Callable, columns: list[str]) -> Callable:
    """Wrap ``fn(row) -> list of tuples`` for ``mapInPandas`` over packed series."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(row.series_id, *out) for row in pdf.itertuples(index=False) for out in fn(row)]
            yield pd.DataFrame(rows, columns=["series_id", *columns])

    return run


def chained(fns: list[tuple[Callable, str]]) -> Callable:
    """Run several forecast kernels over the same packed series, naming each family."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for fn, family in fns:
                for out in fn(iter([pdf])):
                    yield out.reindex(columns=["series_id", "day", "model", "yhat", "lo", "hi"]).assign(family=family)

    return run


def padded(arrays: list, fill: float = np.nan) -> np.ndarray:
    """Arrays of different lengths as one matrix, one row per array."""
    out = np.full((len(arrays), max((len(a) for a in arrays), default=0)), fill)
    for i, a in enumerate(arrays):
        out[i, : len(a)] = a
    return out


# --- exponential smoothing over a parameter grid -------------------------------------


def smoothing_paths(kind: str, y: np.ndarray, grid: np.ndarray, period: int):
    """Walk all series and all grid points one day at a time; after each day yield the
    days used so far, the squared error so far and the next forecast, each (series, grid)."""
    a, b, g, phi = (grid[:, i] for i in range(4))
    shape = (y.shape[0], len(grid))

    def wide(v):
        return np.broadcast_to(np.asarray(v)[:, None], shape).astype(float)

    sse = np.zeros(shape)
    seasonal = kind.startswith("hw")
    if seasonal:
        first, second = y[:, :period].mean(axis=1), y[:, period : 2 * period].mean(axis=1)
        level, slope, start = wide(first), wide((second - first) / period), period
        season = [wide(y[:, i] - first if kind == "hw_add" else y[:, i] / first) for i in range(period)]
    elif kind == "ses":
        level, slope, start = wide(y[:, 0]), np.zeros(shape), 1
    else:
        level, slope, start = wide(y[:, 1]), wide(y[:, 1] - y[:, 0]), 2
    for t in range(start, y.shape[1] + 1):
        ahead = level + phi * slope
        if kind == "hw_add":
            forecast = ahead + season[t % period]
        elif kind == "hw_mul":
            forecast = ahead * season[t % period]
        else:
            forecast = ahead
        yield t, sse, forecast
        if t == y.shape[1]:
            return
        now = y[:, t : t + 1]
        sse = sse + (now - forecast) ** 2
        old = level
        if seasonal:
            s = season[t % period]
            level = a * (now - s if kind == "hw_add" else now / s) + (1 - a) * ahead
            season[t % period] = g * (now - level if kind == "hw_add" else now / level) + (1 - g) * s
        else:
            level = a * now + (1 - a) * ahead
        slope = b * (level - old) + (1 - b) * phi * slope


def smoothing(kind: str, model: str, grid: np.ndarray, period: int, min_obs: int) -> Callable:
    """For every target the forecast of the grid point with the least squared one-step
    error over the days before it.  One walk serves all targets of a series."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), SERIES_PER_BATCH):
                part = pdf.iloc[lo : lo + SERIES_PER_BATCH]
                part = part[[len(v) >= min_obs for v in part.y]]
                if len(part):
                    yield from chunk(part)

    def chunk(part):
        wanted: dict[int, list] = {}
        for i, (sid, days, tdays) in enumerate(zip(part.series_id, part.days, part.targets)):
            for day, n in zip(tdays, np.searchsorted(days, tdays)):
                if n >= min_obs:
                    wanted.setdefault(int(n), []).append((i, sid, int(day)))
        out = []
        for t, sse, forecast in smoothing_paths(kind, padded(list(part.y)), grid, period):
            for i, sid, day in wanted.get(t, ()):
                # a grid point that broke down has lost; without any other there is no forecast
                error = np.where(np.isfinite(sse[i]) & np.isfinite(forecast[i]), sse[i], np.inf)
                best = int(np.argmin(error))
                if np.isfinite(error[best]):
                    out.append((sid, day, model, float(forecast[i, best])))
        yield pd.DataFrame(out, columns=["series_id", "day", "model", "yhat"])

    return run


# --- regressions ---------------------------------------------------------------------


def least_squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Normal equations of a tall, narrow matrix, with a trace of ridge for flat series."""
    gram = x.T @ x
    return np.linalg.solve(gram + np.eye(len(gram)) * (1e-10 * np.trace(gram) + 1e-12), x.T @ y)


#: Lags of the first autoregression, and by how many it exceeds the deepest lag of the model.
LONG_LAGS, LONG_MORE = 10, 3


def hannan_rissanen(
    z: np.ndarray, ar_lags: list[int], ma_lags: list[int], const: bool, long_lags: int = LONG_LAGS
) -> float:
    """One-step forecast: residuals of an autoregression of ``long_lags`` lags (three more
    than the model's deepest, if that is longer), then one least-squares fit on lagged
    values and lagged residuals.  NaN when there are too few rows for either."""
    n, deepest = len(z), max([0, *ar_lags, *ma_lags])
    long = max(deepest + LONG_MORE, long_lags) if ma_lags else 0
    first = long + deepest
    if ma_lags and n - long < long + 1 + 5:
        return float("nan")
    if n - first < len(ar_lags) + len(ma_lags) + const + 5:
        return float("nan")
    resid = np.zeros(n)
    if ma_lags:
        past = np.column_stack([np.ones(n - long)] + [z[long - k : n - k] for k in range(1, long + 1)])
        resid[long:] = z[long:] - past @ least_squares(past, z[long:])

    def design(rows):
        cols = [z[rows - k] for k in ar_lags] + [resid[rows - k] for k in ma_lags]
        return np.column_stack(cols + ([np.ones(len(rows))] if const else []))

    beta = least_squares(design(np.arange(first, n)), z[first:])
    return float((design(np.array([n])) @ beta)[0])


def difference(y: np.ndarray, order: int, season: int) -> tuple[np.ndarray, float]:
    """Differenced series and what to add to its next value to get back to the level."""
    z, back = y, 0.0
    if season:
        back += z[-season]
        z = z[season:] - z[:-season]
    for _ in range(order):
        back += z[-1]
        z = np.diff(z)
    return z, back


def arma(specs: list[tuple[str, int, int, list, list]], min_obs: int) -> Callable:
    """``specs``: (model, differences, season, ar lags, ma lags)."""

    def fit(row):
        y, out = np.asarray(row.y), []
        for day, n in zip(row.targets, np.searchsorted(row.days, row.targets)):
            if n < min_obs:
                continue
            for model, order, season, ar, ma in specs:
                z, back = difference(y[:n], order, season)
                value = hannan_rissanen(z, ar, ma, const=order == 0 and not season)
                if np.isfinite(value):
                    out.append((int(day), model, value + back))
        return out

    return per_series(fit, ["day", "model", "yhat"])


def fourier_design(days: np.ndarray, origin: int, yearly: int, weekly: int) -> np.ndarray:
    cols = [np.ones(len(days)), (days - origin) / 365.25]
    for period, order in ((365.25, yearly), (7.0, weekly)):
        for k in range(1, order + 1):
            angle = 2 * np.pi * k * days / period
            cols += [np.sin(angle), np.cos(angle)]
    return np.column_stack(cols)


def fourier(yearly: int, weekly: int, model: str, min_obs: int) -> Callable:
    """Trend plus Fourier seasons by least squares with a +/-1.96 sigma band; the normal
    equations grow from target to target, so each history row is used once."""

    def fit(row):
        days, y = np.asarray(row.days), np.asarray(row.y)
        x = fourier_design(days, days[0], yearly, weekly)
        k, done, out = x.shape[1], 0, []
        gram, cross, square = np.zeros((k, k)), np.zeros(k), 0.0
        ridge = np.eye(k) * 1e-8
        for day, n in sorted(zip(row.targets, np.searchsorted(days, row.targets))):
            new, ynew = x[done:n], y[done:n]
            gram, cross, square = gram + new.T @ new, cross + new.T @ ynew, square + ynew @ ynew
            done = n
            if n < max(min_obs, k + 5):
                continue
            beta = np.linalg.solve(gram + ridge, cross)
            rss = max(square - 2 * beta @ cross + beta @ gram @ beta, 0.0)
            value = float((fourier_design(np.array([day]), days[0], yearly, weekly) @ beta)[0])
            half = 1.96 * np.sqrt(rss / (n - k))
            out.append((int(day), model, value, value - half, value + half))
        return out

    return per_series(fit, ["day", "model", "yhat", "lo", "hi"])


def bayes_ridge(gram, cross, square, n, rounds: int = 300, tol: float = 1e-3):
    """Evidence iteration on the normal equations of centred data: weights, their
    covariance, the noise variance and whether the iteration settled within ``rounds``,
    with flat 1e-6 gamma priors."""
    eig, vec = np.linalg.eigh(gram)
    eig, proj = np.maximum(eig, 0.0), vec.T @ cross
    noise, prior, weights, settled = n / max(square, 1e-12), 1.0, None, False
    for _ in range(rounds):
        new = vec @ (noise * proj / (noise * eig + prior))
        rss = max(square - 2 * new @ cross + new @ gram @ new, 0.0)
        used = np.sum(noise * eig / (noise * eig + prior))
        if weights is not None and np.abs(new - weights).sum() < tol:
            weights, settled = new, True
            break
        weights = new
        prior = (used + 2e-6) / (new @ new + 2e-6)
        noise = (n - used + 2e-6) / (rss + 2e-6)
    cov = (vec / (noise * eig + prior)) @ vec.T
    return weights, cov, 1.0 / noise, settled


def gram_entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sum of ``z z'`` over all rows of a task, as one row per matrix entry."""
    total = None
    for pdf in batches:
        if len(pdf):
            z = np.vstack(pdf.z.to_numpy())
            total = z.T @ z if total is None else total + z.T @ z
    if total is not None:
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": total.ravel()})


def huber(x, y, eps: float = 1.35, alpha: float = 1e-4, rounds: int = 500, tol: float = 1e-7):
    """Huber regression with a jointly estimated scale, by re-weighted least squares from
    the least-squares fit: weights (intercept last), scale and whether it settled."""
    x1 = np.column_stack([x, np.ones(len(y))])
    penalty = np.diag([alpha] * x.shape[1] + [0.0])
    beta, sigma = least_squares(x1, y), np.std(y)
    for _ in range(rounds):
        r = np.abs(y - x1 @ beta)
        inside = r <= eps * sigma
        left = max(len(y) - eps**2 * np.count_nonzero(~inside), 1e-3 * len(y))
        sigma = max(np.sqrt(r[inside] @ r[inside] / left), 1e-8)
        w = np.minimum(1.0, eps * sigma / np.maximum(r, 1e-12))
        xw = x1 * w[:, None]
        new = np.linalg.solve(xw.T @ x1 + penalty * sigma + 1e-10 * np.eye(len(beta)), xw.T @ y)
        moved, beta = np.abs(new - beta).max(), new
        if moved < tol * (1 + np.abs(beta).max()):
            return beta, sigma, True
    return beta, sigma, False


def lag_regression(kinds: list[str], min_rows: int) -> Callable:
    """Regressions on standardised features of each series, refitted before each target
    from a fresh start, so that no forecast depends on which others are asked for.  A fit
    that did not settle gives no row."""

    def fit(row):
        days, y, out = np.asarray(row.days), np.asarray(row.y), []
        x = np.asarray(row.x).reshape(len(days), -1)
        for target in sorted(row.targets, key=lambda t: t["day"]):
            day, x0 = target["day"], np.asarray(target["x"], dtype=float)
            n = int(np.searchsorted(days, day))
            if n < min_rows or np.isnan(x0).any():
                continue
            mean, sd, ymean = x[:n].mean(axis=0), x[:n].std(axis=0), y[:n].mean()
            sd = np.where(sd > 0, sd, 1.0)
            xs, yc, z = (x[:n] - mean) / sd, y[:n] - ymean, (x0 - mean) / sd
            gram, cross = xs.T @ xs, xs.T @ yc
            if "ridge" in kinds:
                w = np.linalg.solve(gram + np.eye(len(z)), cross)
                out.append((int(day), "Ridge_Regression", float(z @ w + ymean), None, None))
            if "bayes" in kinds:
                w, cov, noise, settled = bayes_ridge(gram, cross, yc @ yc, n)
                value, half = z @ w + ymean, 1.96 * np.sqrt(z @ cov @ z + noise)
                if settled:
                    out.append((int(day), "BayesRidge", float(value), float(value - half), float(value + half)))
            if "huber" in kinds:
                beta, _, settled = huber(xs, y[:n])
                if settled:
                    out.append((int(day), "Huber_Regression", float(z @ beta[:-1] + beta[-1]), None, None))
        return out

    return per_series(fit, ["day", "model", "yhat", "lo", "hi"])


# --- tests, densities, resampling ----------------------------------------------------

# Published response-surface coefficients of the unit-root test with a
# constant (MacKinnon 1994 p-values, 2010 critical values).
ADF_SMALL_P = (2.1659, 1.4412, 0.038269)
ADF_LARGE_P = (1.7339, 0.93202, -0.12745, -0.010368)
ADF_SPLIT, ADF_MIN, ADF_MAX = -1.61, -18.83, 2.74
ADF_CRIT_1 = (-3.43035, -6.5393, -16.786, -79.433)
ADF_CRIT_5 = (-2.86154, -2.8903, -4.234, -40.040)


def adf_p_value(tau: float) -> float:
    from math import erfc, sqrt

    if tau > ADF_MAX:
        return 1.0
    if tau < ADF_MIN:
        return 0.0
    coefs = ADF_SMALL_P if tau <= ADF_SPLIT else ADF_LARGE_P
    return erfc(-sum(c * tau**i for i, c in enumerate(coefs)) / sqrt(2)) / 2


def unit_root(y: np.ndarray) -> tuple[float, int, int]:
    """t statistic of the lagged level, lag order of least AIC and rows used."""
    n, dy = len(y), np.diff(y)
    most = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 3)

    def fit(lags, start):
        rows = np.arange(start, len(dy))
        x = np.column_stack([y[rows]] + [dy[rows - k] for k in range(1, lags + 1)] + [np.ones(len(rows))])
        target = dy[rows]
        inv = np.linalg.pinv(x.T @ x)
        beta = inv @ x.T @ target
        rss = max(np.sum((target - x @ beta) ** 2), 1e-300)
        aic = len(rows) * np.log(rss / len(rows)) + 2 * x.shape[1]
        se = np.sqrt(rss / (len(rows) - x.shape[1]) * inv[0, 0])
        return aic, (beta[0] / se if se > 0 else 0.0), len(rows)

    best = min(range(most + 1), key=lambda lags: fit(lags, most)[0])
    _, tau, rows = fit(best, best)
    return tau, best, rows


def adf(min_obs: int = 20) -> Callable:
    def fit(row):
        y = np.asarray(row.y)
        if len(y) < min_obs:
            return [(None, 0.0, None, None, None, True)]
        tau, lags, rows = unit_root(y)
        p = adf_p_value(tau)
        c1, c5 = (sum(c / rows**i for i, c in enumerate(cs)) for cs in (ADF_CRIT_1, ADF_CRIT_5))
        return [(float(tau), p, int(lags), c1, c5, bool(p < 0.05))]

    return per_series(fit, ["adf_stat", "p_value", "lags", "critical_1pct", "critical_5pct", "stationary"])


def density_mode(points: int, least: int) -> Callable:
    """Highest point of a Gaussian kernel density (Scott bandwidth) between the least and
    greatest earlier value on the target's weekday."""

    def mode(v):
        if len(v) < least or v.std(ddof=1) == 0:
            return None
        width = v.std(ddof=1) * len(v) ** -0.2
        x = np.linspace(v.min(), v.max(), points)
        return float(x[np.argmax(np.exp(-0.5 * ((x[:, None] - v) / width) ** 2).sum(axis=1))])

    def fit(row):
        days, y = np.asarray(row.days), np.asarray(row.y)
        found = ((day, mode(y[(days < day) & ((days - day) % 7 == 0)])) for day in row.targets)
        return [(int(day), "KDE_Mode", value) for day, value in found if value is not None]

    return per_series(fit, ["day", "model", "yhat"])


# The linear congruential generator of ANSI C.
LCG_A, LCG_C, LCG_M = 1103515245, 12345, 2**31


def resample_index(n: int, rounds: int, seed: int) -> np.ndarray:
    """(rounds, n) positions drawn with replacement, the same on every machine."""
    x = (np.arange(rounds * n, dtype=np.int64) + seed) % LCG_M
    for _ in range(3):
        x = (x * LCG_A + LCG_C) % LCG_M
        x = x ^ (x >> 15)
    return ((x >> 8) % n).reshape(rounds, n)


def bootstrap(rounds: int, seed: int) -> Callable:
    """Mean and outer percentiles of resampled means.  How often each position is drawn
    is the same for all targets with as many values, so a batch is one matrix product."""

    def drawn(n: int) -> np.ndarray:
        counts = np.zeros((rounds, n))
        np.add.at(counts, (np.arange(rounds)[:, None], resample_index(n, rounds, seed)), 1.0)
        return counts

    def run(values: pd.Series) -> pd.DataFrame:
        out = np.full((len(values), 3), np.nan)
        sizes = np.array([len(v) for v in values], dtype=int)
        for n in set(sizes.tolist()) - {0}:
            counts, rows = drawn(n), np.flatnonzero(sizes == n)
            for part in np.array_split(rows, 1 + len(rows) // 4096):
                means = np.vstack([values.iloc[i] for i in part]) @ counts.T / n
                out[part, 0] = means.mean(axis=1)
                out[part, 1], out[part, 2] = np.percentile(means, [2.5, 97.5], axis=1)
        return pd.DataFrame(out, columns=["yhat", "lo", "hi"]).astype(object).where(~np.isnan(out), None)

    return run


# --- best matches within a slice of time ---------------------------------------------


def slice_top_k(k: int, kind: str) -> Callable:
    """For each target the ``k`` best rows of one slice of its series, earlier rows first
    among equals: least weighted distance, or greatest correlation (0 for a flat run).
    Only those rows leave the task; pairs exist as a matrix of one slice at a time."""

    def unit(x):
        left = x - x.mean(axis=1, keepdims=True)
        norm = np.sqrt((left**2).sum(axis=1, keepdims=True))
        return np.where(norm > 1e-8, left / np.maximum(norm, 1e-8), 0.0)

    def scores(x, target, weight):
        if kind == "correlation":
            return -(unit(target) @ unit(x).T)
        square = np.zeros((len(target), len(x)))
        for c in range(x.shape[1]):
            square += ((target[:, c : c + 1] - x[:, c]) * weight[:, c : c + 1]) ** 2
        return np.sqrt(square)

    def fit(row):
        keys = np.asarray(row.key)
        x, v = (np.asarray(a).reshape(len(keys), -1) for a in (row.x, row.v))
        out = []
        for lo in range(0, len(row.targets), 1024):
            part = row.targets[lo : lo + 1024]
            score = scores(x, np.array([list(t["x"]) for t in part]), np.array([list(t["w"]) for t in part]))
            since, until = (np.array([t[c] for t in part])[:, None] for c in ("since", "until"))
            score = np.where((keys >= since) & (keys < until), score, np.inf)
            order = np.argsort(np.round(score, 9), axis=1, kind="stable")[:, :k]
            for i, t in enumerate(part):
                out += [
                    (int(t["day"]), int(keys[j]), float(score[i, j]), list(v[j]))
                    for j in order[i] if np.isfinite(score[i, j])
                ]
        return out

    return per_series(fit, ["day", "key", "score", "v"])


def similar(k: int, weights: list[float]) -> Callable:
    """The ``k`` nearest earlier days of each target with their distance, and the mean
    growth of yearly means (within -15 %..25 %) over the days the target sees."""

    def fit(row):
        key = np.asarray(row.key)
        x = np.asarray(row.x).reshape(len(key), -1)
        y, year, out = np.asarray(row.y), np.asarray(row.year), []
        for t in row.targets:
            lo, hi = np.searchsorted(key, [t["since"], t["day"]])
            lo = lo if hi - lo >= 10 else 0
            if hi == 0:
                continue
            seen, sd = x[lo:hi], x[lo:hi].std(axis=0)
            scale = np.array(weights) / np.where(sd > 1e-6, sd, 1.0)
            distance = np.sqrt((((seen - np.asarray(t["x"])) * scale) ** 2).sum(axis=1))
            best = lo + np.argsort(np.round(distance, 9), kind="stable")[:k]
            starts = np.unique(year[lo:hi], return_index=True)[1]
            means = np.add.reduceat(y[lo:hi], starts) / np.diff(np.append(starts, hi - lo))
            growth = np.clip(np.mean(means[1:] / means[:-1] - 1), -0.15, 0.25) if len(means) > 1 else 0.0
            out += [(int(t["day"]), float(growth), float(distance[j - lo]), int(year[j]), float(y[j])) for j in best]
        return out

    return per_series(fit, ["day", "growth", "distance", "year", "y"])


# --- sequential bias correction ------------------------------------------------------


def bias_step(errors: np.ndarray, count: np.ndarray, floor: float, rate: float) -> np.ndarray:
    """Correction for each series from its last errors (NaN where not yet known)."""
    known = count >= 3
    k = np.maximum(np.minimum(count, errors.shape[1]), 1)
    mean = np.nansum(errors, axis=1) / k
    spread = np.sqrt(np.nansum((errors - mean[:, None]) ** 2, axis=1) / np.maximum(k - 1, 1))
    biased = known & (np.abs(mean) > np.maximum(floor, 0.5 * spread))
    return np.where(biased, -mean * rate, 0.0)


def sequential_correction(memory: int, floor: float, rate: float) -> Callable:
    """Walk each series in date order; the correction of a day comes from the corrected
    errors of the days before it, so it cannot be a window."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for lo in range(0, len(pdf), SERIES_PER_BATCH):
                yield chunk(pdf.iloc[lo : lo + SERIES_PER_BATCH])

    def chunk(part):
        base, actual = padded(list(part.base)), padded(list(part.y))
        errors = np.full((len(part), memory), np.nan)
        count, fixes = np.zeros(len(part), dtype=int), np.zeros_like(base)
        for t in range(base.shape[1]):
            fixes[:, t] = bias_step(errors, count, floor, rate)
            errors[:, t % memory] = base[:, t] + fixes[:, t] - actual[:, t]
            count += 1
        sizes = [len(v) for v in part.y]
        out = {"series_id": np.repeat(part.series_id.to_numpy(), sizes)}
        for column in ("days", "base", "p1", "y"):
            out[column] = np.concatenate([np.asarray(v) for v in part[column]])
        out["correction"] = np.concatenate([fixes[i, :n] for i, n in enumerate(sizes)])
        return pd.DataFrame(out)

    return run


def running_correction(memory: int, floor: float, rate: float) -> Callable:
    """The same walk for a stream: the last errors of a series are its state."""

    def update(key, batches, state):
        errors = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values("ds")
        fixes = []
        for base, y in zip(rows.base, rows.y):
            held = np.full((1, memory), np.nan)
            held[0, : len(errors)] = errors
            fix = float(bias_step(held, np.array([len(errors)]), floor, rate)[0])
            errors = [*errors, base + fix - y][-memory:]
            fixes.append(fix)
        state.update((errors,))
        yield rows.assign(series_id=key[0], correction=fixes)[["series_id", "ds", "base", "y", "correction"]]

    return update


def ordered_correction(memory: int, floor: float, rate: float, idle_ms: int) -> Callable:
    """The walk in order of event time: days wait in the state, sorted, until the watermark has passed their end.
    A series without days for ``idle_ms`` after its last one leaves the state."""
    day_ms = 86_400_000

    def update(key, batches, state):
        errors, days, bases, ys, last = ([*x] if isinstance(x, (list, tuple, np.ndarray)) else x for x in state.get) if state.exists else ([], [], [], [], 0)
        waiting = list(zip(days, bases, ys))
        for rows in batches:
            at = (pd.to_datetime(rows.ds) - pd.Timestamp(0)) // pd.Timedelta(days=1)
            waiting += zip(at.astype(int).tolist(), rows.base.tolist(), rows.y.tolist())
        waiting.sort()
        mark = state.getCurrentWatermarkMs()
        due = sum((day + 1) * day_ms <= mark for day, _, _ in waiting)
        out = []
        for day, base, y in waiting[:due]:
            held = np.full((1, memory), np.nan)
            held[0, : len(errors)] = errors
            fix = float(bias_step(held, np.array([len(errors)]), floor, rate)[0])
            errors = [*errors, base + fix - y][-memory:]
            out.append((key[0], dt.date.fromordinal(EPOCH + day), base, y, fix))
        waiting = waiting[due:]
        last = max([last, *(day for day, _, _ in waiting), *((d.toordinal() - EPOCH) for _, d, *_ in out)])
        end = (waiting[0][0] + 1) * day_ms if waiting else (last + 1) * day_ms + idle_ms
        if not waiting and end <= mark:
            state.remove()
        else:
            state.update((errors, *([w[i] for w in waiting] for i in range(3)), last))
            state.setTimeoutTimestamp(max(end, mark + 1))
        if out:
            yield pd.DataFrame(out, columns=["series_id", "ds", "base", "y", "correction"])

    return update


#: The day that Spark counts from.
EPOCH = dt.date(1970, 1, 1).toordinal()
