"""Smoothing, autoregression, Fourier and lag regressions, densities and resampling."""

from tidecast.operators import estimates, lagreg, smoothing

from .panels import ORDERS, TARGETS, orders_panel
from .queries_baselines import BASE, PAST, long_sql, run
from .registry import query
from .solve_sql import arma, fourier, lag_ridge


def _grid(kind):
    rows = ", ".join(f"({i}, {a}::double, {b}::double, {g}::double, {p}::double)"
                     for i, (a, b, g, p) in enumerate(smoothing.KINDS[kind][2]))
    return f"g as (select * from (values {rows}) v(k, a, b, g, phi))"


# kind: (first forecast uses this many days, start of level, slope and season list,
#        forecast, new level, new season value), the season list rotating with the day
SMOOTH = {
    "ses": (1, "y1", "0.0", "l", "a * y + (1 - a) * ahead", None),
    "holt": (2, "y2", "y2 - y1", "ahead", "a * y + (1 - a) * ahead", None),
    "damped": (2, "y2", "y2 - y1", "ahead", "a * y + (1 - a) * ahead", None),
    "hw_add": (7, "m1", "(m2 - m1) / 7", "ahead + s[1]", "a * (y - s[1]) + (1 - a) * ahead", "g * (y - nl) + (1 - g) * s[1]"),
    "hw_mul": (7, "m1", "(m2 - m1) / 7", "ahead * s[1]", "a * (y / s[1]) + (1 - a) * ahead", "g * (y / nl) + (1 - g) * s[1]"),
}


def smooth_sql(kind):
    first, level, slope, forecast, new_level, new_season = SMOOTH[kind]
    model, least = smoothing.KINDS[kind][:2]
    seasons = {"hw_add": "[v - m1 for v in first7]", "hw_mul": "[v / m1 for v in first7]"}.get(kind, "[0.0::double]")
    rotate = f"list_concat(s[2:7], [{new_season}])" if new_season else "s"
    body = f"""{ORDERS}, {TARGETS}, {_grid(kind)},
  i as (select *, row_number() over (partition by series_id order by ds) as rn from h),
  f as (select series_id, max(y) filter (where rn = 1) as y1, max(y) filter (where rn = 2) as y2,
    avg(y) filter (where rn <= 7) as m1, avg(y) filter (where rn between 8 and 14) as m2,
    list(y order by rn) filter (where rn <= 7) as first7 from i group by 1 having count(*) >= {least}),
  walk as (
    select series_id, k, a, b, g, phi, {first} as rn, {level} as l, {slope} as sl, {seasons} as s, 0.0::double as sse from f, g
    union all
    select series_id, k, a, b, g, phi, rn, nl, b * (nl - l) + (1 - b) * phi * sl, {rotate}, sse + (y - fc) * (y - fc) from (
      select *, {new_level} as nl from (
        select w.*exclude(rn), i.rn, i.y, w.ahead, {forecast.replace("s[1]", "w.s[1]").replace("ahead", "w.ahead").replace("l", "w.l") if kind == "ses" else forecast.replace("ahead", "w.ahead").replace("s[1]", "w.s[1]")} as fc
        from (select *, l + phi * sl as ahead from walk) w join i on i.series_id = w.series_id and i.rn = w.rn + 1))),
  n as (select t.series_id, t.target_ds, count(*) as n from t join h on h.series_id = t.series_id and h.ds < t.target_ds group by 1, 2),
  best as (select n.series_id, n.target_ds, arg_min(fc, (sse, k)) as yhat from n join (
      select *, {forecast} as fc from (select *, l + phi * sl as ahead from walk)) v on v.series_id = n.series_id and v.rn = n.n
    where n.n >= {least} group by 1, 2)"""
    return long_sql([(model, "select * from best")], body)


for _kind in SMOOTH:

    @query(f"smooth_{_kind}", smooth_sql(_kind))
    def _(spark, d, kind=_kind):
        return run(spark, d, smoothing.smooth, kind, panel=orders_panel)


AR = f"""{BASE}, q as (select *, lag(y) over (partition by series_id, target_ds order by ds) as x,
    count(*) over (partition by series_id, target_ds) as n from p),
  dd as (select *, y - x as dy, lag(y - x) over (partition by series_id, target_ds order by ds) as dx from q where n >= 30)"""


FIRST_ORDER = [
    ("ARIMA_100", """select series_id, target_ds, max(y) filter (where r = 1) * regr_slope(y, x) + regr_intercept(y, x) as yhat
       from dd group by 1, 2"""),
    ("ARIMA_110", """select series_id, target_ds, max(y) filter (where r = 1)
       + max(dy) filter (where r = 1) * sum(dy * dx) / sum(case when dy is not null then dx * dx end) as yhat from dd group by 1, 2""")]


@query("ar_first_order", long_sql(FIRST_ORDER, AR))
def _(spark, d):
    return run(spark, d, lagreg.first_order)


PANEL = f"{ORDERS}, {TARGETS}, {PAST}"


def models_sql(specs, ctes=PANEL, more=(), values=("yhat",)):
    """Several fits, each (name, (CTEs, rows)), in long form."""
    body = ",\n  ".join([ctes, *[c for _, (own, _) in specs for c in own]])
    return long_sql([*more, *[(m, rows) for m, (_, rows) in specs]], body, values)


# model: lags of values and of residuals
AR_LAGS = {"ARIMA_111": ([1], [1]), "ARIMA_211": ([1, 2], [1]), "ARIMA_212": ([1, 2], [1, 2]), "ARIMA_011": ([], [1])}
SEASONAL_LAGS = {"SARIMA_111_111": ([1, 7, 8], [1, 7, 8]), "SARIMA_111_011": ([1], [1, 7, 8]), "SARIMA_211_110": ([1, 2, 7, 8, 9], [1])}


@query("ar_forecast", models_sql([(m, arma(m, m, 0, *ar, 30)) for m, ar in AR_LAGS.items()], AR.replace(BASE, PANEL), FIRST_ORDER))
def _(spark, d):
    return run(spark, d, lagreg.ar_forecast, panel=orders_panel)


@query("seasonal_ar_forecast", models_sql([(m, arma(m, m, 7, *ar, 60)) for m, ar in SEASONAL_LAGS.items()]))
def _(spark, d):
    return run(spark, d, lagreg.seasonal_ar_forecast, panel=orders_panel)


@query("fourier_forecast", models_sql([("Prophet", fourier(10, 3))], values=("yhat", "lo", "hi")))
def _(spark, d):
    return run(spark, d, lagreg.fourier_forecast, panel=orders_panel, banded=True)


@query("lag_ridge", models_sql([("Ridge_Regression", lag_ridge())]))
def _(spark, d):
    return run(spark, d, lagreg.lag_regression, kinds=("ridge",), panel=orders_panel)


@query("lag_regression")
def _(spark, d):
    return run(spark, d, lagreg.lag_regression, panel=orders_panel, banded=True)


@query("kde_mode", long_sql([("KDE_Mode", """
  select series_id, target_ds, arg_max(x, (dens, -gi)) as yhat from (
    select series_id, target_ds, gi, x, sum(exp(-0.5::double * power((x - y) / bw, 2))) as dens from (
      select *, lo + gi * (hi - lo) / 999.0::double as x from (
        select series_id, target_ds, ys, lo, hi, bw, unnest(range(0, 1000)) as gi from (
          select series_id, target_ds, list(y) as ys, min(y) as lo, max(y) as hi,
            stddev_samp(y) * power(count(*), -0.2::double) as bw
          from p where isodow(ds) = isodow(target_ds) group by 1, 2 having count(*) >= 5 and stddev_samp(y) > 0))),
      unnest(ys) as u(y) group by all) group by 1, 2""")], f"{ORDERS}, {TARGETS}, {PAST}"))
def _(spark, d):
    return run(spark, d, estimates.kde_mode, panel=orders_panel)


@query("bootstrap", long_sql([("Bootstrap_Mean", """
  select series_id, target_ds, avg(m) as yhat, quantile_cont(m, 0.025) as lo, quantile_cont(m, 0.975) as hi from (
    select series_id, target_ds, b, avg(ys[1 + (x3 >> 8) % n]) as m from (
      select *, xor((x2 * 1103515245 + 12345) % 2147483648, ((x2 * 1103515245 + 12345) % 2147483648) >> 15) as x3 from (
        select *, xor((x1 * 1103515245 + 12345) % 2147483648, ((x1 * 1103515245 + 12345) % 2147483648) >> 15) as x2 from (
          select *, xor((x0 * 1103515245 + 12345) % 2147483648, ((x0 * 1103515245 + 12345) % 2147483648) >> 15) as x1 from (
            select series_id, target_ds, ys, n, c // n as b, (c + 42) % 2147483648 as x0 from (
              select series_id, target_ds, ys, len(ys) as n, unnest(range(0, 1000 * len(ys))) as c from (
                select series_id, target_ds, list(y order by ds) as ys from p where r <= 30 group by 1, 2))))))
    group by 1, 2, 3) group by 1, 2""")], f"{ORDERS}, {TARGETS}, {PAST}", ("yhat", "lo", "hi")))
def _(spark, d):
    return run(spark, d, estimates.bootstrap, panel=orders_panel, banded=True)
