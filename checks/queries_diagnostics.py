"""Tests, descriptive statistics and decomposition."""

from pyspark.sql import functions as F

from tidecast.functions.distributions import t_series
from tidecast.operators import diagnostics as g

from .panels import SUPPLIERS, supplier_panel
from .queries_baselines import BASE, long_sql, run, t_list
from .registry import query, rounded, select_rounded

H = ["series_id", "ds"]

ACF = f"""{SUPPLIERS}, c as (select series_id, ds, y - avg(y) over (partition by series_id) as x,
    row_number() over (partition by series_id order by ds) as i, count(*) over (partition by series_id) as n from h),
  tot as (select series_id, sum(x * x) as tot, max(n) as n from c group by 1 having max(n) >= 25 and sum(x * x) > 0),
  rho as (select a.series_id, b.i - a.i as lag, sum(a.x * b.x) / max(tot) as r, max(tot.n) as n
    from c a join c b on a.series_id = b.series_id and b.i between a.i + 1 and a.i + 20
    join tot on tot.series_id = a.series_id group by 1, 2)"""


@query("acf", select_rounded(ACF + """, x as (select series_id, 0 as lag, 1.0::double as acf from tot
  union all select series_id, cast(lag as integer), r from rho)""", "x", ["series_id", "lag"], ["acf"]))
def _(spark, d):
    return rounded(g.acf(supplier_panel(spark, d)))


@query("pacf", select_rounded(ACF + """, a as (select series_id, list(r * n / (n - lag) order by lag) as rho from rho group by 1),
  dl as (select series_id, rho, 0 as k, cast([] as double[]) as phi, 1.0::double as kk from a
    union all
    select series_id, rho, k, list_concat([phi[j] - kk * phi[k - j] for j in range(1, k)], [kk]) as phi, kk from (
      select series_id, rho, k + 1 as k, phi,
        (rho[k + 1] - coalesce(list_sum([phi[j] * rho[k + 1 - j] for j in range(1, k + 1)]), 0)) /
        (1 - coalesce(list_sum([phi[j] * rho[j] for j in range(1, k + 1)]), 0)) as kk from dl where k < 20)),
  x as (select series_id, k as lag, kk as pacf from dl)""", "x", ["series_id", "lag"], ["pacf"]))
def _(spark, d):
    return rounded(g.pacf(supplier_panel(spark, d)))


@query("ljung_box", select_rounded(ACF + """, q as (select series_id, max(n) * (max(n) + 2) * sum(r * r / (n - lag)) as lb_stat
    from rho where lag <= 10 group by 1),
  x as (select series_id, lb_stat, exp(-lb_stat / 2) * (1 + lb_stat / 2 + power(lb_stat / 2, 2) / 2
    + power(lb_stat / 2, 3) / 6 + power(lb_stat / 2, 4) / 24) as p_value from q),
  z as (select *, p_value < 0.05 as autocorrelated from x)""", "z", ["series_id", "autocorrelated"], ["lb_stat", "p_value"]))
def _(spark, d):
    return rounded(g.ljung_box(supplier_panel(spark, d)))


@query("adf")
def _(spark, d):
    return rounded(g.adf(supplier_panel(spark, d)))


BOUNDS = f"""{SUPPLIERS}, q as (select series_id, quantile_cont(y, 0.25) as q1, quantile_cont(y, 0.75) as q3 from h group by 1),
  b as (select series_id, q1 - 1.5 * (q3 - q1) as lower, q3 + 1.5 * (q3 - q1) as upper from q),
  x as (select h.*, lower, upper, y < lower or y > upper as is_outlier from h join b using (series_id))"""


@query("iqr_outliers", select_rounded(BOUNDS, "x", [*H, "is_outlier"], ["y", "lower", "upper"]))
def _(spark, d):
    return rounded(g.iqr_outliers(supplier_panel(spark, d)))


@query("iqr_outlier_summary", select_rounded(BOUNDS + """, s as (select series_id, lower, upper, count(*) filter (where is_outlier)
  as n_outliers, 100.0 * count(*) filter (where is_outlier) / count(*) as pct_outliers from x group by 1, 2, 3)""",
    "s", ["series_id", "n_outliers"], ["lower", "upper", "pct_outliers"]))
def _(spark, d):
    return rounded(g.iqr_outlier_summary(supplier_panel(spark, d)))


@query("zscore_outliers", select_rounded(SUPPLIERS + """, x as (select series_id, ds, y, (y - avg(y) over s) / stddev_pop(y) over s as z
  from h window s as (partition by series_id)), v as (select *, abs(z) > 3 as is_outlier from x)""",
    "v", [*H, "is_outlier"], ["y", "z"]))
def _(spark, d):
    return rounded(g.zscore_outliers(supplier_panel(spark, d)))


def t_sql(dof):
    z, coefs = t_series(0.95)
    tail = " + ".join([f"{z!r}::double"] + [f"{c!r}::double / power({dof}, {i})" for i, c in enumerate(coefs, 1)])
    return f"(case when {dof} between 1 and 60 then list_extract({t_list()}, {dof}) else {tail} end)"


@query("mean_ci", select_rounded(f"""{SUPPLIERS}, m as (select series_id, avg(y) as mean,
    {t_sql("(count(*) - 1)")} * stddev_samp(y) / sqrt(count(*)) as half from h group by 1),
  x as (select series_id, mean, mean - half as lo, mean + half as hi from m)""", "x", ["series_id"], ["mean", "lo", "hi"]))
def _(spark, d):
    return rounded(g.mean_ci(supplier_panel(spark, d)))


@query("prediction_halfwidth", select_rounded(f"""{SUPPLIERS}, r as (select series_id, y - lag(y) over (partition by series_id order by ds) as resid from h),
  x as (select series_id, {t_sql("(count(resid) - 1)")} * stddev_pop(resid) * sqrt(1 + 1.0::double / count(resid)) as halfwidth
    from r where resid is not null group by 1)""", "x", ["series_id"], ["halfwidth"]))
def _(spark, d):
    from tidecast.operators.features import diff

    resid = diff(supplier_panel(spark, d), [1]).select("series_id", F.col("diff_1").alias("resid"))
    return rounded(g.prediction_halfwidth(resid.dropna()))


@query("seasonal_profile", select_rounded(SUPPLIERS + ", x as (" + " union all ".join(
    f"select series_id, '{name}' as profile, cast({key} as integer) as key, avg(y) as mean, stddev_samp(y) as std, count(*) as n from h group by 1, 2, 3"
    for name, key in (("weekday", "isodow(ds) - 1"), ("month", "month(ds)"), ("week_of_month", "(day(ds) - 1) // 7 + 1"))) + ")",
    "x", ["series_id", "profile", "key", "n"], ["mean", "std"]))
def _(spark, d):
    return rounded(g.seasonal_profile(supplier_panel(spark, d)))


def _split(source, weight, name):
    near = "(partition by series_id order by ds rows between 3 preceding and 3 following)"
    ph = "(partition by series_id, phase)"
    return f"""{name}1 as (select *, {weight} as w from {source}),
  {name}2 as (select *, coalesce(sum(y * w) over {near} / nullif(sum(w) over {near}, 0), avg(y) over {near}) as tr from {name}1),
  {name}3 as (select *, coalesce(sum((y - tr) * w) over {ph} / nullif(sum(w) over {ph}, 0), 0) as s0 from {name}2),
  {name}4 as (select *, s0 - avg(s0) over (partition by series_id) as se from {name}3),
  {name} as (select series_id, ds, y, phase, tr as trend, se as seasonal, y - tr - se as resid from {name}4)"""


START = SUPPLIERS + ", i as (select *, cast((row_number() over (partition by series_id order by ds) - 1) % 7 as integer) as phase from h)"
PLAIN = START + ", " + _split("i", "1.0::double", "d")
SPLIT_COLS = ["y", "trend", "seasonal", "resid"]


@query("decompose", select_rounded(PLAIN, "d", [*H, "phase"], SPLIT_COLS))
def _(spark, d):
    return rounded(g.decompose(supplier_panel(spark, d)))


@query("decompose_robust", select_rounded(PLAIN + """, u as (select series_id, ds, y, phase,
    abs(resid) / (6 * median(abs(resid)) over (partition by series_id)) as u from d), """ + _split(
    "u", "case when u < 1 then (1 - u * u) * (1 - u * u) else 0 end", "e"), "e", [*H, "phase"], SPLIT_COLS))
def _(spark, d):
    return rounded(g.decompose(supplier_panel(spark, d), robust=True))


@query("strength", select_rounded(PLAIN + """, x as (select series_id,
    greatest(0, 1 - var_pop(resid) / var_pop(trend + resid)) as trend_strength,
    greatest(0, 1 - var_pop(resid) / var_pop(seasonal + resid)) as seasonal_strength from d group by 1)""",
    "x", ["series_id"], ["trend_strength", "seasonal_strength"]))
def _(spark, d):
    return rounded(g.strength(g.decompose(supplier_panel(spark, d))))


STL = BASE + """, q as (select *, n - r as i from (select *, count(*) over (partition by series_id, target_ds) as n from p)),
  tr as (select *, avg(y) over (partition by series_id, target_ds order by i rows between 3 preceding and 3 following) as trend
    from q where n >= 14),
  lf as (select series_id, target_ds, max(n) as n, max(trend) filter (where i = n - 1) as t0,
    max(trend) filter (where i = n - 8) as t7, avg(y - trend) filter (where i % 7 = n % 7) as s, avg(y - trend) as c
    from tr group by 1, 2)"""
STL_MODELS = [
    ("STL_Trend", "select *, t0 + (t0 - t7) / 7 as yhat from lf"),
    ("STL_Combined", "select *, t0 + (t0 - t7) / 7 + s - c as yhat from lf"),
    ("STL_Level", "select *, t0 + s - c as yhat from lf"),
]


@query("decompose_forecast", long_sql(STL_MODELS, STL))
def _(spark, d):
    return run(spark, d, g.decompose_forecast)


@query("decompose_forecast_whole", long_sql(STL_MODELS, STL.replace("h.ds < t.target_ds", "h.ds <= date '9999-01-01'")))
def _(spark, d):
    return run(spark, d, g.decompose_forecast, strict=False)
