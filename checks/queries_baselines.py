"""Averages, seasonal means and previous-year lookups against brute-force SQL."""

from tidecast.operators import baselines as b

from .panels import ORDERS, SUPPLIERS, TARGETS, orders_panel, supplier_panel, targets
from .queries_history import ema_sql
from .registry import query, rounded, select_rounded

IDS = ["series_id", "target_ds"]
OUT = [*IDS, "model"]

# every earlier row of each target, newest first (r = 1)
PAST = """p as (select t.series_id, t.target_ds, h.ds, h.y,
  row_number() over (partition by t.series_id, t.target_ds order by h.ds desc) as r,
  row_number() over (partition by t.series_id, t.target_ds, isodow(h.ds) order by h.ds desc) as rw
  from t join h on h.series_id = t.series_id and h.ds < t.target_ds)"""
BASE = f"{SUPPLIERS}, {TARGETS}, {PAST}"


def long_sql(branches, ctes=BASE, values=("yhat",), nudge=0.0):
    """Union of (model, query giving series_id, target_ds, yhat[, lo, hi])."""
    parts = [f"select series_id, target_ds, '{m}' as model, {', '.join(values)} from ({q}) where yhat is not null"
             for m, q in branches]
    return select_rounded(f"{ctes}, x as ({' union all '.join(parts)})", "x", OUT, values, nudge=nudge)


def tail(agg, n, need=None):
    having = f" having count(*) >= {need}" if need else ""
    return f"select series_id, target_ds, {agg} as yhat from p where r <= {n} group by 1, 2{having}"


def run(spark, d, fn, *args, panel=supplier_panel, nudge=0.0, banded=False, **kw):
    h = panel(spark, d)
    out = fn(h, targets(h), *args, **kw).drop("family")
    return rounded(out if banded else out.drop("lo", "hi"), nudge=nudge)


@query("sma", long_sql([(f"SMA_{n}", tail("avg(y)", n, n)) for n in (3, 5, 7, 14, 21, 30)]))
def _(spark, d):
    return run(spark, d, b.sma)


@query("sma_available", long_sql([(f"SMA_{n}", tail("avg(y)", n)) for n in (7, 14, 30)]))
def _(spark, d):
    return run(spark, d, b.sma, (7, 14, 30), require_full=False)


@query("wma", long_sql([("WMA_7", tail("sum(y * (8 - r)) / 28", 7, 7))]))
def _(spark, d):
    return run(spark, d, b.wma)


@query("tma", long_sql([("TMA_7", """select a.series_id, a.target_ds, sum(c.y) / 49 as yhat from
  (select distinct series_id, target_ds, unnest(range(1, 8)) as s from p) a
  join p c on c.series_id = a.series_id and c.target_ds = a.target_ds and c.r between a.s and a.s + 6
  group by 1, 2 having max(c.r) >= 13""")]))
def _(spark, d):
    return run(spark, d, b.tma)


def _ema_forecast_sql(spans, adjust):
    ctes = ema_sql(ORDERS, spans, adjust, 0, "e").replace("x as (", "ema as (") + f", {TARGETS}"
    return long_sql([(f"EMA_{s}", f"""select t.series_id, t.target_ds, arg_max(ema.e{s}, ema.ds) as yhat
      from t join ema on ema.series_id = t.series_id and ema.ds < t.target_ds group by 1, 2""") for s in spans],
        ctes, nudge=1.7e-7)


@query("ema_forecast", _ema_forecast_sql((7, 14, 21), True))
def _(spark, d):
    return run(spark, d, b.ema_forecast, panel=orders_panel, nudge=1.7e-7)


@query("ema_forecast_recursive", _ema_forecast_sql((7, 14), False))
def _(spark, d):
    return run(spark, d, b.ema_forecast, (7, 14), adjust=False, panel=orders_panel, nudge=1.7e-7)


def strict_mean(cond):
    return f"select series_id, target_ds, avg(y) as yhat from p where {cond} group by 1, 2"


def whole_mean(cond):
    return f"""select t.series_id, t.target_ds, avg(y) as yhat from t join h on h.series_id = t.series_id
      and {cond} group by 1, 2"""


WD = "isodow(ds) = isodow(target_ds)"
MO = "month(ds) = month(target_ds)"
WOM = "(day(ds) - 1) // 7 = (day(target_ds) - 1) // 7"


@query("weekday_mean", long_sql([("Weekday_Mean", strict_mean(WD))]))
def _(spark, d):
    return run(spark, d, b.weekday_mean)


@query("weekday_mean_whole", long_sql([("Weekday_Mean", whole_mean(WD))]))
def _(spark, d):
    return run(spark, d, b.weekday_mean, strict=False)


@query("month_mean", long_sql([("Month_Mean", strict_mean(MO))]))
def _(spark, d):
    return run(spark, d, b.month_mean)


@query("month_mean_whole", long_sql([("Month_Mean", whole_mean(MO))]))
def _(spark, d):
    return run(spark, d, b.month_mean, strict=False)


@query("week_of_month_mean", long_sql([("WeekOfMonth_Mean", strict_mean(WOM))]))
def _(spark, d):
    return run(spark, d, b.week_of_month_mean)


@query("week_of_month_mean_whole", long_sql([("WeekOfMonth_Mean", whole_mean(WOM))]))
def _(spark, d):
    return run(spark, d, b.week_of_month_mean, strict=False)


@query("weekday_month_mean", long_sql([("Weekday_Month_Mean", strict_mean(f"{WD} and {MO}"))]))
def _(spark, d):
    return run(spark, d, b.weekday_month_mean)


def t_list():
    from tidecast.functions.distributions import t_table

    return "[" + ", ".join(f"{v!r}::double" for v in t_table(0.95)) + "]"


@query("weekday_recent", long_sql([
    ("Weekday_Recent4", f"select series_id, target_ds, avg(y) as yhat, null::double as lo, null::double as hi from p where {WD} and rw <= 4 group by 1, 2"),
    ("Weekday_Recent8", f"""select series_id, target_ds, m as yhat, m - half as lo, m + half as hi from (
        select series_id, target_ds, avg(y) as m, case when count(*) >= 4 then
          list_extract({t_list()}, count(*) - 1) * stddev_samp(y) / sqrt(count(*)) end as half
        from p where {WD} and rw <= 8 group by 1, 2)""")], values=("yhat", "lo", "hi")))
def _(spark, d):
    return run(spark, d, b.weekday_recent, banded=True)


def back(days):
    return f"select t.series_id, t.target_ds, y as yhat from t join h on h.series_id = t.series_id and ds = target_ds - {days}"


@query("prev_year_same_day", long_sql([("PrevYear_SameDay", back(365))]))
def _(spark, d):
    return run(spark, d, b.prev_year_same_day)


@query("prev_year_same_weekday", long_sql([("PrevYear_SameWeekday", back(364))]))
def _(spark, d):
    return run(spark, d, b.prev_year_same_weekday)


@query("prev_year_same_weekday_fallback", long_sql([("PrevYear_SameWeekday", """
  select t.series_id, t.target_ds, coalesce(max(y) filter (where ds = target_ds - 364), arg_min(y, ds)) as yhat
  from t join h on h.series_id = t.series_id and ds between target_ds - 367 and target_ds - 361 group by 1, 2""")]))
def _(spark, d):
    return run(spark, d, b.prev_year_same_weekday, fallback=True)


@query("prev_year_month_mean", long_sql([("PrevYear_MonthMean", strict_mean(f"{MO} and year(ds) = year(target_ds) - 1"))]))
def _(spark, d):
    return run(spark, d, b.prev_year_month_mean)


@query("prev_year_nearby", long_sql([("PrevYear_Nearby", """
  select c.series_id, c.target_ds, avg(y) as yhat from (
    select t.series_id, t.target_ds, min(ds) as centre from t join h on h.series_id = t.series_id
      and ds between target_ds - 368 and target_ds - 362 group by 1, 2) c
  join h on h.series_id = c.series_id and ds between centre - 3 and centre + 3 group by 1, 2""")]))
def _(spark, d):
    return run(spark, d, b.prev_year_nearby)


@query("prev_year_growth", long_sql([("PrevYear_GrowthAdj", """
  select g.series_id, g.target_ds, h.y * case when b > 0 then least(greatest(a / b, 0.8), 1.3) else 1.0 end as yhat
  from (select series_id, target_ds, coalesce(avg(y) filter (where year(ds) = year(target_ds)), avg(y)) as a,
               coalesce(avg(y) filter (where year(ds) = year(target_ds) - 1), avg(y)) as b from p group by 1, 2) g
  join h on h.series_id = g.series_id and h.ds = g.target_ds - 365""")]))
def _(spark, d):
    return run(spark, d, b.prev_year_growth)


@query("bayes_posterior", long_sql([("Bayes_Posterior", """
  select series_id, target_ds, (m0 * p0 + m1 * p1) / (p0 + p1) as yhat,
    (m0 * p0 + m1 * p1) / (p0 + p1) - 1.96::double / sqrt(p0 + p1) as lo,
    (m0 * p0 + m1 * p1) / (p0 + p1) + 1.96::double / sqrt(p0 + p1) as hi from (
    select series_id, target_ds, avg(y) as m0, 1 / nullif(var_samp(y), 0) as p0,
      avg(y) filter (where r <= 14) as m1, 14 / nullif(var_samp(y) filter (where r <= 14), 0) as p1
    from p group by 1, 2)""")], values=("yhat", "lo", "hi")))
def _(spark, d):
    return run(spark, d, b.bayes_posterior, banded=True)


@query("recent_median", long_sql([(f"Median_{n}", tail("median(y)", n)) for n in (7, 14, 30)]))
def _(spark, d):
    return run(spark, d, b.recent_median)


def _trim(p):
    return f"""select series_id, target_ds, avg(y) as yhat from (
      select *, row_number() over (partition by series_id, target_ds order by y) as k,
             floor({p}::double * count(*) over (partition by series_id, target_ds)) as cut,
             count(*) over (partition by series_id, target_ds) as n from p where r <= 30)
      where k > cut and k <= n - cut group by 1, 2"""


@query("trim_mean", long_sql([("TrimMean_10pct", _trim(0.1)), ("TrimMean_20pct", _trim(0.2))]))
def _(spark, d):
    return run(spark, d, b.trim_mean)


@query("trend_change", long_sql([("TrendChange_Adj", """
  select series_id, target_ds, avg(y) filter (where r <= 7) *
    case when sum((4 - r) * y) filter (where r <= 7) > sum((11 - r) * y) filter (where r > 7) then 1.02::double
         when sum((4 - r) * y) filter (where r <= 7) < sum((11 - r) * y) filter (where r > 7) then 0.98::double
         else 1.0 end as yhat
  from p where r <= 14 group by 1, 2 having count(*) = 14""")]))
def _(spark, d):
    return run(spark, d, b.trend_change)
