"""Similar days, pattern matching, previous-year and recent-trend forecasts, neighbours."""

from pyspark.sql import functions as F

from tidecast.functions.calendar import calendar
from tidecast.operators import analogs as a
from tidecast.operators import features

from .panels import ORDERS, TARGETS, orders_panel, supplier_panel, targets
from .queries_baselines import BASE, PAST, long_sql, run
from .registry import query, rounded, select_rounded

FEATS = {
    "weekday": "isodow({d}) - 1", "month": "month({d})", "week_of_month": "(day({d}) - 1) // 7 + 1",
    "is_month_start": "cast(day({d}) <= 3 as integer)", "is_month_end": "cast(day({d}) >= 25 as integer)",
    "month_sin": "sin(month({d}) * (2 * pi() / 12))", "month_cos": "cos(month({d}) * (2 * pi() / 12))",
    "weekday_sin": "sin((isodow({d}) - 1) * (2 * pi() / 7))", "weekday_cos": "cos((isodow({d}) - 1) * (2 * pi() / 7))",
}


def feats(day, prefix):
    return ", ".join(f"cast({e.format(d=day)} as double) as {prefix}{n}" for n, e in FEATS.items())


_DIST = " + ".join(f"power((f_{n} - t_{n}) * {w}::double / sd_{n}, 2)" for n, w in a.DAY_WEIGHTS.items())
SIMILAR = f"""{BASE}, c as (select *, count(*) filter (where ds >= target_ds - interval 3 year)
    over (partition by series_id, target_ds) as recent from p),
  v as (select series_id, target_ds, ds, y, {feats('ds', 'f_')}, {feats('target_ds', 't_')} from c
    where recent < 10 or ds >= target_ds - interval 3 year),
  sd as (select series_id, target_ds, {', '.join(f"case when var_pop(f_{n}) > 1e-12 then stddev_pop(f_{n}) else 1 end as sd_{n}" for n in FEATS)}
    from v group by 1, 2),
  ym as (select series_id, target_ds, year(ds) as yr, avg(y) as m from v group by 1, 2, 3),
  gr as (select series_id, target_ds, least(greatest(coalesce(avg(g), 0), -0.15), 0.25) as g from (
    select *, m / lag(m) over (partition by series_id, target_ds order by yr) - 1 as g from ym) group by 1, 2),
  ds1 as (select v.series_id, v.target_ds, v.ds, v.y, sqrt({_DIST}) as d from v join sd using (series_id, target_ds)),
  top as (select *, row_number() over (partition by series_id, target_ds order by round(d, 9), ds) as k from ds1),
  s as (select series_id, target_ds, sum(y / (d + 0.01)) / sum(1 / (d + 0.01)) as v, avg(year(ds)) as yr
    from top where k <= 20 group by 1, 2)"""


@query("similar_days", long_sql([("similar", """select series_id, target_ds,
  v * least(greatest(power(1 + g, year(target_ds) - yr), 0.7), 1.5) as yhat from s join gr using (series_id, target_ds)""")], SIMILAR))
def _(spark, d):
    return run(spark, d, a.similar_days)


def pattern_sql(strict):
    total = "n" if strict else "(select count(*) from h where h.series_id = w0.series_id)"
    overall = "oall" if strict else "(select avg(y) from h where h.series_id = w0.series_id)"
    return f"""{ORDERS}, {TARGETS}, {PAST},
  i as (select *, row_number() over (partition by series_id order by ds) - 1 as i from h),
  lists as (select series_id, i, y, list(y) over (partition by series_id order by i rows between 7 preceding and 1 preceding) as ys from i),
  mom as (select series_id, i, y, ys, list_avg(ys) as m from lists where len(ys) = 7),
  runs as (select *, sqrt(list_sum([(v - m) * (v - m) for v in ys])) as nm from mom),
  w0 as (select series_id, target_ds, list(y order by ds) filter (where r <= 7) as ts, count(*) as n, avg(y) as oall from p group by 1, 2),
  w1 as (select *, list_avg(ts) as tm, {total} as total, {overall} as overall from w0),
  x1 as (select *, sqrt(list_sum([(v - tm) * (v - tm) for v in ts])) as tn from w1),
  pr as (select x1.series_id, target_ds, i, y, m, tm, case when nm > 1e-8 and tn > 1e-8 then
      ((ys[1] - m) * (ts[1] - tm) + (ys[2] - m) * (ts[2] - tm) + (ys[3] - m) * (ts[3] - tm) + (ys[4] - m) * (ts[4] - tm)
      + (ys[5] - m) * (ts[5] - tm) + (ys[6] - m) * (ts[6] - tm) + (ys[7] - m) * (ts[7] - tm)) / (nm * tn) else 0 end as r
    from x1 join runs on runs.series_id = x1.series_id and i < total - 8 where n >= 7 and total >= 21),
  tk as (select *, least(greatest(tm / (m + 1e-8), 0.5), 2) as sc,
    row_number() over (partition by series_id, target_ds order by round(r, 9) desc, i) as k from pr),
  g as (select series_id, target_ds, sum(y * sc * (r + 1) / 2) / sum((r + 1) / 2) as v from tk where k <= 10 group by 1, 2)"""


STRICT_ROWS = """select x1.series_id, x1.target_ds, coalesce(v, overall) as yhat
      from x1 left join g on g.series_id = x1.series_id and g.target_ds = x1.target_ds"""
_WHOLE_ROWS = """select t.series_id, t.target_ds, coalesce(v, (select avg(y) from h where h.series_id = t.series_id)) as yhat
      from t left join g on g.series_id = t.series_id and g.target_ds = t.target_ds"""

for _name, _strict, _rows in (("pattern_match", True, STRICT_ROWS), ("pattern_match_whole", False, _WHOLE_ROWS)):

    @query(_name, long_sql([("pattern", _rows)], pattern_sql(_strict)))
    def _(spark, d, strict=_strict):
        return run(spark, d, a.pattern_match, strict=strict, panel=orders_panel)


def growth_sql(source):
    return f"""select series_id, target_ds, coalesce(mm * case when cy is not null and py is not null
      then least(greatest(cy / py, 0.8), 1.3) else 1.0 end, oa) as yhat from (
    select t.series_id, t.target_ds, avg(y) as oa, avg(y) filter (where year(ds) = year(target_ds)) as cy,
      avg(y) filter (where year(ds) = year(target_ds) - 1) as py,
      avg(y) filter (where year(ds) = year(target_ds) - 1 and month(ds) = month(target_ds)) as mm from {source} group by 1, 2)"""


@query("prev_year_trend", long_sql([("prev_year", growth_sql("p t"))]))
def _(spark, d):
    return run(spark, d, a.prev_year_trend)


@query("prev_year_trend_whole", long_sql([("prev_year", growth_sql("t join h on h.series_id = t.series_id"))]))
def _(spark, d):
    return run(spark, d, a.prev_year_trend, strict=False)


def recent_sql(weekday, overall):
    return f"""select o.series_id, o.target_ds, case when now is null then oa else
        coalesce(coalesce(same, wd) * least(greatest(now / oa, 0.7), 1.5), now) end as yhat
    from (select t.series_id, t.target_ds, avg(y) as oa from {overall} group by 1, 2) o
    left join (
      select series_id, target_ds, coalesce(case when count(*) filter (where ds >= target_ds - 30) >= 5
          then avg(y) filter (where ds >= target_ds - 30) end, avg(y) filter (where r <= 20)) as now,
        avg(y) filter (where month(ds) = month(target_ds) and isodow(ds) = isodow(target_ds) and year(ds) < year(target_ds)) as same
      from p group by 1, 2) e on e.series_id = o.series_id and e.target_ds = o.target_ds
    left join (select t.series_id, t.target_ds, avg(y) as wd from {weekday} where isodow(ds) = isodow(target_ds) group by 1, 2) w
      on w.series_id = o.series_id and w.target_ds = o.target_ds"""


@query("recent_trend", long_sql([("trend", recent_sql("p t", "p t"))]))
def _(spark, d):
    return run(spark, d, a.recent_trend)


@query("recent_trend_whole", long_sql([("trend", recent_sql(*["t join h on h.series_id = t.series_id"] * 2))]))
def _(spark, d):
    return run(spark, d, a.recent_trend, strict=False)


@query("with_fallback", select_rounded(BASE + """, f as (
    select t.series_id, t.target_ds, m.model, case when m.model = 'PrevYear_SameDay' then h.y end as y0,
      (select avg(p.y) from p where p.series_id = t.series_id and p.target_ds = t.target_ds) as oa
    from t cross join (values ('PrevYear_SameDay'), ('similar')) m(model)
    left join h on h.series_id = t.series_id and h.ds = t.target_ds - 365),
  x as (select series_id, target_ds, model, coalesce(y0, oa, 1000) as yhat,
    case when y0 is null then 'fallback' else 'previous_year' end as family from f)""",
    "x", ["series_id", "target_ds", "model", "family"], ["yhat"]))
def _(spark, d):
    from tidecast.operators.baselines import prev_year_same_day

    h = supplier_panel(spark, d)
    t = targets(h)
    return rounded(a.with_fallback(prev_year_same_day(h, t), h, t, ["PrevYear_SameDay", "similar"], 1000.0).drop("lo", "hi"))


KNN = f"""{ORDERS}, {TARGETS}, f as (select *, lag(y) over w as l1, lag(y, 7) over w as l7 from h window w as (partition by series_id order by ds)),
  tr as (select series_id, ds, y, cast(isodow(ds) - 1 as double) as wd, cast(month(ds) as double) as mo, l1, l7 from f where l7 is not null),
  q as (select distinct series_id, ds as target_ds, wd, mo, l1, l7 from tr),
  d as (select q.series_id, q.target_ds, tr.ds, tr.y, sqrt(power(q.wd - tr.wd, 2) + power(q.mo - tr.mo, 2)
      + power(q.l1 - tr.l1, 2) + power(q.l7 - tr.l7, 2)) as d from q join tr on q.series_id = tr.series_id and tr.ds < q.target_ds),
  k as (select *, row_number() over (partition by series_id, target_ds order by round(d, 9), ds) as k from d)"""


def _knn(spark, d, k, weights):
    w = features.lags(calendar(orders_panel(spark, d), parts=["weekday", "month"]), [1, 7])
    rows = w.filter(F.col("lag_7").isNotNull())
    wanted = rows.drop("y").withColumnRenamed("ds", "target_ds")
    return rounded(a.nearest_neighbours(rows, wanted, ["weekday", "month", "lag_1", "lag_7"], k, weights).drop("family", "lo", "hi"))


@query("knn", long_sql([("KNN", """select series_id, target_ds, coalesce(avg(y) filter (where d = 0),
  sum(y / d) filter (where d > 0) / sum(1 / d) filter (where d > 0)) as yhat from k where k <= 10 group by 1, 2""")], KNN))
def _(spark, d):
    return _knn(spark, d, 10, "distance")


@query("knn_uniform", long_sql([("KNN", "select series_id, target_ds, avg(y) as yhat from k where k <= 5 group by 1, 2")], KNN))
def _(spark, d):
    return _knn(spark, d, 5, "uniform")
