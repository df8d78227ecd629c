"""Sources, cleaning, calendar and window features."""

import uuid

from pyspark.sql import functions as F

from tidecast.functions import calendar as cal
from tidecast.functions.columns import null_inf
from tidecast.operators import asof, diagnostics, features
from tidecast.session import ensure_checkpoint_dir
from tidecast.sources import history

from .panels import EVENTS, ORDERS, SUPPLIERS, TARGETS, events_panel, orders_panel, supplier_panel, table, targets
from .registry import query, rounded, select_rounded

H = ["series_id", "ds"]


@query("read_history", "select o_orderpriority as series_id, cast(o_orderdate as date) as ds, o_totalprice as y from orders")
def _(spark, d):
    schema = "o_orderkey bigint, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
    raw = history.read_history(spark, f"{d}/orders.parquet", "parquet", schema)
    return raw.select(F.col("o_orderpriority").alias("series_id"), F.to_date("o_orderdate").alias("ds"),
                      F.col("o_totalprice").alias("y"))


@query("read_history_csv", """select 'all' as series_id, cast(o_orderdate as date) as ds,
  cast(sum(floor(o_totalprice)) as double) as y from orders group by 2 having sum(floor(o_totalprice)) > 0""")
def _(spark, d):
    """The orders as the CSV files a user would hand in, then read, renamed and cleaned."""
    folder = f"{ensure_checkpoint_dir(spark)}/csv-{uuid.uuid4().hex}"
    orders = spark.read.parquet(f"{d}/orders.parquet")
    orders.select(F.date_format("o_orderdate", "yyyy-MM-dd").alias(history.DATE_NAMES[1]),
                  F.floor("o_totalprice").alias(history.TOTAL_NAME)).write.option("header", True).csv(folder)
    schema = f"`{history.DATE_NAMES[1]}` string, `{history.TOTAL_NAME}` string"
    raw = history.read_history(spark, folder, "csv", schema)
    return history.clean_history(history.normalise_columns(raw)).select("series_id", "ds", "y")


@query("normalise_columns", "select cast(o_orderdate as date) as ds, cast(o_custkey as varchar) as series_id, "
       "o_totalprice as y from orders")
def _(spark, d):
    raw = table(spark, d, "orders").select(
        F.to_date("o_orderdate").alias("日付"), F.col("o_custkey").cast("string").alias("branch"),
        F.col("o_totalprice").alias("合計"))
    return history.normalise_columns(raw, series="branch")


def _dirty(spark, d):
    """Orders as text with every seventh date and every fifth total unreadable."""
    key = F.col("o_orderkey")
    day = F.when(key % 7 == 0, "not a date").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    cents = (F.col("o_totalprice") * 100).cast("bigint") - 25_000_000
    total = F.when(key % 5 == 0, F.when(key % 10 == 0, "n/a")).otherwise(cents.cast("string"))
    return table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("series_id"), day.alias("ds"), total.alias("y"))


DIRTY = """raw as (
  select o_orderpriority as series_id,
         case when o_orderkey % 7 <> 0 then cast(o_orderdate as date) end as ds,
         case when o_orderkey % 5 <> 0 then cast(trunc(o_totalprice * 100) - 25000000 as double) end as y,
         o_orderkey % 10 = 0 as is_text
  from orders)"""


@query("clean_history", f"with {DIRTY} select series_id, ds, sum(y) as y from raw "
       "where ds is not null and y is not null group by 1, 2 having sum(y) > 0")
def _(spark, d):
    return history.clean_history(_dirty(spark, d))


@query("clean_history_lenient", f"with {DIRTY} select series_id, ds, sum(coalesce(y, 0)) as y from raw "
       "where ds is not null group by 1, 2 having sum(coalesce(y, 0)) > 0")
def _(spark, d):
    return history.clean_history(_dirty(spark, d), lenient=True)


@query("daily_rollup", f"with {EVENTS} select * from h")
def _(spark, d):
    return events_panel(spark, d)


@query("daily_rollup_two_keys", """
select c_mktsegment || '|' || cast(c_nationkey as varchar) as series_id, cast(o_orderdate as date) as ds,
       cast(sum(floor(o_totalprice)) as double) as y,
       cast(sum(case when hour(o_orderdate) < 12 then floor(o_totalprice) else 0 end) as double) as partial_y
from orders join customer on o_custkey = c_custkey group by 1, 2""")
def _(spark, d):
    facts = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return history.daily_rollup(facts, "o_orderdate", ["c_mktsegment", "c_nationkey"], F.floor("o_totalprice"))


@query("null_inf", f"with {ORDERS} select series_id, ds, case when y % 5 <> 0 then round(1 / (y % 5), 6) end as x from h")
def _(spark, d):
    m = F.col("y") % 5
    x = F.when(m == 0, F.lit(float("inf"))).otherwise(F.try_divide(F.lit(1.0), m))
    return rounded(null_inf(orders_panel(spark, d).select(*H, x.alias("x"))))


@query("eligible_targets", f"""with {ORDERS}, {TARGETS}
select t.series_id, t.target_ds, max(h.ds) as last_ds, cast(count(*) as integer) as n_obs
from t join h on h.series_id = t.series_id and h.ds < t.target_ds group by 1, 2 having count(*) >= 14""")
def _(spark, d):
    h = orders_panel(spark, d)
    return asof.eligible_targets(h, targets(h), 14)


@query("asof_attach", f"""with {SUPPLIERS}, {TARGETS}
select t.series_id, t.target_ds, max(h.ds) as ds, arg_max(h.y, h.ds) as y
from t left join h on h.series_id = t.series_id and h.ds < t.target_ds group by 1, 2""")
def _(spark, d):
    h = supplier_panel(spark, d)
    return asof.asof_attach(h, targets(h))


@query("lookup", f"with {ORDERS}, {TARGETS} select t.series_id, target_ds, y from t join h on h.series_id = t.series_id and ds = target_ds")
def _(spark, d):
    h = orders_panel(spark, d)
    return asof.lookup(h, targets(h))


@query("overview", f"""with {SUPPLIERS} select series_id, min(ds) as first_ds, max(ds) as last_ds, count(*) as n,
round(avg(y), 6) as mean, round(stddev_samp(y), 6) as std from h group by 1""")
def _(spark, d):
    return rounded(history.overview(supplier_panel(spark, d)))


@query("profile", f"""with {SUPPLIERS}, m as (
  select series_id, count(*)::double as n, avg(y) as mean, stddev_samp(y) as std, median(y) as median,
         skewness(y) as skew, kurtosis(y) as kurtosis from h group by 1)
select series_id, cast(n as bigint) as n, round(mean, 6) as mean, round(median, 6) as median, round(std, 6) as std,
       round(std / mean * 100, 6) as cv_pct, round(skew, 6) as skew, round(kurtosis, 6) as kurtosis from m""")
def _(spark, d):
    return rounded(diagnostics.profile(supplier_panel(spark, d)))


CAL = """select series_id, ds, cast(year(ds) as integer) as year, cast(month(ds) as integer) as month,
 cast(day(ds) as integer) as day, cast(quarter(ds) as integer) as quarter, cast(dayofyear(ds) as integer) as day_of_year,
 cast(isodow(ds) - 1 as integer) as weekday, cast(weekofyear(ds) as integer) as week_of_year,
 cast((day(ds) - 1) // 7 + 1 as integer) as week_of_month from h"""


@query("calendar", f"with {ORDERS} {CAL}")
def _(spark, d):
    return cal.calendar(orders_panel(spark, d).select(*H))


@query("cyclic", select_rounded(
    ORDERS + f", c as ({CAL}), x as (select series_id, ds, " + ", ".join(
        f"{fn}(2.0::double * pi() * {c} / {p}) as {c}_{fn}" for c, p in
        (("month", 12), ("weekday", 7), ("day", 31), ("quarter", 4)) for fn in ("sin", "cos")) + " from c)",
    "x", H, [f"{c}_{fn}" for c in ("month", "weekday", "day", "quarter") for fn in ("sin", "cos")]))
def _(spark, d):
    parts = {"month": 12, "weekday": 7, "day": 31, "quarter": 4}
    return rounded(cal.cyclic(cal.calendar(orders_panel(spark, d).select(*H), parts=list(parts)), parts).drop(*parts))


def _flags(*pairs):
    return ", ".join(f"cast(({cond}) as integer) as {name}" for name, cond in pairs)


@query("edge_flags", f"with {ORDERS} select series_id, ds, " + _flags(
    ("is_month_start", "day(ds) <= 5"), ("is_month_end", "day(ds) >= 25")) + " from h")
def _(spark, d):
    return cal.edge_flags(orders_panel(spark, d).select(*H), 5, 25)


for _lo, _hi in ((3, 28), (3, 25)):

    @query(f"edge_flags_{_lo}_{_hi}", f"with {ORDERS} select series_id, ds, " + _flags(
        ("is_month_start", f"day(ds) <= {_lo}"), ("is_month_end", f"day(ds) >= {_hi}")) + " from h")
    def _(spark, d, lo=_lo, hi=_hi):
        return cal.edge_flags(orders_panel(spark, d).select(*H), lo, hi)


@query("day_flags", f"with {ORDERS} select series_id, ds, " + _flags(
    ("is_weekend", "isodow(ds) >= 6"), ("is_monday", "isodow(ds) = 1"), ("is_friday", "isodow(ds) = 5")) + " from h")
def _(spark, d):
    return cal.day_flags(orders_panel(spark, d).select(*H))


@query("quarter_flags", f"with {ORDERS} select series_id, ds, " + _flags(
    ("is_quarter_start", "month(ds) in (1, 4, 7, 10) and day(ds) <= 5"),
    ("is_quarter_end", "month(ds) in (3, 6, 9, 12) and day(ds) >= 25")) + " from h")
def _(spark, d):
    return cal.quarter_flags(orders_panel(spark, d).select(*H))


@query("holiday_flag", f"""with {ORDERS}, hol as (select cast(o_orderdate as date) as ds from orders group by 1
  having count(distinct o_orderpriority) = 1)
select series_id, h.ds, cast(hol.ds is not null as integer) as is_holiday from h left join hol on h.ds = hol.ds""")
def _(spark, d):
    orders = table(spark, d, "orders")
    quiet = orders.groupBy(F.to_date("o_orderdate").alias("ds")).agg(
        F.min("o_orderpriority").alias("a"), F.max("o_orderpriority").alias("b")).filter("a = b").select("ds")
    return cal.holiday_flag(orders_panel(spark, d).select(*H), quiet)


@query("special_periods", f"with {ORDERS} select series_id, ds, " + _flags(
    ("is_golden_week", "(month(ds) = 4 and day(ds) >= 29) or (month(ds) = 5 and day(ds) <= 5)"),
    ("is_obon", "month(ds) = 8 and day(ds) between 10 and 16"),
    ("is_year_end", "(month(ds) = 12 and day(ds) >= 28) or (month(ds) = 1 and day(ds) <= 3)")) + " from h")
def _(spark, d):
    return cal.special_periods(orders_panel(spark, d).select(*H))


@query("trend", f"with {SUPPLIERS} select series_id, ds, cast(row_number() over (partition by series_id order by ds) - 1 as integer) as trend from h")
def _(spark, d):
    return cal.trend(supplier_panel(spark, d).select(*H))


W = "(partition by series_id order by ds)"
LAGS = (1, 2, 3, 4, 5, 6, 7, 14, 21, 28, 30, 56, 60, 84, 90, 364, 365)


@query("lags", f"with {SUPPLIERS} select series_id, ds, " + ", ".join(
    f"lag(y, {n}) over {W} as lag_{n}" for n in LAGS) + " from h")
def _(spark, d):
    return features.lags(supplier_panel(spark, d), LAGS).drop("y")


def _frame(n, back=1):
    return f"(partition by series_id order by ds rows between {n} preceding and {back} preceding)"


WINDOWS = (3, 5, 7, 14, 21, 30, 60)
FNS = {"mean": "avg(y)", "std": "stddev_samp(y)", "min": "min(y)", "max": "max(y)", "median": "median(y)"}


def _rolling_sql(panel, windows, stats, full):
    names = [f"rolling_{s}_{n}" for n in windows for s in stats]
    exprs = [
        (f"case when count(y) over {_frame(n)} >= {n} then {FNS[s]} over {_frame(n)} end" if full
         else f"{FNS[s]} over {_frame(n)}") + f" as rolling_{s}_{n}"
        for n in windows for s in stats]
    return select_rounded(f"{panel}, x as (select series_id, ds, {', '.join(exprs)} from h)", "x", H, names)


@query("rolling", _rolling_sql(SUPPLIERS, WINDOWS, ("mean", "std", "min", "max"), False))
def _(spark, d):
    return rounded(features.rolling_apart(supplier_panel(spark, d), WINDOWS).drop("y"))


@query("rolling_full", _rolling_sql(SUPPLIERS, (7, 14, 21, 30), ("mean", "std", "min", "max"), True))
def _(spark, d):
    return rounded(features.rolling_apart(supplier_panel(spark, d), (7, 14, 21, 30), min_periods=None).drop("y"))


@query("rolling_median", _rolling_sql(ORDERS, WINDOWS, ("median",), False))
def _(spark, d):
    return rounded(features.rolling(orders_panel(spark, d), WINDOWS, ("median",)).drop("y"))


def ema_sql(panel, spans, adjust, shift, prefix):
    """The textbook recursion, row by row."""
    start = "y" if not adjust else "1.0::double"
    num0 = ", ".join(f"y as n{s}, 1.0::double as d{s}" for s in spans)
    step = ", ".join(
        (f"e.n{s} * {(s - 1) / (s + 1)!r}::double + i.y, e.d{s} * {(s - 1) / (s + 1)!r}::double + 1.0" if adjust
         else f"e.n{s} * {(s - 1) / (s + 1)!r}::double + i.y * {2 / (s + 1)!r}::double, 1.0") for s in spans)
    cols = ", ".join(f"n{s} / d{s} as {prefix}{s}" for s in spans)
    out = ", ".join(f"lag({prefix}{s}, {shift}) over {W} as {prefix}{s}" for s in spans)
    return f"""{panel}, i as (select *, row_number() over {W} as rn from h),
e as (select series_id, ds, rn, {num0} from i where rn = 1
      union all select i.series_id, i.ds, i.rn, {step} from e join i on i.series_id = e.series_id and i.rn = e.rn + 1),
v as (select series_id, ds, {cols} from e), x as (select series_id, ds, {out} from v)"""


@query("ema_recursive", select_rounded(ema_sql(ORDERS, (3, 7, 14, 21, 30), False, 1, "ema_"), "x", H,
                                       [f"ema_{s}" for s in (3, 7, 14, 21, 30)], nudge=1.7e-7))
def _(spark, d):
    return rounded(features.ema(orders_panel(spark, d), (3, 7, 14, 21, 30), adjust=False).drop("y"), nudge=1.7e-7)


@query("ema_adjust", select_rounded(ema_sql(ORDERS, (7, 14, 21), True, 1, "ewm_"), "x", H,
                                    [f"ewm_{s}" for s in (7, 14, 21)]))
def _(spark, d):
    return rounded(features.ema(orders_panel(spark, d), (7, 14, 21), adjust=True, prefix="ewm_").drop("y"))


@query("diff", f"with {SUPPLIERS} select series_id, ds, y - lag(y, 1) over {W} as diff_1, y - lag(y, 7) over {W} as diff_7 from h")
def _(spark, d):
    return features.diff(supplier_panel(spark, d), (1, 7)).drop("y")


@query("pct_change", f"with {SUPPLIERS} select series_id, ds, " + ", ".join(
    f"round(y / nullif(lag(y, {n}) over {W}, 0) - 1, 6) + 0.0 as pct_change_{n}" for n in (1, 7)) + " from h")
def _(spark, d):
    return rounded(features.pct_change(supplier_panel(spark, d), (1, 7)).drop("y"))


@query("group_stat", f"""with {SUPPLIERS}, c as (select *, isodow(ds) as wd, month(ds) as mo, (day(ds) - 1) // 7 as wom from h)
select series_id, ds, round(avg(y) over (partition by series_id, wd), 6) as weekday_mean,
 round(stddev_samp(y) over (partition by series_id, wd), 6) as weekday_std,
 round(avg(y) over (partition by series_id, mo), 6) as month_mean,
 round(stddev_samp(y) over (partition by series_id, mo), 6) as month_std,
 round(avg(y) over (partition by series_id, wom), 6) as week_of_month_mean,
 round(avg(y) over (partition by series_id, wd, mo), 6) as weekday_month_mean from c""")
def _(spark, d):
    parts = ["weekday", "month", "week_of_month"]
    h = cal.calendar(supplier_panel(spark, d), parts=parts)
    h = features.group_stat(features.group_stat(h, ["weekday"], ("mean", "std")), ["month"], ("mean", "std"))
    h = features.group_stat(features.group_stat(h, ["week_of_month"]), ["weekday", "month"])
    return rounded(h.drop("y", *parts))


@query("same_weekday_mean", f"""with {SUPPLIERS} select series_id, ds, round(avg(y) over (
  partition by series_id, isodow(ds) order by ds rows between 4 preceding and 1 preceding), 6) as same_weekday_mean from h""")
def _(spark, d):
    return rounded(features.same_weekday_mean(supplier_panel(spark, d)).drop("y"))
