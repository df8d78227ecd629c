"""Blending, intervals, scores, noon adjustment, ledger feedback and back-test."""

import datetime as dt
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidecast.functions.columns import by_day
from tidecast.operators import baselines as b
from tidecast.operators import ensemble as e
from tidecast.operators import feedback as f
from tidecast.operators.asof import forecast_dates, one_by_one
from tidecast.sources.history import materialise

from .panels import EVENTS, ORDERS, SUPPLIERS, TARGET_DATES, events_panel, orders_panel, supplier_panel, targets
from .queries_baselines import BASE, IDS, MO, WD, back, strict_mean, tail
from .registry import query, rounded, select_rounded

MODELS = [
    *[(f"SMA_{n}", "moving_average", tail("avg(y)", n, n)) for n in (3, 5, 7, 14, 21, 30)],
    ("WMA_7", "ml", tail("sum(y * (8 - r)) / 28", 7, 7)),
    ("Median_7", "ml", tail("median(y)", 7)), ("Median_30", "ml", tail("median(y)", 30)),
    ("Weekday_Mean", "seasonal", strict_mean(WD)), ("Weekday_Month_Mean", "seasonal", strict_mean(f"{WD} and {MO}")),
    ("PrevYear_SameWeekday", "previous_year", back(364)),
]
PRED = BASE + ", pr as (" + " union all ".join(
    f"select series_id, target_ds, '{m}' as model, '{fam}' as family, yhat from ({q}) where yhat is not null"
    for m, fam, q in MODELS) + ")"


def gathered(spark, d) -> DataFrame:
    """All models of one pass over the days of each series, a row per target with its list of models."""
    dates = [dt.date.fromisoformat(x) for x in TARGET_DATES]
    recent = [b.sma_recipe(), replace(b.wma_recipe(), family="ml"), replace(b.median_recipe((7, 30)), family="ml")]
    keys = {"Weekday_Mean": ["weekday"], "Weekday_Month_Mean": ["weekday", "month"]}
    # Suppliers are numbers, which is less to gather by than their text.
    made = forecast_dates(supplier_panel(spark, d, text=False), dates, recent, keys, {"PrevYear_SameWeekday": 364})
    return made.withColumn("series_id", F.col("series_id").cast("string"))


def predictions(spark, d) -> DataFrame:
    """All models of ``gathered``, a row each."""
    return one_by_one(gathered(spark, d)).drop("lo", "hi")


def key_rounded(ctes, body, keys, values):
    return select_rounded(f"{ctes}, x as ({body})", "x", keys, values)


@query("valid_predictions", f"""with {PRED} select series_id, target_ds, model, family, round(yhat, 6) as yhat from (
  select * exclude (yhat), case when day(target_ds) = 1 then 'inf'::double when model = 'SMA_3' then 'nan'::double
    when model = 'SMA_5' then -yhat else yhat end as yhat from pr)
  where not isnan(yhat) and not isinf(yhat) and yhat > 0""")
def _(spark, d):
    bad = F.when(F.dayofmonth("target_ds") == 1, float("inf")).when(F.col("model") == "SMA_3", float("nan"))
    p = predictions(spark, d).withColumn("yhat", bad.when(F.col("model") == "SMA_5", -F.col("yhat")).otherwise(F.col("yhat")))
    return rounded(e.valid(p))


STATS = """select s.*, trimmed, iqr_mean from (
    select series_id, target_ds, count(*) as model_count, avg(yhat) as mean, median(yhat) as median, stddev_pop(yhat) as std,
      quantile_cont(yhat, 0.025) as p_low, quantile_cont(yhat, 0.975) as p_high from pr group by 1, 2) s
  join (select series_id, target_ds, avg(yhat) filter (where k > cut and k <= n - cut) as trimmed,
      avg(yhat) filter (where yhat between q1 and q3) as iqr_mean from (
        select *, row_number() over w as k, count(*) over u as n, floor(0.1::double * count(*) over u) as cut,
          quantile_cont(yhat, 0.25) over u as q1, quantile_cont(yhat, 0.75) over u as q3 from pr
        window w as (partition by series_id, target_ds order by yhat), u as (partition by series_id, target_ds)) group by 1, 2) r
  using (series_id, target_ds)"""
STAT_COLS = ["mean", "median", "std", "p_low", "p_high", "trimmed", "iqr_mean"]


@query("ensemble_stats", key_rounded(PRED, STATS, [*IDS, "model_count"], STAT_COLS))
def _(spark, d):
    return rounded(e.ensemble_stats(gathered(spark, d)))


def _rules():
    rows = [f"('{c}', '{t}')" for c, texts in e.CATEGORIES.items() for t in texts]
    return f"(values {', '.join(rows)}) r(category, txt)"


@query("category_summary", key_rounded(PRED, f"""select series_id, target_ds, category, median(yhat) as median, count(*) as n_models
  from (select distinct pr.*, category from pr join {_rules()} on contains(model, txt)) group by 1, 2, 3""",
    [*IDS, "category", "n_models"], ["median"]))
def _(spark, d):
    return rounded(e.category_summary(gathered(spark, d)))


@query("category_summary_exclusive", key_rounded(PRED, """select series_id, target_ds, family as category, median(yhat) as median,
  count(*) as n_models from pr group by 1, 2, 3""", [*IDS, "category", "n_models"], ["median"]))
def _(spark, d):
    return rounded(e.category_summary(gathered(spark, d), exclusive=True))


for _rule, (_m, _mw, _s, _sw) in e.BLENDS.items():
    _agg = {"mean": "avg", "median": "median"}

    @query(f"blend_{_rule}", key_rounded(PRED, f"""select *, coalesce({_mw}::double * ml + {_sw}::double * stat, ml, stat) as yhat from (
      select series_id, target_ds, {_agg[_m]}(yhat) filter (where family = 'ml') as ml,
        {_agg[_s]}(yhat) filter (where family <> 'ml') as stat from pr group by 1, 2)""", IDS, ["ml", "stat", "yhat"]))
    def _(spark, d, rule=_rule):
        return rounded(e.blend(gathered(spark, d), rule))


@query("blend_statistical", key_rounded(PRED, "select series_id, target_ds, median(yhat) as yhat from pr group by 1, 2", IDS, ["yhat"]))
def _(spark, d):
    return rounded(e.blend(gathered(spark, d), "statistical").select(*IDS, "yhat"))


FOUR = {"similar": "SMA_7", "pattern": "SMA_14", "prev_year": "Weekday_Mean", "trend": "SMA_30"}


@query("blend_fixed", key_rounded(PRED, """select a.series_id, a.target_ds, ml, stat, coalesce(0.65::double * ml + 0.35::double * stat, stat) as yhat,
    sd / (m + 1e-8) as uncertainty from (
  select v.series_id, v.target_ds, max(yhat) filter (where w = 0) as ml, sum(yhat * w) as stat, stddev_pop(yhat) as sd, avg(yhat) as m from (
    select series_id, target_ds, yhat, case model when 'SMA_7' then 0.35::double when 'SMA_14' then 0.2::double
      when 'Weekday_Mean' then 0.25::double when 'SMA_30' then 0.2::double else 0 end as w
    from pr where model in ('SMA_7', 'SMA_14', 'Weekday_Mean', 'SMA_30', 'WMA_7')) v group by 1, 2) a""",
    IDS, ["ml", "stat", "yhat", "uncertainty"]))
def _(spark, d):
    p = predictions(spark, d)
    names = F.lit(None).cast("string")
    for ours, theirs in FOUR.items():
        names = F.when(F.col("model") == theirs, ours).otherwise(names)
    four = p.withColumn("model", names).filter(F.col("model").isNotNull())
    one = p.filter(F.col("model") == "WMA_7").withColumn("std", F.lit(0.0))
    return rounded(e.blend_fixed(four, one).drop("std"))


NOON = f"""{EVENTS}, ra as (select series_id, coalesce(avg(partial_y / y) filter (where partial_y > 0 and y > 0), 0.45::double) as ratio from h group by 1)"""


@query("noon_ratio", key_rounded(NOON, "select * from ra", ["series_id"], ["ratio"]))
def _(spark, d):
    return rounded(e.noon_ratio(events_panel(spark, d)))


@query("noon_adjust", key_rounded(NOON, """select h.series_id, ds as target_ds, case when partial_y > 0 and day(ds) % 2 = 0
    then (l * 0.35::double) + (partial_y / ratio) * (1 - 0.35::double) else l end as yhat from (
  select *, lag(y) over (partition by series_id order by ds) as l from h) h join ra using (series_id) where l is not null""", IDS, ["yhat"]))
def _(spark, d):
    h = events_panel(spark, d)
    naive = h.select("series_id", F.col("ds").alias("target_ds"), F.lag("y").over(by_day()).alias("yhat")).dropna()
    noon = h.filter(F.dayofmonth("ds") % 2 == 0).select("series_id", F.col("ds").alias("target_ds"), F.col("partial_y").alias("noon"))
    return rounded(e.noon_adjust(naive, noon, e.noon_ratio(h), e.NOON_SHARE["enhanced"]))


RECORD = [*IDS, "final_prediction", "pred_lower", "pred_upper"]
INTERVALS = {
    "percentile": ("p_low", "p_high"),
    "sigma": ("greatest(0, yhat - 1.96::double * std)", "yhat + 1.96::double * std"),
    "relative": tuple(f"{side} 1.96::double * case when std > 1e-9 then (yhat * 0.08::double + std) / 2 else yhat * 0.08::double end{end}"
                 for side, end in (("greatest(0, yhat -", ")"), ("yhat +", ""))),
}
for _kind, (_lo, _hi) in INTERVALS.items():

    @query(f"interval_{_kind}", key_rounded(PRED, f"""select series_id, target_ds, yhat, {_lo} as lo, {_hi} as hi
      from (select *, median as yhat from ({STATS}))""", IDS, ["yhat", "lo", "hi"]))
    def _(spark, d, kind=_kind):
        s = e.ensemble_stats(gathered(spark, d)).withColumn("yhat", F.col("median"))
        return rounded(e.interval(s, kind).select(*IDS, "yhat", "lo", "hi"))


def _ladder_sql(value, steps, last):
    return "case " + " ".join(f"when {value} < {x} then {s}" for x, s in steps) + f" else {last} end"


for _name, _scores in (("statistical", (95, 85, 75, 65)), ("hybrid", (90, 80, 70, 60))):

    @query(f"confidence_cv_{_name}", key_rounded(PRED, f"""select series_id, target_ds, std / mean * 100 as cv,
      {_ladder_sql('std / mean * 100', list(zip((5, 10, 15), _scores)), _scores[3])} as confidence_score from ({STATS})""",
        [*IDS, "confidence_score"], ["cv"]))
    def _(spark, d, rule=_name):
        return rounded(e.confidence_cv(e.ensemble_stats(gathered(spark, d)), rule).select(*IDS, "cv", "confidence_score"))


FINAL = f"""select series_id, target_ds, cast(trunc(median) as bigint) as final_prediction, cast(trunc(p_low) as bigint) as pred_lower,
  cast(trunc(p_high) as bigint) as pred_upper, {_ladder_sql('std / mean * 100', [(5, 95), (10, 85), (15, 75)], 65)} as confidence_score,
  std / mean * 100 as cv, model_count from ({STATS})"""


@query("final_record", key_rounded(PRED, FINAL, [*RECORD, "confidence_score", "model_count"], ["cv"]))
def _(spark, d):
    s = e.confidence_cv(e.ensemble_stats(gathered(spark, d)).withColumn("yhat", F.col("median")))
    return rounded(e.final_record(e.interval(s, "percentile"), "cv", "model_count"))


# a ledger of naive forecasts; the last two days of each series are not known yet
LEDGER = f"""{SUPPLIERS}, nv as (select series_id, ds, y, lag(y) over w as fc, row_number() over w as seq,
    count(*) over (partition by series_id) as n from h window w as (partition by series_id order by ds)),
  led as (select series_id, cast(seq as bigint) as seq, ds as prediction_date, fc as final_prediction,
    case when seq <= n - 2 then y end as actual_value, case when seq <= n - 2 then fc - y end as error,
    case when seq <= n - 2 then (fc - y) / y * 100 end as error_pct from nv where fc is not null),
  done as (select *, row_number() over (partition by series_id order by seq desc) as k from led where actual_value is not null)"""


def ledger(spark, d) -> DataFrame:
    every = Window.partitionBy("series_id")
    x = supplier_panel(spark, d).select(
        "series_id", "ds", "y", F.lag("y").over(by_day()).alias("final_prediction"),
        F.row_number().over(by_day()).cast("bigint").alias("seq"), F.count("y").over(every).alias("n"))
    actual = F.when(F.col("seq") <= F.col("n") - 2, F.col("y"))
    error = F.col("final_prediction") - actual
    return x.filter(F.col("final_prediction").isNotNull()).select(
        "series_id", "seq", F.col("ds").alias("prediction_date"), "final_prediction",
        actual.alias("actual_value"), error.alias("error"), (error / actual * 100).alias("error_pct"))


BIAS = """select series_id, count(*) as sample_count, avg(error) as bias, coalesce(stddev_samp(error), 0) as std,
  abs(avg(error)) > case when stddev_samp(error) > 0 then greatest(10, 0.5 * stddev_samp(error)) else 10 end as detected,
  case when avg(error) > 0 then 'over' else 'under' end as direction from done where k <= {n} group by 1 having count(*) >= 3"""

for _n in (10, 30):

    @query(f"detect_bias_{_n}", key_rounded(LEDGER, BIAS.format(n=_n), ["series_id", "sample_count", "detected", "direction"], ["bias", "std"]))
    def _(spark, d, n=_n):
        return rounded(f.detect_bias(ledger(spark, d), n))


@query("apply_correction", key_rounded(LEDGER, f"""select series_id, target_ds, yhat + correction as yhat, correction from (
  select series_id, target_ds, yhat, case when detected then -bias * case when score > 0.5 then 0.3::double when score > 0.2 then 0.5::double else 0.7::double end
    else 0 end as correction from (select series_id, prediction_date as target_ds, final_prediction as yhat, (seq % 10) / 10.0 as score
      from led where actual_value is null) left join ({BIAS.format(n=10)}) using (series_id))""", IDS, ["yhat", "correction"]))
def _(spark, d):
    led = ledger(spark, d)
    fc = led.filter(F.col("actual_value").isNull()).select(
        "series_id", F.col("prediction_date").alias("target_ds"), F.col("final_prediction").alias("yhat"),
        (F.col("seq") % 10 / 10).alias("score"))
    return rounded(f.apply_correction(fc, f.detect_bias(led), "score").drop("score"))


ACC = """select series_id, count(*) as total, avg(abs(error)) as mae, avg(abs(error_pct)) as mae_pct, median(error_pct) as median_error,
  count(*) filter (where abs(error_pct) <= 5) as within_5pct, count(*) filter (where abs(error_pct) <= 10) as within_10pct from done group by 1"""


@query("accuracy", key_rounded(LEDGER, ACC, ["series_id", "total", "within_5pct", "within_10pct"], ["mae", "mae_pct", "median_error"]))
def _(spark, d):
    return rounded(f.accuracy(ledger(spark, d)))


@query("confidence_mape", key_rounded(LEDGER, f"""select series_id, {_ladder_sql('mae_pct / 30', [(5, 88), (10, 78)], 68)} as confidence_score
  from ({ACC})""", ["series_id", "confidence_score"], []))
def _(spark, d):
    acc = f.accuracy(ledger(spark, d)).withColumn("mae_pct", F.col("mae_pct") / 30)
    return e.confidence_mape(acc).select("series_id", "confidence_score")


@query("tuner_correction", key_rounded(LEDGER, "select series_id, case when count(*) >= 5 then -0.5 * avg(error) else 0 end as correction from done where k <= 10 group by 1",
                                       ["series_id"], ["correction"]))
def _(spark, d):
    return rounded(f.tuner_correction(ledger(spark, d)))


@query("accuracy_score", key_rounded(LEDGER, """select series_id, case when count(*) >= 3 then greatest(0, least(100, 100 - 2 * avg(abs(error_pct)))) else 70 end as score
  from (select * replace (error_pct / 20 as error_pct) from done) where k <= 30 group by 1""", ["series_id"], ["score"]))
def _(spark, d):
    return rounded(f.accuracy_score(ledger(spark, d).withColumn("error_pct", F.col("error_pct") / 20)))


@query("memory_correction", key_rounded(LEDGER, """select series_id, target_ds, yhat + c as yhat, c as memory_correction from (
  select l.series_id, prediction_date as target_ds, final_prediction as yhat, case when abs(m) > 0.02 then final_prediction * m else 0 end as c
  from led l join (select series_id, avg((actual_value - final_prediction) / actual_value) as m from done where k <= 10 group by 1) using (series_id)
  where actual_value is null)""", IDS, ["yhat", "memory_correction"]))
def _(spark, d):
    led = ledger(spark, d)
    fc = led.filter(F.col("actual_value").isNull()).select(
        "series_id", F.col("prediction_date").alias("target_ds"), F.col("final_prediction").alias("yhat"))
    return rounded(f.memory_correction(fc, led))


@query("retain", f"""with {LEDGER} select series_id, seq, prediction_date, final_prediction, actual_value, error, round(error_pct, 6) as error_pct
  from led qualify row_number() over (partition by series_id order by seq desc) <= 100""")
def _(spark, d):
    return rounded(f.retain(ledger(spark, d), 100))


BACKTEST = """{panel}, bt as (select a.series_id, a.ds, any_value(a.y) as y, count(*) as n_obs, avg(b.y) as al,
    avg(b.y) filter (where isodow(b.ds) = isodow(a.ds) and month(b.ds) = month(a.ds)) as q1,
    avg(b.y) filter (where year(b.ds) = year(a.ds) - 1 and month(b.ds) = month(a.ds)) as q2,
    avg(b.y) filter (where b.ds >= a.ds - 30) as q3
  from (select *, max(ds) over (partition by series_id) as mx, min(ds) over (partition by series_id) as mn from h) a
  join h b on b.series_id = a.series_id and b.ds < a.ds
  where a.ds >= greatest(a.mx - 730, a.mn + 90) group by 1, 2 having count(*) >= 30),
  bb as (select series_id, ds, y, coalesce(q1, al) as p1, coalesce(q2, q1, al) as p2, coalesce(q3, q1, al) as p3 from bt),
  ba as (select *, p1 * 0.4::double + p2 * 0.4::double + p3 * 0.2::double as base from bb)"""


@query("backtest_base", select_rounded(BACKTEST.format(panel=SUPPLIERS), "ba", ["series_id", "ds"], ["y", "p1", "p2", "p3", "base"]))
def _(spark, d):
    return rounded(f.backtest_base(supplier_panel(spark, d)))


CORRECTED = BACKTEST.format(panel=ORDERS) + """, o as (select *, row_number() over (partition by series_id order by ds) as rn from ba),
  wk as (select series_id, ds, rn, y, base, p1, 0.0::double as correction, [base - y] as errs from o where rn = 1
    union all
    select series_id, ds, rn, y, base, p1, c, list_slice(list_append(errs, base + c - y), greatest(len(errs) - 8, 1), len(errs) + 1) from (
      select w.series_id, o.ds, o.rn, o.y, o.base, o.p1, w.errs, case when len(w.errs) >= 3 and abs(list_avg(w.errs)) >
          greatest(10, 0.5::double * coalesce(list_stddev_samp(w.errs), 0)) then -list_avg(w.errs) * 0.7::double else 0 end as c
      from wk w join o on o.series_id = w.series_id and o.rn = w.rn + 1)),
  x as (select series_id, ds as prediction_date, base + correction as final_prediction, (base + correction) * 0.85::double as pred_lower,
    (base + correction) * 1.15::double as pred_upper, 70 as confidence_score, base as ml_prediction, p1 as stat_prediction,
    y as actual_value, base + correction - y as error, (base + correction - y) / y * 100 as error_pct,
    correction <> 0 as bias_correction_applied, correction as bias_correction_amount, cast(ds - date '1970-01-01' as bigint) as seq from wk)"""


@query("backtest_corrected", select_rounded(CORRECTED, "x", ["series_id", "prediction_date", "confidence_score", "bias_correction_applied", "seq"],
    ["final_prediction", "pred_lower", "pred_upper", "ml_prediction", "stat_prediction", "actual_value", "error", "error_pct", "bias_correction_amount"]))
def _(spark, d):
    return rounded(f.backtest_corrected(f.backtest_base(orders_panel(spark, d))))
