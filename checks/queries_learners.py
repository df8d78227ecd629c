"""Feature matrices, folds, pooled models, weights and whole forecasts."""

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidecast.functions.columns import by_day
from tidecast.functions.trees import Spec
from tidecast.operators import learners as ml
from tidecast.operators import trees
from tidecast.plans import features as pf
from tidecast.plans import forecast as plan
from tidecast.plans.presets import MODELS
from tidecast.sources.history import materialise

from .panels import ORDERS, SUPPLIERS, TARGETS, orders_panel, supplier_panel, targets
from .queries_analogs import SIMILAR, STRICT_ROWS, growth_sql, pattern_sql, recent_sql
from .queries_baselines import BASE, PAST
from .queries_ensemble import ACC, BIAS, LEDGER, PRED, ledger, predictions
from .queries_ensemble import MODELS as _P
from .registry import query, rounded, select_rounded

H = ["series_id", "ds"]
T = ["series_id", "target_ds"]

_W = "(partition by series_id order by ds)"
_LAGS = (1, 7, 14, 28, 365)
_MATRIX = ["level", *[f"lag_{n}" for n in _LAGS], *[f"rolling_{s}_{n}" for n in (7, 14, 30) for s in ("mean", "std")]]


@query("feature_matrix", select_rounded(f"""{SUPPLIERS}, x as (select series_id, ds,
  coalesce(avg(y) over (partition by series_id order by ds rows between unbounded preceding and 1 preceding), 0) as level,
  {', '.join(f"coalesce(lag(y, {n}) over {_W}, 0) as lag_{n}" for n in _LAGS)},
  {', '.join(f"coalesce({a}(y) over (partition by series_id order by ds rows between {n} preceding and 1 preceding), 0) as rolling_{s}_{n}"
    for n in (7, 14, 30) for s, a in (("mean", "avg"), ("std", "stddev_samp")))} from h)""", "x", H, _MATRIX))
def _(spark, d):
    raw = vector_to_array("raw")
    rows = ml.assemble(pf.feature_frame(supplier_panel(spark, d), "optimized"), _MATRIX)
    return rounded(rows.select(*H, *[raw[i].alias(c) for i, c in enumerate(_MATRIX)]))


@query("serving_rows", select_rounded(f"""{BASE}, x as (select series_id, target_ds, avg(y) as level,
  {', '.join(f"max(y) filter (where r = {n}) as lag_{n}" for n in (1, 2, 3, 7, 14, 21, 28))},
  {', '.join(f"case when count(*) >= {n} then {a}(y) filter (where r <= {n}) end as rolling_{s}_{n}" for n in (7, 30)
    for s, a in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))},
  avg(y) filter (where isodow(ds) = isodow(target_ds) and rw <= 4) as same_weekday_mean, cast(count(*) as integer) as trend,
  cast(isodow(target_ds) - 1 as integer) as weekday, cast(day(target_ds) >= 25 as integer) as is_month_end from p group by 1, 2)""",
    "x", [*T, "trend", "weekday", "is_month_end"],
    ["level", *[f"lag_{n}" for n in (1, 2, 3, 7, 14, 21, 28)],
     *[f"rolling_{s}_{n}" for n in (7, 30) for s in ("mean", "std", "min", "max")], "same_weekday_mean"]))
def _(spark, d):
    h = supplier_panel(spark, d)
    rows = pf.serving_rows(h, targets(h), "complete")
    return rounded(rows.select(*T, "trend", "weekday", "is_month_end", "level", *[f"lag_{n}" for n in (1, 2, 3, 7, 14, 21, 28)],
                               *[f"rolling_{s}_{n}" for n in (7, 30) for s in ("mean", "std", "min", "max")], "same_weekday_mean"))


@query("serving_rows_carry", select_rounded(f"""{SUPPLIERS}, {TARGETS}, l as (select *, lag(y) over {_W} as lag_1, lag(y, 7) over {_W} as lag_7 from h),
  x as (select t.series_id, t.target_ds, arg_max({{'v': lag_1}}, ds).v as lag_1, arg_max({{'v': lag_7}}, ds).v as lag_7,
    cast(month(target_ds) as integer) as month, cast(arg_max(quarter(ds), ds) as integer) as quarter
    from t join l on l.series_id = t.series_id and l.ds < t.target_ds group by 1, 2)""",
    "x", [*T, "month", "quarter"], ["lag_1", "lag_7"]))
def _(spark, d):
    h = supplier_panel(spark, d)
    return rounded(pf.serving_rows(h, targets(h), "optimized", "carry").select(*T, "month", "quarter", "lag_1", "lag_7"))


@query("fold_ids", f"""with {SUPPLIERS}, dd as (select ds, row_number() over (order by ds) - 1 as i, count(*) over () as n
  from (select distinct ds from h)), f as (select ds, case when i < n - 5 * (n // 6) then 0
  else (i - (n - 5 * (n // 6))) // (n // 6) + 1 end as fold from dd)
select series_id, h.ds, cast(fold as integer) as fold from h join f on h.ds = f.ds""")
def _(spark, d):
    return ml.fold_ids(supplier_panel(spark, d), 5).select(*H, "fold")


def _lagged(spark, d, names=("lag_1", "lag_7")):
    """Two lags as the raw vector, rows with both known; written once, as every fit passes over them several times."""
    frame = pf.feature_frame(supplier_panel(spark, d), "optimized")
    return materialise(ml.assemble(frame.select(*H, "y", *names), list(names), "drop"))


LAGGED = f"""{SUPPLIERS}, l as (select series_id, ds, y, lag(y, 1) over {_W} as lag_1, lag(y, 7) over {_W} as lag_7 from h),
  f as materialized (select * from l where lag_7 is not null)"""


@query("standard_scale", select_rounded(f"""{LAGGED}, x as (select series_id, ds, (lag_1 - avg(lag_1) over ()) / stddev_samp(lag_1) over () as z1,
  (lag_7 - avg(lag_7) over ()) / stddev_samp(lag_7) over () as z7 from f)""", "x", H, ["z1", "z7"]))
def _(spark, d):
    rows = _lagged(spark, d)
    z = vector_to_array("features")
    out = ml.fit_scaler(rows, "standard").transform(rows)
    return rounded(out.select(*H, z[0].alias("z1"), z[1].alias("z7")))


_IQR = "(lag_{0} - quantile_cont(lag_{0}, 0.5) over ()) / (quantile_cont(lag_{0}, 0.75) over () - quantile_cont(lag_{0}, 0.25) over ())"


@query("robust_scale", select_rounded(
    f"{LAGGED}, x as (select series_id, ds, {_IQR.format(1)} as z1, {_IQR.format(7)} as z7 from f)", "x", H, ["z1", "z7"]))
def _(spark, d):
    rows = _lagged(spark, d)
    z = vector_to_array("features")
    out = ml.fit_scaler(rows, "robust").transform(rows)
    return rounded(out.select(*H, z[0].alias("z1"), z[1].alias("z7")))


# sums around the means, in one row
_SUMS = f"""{LAGGED}, m as materialized (select *, avg(y) over () as my, avg(lag_1) over () as m1, avg(lag_7) over () as m7, count(*) over () as n from f),
  s as materialized (select max(n) as n, sum((lag_1 - m1) * (lag_1 - m1)) as a, sum((lag_1 - m1) * (lag_7 - m7)) as b,
    sum((lag_7 - m7) * (lag_7 - m7)) as c, sum((lag_1 - m1) * (y - my)) as u, sum((lag_7 - m7) * (y - my)) as v from m)"""


@query("ridge", select_rounded(f"""{_SUMS},
  w as materialized (select (u * (c + 100) - v * b) / ((a + 100) * (c + 100) - b * b) as w1, (v * (a + 100) - u * b) / ((a + 100) * (c + 100) - b * b) as w7 from s),
  x as (select series_id, ds, my + (select w1 from w) * (lag_1 - m1) + (select w7 from w) * (lag_7 - m7) as prediction from m)""", "x", H, ["prediction"]))
def _(spark, d):
    rows = _lagged(spark, d).withColumnRenamed("raw", "features")
    model = ml.fit_model(rows, "ridge", dict(alpha=100.0))
    return rounded(model.transform(rows).select(*H, "prediction"))


def descent_sql(l1, l2):
    """Two coordinates in turn, one row of the recursion per round, until both stand still."""
    soft = "sign({0}) * greatest(abs({0}) - " + f"{l1!r}::double, 0)"
    one, seven = soft.format("(u - b * w7) / n"), soft.format("(v - b * n1) / n")
    return f"""{_SUMS}, it as (select 0 as k, 0.0::double as w1, 0.0::double as w7, false as done from s
    union all
    select k + 1, n1, n7, abs(n1 - w1) + abs(n7 - w7) < 1e-14 * (abs(n1) + abs(n7)) + 1e-300 from (
      select *, {seven} / (c / n + {l2!r}::double) as n7 from (
        select it.*, s.*, {one} / (a / n + {l2!r}::double) as n1 from it, s where not done and k < 500))),
  w as materialized (select w1, w7 from it order by k desc limit 1),
  x as (select series_id, ds, my + (select w1 from w) * (lag_1 - m1) + (select w7 from w) * (lag_7 - m7) as prediction from m)"""


for _name, _settings, _l1, _l2 in (
    ("lasso", dict(alpha=0.5), 0.5, 0.0), ("elastic_net", dict(alpha=4.0, l1_ratio=0.25), 1.0, 3.0),
):

    @query(_name, select_rounded(descent_sql(_l1, _l2), "x", H, ["prediction"]))
    def _(spark, d, kind=_name, settings=_settings):
        rows = _lagged(spark, d).withColumnRenamed("raw", "features")
        return rounded(ml.fit_model(rows, kind, settings).transform(rows).select(*H, "prediction"))


# the evidence iteration on two features, one row of the recursion per round
_M11, _M12, _M22 = "(noise * a + prior)", "(noise * b)", "(noise * c + prior)"
_DET = f"({_M11} * {_M22} - {_M12} * {_M12})"
EVIDENCE = f"""{LAGGED}, m as materialized (select avg(y) as my, avg(lag_1) as m1, avg(lag_7) as m7 from f),
  s as materialized (select count(*) as n, sum((lag_1 - m1) * (lag_1 - m1)) as a, sum((lag_1 - m1) * (lag_7 - m7)) as b,
    sum((lag_7 - m7) * (lag_7 - m7)) as c, sum((lag_1 - m1) * (y - my)) as u, sum((lag_7 - m7) * (y - my)) as v,
    sum((y - my) * (y - my)) as sq from f, m),
  it as (select 0 as k, null::double as w1, null::double as w7, n / sq as noise, 1.0::double as prior, false as done from s
    union all
    select k + 1, n1, n7, case when near then noise else (n - used + 2e-6) / (greatest(sq - 2 * (n1 * u + n7 * v)
        + n1 * n1 * a + 2 * n1 * n7 * b + n7 * n7 * c, 0) + 2e-6) end,
      case when near then prior else (used + 2e-6) / (n1 * n1 + n7 * n7 + 2e-6) end, near from (
      select *, coalesce(abs(n1 - w1) + abs(n7 - w7) < 1e-3, false) as near from (
        select it.*, s.*, noise * ({_M22} * u - {_M12} * v) / {_DET} as n1, noise * ({_M11} * v - {_M12} * u) / {_DET} as n7,
          noise * (a * {_M22} - 2 * b * {_M12} + c * {_M11}) / {_DET} as used from it, s where not done and k < 300))),
  fin as materialized (select it.*, {_M22} / {_DET} as c11, -{_M12} / {_DET} as c17, {_M11} / {_DET} as c77 from it, s where done),
  x as (select series_id, ds, my + w1 * (lag_1 - m1) + w7 * (lag_7 - m7) as prediction,
    sqrt(power(lag_1 - m1, 2) * c11 + 2 * (lag_1 - m1) * (lag_7 - m7) * c17 + power(lag_7 - m7, 2) * c77 + 1 / noise) as prediction_sd
    from f, m, fin)"""


@query("bayesian_ridge_two", select_rounded(EVIDENCE, "x", H, ["prediction", "prediction_sd"]))
def _(spark, d):
    rows = _lagged(spark, d).withColumnRenamed("raw", "features")
    out = ml.fit_model(rows, "bayesian_ridge", {}).transform(rows)
    return rounded(out.select(*H, "prediction", "prediction_sd"))


# three expanding folds by day; standardised on the training days, ridge by its normal equations
CV_RIDGE = f"""{LAGGED}, dd as (select ds, row_number() over (order by ds) - 1 as i, count(*) over () as n from (select distinct ds from f)),
  fo as (select ds, case when i < n - 3 * (n // 4) then 0 else (i - (n - 3 * (n // 4))) // (n // 4) + 1 end as fold from dd),
  ff as materialized (select f.*, fold from f join fo using (ds)),
  tr as materialized (select k, ff.* from (values (1), (2), (3)) v(k) join ff on fold < k),
  st as materialized (select k, avg(y) as my, avg(lag_1) as m1, avg(lag_7) as m7, stddev_samp(lag_1) as s1, stddev_samp(lag_7) as s7 from tr group by 1),
  sm as materialized (select k, sum(power((lag_1 - m1) / s1, 2)) + 1 as a, sum((lag_1 - m1) / s1 * (lag_7 - m7) / s7) as b,
    sum(power((lag_7 - m7) / s7, 2)) + 1 as c, sum((lag_1 - m1) / s1 * (y - my)) as u, sum((lag_7 - m7) / s7 * (y - my)) as v
    from tr join st using (k) group by 1),
  x as (select 'Ridge' as model, cast(st.k as bigint) as fold, avg(abs(my + (u * c - v * b) / (a * c - b * b) * (lag_1 - m1) / s1
      + (v * a - u * b) / (a * c - b * b) * (lag_7 - m7) / s7 - y)) as mae
    from ff join st on st.k = ff.fold join sm on sm.k = st.k group by 2)"""


@query("ts_cv_ridge", select_rounded(CV_RIDGE, "x", ["model", "fold"], ["mae"]))
def _(spark, d):
    scores = ml.ts_cv(_lagged(spark, d), {"Ridge": ("ridge", dict(alpha=1.0))}, 3, "standard")
    return rounded(scores.withColumn("fold", F.col("fold").cast("bigint")))


# stumps on two lags of the orders panel: the cut points are quantiles of the columns, the best one lessens the squared
# error most (ties to the first column, then to the lowest cut)
_PANEL = f"""{ORDERS}, l as (select series_id, ds, y, lag(y, 1) over {_W} as lag_1, lag(y, 7) over {_W} as lag_7 from h),
  f as materialized (select * from l where lag_7 is not null),
  cuts as materialized (select distinct c, v from (
    select 1 as c, unnest(quantile_disc(lag_1, [{', '.join(f'{i}/32' for i in range(1, 32))}])) as v from f
    union all select 7, unnest(quantile_disc(lag_7, [{', '.join(f'{i}/32' for i in range(1, 32))}])) from f))"""


def stump_sql(name, source, target):
    """The best cut ``name`` of a target and what either side says, ``name``_p per row of ``source``."""
    return f"""{name}_n as materialized (select c, v, count(*) filter (where (case c when 1 then lag_1 else lag_7 end) <= v) as n,
      sum({target}) filter (where (case c when 1 then lag_1 else lag_7 end) <= v) as s, count(*) as n_all, sum({target}) as s_all
    from {source} cross join cuts group by 1, 2),
  {name} as materialized (select c, v, s / n as low, (s_all - s) / (n_all - n) as high from {name}_n where n > 0 and n < n_all
    order by round(s * s / n + (s_all - s) * (s_all - s) / (n_all - n), 4) desc, c, v limit 1),
  {name}_p as materialized (select q.*, case when (case k.c when 1 then lag_1 else lag_7 end) <= k.v then low else high end as {name}_said
    from {source} q cross join {name} k)"""


def _panel_lags(spark, d):
    frame = pf.feature_frame(orders_panel(spark, d), "optimized")
    return ml.assemble(frame.select(*H, "y", "lag_1", "lag_7"), ["lag_1", "lag_7"], "drop")


@query("tree_stump", select_rounded(f"""{_PANEL}, {stump_sql("one", "f", "y")},
  x as (select series_id, ds, one_said as prediction from one_p)""", "x", H, ["prediction"]))
def _(spark, d):
    rows = _panel_lags(spark, d)
    model = trees.fit(rows, {"stump": Spec("mean", 1, 1)})["stump"]
    return rounded(model.transform(rows).select(*H, "prediction"))


@query("boosted_stumps", select_rounded(f"""{_PANEL}, a as materialized (select *, avg(y) over () as start from f),
  {stump_sql("one", "a", "(y - start)")}, {stump_sql("two", "one_p", "(y - start - 0.5::double * one_said)")},
  x as (select series_id, ds, start + 0.5::double * (one_said + two_said) as prediction from two_p)""", "x", H, ["prediction"]))
def _(spark, d):
    rows = _panel_lags(spark, d)
    model = trees.fit(rows, {"two": Spec("sum", 2, 1, 0.5)}, task_bytes=0)["two"]
    return rounded(model.transform(rows).select(*H, "prediction"))


# two rounds of AdaBoost.R2: rows weigh more the worse the first stump fits them; the weighted median of two votes is
# that of the larger one, or of the lesser value if they are equal
def _weighted(name, source, weight):
    return f"""{name}_n as materialized (select c, v, sum({weight}) filter (where (case c when 1 then lag_1 else lag_7 end) <= v) as n,
      sum({weight} * y) filter (where (case c when 1 then lag_1 else lag_7 end) <= v) as s, sum({weight}) as n_all, sum({weight} * y) as s_all
    from {source} cross join cuts group by 1, 2),
  {name} as materialized (select c, v, s / n as low, (s_all - s) / (n_all - n) as high from {name}_n where n > 0 and n < n_all
    order by round(s * s / n + (s_all - s) * (s_all - s) / (n_all - n), 4) desc, c, v limit 1),
  {name}_p as materialized (select q.*, case when (case k.c when 1 then lag_1 else lag_7 end) <= k.v then low else high end as {name}_said
    from {source} q cross join {name} k),
  {name}_e as materialized (select *, abs(y - {name}_said) as {name}_err, max(abs(y - {name}_said)) over () as {name}_worst from {name}_p),
  {name}_l as materialized (select *, sum({weight} * {name}_err / {name}_worst) over () / sum({weight}) over () as {name}_loss from {name}_e)"""


@query("adaboost_two_rounds", select_rounded(f"""{_PANEL}, {_weighted("one", "f", "1.0::double")},
  w as materialized (select *, power(one_loss / (1 - one_loss), 1 - one_err / one_worst) as weight from one_l),
  {_weighted("two", "w", "weight")},
  x as (select series_id, ds, case when ln((1 - one_loss) / one_loss) > ln((1 - two_loss) / two_loss) then one_said
    when ln((1 - one_loss) / one_loss) < ln((1 - two_loss) / two_loss) then two_said else least(one_said, two_said) end as prediction from two_l)""",
    "x", H, ["prediction"]))
def _(spark, d):
    rows = _panel_lags(spark, d)
    model = trees.fit(rows, {"two": Spec("median", 2, 1, 1.0, 0.0)}, task_bytes=0)["two"]
    return rounded(model.transform(rows).select(*H, "prediction"))


TRAINED: dict = {}


def _trained(spark, d, version, model=None):
    """The history of the orders panel and the models of a version, or the one that is asked for, as the preset has
    it; trained once per session and folder."""
    whole, key = ((spark.sparkContext.applicationId, d, version, m) for m in (None, model))
    if whole in TRAINED:
        return TRAINED[whole]
    if key not in TRAINED:
        h = materialise(orders_panel(spark, d))
        TRAINED[key] = h, plan.train(h, version, {model: MODELS[version][model]} if model else None)
    return TRAINED[key]


for _name, _model in {
    "lasso_complete": "Lasso", "elastic_net_complete": "ElasticNet", "bayesian_ridge": "BayesianRidge", "huber": "HuberRegressor",
    "random_forest": "RandomForest", "extra_trees": "ExtraTrees", "gradient_boosting": "GradientBoosting",
    "adaboost_r2": "AdaBoost",
}.items():

    @query(_name)
    def _(spark, d, model=_model):
        _, trained = _trained(spark, d, "complete", model)
        rows = trained.prep.transform(trained.rows)
        return trained.models[model].transform(rows).select(*H, "prediction")


@query("ts_cv")
def _(spark, d):
    return _trained(spark, d, "optimized")[1].scores


# naive models scored by month: MAE of repeating the value some rows back
SCORES = SUPPLIERS + ", sc as (" + " union all ".join(
    f"select 'lag_{k}' as model, month(ds) as fold, avg(abs(y - b)) as mae from (select ds, y, lag(y, {k}) over {_W} as b from h) where b is not null group by 2"
    for k in range(1, 8)) + "), su as (select model, avg(mae) as mae, stddev_pop(mae) as std from sc group by 1), tw as (select sum(1 / (mae + 1)) as t from su)"


def _scores(spark, d):
    x = supplier_panel(spark, d)
    w = by_day()
    x = x.select("ds", "y", *[F.lag("y", k).over(w).alias(f"lag_{k}") for k in range(1, 8)])
    long = x.unpivot(["ds", "y"], [f"lag_{k}" for k in range(1, 8)], "model", "b").dropna()
    return long.groupBy("model", F.month("ds").alias("fold")).agg(F.avg(F.abs(F.col("y") - F.col("b"))).alias("mae"))


@query("mae_weights", select_rounded(SCORES + ", x as (select su.*, 1 / (mae + 1) / t as weight from su, tw)", "x", ["model"], ["mae", "std", "weight"]))
def _(spark, d):
    return rounded(ml.mae_weights(ml.summarise(_scores(spark, d))))


@query("top_models", select_rounded(SCORES + ", x as (select * from su order by mae, model limit 5)", "x", ["model"], ["mae", "std"]))
def _(spark, d):
    return rounded(ml.top_models(ml.summarise(_scores(spark, d)), 5))


@query("leaderboard", select_rounded(SCORES + ", x as (select su.*, 100 / (mae + 1) / t as weight from su, tw)", "x", ["model"], ["mae", "std", "weight"]))
def _(spark, d):
    return rounded(ml.leaderboard(ml.summarise(_scores(spark, d))))


_NAMES = ", ".join(f"('{m}', {len(m)} / 10.0::double)" for m, _, _ in _P)


@query("weighted_ensemble", select_rounded(f"""{PRED}, w as (select * from (values {_NAMES}) v(model, weight)),
  x as (select series_id, target_ds, sum(yhat * weight) / sum(weight) as yhat, stddev_pop(yhat) as std, count(*) as model_count
    from pr join w using (model) group by 1, 2)""", "x", [*T, "model_count"], ["yhat", "std"]))
def _(spark, d):
    p = predictions(spark, d)
    weights = spark.createDataFrame([(m, len(m) / 10) for m, _, _ in _P], "model string, weight double")
    return rounded(ml.weighted_ensemble(p, weights))


@query("ml_predictions")
def _(spark, d):
    h, trained = _trained(spark, d, "complete")
    return plan.ml_predictions(trained, h, targets(h))


@query("statistical_predictions")
def _(spark, d):
    h = materialise(orders_panel(spark, d))
    return plan.statistical_predictions(h, targets(h))


@query("forecast_statistical")
def _(spark, d):
    h = materialise(orders_panel(spark, d))
    return plan.forecast(h, targets(h))


@query("forecast_complete")
def _(spark, d):
    h, trained = _trained(spark, d, "complete")
    return plan.forecast(h, targets(h), "complete", trained, plan.backtest(h))


@query("forecast_hybrid")
def _(spark, d):
    h, trained = _trained(spark, d, "hybrid")
    return plan.forecast(h, targets(h), "hybrid", trained, plan.backtest(h))


@query("forecast_optimized")
def _(spark, d):
    h, trained = _trained(spark, d, "optimized")
    return plan.forecast(h, targets(h), "optimized", trained, plan.backtest(h))


@query("forecast_enhanced")
def _(spark, d):
    h, trained = _trained(spark, d, "enhanced")
    return plan.forecast(h, targets(h), "enhanced", trained, plan.backtest(h))


# the four analog forecasts, the mean of the past where one is missing, fixed weights, the
# bias of the ledger taken off, the band of 8 % and the score by past error
_PATTERN = pattern_sql(True).split(PAST + ",")[1]
_LEDGER = LEDGER.removeprefix(SUPPLIERS + ", ")
ANALOGS = f"""{SIMILAR}, {_PATTERN}, {_LEDGER},
  m as (select series_id, target_ds, 'similar' as model, v * least(greatest(power(1 + gr.g, year(target_ds) - yr), 0.7), 1.5) as yhat
      from s join gr using (series_id, target_ds)
    union all select series_id, target_ds, 'pattern', yhat from ({STRICT_ROWS})
    union all select series_id, target_ds, 'prev_year', yhat from ({growth_sql("p t")})
    union all select series_id, target_ds, 'trend', yhat from ({recent_sql("p t", "p t")})),
  oa as (select series_id, target_ds, avg(y) as oa from p group by 1, 2),
  four as (select oa.series_id, oa.target_ds, w, coalesce(m.yhat, oa) as yhat from oa
    cross join (values ('similar', 0.35::double), ('pattern', 0.20::double), ('prev_year', 0.25::double), ('trend', 0.20::double)) n(model, w)
    left join m on m.series_id = oa.series_id and m.target_ds = oa.target_ds and m.model = n.model),
  bl as (select series_id, target_ds, sum(yhat * w) as stat, stddev_pop(yhat) / (avg(yhat) + 1e-8) as uncertainty from four group by 1, 2),
  fx as (select bl.*, case when detected then -bias * 0.7::double else 0 end as correction, mae_pct from bl
    left join ({BIAS.format(n=30)}) using (series_id) left join ({ACC}) using (series_id)),
  x as (select series_id, target_ds, cast(trunc(stat + correction) as bigint) as final_prediction,
    cast(trunc(greatest(0, (stat + correction) * (1 - 1.96::double * 0.08::double))) as bigint) as pred_lower,
    cast(trunc((stat + correction) * (1 + 1.96::double * 0.08::double)) as bigint) as pred_upper,
    case when mae_pct < 5 then 88 when mae_pct < 10 then 78 else 68 end as confidence_score, uncertainty, correction from fx)"""


@query("forecast_analogs", select_rounded(
    ANALOGS, "x", [*T, "final_prediction", "pred_lower", "pred_upper", "confidence_score"], ["uncertainty", "correction"]))
def _(spark, d):
    h = materialise(supplier_panel(spark, d))
    return rounded(plan.forecast(h, targets(h), "enhanced", ledger=ledger(spark, d)))


# the same with the count at noon of the days that are there, half of their total: 35 % forecast, 65 % what the count implies
_FIXED = ANALOGS[: ANALOGS.index("  x as (select series_id, target_ds, cast(trunc(stat + correction)")]
NOON_FORECAST = f"""{_FIXED}
  nz as (select fx.*, case when floor(h.y / 2) > 0 then (stat + correction) * 0.35::double + floor(h.y / 2) / 0.45::double * (1 - 0.35::double)
    else stat + correction end as v from fx left join h on h.series_id = fx.series_id and h.ds = fx.target_ds),
  x as (select series_id, target_ds, cast(trunc(v) as bigint) as final_prediction,
    cast(trunc(greatest(0, v * (1 - 1.96::double * 0.08::double))) as bigint) as pred_lower,
    cast(trunc(v * (1 + 1.96::double * 0.08::double)) as bigint) as pred_upper,
    case when mae_pct < 5 then 88 when mae_pct < 10 then 78 else 68 end as confidence_score, uncertainty, correction from nz)"""


@query("forecast_noon", select_rounded(
    NOON_FORECAST, "x", [*T, "final_prediction", "pred_lower", "pred_upper", "confidence_score"], ["uncertainty", "correction"]))
def _(spark, d):
    h = materialise(supplier_panel(spark, d))
    actuals = h.select("series_id", F.col("ds").alias("target_ds"), F.floor(F.col("y") / 2).cast("double").alias("noon"))
    return rounded(plan.forecast(h, targets(h), "enhanced", ledger=ledger(spark, d), actuals=actuals))
