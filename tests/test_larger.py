"""Results that must not change with the order and number of the rows."""

import datetime as dt

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from checks import QUERIES
from tidecast.functions.calendar import CALENDAR
from tidecast.operators import asof, baselines, diagnostics, ensemble, features, feedback, trees
from tidecast.operators.asof import forecast_asof, forecast_packed
from tidecast.operators.packed import pack_rows
from tidecast.sources.history import daily_rollup


def test_cut_points_are_exact_however_the_rows_are_dealt(spark):
    n = 40_000
    values = np.random.default_rng(3).permutation(n).astype(float)
    df = spark.createDataFrame([(float(v), float(v * v)) for v in values], "a double, b double")
    want = np.sort(values)[[-(-n * i // 32) - 1 for i in range(1, 33)]]
    for parts in (1, 7, 64):
        raw = df.repartition(parts).select(array_to_vector(F.array("a", "b")).alias("raw"))
        got = trees.cut_points(raw)
        assert np.array_equal(got[0], want) and np.array_equal(got[1], want * want), parts


def test_equal_analogs_are_their_own_blend(spark):
    day = dt.date(2024, 1, 1)
    names = list(ensemble.ANALOG_WEIGHTS)
    rows = [(f"{v}-{k}", day, m, float(v), "analog") for v in range(1, 200) for k in range(4) for m in names[k:] + names[:k]]
    p = spark.createDataFrame(rows, "series_id string, target_ds date, model string, yhat double, family string")
    got = ensemble.blend_fixed(p.repartition(1)).collect()
    assert len(got) == 4 * 199
    assert all(r.stat == r.yhat == float(r.series_id.split("-")[0]) for r in got)


def test_mean_and_spread_do_not_depend_on_the_order_of_models(spark):
    day, rng = dt.date(2024, 1, 1), np.random.default_rng(5)
    values = [rng.normal(40, 8, 12).round(3) / 7 for _ in range(100)]
    rows = [(f"{i}-{k}", day, f"m{j}", "stat", float(x)) for i, v in enumerate(values) for k in range(6) for j, x in enumerate(rng.permutation(v))]
    p = spark.createDataFrame(rows, "series_id string, target_ds date, model string, family string, yhat double").repartition(1)
    seen = {}
    for r in ensemble.ensemble_stats(p).collect():
        seen.setdefault(r.series_id.split("-")[0], set()).add((r["mean"], r["std"]))
    assert len(seen) == 100 and all(len(v) == 1 for v in seen.values())


def test_only_days_before_targets_carry_states_on(spark, make, wanted):
    h = make({"a": [(k, k * k) for k in range(60)], "b": [(3, 7), (9, 5)]})
    day = lambda k: dt.date(2021, 1, 1) + dt.timedelta(days=k)
    t = wanted(("a", day(0)), ("a", day(10)), ("a", day(10)), ("a", day(11)), ("a", day(99)), ("b", day(9)), ("b", day(30)), ("c", day(5)))
    got = baselines.sma(h, t, (1, 3)).collect()
    rows = sorted((r.series_id, r.target_ds, r.model, round(r.yhat, 9)) for r in got)
    a = lambda k: [("a", day(k), "SMA_1", float((min(k, 60) - 1) ** 2)),
                   ("a", day(k), "SMA_3", round(sum((min(k, 60) - j) ** 2 for j in (1, 2, 3)) / 3, 9))]
    want = [*a(10), *a(10), *a(11), *a(99), ("b", day(9), "SMA_1", 7.0), ("b", day(30), "SMA_1", 5.0)]
    assert rows == sorted(want)


def test_windows_of_several_orders_hold_a_share_of_a_stage(spark, two_years):
    tasks = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    for out in (feedback.backtest_base(two_years), diagnostics.decompose(two_years, robust=True), diagnostics.with_remainder(two_years)):
        assert out.rdd.getNumPartitions() == tasks


def test_packed_forecasts_are_those_of_windows_and_move_days_once(spark, make, wanted):
    rng = np.random.default_rng(6)
    days = {s: sorted(rng.choice(900, n, replace=False).tolist()) for s, n in (("a", 700), ("b", 40), ("c", 3))}
    h = make({s: [(k, round(float(rng.normal(50, 9)), 3)) for k in v] for s, v in days.items()})
    at = [dt.date(2021, 1, 1) + dt.timedelta(days=k) for k in (0, 1, 35, 364, 500, 501, 1200)]
    t = wanted(*[(s, x) for s in days for x in at])
    recent = [baselines.sma_recipe(), baselines.wma_recipe(), baselines.median_recipe((7, 30))]
    parts = [forecast_asof(h, t, recent), baselines.weekday_mean(h, t), baselines.weekday_month_mean(h, t), baselines.prev_year_same_weekday(h, t)]
    want = sorted((r.series_id, r.target_ds, r.model, r.family, round(r.yhat, 9)) for p in parts for r in p.collect())
    packed = pack_rows(h).withColumn("targets", F.array(*[F.lit(x) for x in at]))
    keys = {"Weekday_Month_Mean": ["weekday", "month"], "Weekday_Mean": ["weekday"]}
    p = forecast_packed(packed, recent, keys, {"PrevYear_SameWeekday": 364})
    assert sorted((r.series_id, r.target_ds, r.model, r.family, round(r.yhat, 9)) for r in p.collect()) == want and len(want) > 60


def test_queries_on_predictions_exchange_the_days_twice_at_most(spark):
    """Once for the roll-up, once for the series: no model and no statistic sorts or moves them again."""
    for name in ("ensemble_stats", "interval_sigma", "blend_complete", "category_summary"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(series_id") + plan.count("Exchange hashpartitioning(cast") <= 2, plan
        assert "Window" not in plan and "Union" not in plan


def test_whole_numbers_name_their_series(spark):
    facts = spark.createDataFrame([(7, dt.datetime(2024, 1, 1, 5), 2.0), (7, dt.datetime(2024, 1, 1, 15), 3.0), (None, dt.datetime(2024, 1, 1), 1.0)], "k long, at timestamp, v double")
    assert [tuple(r) for r in daily_rollup(facts, "at", ["k"], F.col("v")).collect()] == [("7", dt.date(2024, 1, 1), 5.0, 2.0)]


def test_one_model_of_a_preset_is_trained_alone(spark):
    from checks import queries_learners as q

    q.TRAINED.clear()
    _, trained = q._trained(spark, "/root/testdata/sf0.001", "complete", "ExtraTrees")
    assert set(trained.models) == {"ExtraTrees"} == set(trained.specs)
    assert QUERIES["extra_trees"](spark, "/root/testdata/sf0.001").count() > 0 and len(q.TRAINED) == 1
    trained.release()
    q.TRAINED.clear()


def test_rolling_apart_is_rolling_however_the_batches_fall(spark):
    rng = np.random.default_rng(2)
    days = [(s, dt.date(2021, 1, 1) + dt.timedelta(days=int(k)), None if k % 13 == 5 else float(rng.normal(40, 9))) for s, n in (("a", 150), ("b", 1), ("c", 33)) for k in range(n)]
    h = spark.createDataFrame(days, "series_id string, ds date, y double").repartition(3)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        for size in (7, 40, 1000):
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            for least in (1, None):
                got, want = features.rolling_apart(h, (3, 14, 60), min_periods=least), features.rolling(h, (3, 14, 60), min_periods=least)
                assert got.columns == want.columns and "Window" not in got._jdf.queryExecution().executedPlan().toString()
                rows = [{(r.series_id, r.ds): [round(v, 9) if isinstance(v, float) else v for v in r] for r in x.collect()} for x in (got, want)]
                assert rows[0] == rows[1] and len(rows[0]) == len(days)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)


def test_forecasts_of_dates_are_those_of_windows_in_any_order_and_chunk(spark, make, wanted, monkeypatch):
    rng = np.random.default_rng(8)
    days = {str(s): rng.choice(900, n, replace=False).tolist() for s, n in ((7, 700), (12, 40), (3, 3), (40, 1))}
    h = make({s: [(k, round(float(rng.normal(50, 9)), 3)) for k in v] for s, v in days.items()}).withColumn("series_id", F.col("series_id").cast("long"))
    at = [dt.date(2021, 1, 1) + dt.timedelta(days=k) for k in (0, 1, 35, 364, 500, 501, 1200)]
    t = wanted(*[(s, x) for s in days for x in at])
    text = h.withColumn("series_id", F.col("series_id").cast("string"))
    recent = [baselines.sma_recipe(), baselines.wma_recipe(), baselines.median_recipe((7, 30))]
    parts = [forecast_asof(text, t, recent), baselines.weekday_mean(text, t), baselines.weekday_month_mean(text, t), baselines.prev_year_same_weekday(text, t)]
    want = sorted((r.series_id, r.target_ds, r.model, r.family, round(r.yhat, 9)) for p in parts for r in p.collect())
    keys = {"Weekday_Month_Mean": ["weekday", "month"], "Weekday_Mean": ["weekday"]}
    for size in (1, 41, 10_000):
        monkeypatch.setattr(asof, "CHUNK", size)
        p = asof.one_by_one(asof.forecast_dates(h.repartition(3), at, recent, keys, {"PrevYear_SameWeekday": 364}))
        assert sorted((str(r.series_id), r.target_ds, r.model, r.family, round(r.yhat, 9)) for r in p.collect()) == want and len(want) > 60


def test_calendar_keys_of_numbers_are_those_of_dates(spark):
    days = spark.range(-30_000, 60_000, 17).select(F.col("id").cast("int").alias("day")).withColumn("ds", F.date_from_unix_date("day"))
    rows = days.select("day", *[CALENDAR[k]("ds").alias(k) for k in asof.NUMBERS]).toPandas()
    for k, number in asof.NUMBERS.items():
        assert (number(rows["day"].to_numpy().astype(np.int64)) == rows[k].to_numpy()).all(), k


def test_weighted_ensemble_gathers_no_days_by_text(spark):
    """The days are grouped by whole numbers and sorted as numbers in the tasks; models come of whole columns."""
    plan = QUERIES["weighted_ensemble"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "sort_array(collect_list" not in plan and "hashpartitioning(cast(" not in plan


def test_lists_of_models_are_blended_like_rows_of_them(spark):
    day, rng = dt.date(2024, 1, 1), np.random.default_rng(9)
    rows = []
    for i in range(60):
        some = [("WMA_7", "ml"), ("Median_7", "ml"), ("Median_30", "ml"), ("SMA_3", "moving_average"), ("Weekday_Mean", "seasonal"), ("PrevYear_X", "previous_year")][i % 4:i % 6 + 1]
        rows += [(str(i), day, m, f, float(v)) for (m, f), v in zip(some, rng.normal(40, 8, 6).round(2 * (i % 3)))]
    p = spark.createDataFrame(rows, "series_id string, target_ds date, model string, family string, yhat double")
    lists = p.groupBy("series_id", "target_ds").agg(F.collect_list(F.struct("model", "family", "yhat")).alias("models"))
    ways = [ensemble.combine, ensemble.category_summary, lambda x: ensemble.category_summary(x, exclusive=True)]
    ways += [lambda x, rule=rule: ensemble.combine(x, rule) for rule in ensemble.BLENDS]
    for way in ways:
        plan = way(lists.localCheckpoint())._jdf.queryExecution().executedPlan().toString()
        assert "Aggregate" not in plan and "Exchange" not in plan
        got, want = (sorted((tuple(r) for r in way(x).collect()), key=str) for x in (lists, p))
        assert got == want and len(got) >= 40
