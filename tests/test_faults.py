"""Cases that once went wrong."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.operators import ensemble, feedback, lagreg, learners, smoothing
from tidecast.plans import forecast as plan
from tidecast.sources import history
from tidecast.sources import ledger as store


def record(spark, value, at=None):
    row = [("s", dt.date(2024, 1, 1), float(value), at or dt.datetime(2024, 1, 1))]
    return spark.createDataFrame(row, "series_id string, prediction_date date, final_prediction double, prediction_timestamp timestamp")


def test_the_tenth_run_is_newer_than_the_ninth(spark, tmp_path):
    path = str(tmp_path / "l")
    for k in (9, 10):
        store.append_ledger(record(spark, k).drop("prediction_timestamp"), path, f"run-{k}")
    assert [r.final_prediction for r in store.read_ledger(spark, path).collect()] == [10.0]
    assert [r.final_prediction for r in store.read_ledger(spark, path, "run-9").collect()] == [9.0]
    # a repeated older run has newer predictions
    store.append_ledger(record(spark, 99).drop("prediction_timestamp"), path, "run-9")
    assert [r.final_prediction for r in store.read_ledger(spark, path).collect()] == [99.0]
    assert store.runs(spark, path) == ["run-9", "run-10"]
    # One run's folder is read; the run that was written again has one.
    assert len({f.rsplit("/", 1)[0] for f in store.read_ledger(spark, path).inputFiles()}) == 1
    assert len(list((tmp_path / "l").glob("run_id=*/write=*"))) == 2


def test_a_killed_write_is_not_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "l")
    store.append_ledger(record(spark, 1), path, "run-1")

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(store, "_record", killed)
        for run in ("run-1", "run-2"):
            with pytest.raises(KeyboardInterrupt):
                store.append_ledger(record(spark, 2, dt.datetime(2025, 1, 1)), path, run)
    assert store.runs(spark, path) == ["run-1"] and store.read_ledger(spark, path).first().final_prediction == 1.0
    assert store.read_ledger(spark, path, "run-2").count() == 0
    store.append_ledger(record(spark, 2), path, "run-1")
    assert [r.final_prediction for r in store.read_ledger(spark, path, "run-1").collect()] == [2.0]


def test_trimming_keeps_the_newest_runs(spark, tmp_path):
    path = str(tmp_path / "l")
    for k in range(5):
        store.append_ledger(record(spark, k, dt.datetime(2024, 1, 1 + k)), path, f"a/b {k}")
    store.append_ledger(record(spark, 44, dt.datetime(2024, 1, 5)), path, "a/b 4")
    held = store.read_ledger(spark, path)
    store.trim_ledger(spark, path, 2)
    assert store.runs(spark, path) == ["a/b 4", "a/b 3"] and held.first().final_prediction == 44.0
    assert len(list((tmp_path / "l").glob("run_id=*/write=*"))) == 5  # within the grace
    store.trim_ledger(spark, path, 2, grace_hours=-1)
    assert len(list((tmp_path / "l").glob("run_id=*/write=*"))) == 2
    assert len(list((tmp_path / "l" / "_commits").glob("*.json"))) == 1
    assert store.runs(spark, path) == ["a/b 4", "a/b 3"] and store.read_ledger(spark, path, "a/b 3").first().final_prediction == 3.0
    store.trim_ledger(spark, str(tmp_path / "none"), 2)
    assert store.runs(spark, str(tmp_path / "none")) == []


def test_runs_of_one_instant_go_by_their_number(spark, tmp_path):
    path = str(tmp_path / "l")
    for k in (10, 9):
        store.append_ledger(record(spark, k), path, f"run-{k}")
    assert store.read_ledger(spark, path).first().run_id == "run-10"


def test_a_day_without_sales_has_no_error_in_percent(make):
    h = make({"a": [(i, 0.0 if i == 700 else 100.0 + i % 7) for i in range(720)]})
    got = {r.prediction_date: r for r in feedback.backtest_corrected(feedback.backtest_base(h)).collect()}
    zero = got[dt.date(2021, 1, 1) + dt.timedelta(days=700)]
    assert zero.error_pct is None and zero.error == zero.final_prediction
    assert sum(r.error_pct is None for r in got.values()) == 1


def test_zero_mean_has_no_variation(spark):
    x = spark.createDataFrame([("a", 0.0, 1.0)], "series_id string, mean double, std double")
    assert ensemble.confidence_cv(x).first().cv is None


def test_a_broken_grid_point_loses(make, wanted):
    day = dt.date(2021, 3, 20)
    zero_phase = make({"z": [(i, 0.0 if i % 7 == 3 else 50.0 + i) for i in range(70)]})
    assert smoothing.smooth(zero_phase, wanted(("z", day)), "hw_mul").collect() == []
    good = make({"g": [(i, 50.0 + i % 7) for i in range(70)]})
    assert np.isfinite(smoothing.smooth(good, wanted(("g", day)), "hw_mul").first().yhat)


def test_a_forecast_does_not_depend_on_other_targets(two_years, wanted):
    days = [dt.date(2020, 1, 1) + dt.timedelta(days=7 * i) for i in range(40)]
    every = {(r.model, r.target_ds): r.yhat for r in lagreg.lag_regression(two_years, wanted(*[("a", x) for x in days])).collect()}
    for x in (days[0], days[25], days[39]):
        for r in lagreg.lag_regression(two_years, wanted(("a", x))).collect():
            assert every[r.model, x] == r.yhat


def test_little_history_means_no_machine_learning(make, wanted):
    h = make({"a": [(i, 100.0 + i % 7) for i in range(45)]})
    models = {"Ridge": ("ridge", dict(alpha=1.0))}
    assert plan.train(h, "optimized", models) is None
    out = plan.forecast(h, wanted(("a", dt.date(2021, 2, 20))), "optimized", None)
    assert out.count() == 1


def test_folds_without_enough_days_are_refused(make):
    h = make({s: [(i, 1.0 + i) for i in range(3)] for s in "ab"})
    rows = learners.assemble(h.withColumn("x", F.col("y")), ["x"])
    with pytest.raises(ValueError):
        learners.ts_cv(rows, {"Ridge": ("ridge", dict(alpha=1.0))}, 5, "standard")


def test_bayesian_ridge_gives_a_band(two_years, wanted):
    trained = plan.train(two_years, "complete", {"BayesianRidge": ("bayesian_ridge", {}), "Ridge": ("ridge", dict(alpha=1.0))})
    try:
        got = {r.model: r for r in plan.ml_predictions(trained, two_years, wanted(("a", dt.date(2020, 10, 5)))).collect()}
    finally:
        trained.release()
    b = got["ML_BayesianRidge"]
    assert b.lo < b.yhat < b.hi and b.hi - b.yhat == pytest.approx(b.yhat - b.lo)
    assert got["ML_Ridge"].lo is None


def test_materialised_tables_can_be_dropped(spark, make):
    h = history.materialise(make({"a": [(0, 1.0)]}))
    name = next(t.name for t in spark.catalog.listTables() if t.name.startswith(history.MADE))
    assert h.count() == 1
    history.drop_materialised(spark)
    assert not spark.catalog.tableExists(name)


def test_the_statistical_forecast_reads_its_history_a_few_times(spark, two_years, wanted):
    import re

    h = history.materialise(two_years)
    t = wanted(("a", dt.date(2020, 10, 5)), ("b", dt.date(2020, 10, 6)))
    text = plan.statistical_predictions(h, t)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall("Scan parquet", text)) <= 10
    assert len(re.findall(r"Exchange hashpartitioning", text)) <= 16
