"""No look-ahead, series independent of each other, edge cases, feedback rules."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidecast.operators import analogs, ensemble, feedback
from tidecast.operators import learners as ml
from tidecast.operators.asof import asof_attach, eligible_targets
from tidecast.plans import features as pf
from tidecast.plans import forecast as plan
from tidecast.sources import history, ledger as store

CUT = dt.date(2020, 12, 1)


def rows(df, *cols):
    cols = cols or df.columns
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def predictions(h, t):
    return plan.statistical_predictions(h, t).unionByName(plan.analog_predictions(h, t))


def test_no_look_ahead_and_independent_series(two_years, wanted):
    t = wanted(("a", CUT), ("a", dt.date(2020, 3, 1)), ("b", CUT))
    cols = ("series_id", "target_ds", "model", "yhat")
    full = rows(predictions(two_years, t), *cols)
    changed = two_years.withColumn("y", F.when(F.col("ds") >= CUT, F.col("y") * 100).otherwise(F.col("y")))
    assert rows(predictions(changed, t), *cols) == full
    alone = two_years.filter("series_id = 'a'").repartition(7)
    assert rows(predictions(alone, t), *cols) == [r for r in full if r[0] == "a"]
    assert len({r[2] for r in full}) > 45


def test_every_version_gives_a_record(two_years, wanted):
    t = wanted(("a", CUT), ("b", CUT))
    models = {"Ridge": ("ridge", dict(alpha=1.0)), "KNN": ("knn", dict(k=5, weights="distance"))}
    led = plan.backtest(two_years)
    actuals = t.withColumn("noon", F.lit(150.0))
    actual = {r.series_id: r.y for r in two_years.filter(F.col("ds") == CUT).collect()}
    for version in ("statistical", "complete", "hybrid", "optimized", "enhanced"):
        trained = None if version == "statistical" else plan.train(two_years, version, models)
        got = {r.series_id: r for r in plan.forecast(two_years, t, version, trained, led).collect()}
        assert set(got) == {"a", "b"}
        for s, r in got.items():
            assert r.pred_lower <= r.final_prediction <= r.pred_upper
            assert r.final_prediction == pytest.approx(actual[s], rel=0.25), version
        if version in ("statistical", "enhanced"):
            moved = {r.series_id: r for r in plan.forecast(two_years, t, version, trained, led, actuals).collect()}
            assert moved["a"].final_prediction != got["a"].final_prediction


def test_serving_row_of_a_known_day_is_its_feature_row(two_years, wanted):
    t = wanted(("a", CUT), ("b", dt.date(2020, 5, 5)))
    for version in ("enhanced", "complete", "optimized"):
        names = pf.model_features(version)
        served = rows(pf.serving_rows(two_years, t, version), "series_id", "target_ds", *names)
        frame = pf.feature_frame(two_years, version).withColumnRenamed("ds", "target_ds")
        assert served == rows(frame.join(t, ["series_id", "target_ds"]), "series_id", "target_ds", *names)


def test_short_history_is_left_out(make, wanted):
    h = make({"tiny": [(i, 10 + i) for i in range(10)]})
    t = wanted(("tiny", dt.date(2021, 1, 11)), ("tiny", dt.date(2020, 1, 1)))
    assert plan.statistical_predictions(h, t).count() == 0
    assert plan.forecast(h, t).count() == 0
    assert eligible_targets(h, t, 10).count() == 1
    # the analogs fall back to the mean of what is known
    assert {r.yhat for r in analogs.pattern_match(h, t).collect()} == {14.5}


def test_constant_series(make, wanted):
    h = make({"c": [(i, 100.0) for i in range(90)]})
    t = wanted(("c", dt.date(2021, 4, 1)))
    got = {r.model: r.yhat for r in predictions(h, t).collect()}
    assert "KDE_Mode" not in got and "Bayes_Posterior" not in got
    for model, value in got.items():
        want = 100.0
        assert value == pytest.approx(want, rel=1e-3), model
    assert plan.forecast(h, t).first().final_prediction in (99, 100)


def test_gaps_and_duplicates(make, spark, wanted):
    days = [i for i in range(60) if i % 7 != 3]
    raw = make({"g": [(i, 10 + i) for i in days]}).unionByName(make({"g": [(5, 1.0)]}))
    h = history.clean_history(raw)
    assert h.count() == len(days)
    assert h.filter("ds = '2021-01-06'").first().y == 16.0
    at = asof_attach(h, wanted(("g", dt.date(2021, 1, 5)))).first()
    assert at.ds == dt.date(2021, 1, 3)  # the 4th is missing, the row of the day itself does not count


def test_clean_strict_and_lenient(spark):
    raw = spark.createDataFrame(
        [("s", "2021-01-01", "5"), ("s", "2021/13/45", "5"), ("s", "2021-01-02", "x"), ("s", None, "1"),
         ("s", "2021-01-03", "-4"), ("s", "2021-01-04", "0"), ("s", "2021-01-05", None)],
        "series_id string, ds string, y string",
    )
    for lenient in (False, True):
        assert [r.y for r in history.clean_history(raw, lenient).collect()] == [5.0]


def test_csv_history(spark, tmp_path):
    (tmp_path / "a.csv").write_text("日付,合計,件数(～12:00)\n2021-01-01,10,4\n2021-01-02,20,8\n")
    (tmp_path / "b.csv").write_text("日付,合計,件数(～12:00)\n2021-01-03,30,12\n")
    raw = history.read_history(spark, str(tmp_path / "*.csv"), "csv", "`日付` string, `合計` string, `件数(～12:00)` string")
    h = history.clean_history(history.normalise_columns(raw))
    assert rows(h.select("series_id", "y", "partial_y")) == [("all", 10.0, 4.0), ("all", 20.0, 8.0), ("all", 30.0, 12.0)]
    assert ensemble.noon_ratio(h).first().ratio == pytest.approx(0.4)
    with pytest.raises(ValueError):
        history.read_history(spark, str(tmp_path))


def test_noon_defaults(make):
    h = make({"n": [(i, 10.0) for i in range(3)]})
    assert ensemble.noon_ratio(h).first().ratio == 0.45
    assert ensemble.noon_ratio(h.withColumn("partial_y", F.lit(0.0))).first().ratio == 0.45


def ledger_of(spark, errors):
    rows = [("s", i, 100.0 + e, 100.0, float(e), float(e)) for i, e in enumerate(errors)]
    return spark.createDataFrame(
        rows, "series_id string, seq long, final_prediction double, actual_value double, error double, error_pct double"
    )


def test_bias_rules(spark, wanted):
    assert feedback.detect_bias(ledger_of(spark, [50, 50])).count() == 0
    found = feedback.detect_bias(ledger_of(spark, [50] * 12)).first()
    assert found.detected and found.direction == "over" and found.sample_count == 10
    assert not feedback.detect_bias(ledger_of(spark, [50, -50] * 6)).first().detected
    fc = wanted(("s", CUT)).withColumn("yhat", F.lit(200.0)).withColumn("score", F.lit(0.3))
    bias = feedback.detect_bias(ledger_of(spark, [50] * 12))
    assert feedback.apply_correction(fc, bias).first().yhat == pytest.approx(165.0)
    assert feedback.apply_correction(fc, bias, "score").first().yhat == pytest.approx(175.0)
    assert feedback.tuner_correction(ledger_of(spark, [50] * 12)).first().correction == pytest.approx(-25.0)
    assert feedback.tuner_correction(ledger_of(spark, [50] * 4)).first().correction == 0.0
    assert feedback.accuracy_score(ledger_of(spark, [5, 5])).first().score == 70.0
    assert feedback.accuracy_score(ledger_of(spark, [5, -5, 5])).first().score == pytest.approx(90.0)
    # predictions run high, so the relative memory lowers the next one
    assert feedback.memory_correction(fc, ledger_of(spark, [50] * 12)).first().yhat == pytest.approx(100.0)


def test_backtest_correction_by_hand(make):
    base = make({"s": [(i, 100.0) for i in range(6)]}).withColumns({"base": F.lit(150.0), "p1": F.lit(150.0)})
    got = [r.bias_correction_amount for r in feedback.backtest_corrected(base).orderBy("prediction_date").collect()]
    assert got[:3] == [0.0, 0.0, 0.0]
    assert got[3] == pytest.approx(-35.0)  # mean of three errors of 50
    assert got[4] == pytest.approx(-0.7 * (150 + 15) / 4)


def test_blend_falls_back_to_the_side_that_exists(spark):
    p = spark.createDataFrame(
        [("s", CUT, "SMA_7", 10.0, "moving_average"), ("s", CUT, "SMA_3", 20.0, "moving_average"),
         ("m", CUT, "ML_Ridge", 30.0, "ml"), ("x", CUT, "SMA_7", float("nan"), "moving_average")],
        "series_id string, target_ds date, model string, yhat double, family string",
    )
    for rule in ensemble.BLENDS:
        got = {r.series_id: r.yhat for r in ensemble.blend(ensemble.valid(p), rule).collect()}
        assert got == {"s": 15.0, "m": 30.0}


def test_ledger_runs(spark, tmp_path):
    path = str(tmp_path / "ledger")
    assert store.read_ledger(spark, path).count() == 0
    records = spark.createDataFrame([("s", CUT, 10.0), ("t", CUT, 20.0)], "series_id string, prediction_date date, final_prediction double")
    store.append_ledger(records, path, "2021-01-01")
    store.append_ledger(records, path, "2021-01-02")
    store.append_ledger(records, path, "2021-01-02")
    assert store.read_ledger(spark, path).count() == 2
    assert store.read_ledger(spark, path, "2021-01-01").count() == 2
    assert spark.read.parquet(path).count() == 4
    actuals = spark.createDataFrame([("s", CUT, 8.0)], "series_id string, ds date, y double")
    done = {r.series_id: r for r in store.with_actuals(store.read_ledger(spark, path), actuals).collect()}
    assert (done["s"].error, done["s"].error_pct, done["t"].error) == (2.0, 25.0, None)
    assert not done["s"].bias_correction_applied


def test_fixed_slices_do_not_change_matches(two_years, wanted, monkeypatch):
    t = wanted(("a", CUT), ("b", CUT))
    whole = rows(analogs.pattern_match(two_years, t), "series_id", "yhat")
    monkeypatch.setattr(analogs, "SLICE", 37)
    assert rows(analogs.pattern_match(two_years, t), "series_id", "yhat") == whole


def test_folds_expand(two_years):
    got = {r.fold: (r.lo, r.hi) for r in ml.fold_ids(two_years, 5).groupBy("fold").agg(
        F.min("ds").alias("lo"), F.max("ds").alias("hi")).collect()}
    assert sorted(got) == [0, 1, 2, 3, 4, 5]
    assert all(got[i][1] < got[i + 1][0] for i in range(5))
    assert (got[5][1] - got[5][0]).days + 1 == 800 // 6
