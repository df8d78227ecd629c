"""Fits side by side."""

import time

import pytest

from tidecast.operators.scheduling import POOL, side_by_side


def busy(spark, tasks, seconds, log=None):
    def sleep(batches):
        for b in batches:
            time.sleep(seconds)
            yield b

    def call():
        n = spark.range(0, tasks, 1, tasks).mapInArrow(sleep, "id long").count()
        if log is not None:
            log.append((tasks, time.time()))
        return n

    return call


def test_results_and_properties(spark):
    context = spark.sparkContext
    context.setLocalProperty("tidecast.test", "kept")
    seen = []

    def look():
        seen.append((context.getLocalProperty("tidecast.test"), context.getLocalProperty(POOL)))
        return spark.range(5).count()

    assert side_by_side(spark, {"a": look, "b": look}) == {"a": 5, "b": 5}
    assert [x for x, _ in seen] == ["kept", "kept"] and len({p for _, p in seen}) == 2
    assert context.getLocalProperty(POOL) is None
    assert side_by_side(spark, {}) == {}


def test_a_failing_fit_leaves_no_job(spark):
    def fail():
        time.sleep(1.5)
        raise KeyError("no such fit")

    start = time.time()
    with pytest.raises(KeyError):
        side_by_side(spark, {"long": busy(spark, 400, 0.5), "bad": fail, "later": busy(spark, 400, 0.5)}, 2)
    assert time.time() - start < 15
    time.sleep(0.5)
    assert not spark.sparkContext.statusTracker().getActiveJobsIds()
    assert spark.range(3).count() == 3


def test_short_fits_do_not_wait_for_long_ones(spark):
    log = []
    if spark.sparkContext.getConf().get("spark.scheduler.mode") != "FAIR":
        pytest.skip("the session has no fair scheduler")
    long, short = busy(spark, 40, 0.3, log), busy(spark, 2, 0.1, log)

    def after():
        time.sleep(1)
        return short()

    side_by_side(spark, {"long": long, "short": after})
    assert [tasks for tasks, _ in log] == [2, 40]
