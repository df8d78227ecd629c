"""A history kept up to date equals the full roll-up."""

import datetime as dt

import numpy as np
import pytest

from tidecast.sources import deliveries
from tidecast.sources.history import daily_rollup


def rows_of(df):
    return sorted(map(tuple, df.select("series_id", "ds", "y", "partial_y").collect()))


def test_three_deliveries_with_late_facts(spark, tmp_path, monkeypatch):
    path, rng = str(tmp_path / "h"), np.random.default_rng(1)
    facts = [(f"s{int(s)}", dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(t)), float(v))
             for s, t, v in zip(rng.integers(0, 9, 2000), rng.integers(0, 24 * 120, 2000), rng.integers(1, 9, 2000))]
    schema = "shop string, at timestamp_ntz, v double"
    late = rng.random(2000) < 0.1
    group = [min(2, (r[1].month - 1) // 2 + int(x)) for r, x in zip(facts, late)]
    parts = [spark.createDataFrame([r for r, g in zip(facts, group) if g == k], schema) for k in range(3)]
    files = []
    for k, part in enumerate(parts):
        assert deliveries.deliver(part, path, f"day-{k}", "at", ["shop"], part["v"], buckets=4)
        assert not deliveries.deliver(part, path, f"day-{k}", "at", ["shop"], part["v"])  # again: nothing happens
        files.append({f.split("/parts/")[1] for f in deliveries.read_deliveries(spark, path).inputFiles()})
    whole = spark.createDataFrame(facts, schema)
    assert rows_of(deliveries.read_deliveries(spark, path)) == rows_of(daily_rollup(whole, "at", ["shop"], whole["v"]))
    # A delivery of one series and month leaves the files of all other parts alone.
    one = spark.createDataFrame([("s1", dt.datetime(2024, 2, 3, 9), 5.0)], schema)
    held = deliveries.read_deliveries(spark, path)
    before = rows_of(held)
    deliveries.deliver(one, path, "late", "at", ["shop"], one["v"])
    after = {f.split("/parts/")[1] for f in deliveries.read_deliveries(spark, path).inputFiles()}
    part_of = lambda fs: {f.split("/", 1)[1].rsplit("/", 1)[0] for f in fs}
    assert len(part_of(files[-1] - after)) == len(part_of(after - files[-1])) == 1
    assert rows_of(held) == before  # a reader keeps what it looked up

    def killed(*_, **__):
        raise KeyboardInterrupt

    now = rows_of(deliveries.read_deliveries(spark, path))
    with monkeypatch.context() as m:
        m.setattr(deliveries.time, "time_ns", killed)
        with pytest.raises(KeyboardInterrupt):
            deliveries.deliver(one, path, "killed", "at", ["shop"], one["v"])
    assert rows_of(deliveries.read_deliveries(spark, path)) == now
    assert deliveries.deliver(one, path, "killed", "at", ["shop"], one["v"])


def test_no_facts(spark, tmp_path):
    path = str(tmp_path / "h")
    assert deliveries.read_deliveries(spark, path).count() == 0
    none = spark.createDataFrame([], "shop string, at timestamp_ntz")
    assert deliveries.deliver(none, path, "empty", "at", ["shop"])
    assert deliveries.read_deliveries(spark, path).count() == 0
    assert not deliveries.deliver(none, path, "empty", "at", ["shop"])
