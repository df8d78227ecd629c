"""A stream gives the batch answer, drops late rows and keeps state over batches."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidecast.operators import feedback
from tidecast.streaming import stream


def drain(df, tmp_path, name, mode):
    q = (df.writeStream.outputMode(mode).format("memory").queryName(name)
         .option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start())
    q.awaitTermination()
    return df.sparkSession.table(name)


def test_late_rows_are_dropped(spark, tmp_path):
    schema = "ts timestamp_ntz, kind string"
    # a batch is filtered by the watermark of the batch before it
    days = [[(1, 9), (1, 9), (2, 9)], [(9, 15)], [(9, 16)], [(1, 8)]]
    for batch in ([dt.datetime(2024, 1, *t) for t in b] for b in days):
        spark.createDataFrame([(t, "x") for t in batch], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = drain(stream.daily_rollup_stream(events, "ts", ["kind"]), tmp_path, "rolled", "append")
    got = {r.ds.day: (r.y, r.partial_y) for r in out.collect()}
    assert got == {1: (2.0, 2.0), 2: (1.0, 1.0)}  # the 9th is open, the late row of the 1st is gone


def test_bias_state_over_batches(spark, tmp_path, make):
    rng = np.random.default_rng(5)
    base = make({s: [(i, 100 + rng.normal(0, 5)) for i in range(40)] for s in "ab"}).withColumn(
        "base", F.col("y") + F.when(F.col("series_id") == "a", 30.0).otherwise(1.0)
    ).withColumn("p1", F.col("base")).persist()
    for lo in range(0, 40, 10):
        part = base.filter(F.dayofyear("ds").between(lo + 1, lo + 10)).select("series_id", "ds", "base", "y")
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "series_id string, ds date, base double, y double"
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = drain(stream.running_bias(rows), tmp_path, "bias", "append")
    got = {(r.series_id, r.ds): r.correction for r in out.collect()}
    want = {(r.series_id, r.prediction_date): r.bias_correction_amount for r in feedback.backtest_corrected(base).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k]) for k in want)
    assert any(v != 0 for (s, _), v in got.items() if s == "a")


def test_bias_in_order_of_event_time(spark, tmp_path, make):
    """Shuffled and late days give the batch answer; what waits is bounded; an idle series leaves."""
    rng = np.random.default_rng(6)
    base = make({s: [(i, 100 + rng.normal(0, 5)) for i in range(60)] for s in "ab"}).withColumn(
        "base", F.col("y") + F.when(F.col("series_id") == "a", 30.0).otherwise(1.0)
    ).withColumn("p1", F.col("base")).persist()
    rows = base.select("series_id", "ds", "base", "y").collect()
    gone = [("c", rows[0].ds, 50.0, 40.0)]
    schema = "series_id string, ds date, base double, y double"
    # Every day comes up to five days late, in any order.
    late = {r: (r.ds - rows[0].ds).days + int(rng.integers(0, 6)) for r in rows}
    for part in range(0, 66, 6):
        mine = [r for r in rows if part <= late[r] < part + 6] + (gone if part == 0 else [])
        order = rng.permutation(len(mine))
        spark.createDataFrame([tuple(mine[i]) for i in order], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    stream_of = stream.running_bias_in_order(source, "12 days", idle_days=20)
    q = (stream_of.writeStream.outputMode("append").format("memory").queryName("ordered")
         .option("checkpointLocation", str(tmp_path / "ordered")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = {(r.series_id, r.ds): r.correction for r in spark.table("ordered").collect()}
    want = {(r.series_id, r.prediction_date): r.bias_correction_amount for r in feedback.backtest_corrected(base).collect()}
    passed = max(r.ds for r in rows) - dt.timedelta(days=12)
    assert {k for k in got if k[0] != "c"} == {k for k in want if k[1] < passed}
    assert got.pop(("c", rows[0].ds)) == 0.0
    assert all(v == pytest.approx(want[k]) for k, v in got.items()) and any(got.values())
    in_state = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert max(in_state) == 3 and in_state[-1] == 2
