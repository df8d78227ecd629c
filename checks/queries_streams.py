"""Ledger table and streams, run over the given tables to the end of the input."""

import uuid

from pyspark.sql import functions as F

from tidecast.functions.columns import by_day
from tidecast.operators.ensemble import noon_ratio
from tidecast.operators.feedback import backtest_base
from tidecast.session import ensure_checkpoint_dir
from tidecast.sources import ledger as store
from tidecast.sources.deliveries import deliver, read_deliveries
from tidecast.sources.history import materialise
from tidecast.streaming import stream

from .panels import EVENTS, events_panel, orders_panel, supplier_panel
from .queries_ensemble import CORRECTED, LEDGER, NOON, ledger
from .registry import query, rounded, select_rounded


def _folder(spark, name):
    """A fresh folder next to the session's checkpoints, which all executors share."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def _drain(folder, parts, make, mode, per_batch=None):
    """Hand a stream its input part by part, each in a run of its own that goes on from
    the state of the one before; a micro-batch that is run again replaces its own output."""
    def write(batch, batch_id):
        out = per_batch(batch) if per_batch else batch
        out.write.mode("overwrite").parquet(f"{folder}/out/batch={batch_id}")

    for part in parts:
        part.write.mode("append").parquet(f"{folder}/in")
        source = part.sparkSession.readStream.schema(part.schema).parquet(f"{folder}/in")
        q = (make(source).writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state")
             .foreachBatch(write).trigger(availableNow=True).start())
        q.awaitTermination()
    return part.sparkSession.read.parquet(f"{folder}/out")


def _events_by_date(spark, d):
    """The events up to the 10th, to the 20th and after; some of the evening of the 10th
    and 20th come late, with the next part, but within the watermark's day."""
    events = spark.read.parquet(f"{d}/events.parquet")
    late = (F.col("event_id") % 7 == 0) & (F.hour("ts") >= 18)
    day = F.dayofmonth("ts") + F.when(late, 1).otherwise(0)
    part = F.when(day <= 10, 0).when(day <= 20, 1).otherwise(2)
    return [events.where(part == k) for k in range(3)]


def _rollup(source):
    return stream.daily_rollup_stream(source, "ts", ["event_type"])


@query("ledger_round_trip", f"""with {LEDGER} select series_id, seq, prediction_date, final_prediction, actual_value, error,
  round(error_pct, 6) as error_pct, false as bias_correction_applied, 'run-10' as run_id from led""")
def _(spark, d):
    path, led = _folder(spark, "ledger"), ledger(spark, d)
    store.append_ledger(led.withColumn("final_prediction", F.lit(0.0)), path, "run-9")
    store.append_ledger(led.filter("seq = 2"), path, "run-10")
    store.append_ledger(led, path, "run-10")  # the same run again replaces it
    out = store.read_ledger(spark, path)
    return rounded(out.select("series_id", "seq", "prediction_date", "final_prediction", "actual_value", "error",
                              "error_pct", "bias_correction_applied", "run_id"))


_STORED = LEDGER.replace("h as (", "h as materialized (", 1).replace("led as (", "led as materialized (", 1)


@query("ledger_actuals", select_rounded(f"""{_STORED}, x as (select led.series_id, led.seq, prediction_date, final_prediction,
  h.y as actual_value, final_prediction - h.y as error, (final_prediction - h.y) / h.y * 100 as error_pct
  from led join h on h.series_id = led.series_id and h.ds = prediction_date)""", "x",
  ["series_id", "seq", "prediction_date"], ["final_prediction", "actual_value", "error", "error_pct"]))
def _(spark, d):
    out = store.with_actuals(ledger(spark, d), supplier_panel(spark, d))
    return rounded(out.select("series_id", "seq", "prediction_date", "final_prediction", "actual_value", "error", "error_pct"))


# In append mode a day comes out once the newest event is a day past its end.
@query("stream_daily_rollup", f"""with {EVENTS} select * from h
  where ds + interval 1 day <= (select max(ts) - interval 1 day from events)""")
def _(spark, d):
    out = _drain(_folder(spark, "rollup"), _events_by_date(spark, d), _rollup, "append")
    return out.select("series_id", "ds", "y", "partial_y")


@query("stream_noon_nowcast", select_rounded(NOON + """, x as (select h.series_id, ds as target_ds, partial_y as noon,
  case when partial_y > 0 then l * 0.35::double + partial_y / ratio * (1 - 0.35::double) else l end as yhat from (
    select *, lag(y) over (partition by series_id order by ds) as l from h) h join ra using (series_id) where l is not null)""",
    "x", ["series_id", "target_ds"], ["noon", "yhat"]))
def _(spark, d):
    h = events_panel(spark, d)
    naive = h.select("series_id", F.col("ds").alias("target_ds"), F.lag("y").over(by_day()).alias("yhat")).dropna()
    ratios = noon_ratio(h)
    out = _drain(_folder(spark, "noon"), _events_by_date(spark, d), _rollup, "update",
                 lambda batch: stream.noon_nowcast(batch, naive, ratios))
    # a day that changed again has a row in a later batch too
    last = out.groupBy("series_id", "target_ds").agg(F.max_by(F.struct("noon", "yhat"), "batch").alias("v"))
    return rounded(last.select("series_id", "target_ds", "v.*"))


@query("stream_running_bias", select_rounded(CORRECTED.replace("x as (select series_id, ds as prediction_date", "x0 as (select series_id, ds as prediction_date")
    + ", x as (select series_id, ds, base, y, correction from wk)", "x", ["series_id", "ds"], ["base", "y", "correction"]))
def _(spark, d):
    base = materialise(backtest_base(orders_panel(spark, d)).select("series_id", "ds", "base", "y"))
    parts = [base.where(F.year("ds") < 2000), base.where(F.year("ds") == 2000), base.where(F.year("ds") > 2000)]
    return rounded(_drain(_folder(spark, "bias"), parts, stream.running_bias, "append").drop("batch"))


# days shuffled over three deliveries, up to 20 days late; those that the last watermark has passed are out
@query("stream_bias_in_order", select_rounded(CORRECTED.replace("x as (select series_id, ds as prediction_date", "x0 as (select series_id, ds as prediction_date")
    + ", x as (select series_id, ds, base, y, correction from wk where ds < (select max(ds) from wk) - interval 30 day)",
    "x", ["series_id", "ds"], ["base", "y", "correction"]))
def _(spark, d):
    base = materialise(backtest_base(orders_panel(spark, d)).select("series_id", "ds", "base", "y"))
    come = F.date_add("ds", F.pmod(F.hash("series_id", "ds"), F.lit(20)).cast("int"))
    parts = [base.where(F.year(come) < 2000), base.where(F.year(come) == 2000), base.where(F.year(come) > 2000)]
    in_order = lambda rows: stream.running_bias_in_order(rows, "30 days")
    return rounded(_drain(_folder(spark, "ordered"), [p.orderBy(F.hash("ds", "y")) for p in parts], in_order, "append").drop("batch"))


# the history after three deliveries by year, every seventh order of the first years late by one
@query("delivered_history", """select o_orderpriority as series_id, cast(o_orderdate as date) as ds,
  cast(sum(floor(o_totalprice / 1000)) as double) as y,
  cast(coalesce(sum(floor(o_totalprice / 1000)) filter (where hour(o_orderdate) < 12), 0) as double) as partial_y from orders group by 1, 2""")
def _(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    part = F.when(F.year("o_orderdate") < 1997, 0).when(F.year("o_orderdate") < 2000, 1).otherwise(2)
    part = F.least(part + F.when(F.col("o_orderkey") % 7 == 0, 1).otherwise(0), F.lit(2))
    path = _folder(spark, "delivered")
    for k in range(3):
        deliver(orders.where(part == k), path, f"part-{k}", "o_orderdate", ["o_orderpriority"], F.floor(F.col("o_totalprice") / 1000), buckets=2)
    return read_deliveries(spark, path)
