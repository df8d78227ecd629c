"""The panels the registered queries run on, each with the same thing in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.sources.history import daily_rollup

# Dates inside the order history, so that earlier years and later rows both exist.
TARGET_DATES = ("1995-01-12", "1996-02-29", "1998-01-01", "1999-07-15", "2000-03-01", "2000-12-29")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def orders_panel(spark: SparkSession, d: str) -> DataFrame:
    """Daily order value in thousands, one series per order priority."""
    facts = table(spark, d, "orders")
    return daily_rollup(facts, "o_orderdate", ["o_orderpriority"], F.floor(F.col("o_totalprice") / 1000)).select(
        "series_id", "ds", "y"
    ).filter("y > 0")


ORDERS = """h as (
  select o_orderpriority as series_id, cast(o_orderdate as date) as ds,
         cast(sum(floor(o_totalprice / 1000)) as double) as y
  from orders group by 1, 2 having sum(floor(o_totalprice / 1000)) > 0)"""


def supplier_panel(spark: SparkSession, d: str, text: bool = True) -> DataFrame:
    """Daily shipped quantity, one series per supplier."""
    facts = table(spark, d, "lineitem")
    return daily_rollup(facts, "l_shipdate", ["l_suppkey"], F.col("l_quantity"), text=text).select(
        "series_id", "ds", "y"
    ).filter("y > 0")


SUPPLIERS = """h as (
  select cast(l_suppkey as varchar) as series_id, cast(l_shipdate as date) as ds,
         cast(sum(l_quantity) as double) as y
  from lineitem group by 1, 2 having sum(l_quantity) > 0)"""


def events_panel(spark: SparkSession, d: str) -> DataFrame:
    """Daily event counts with the count before noon, one series per event type."""
    return daily_rollup(table(spark, d, "events"), "ts", ["event_type"])


EVENTS = """h as (
  select event_type as series_id, cast(ts as date) as ds, cast(count(*) as double) as y,
         cast(count(*) filter (where hour(ts) < 12) as double) as partial_y
  from events group by 1, 2)"""


def targets(h: DataFrame, dates=TARGET_DATES) -> DataFrame:
    """The given dates for every series of a history."""
    days = F.array(*[F.lit(x).cast("date") for x in dates])
    return h.select("series_id").distinct().select("series_id", F.explode(days).alias("target_ds"))


def targets_sql(dates=TARGET_DATES) -> str:
    days = ", ".join(f"date '{x}'" for x in dates)
    return f"t as (select series_id, unnest([{days}]) as target_ds from (select distinct series_id from h))"


TARGETS = targets_sql()
