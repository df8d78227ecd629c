"""Daily history: read, canonicalise, clean and roll up.

A history is ``(series_id STRING, ds DATE, y DOUBLE[, partial_y DOUBLE])`` with one
row per series and day.  That uniqueness is what bounds every per-series window in
the library: however many facts a hot series has, it reaches a window as at most
one row per calendar day.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir, planned_tasks

# Column names accepted for the date, the total and the noon count.
DATE_NAMES = ("Date", "日付", "date")
TOTAL_NAME = "合計"
NOON_NAME = "件数(～12:00)"


#: What the names of materialised histories begin with.
MADE = "history_"


def read_history(
    spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | str | None = None
) -> DataFrame:
    """Read history files; ``path`` may be a glob.  CSV always needs a schema, so no
    inference pass over the data is made."""
    reader = spark.read
    if fmt == "csv":
        if schema is None:
            raise ValueError("a CSV history needs an explicit schema")
        reader = reader.option("header", True).option("mode", "PERMISSIVE")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.format(fmt).load(path)


def normalise_columns(
    df: DataFrame,
    series: str | None = None,
    date_names: Sequence[str] = DATE_NAMES,
    total: str = TOTAL_NAME,
    noon: str = NOON_NAME,
) -> DataFrame:
    """Rename the first date alias present, the total and the noon count to the
    canonical names; a table without a series column becomes one series."""
    renames = {total: "y", noon: "partial_y"}
    if series:
        renames[series] = "series_id"
    if "ds" not in df.columns:
        for name in date_names:
            if name in df.columns:
                renames[name] = "ds"
                break
    out = df.withColumnsRenamed({k: v for k, v in renames.items() if k in df.columns})
    return out if "series_id" in out.columns else out.withColumn("series_id", F.lit("all"))


def _as_date(df: DataFrame, name: str) -> Column:
    if df.schema[name].dataType.typeName() == "string":
        return F.try_to_timestamp(F.col(name)).cast("date")
    return F.col(name).cast("date")


def _as_double(df: DataFrame, name: str) -> Column:
    c = F.col(name)
    return c.try_cast("double") if df.schema[name].dataType.typeName() == "string" else c.cast("double")


def clean_history(df: DataFrame, lenient: bool = False, merge_days: bool = True) -> DataFrame:
    """Parse dates (bad ones become null and are dropped), make ``y`` numeric, keep
    ``y > 0``.  Strict drops null totals; lenient turns them into 0, which the
    positive filter then removes too, so only the handling of text differs.
    ``merge_days`` adds up repeated dates so a series has one row per day."""
    has_noon = "partial_y" in df.columns
    y = _as_double(df, "y")
    out = df.select(
        "series_id",
        _as_date(df, "ds").alias("ds"),
        (F.coalesce(y, F.lit(0.0)) if lenient else y).alias("y"),
        *([_as_double(df, "partial_y").alias("partial_y")] if has_noon else []),
    ).dropna(subset=["ds", "y"])
    if merge_days:
        sums = [F.sum("y").alias("y")] + ([F.sum("partial_y").alias("partial_y")] if has_noon else [])
        out = out.groupBy("series_id", "ds").agg(*sums)
    return out.filter(F.col("y") > 0)


def daily_rollup(
    facts: DataFrame,
    ts: str,
    keys: Sequence[str | Column],
    value: Column | None = None,
    cutoff_hour: int = 12,
    text: bool = True,
) -> DataFrame:
    """Facts to daily totals with the part seen before ``cutoff_hour``.

    One aggregation with map-side partials: a task ships at most one row per
    (series, day) it saw, so a series holding a third of the facts costs no more
    shuffle than a small one.  Without ``text`` a series named by a whole number keeps it.
    """
    amount = F.lit(1.0) if value is None else value.cast("double")
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    # A whole number is grouped as it is, which is less to hash and to ship than its text.
    whole = len(cols) == 1 and isinstance(facts.select(cols[0]).schema[0].dataType, T.IntegralType)
    series = cols[0] if whole else F.concat_ws("|", *[c.cast("string") for c in cols]) if len(cols) > 1 else cols[0].cast("string")
    daily = (
        facts.select(
            series.alias("series_id"),
            F.to_date(ts).alias("ds"),
            amount.alias("v"),
            F.when(F.hour(ts) < cutoff_hour, amount).alias("early"),
        )
        .filter(F.col("ds").isNotNull() & F.col("series_id").isNotNull())
        .groupBy("series_id", "ds")
        .agg(F.sum("v").alias("y"), F.coalesce(F.sum("early"), F.lit(0.0)).alias("partial_y"))
    )
    return daily.withColumn("series_id", F.col("series_id").cast("string")) if text else daily


def materialise(h: DataFrame) -> DataFrame:
    """Write a history that came from a query as a table bucketed by series, in the
    cluster's checkpoint folder.

    Every pass over it then starts from the daily rows, not from the facts, finds its
    series already together (windows over a bucketed table need no shuffle), and
    survives a lost executor by reading the files again.  ``drop_materialised`` removes
    such tables when they are no longer read.
    """
    spark, name = h.sparkSession, f"{MADE}{uuid.uuid4().hex}"
    folder = f"{ensure_checkpoint_dir(spark)}/{name}"
    tasks = planned_tasks(spark)
    (
        h.repartition(tasks, "series_id").write.bucketBy(tasks, "series_id").sortBy("series_id", "ds")
        .option("path", folder).saveAsTable(name)
    )
    return spark.table(name)


def drop_materialised(spark: SparkSession) -> None:
    """Drop the history tables of this session's catalog, and their files."""
    jvm = spark.sparkContext._jvm
    for t in spark.catalog.listTables():
        if t.name.startswith(MADE):
            where = spark.sql(f"describe formatted {t.name}").where("col_name = 'Location'").first()["data_type"]
            spark.sql(f"drop table {t.name}")
            path = jvm.org.apache.hadoop.fs.Path(where)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def overview(h: DataFrame) -> DataFrame:
    """First and last day, number of days, mean and standard deviation per series."""
    return h.groupBy("series_id").agg(
        F.min("ds").alias("first_ds"),
        F.max("ds").alias("last_ds"),
        F.count("y").alias("n"),
        F.avg("y").alias("mean"),
        F.stddev_samp("y").alias("std"),
    )
