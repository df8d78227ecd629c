"""A daily history that is kept up to date as facts are delivered.

The history is cut into parts by a hash of the series and by month.  A delivery is rolled up, the parts that its days
fall into are read, added to and written anew under a name of their own, and one commit record puts them in the place of
the old ones.  All other files stay as they are; a delivery that was killed is not seen, one that comes again is
skipped, and a reader keeps the files that it looked up.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .history import daily_rollup

#: Hash buckets of the series in a new history.
BUCKETS = 64
HISTORY = "series_id string, ds date, y double, partial_y double"
COMMIT = "delivery string, write string, parts array<struct<bucket: int, month: int>>, buckets int, committed bigint"


def _commits(spark: SparkSession, path: str) -> list:
    try:
        every = spark.read.schema(COMMIT).json(f"{path}/_deliveries").collect()  # one record per delivery
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted(every, key=lambda c: (c.committed, c.write))


def _places(commits: list) -> dict[tuple[int, int], str]:
    """The write that holds each part (bucket, month)."""
    return {(p.bucket, p.month): c.write for c in commits for p in c.parts}


def _read(spark: SparkSession, path: str, places: dict[tuple[int, int], str]) -> DataFrame:
    if not places:
        return spark.createDataFrame([], f"{HISTORY}, bucket int, month int")
    folders = [f"{path}/parts/write={w}/bucket={b}/month={m}" for (b, m), w in sorted(places.items())]
    schema = f"{HISTORY}, write string, bucket int, month int"
    return spark.read.schema(schema).option("basePath", f"{path}/parts").parquet(*folders).drop("write")


def read_deliveries(spark: SparkSession, path: str) -> DataFrame:
    """The history as of the last delivery: (series_id, ds, y, partial_y), one row per series and day."""
    return _read(spark, path, _places(_commits(spark, path))).drop("bucket", "month")


def deliver(
    facts: DataFrame, path: str, delivery: str, ts: str, keys: Sequence[str | Column], value: Column | None = None,
    cutoff_hour: int = 12, buckets: int = BUCKETS,
) -> bool:
    """Add the facts of one delivery, late ones included, to the history at ``path``; False if it was there already.

    Deliveries to one history follow each other; ``buckets`` counts for the first one."""
    spark = facts.sparkSession
    commits = _commits(spark, path)
    if any(c.delivery == delivery for c in commits):
        return False
    if commits:
        buckets = commits[0].buckets
    ensure_checkpoint_dir(spark)
    part = {
        "bucket": F.pmod(F.xxhash64("series_id"), F.lit(buckets)).cast("int"),
        "month": (F.year("ds") * 100 + F.month("ds")).cast("int"),
    }
    new = daily_rollup(facts, ts, keys, value, cutoff_hour).withColumns(part).checkpoint()
    touched = {(r.bucket, r.month) for r in new.select("bucket", "month").distinct().collect()}  # parts, not rows
    old = _read(spark, path, {p: w for p, w in _places(commits).items() if p in touched})
    both = old.unionByName(new).groupBy("bucket", "month", "series_id", "ds").agg(
        F.sum("y").alias("y"), F.sum("partial_y").alias("partial_y")
    )
    write = uuid.uuid4().hex
    # A part is a file, or a few: its rows are one per series of the bucket and day of the month.
    both.repartition("bucket", "month").sortWithinPartitions("bucket", "month", "series_id", "ds").write.partitionBy(
        "bucket", "month"
    ).parquet(f"{path}/parts/write={write}")
    record = [(delivery, write, sorted(touched), buckets, time.time_ns())]
    spark.createDataFrame(record, COMMIT).coalesce(1).write.mode("append").json(f"{path}/_deliveries")
    return True
