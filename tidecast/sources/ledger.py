"""The forecast ledger: one folder of Parquet files per write of a run, and a catalogue of commits.

A write puts its rows into a folder of its own and then adds a commit record, which alone makes them visible: a
write that was killed leaves nothing to read, and writing a run again (a retried job) replaces it in one step.  Readers
look up the run of the newest predictions, unless they name one, in the catalogue, one small record per write, and
read that run's folder only.  ``trim_ledger`` keeps the newest runs, merges the records of the catalogue and
removes the folders that no reader can reach.
"""

from __future__ import annotations

import re
import time
import uuid
from urllib.parse import quote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

# The columns of a ledger record.
LEDGER_SCHEMA = """series_id string, seq bigint, prediction_date date, prediction_timestamp timestamp,
final_prediction double, pred_lower double, pred_upper double, confidence_score int,
ml_prediction double, stat_prediction double, actual_value double, error double, error_pct double,
bias_correction_applied boolean, bias_correction_amount double, run_id string"""
COLUMNS = [c.split()[0] for c in LEDGER_SCHEMA.replace("\n", " ").split(",")]


def as_ledger(df: DataFrame, run_id: str) -> DataFrame:
    """Bring prediction records to the ledger's columns; missing ones become null, and
    the correction defaults to none."""
    types = dict(c.split() for c in LEDGER_SCHEMA.replace("\n", " ").split(","))
    defaults = {
        "prediction_timestamp": F.current_timestamp(), "run_id": F.lit(run_id),
        "bias_correction_applied": F.lit(False), "bias_correction_amount": F.lit(0.0),
        "seq": F.unix_date("prediction_date").cast("bigint"),
    }
    out = []
    for c in COLUMNS:
        value = F.col(c) if c in df.columns and c != "run_id" else defaults.get(c, F.lit(None))
        out.append(value.cast(types[c]).alias(c))
    return df.select(*out)


COMMIT_SCHEMA = "run_id string, folder string, at bigint, rows bigint, committed bigint"


def _commits(spark: SparkSession, path: str) -> list[Row]:
    """The commit that holds for each run, the newest run first: by its latest prediction, then by its name, numbers in
    names by their value."""
    try:
        every = spark.read.schema(COMMIT_SCHEMA).json(f"{path}/_commits").collect()  # one small record per write
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    last: dict[str, Row] = {}
    for c in sorted(every, key=lambda c: (c.committed, c.folder)):
        last[c.run_id] = c

    def order(c: Row):
        number = re.search(r"([0-9]{1,18})$", c.run_id)
        return (c.at is not None, c.at or 0, int(number[1]) if number else -1, c.run_id)

    return sorted(last.values(), key=order, reverse=True)


def _record(spark: SparkSession, path: str, commits: list[tuple]) -> None:
    # Spark moves finished files into the folder, so that a record is there as a whole or not at all.
    spark.createDataFrame(commits, COMMIT_SCHEMA).coalesce(1).write.mode("append").json(f"{path}/_commits")


def _folder(path: str, run_id: str, folder: str) -> str:
    return f"{path}/run_id={quote(run_id, safe='')}/write={folder}"


def _files(spark: SparkSession, path: str):
    """A path and its file system."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def append_ledger(df: DataFrame, path: str, run_id: str) -> None:
    """Write the records of one run and commit them; what was written for that run before goes then."""
    spark, folder = df.sparkSession, uuid.uuid4().hex
    replaced = [c for c in _commits(spark, path) if c.run_id == run_id]
    here = _folder(path, run_id, folder)
    as_ledger(df, run_id).write.parquet(here)
    written = spark.read.schema(LEDGER_SCHEMA).parquet(here)
    got = written.agg(F.unix_micros(F.max("prediction_timestamp")).alias("at"), F.count(F.lit(1)).alias("rows")).first()
    _record(spark, path, [(run_id, folder, got["at"], got["rows"], time.time_ns())])
    for c in replaced:
        _files(spark, path)[1].delete(_files(spark, _folder(path, run_id, c.folder))[0], True)


def read_ledger(spark: SparkSession, path: str, run_id: str | None = None) -> DataFrame:
    """One committed run of a ledger, the newest if none is named, read from its own folder; empty if there is none."""
    commit = next((c for c in _commits(spark, path) if run_id in (None, c.run_id)), None)
    if commit is None:
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(_folder(path, commit.run_id, commit.folder))


def runs(spark: SparkSession, path: str) -> list[str]:
    """The names of the committed runs, the newest first."""
    return [c.run_id for c in _commits(spark, path)]


def trim_ledger(spark: SparkSession, path: str, keep: int, grace_hours: float = 24.0) -> None:
    """Keep the newest ``keep`` runs, with one file of records, and remove all other folders.

    Folders without a commit may belong to a write that is under way: they go once they are older than
    ``grace_hours``, as do those that a reader may just have looked up."""
    files = _files(spark, path)[1]

    def below(folder: str) -> list:
        at = _files(spark, folder)[0]
        return list(files.listStatus(at)) if files.exists(at) else []

    old = [s.getPath() for s in below(f"{path}/_commits")]
    kept = _commits(spark, path)[:keep]
    if kept:
        # First the merged records, then the old ones go: a record that is there twice does no harm.
        _record(spark, path, [tuple(c) for c in kept])
    for p in old:
        files.delete(p, False)
    reachable = {tuple(_folder("", c.run_id, c.folder).split("/")[1:]) for c in kept}
    before = (time.time() - grace_hours * 3600) * 1000
    for run in below(path):
        if not run.getPath().getName().startswith("run_id="):
            continue
        for s in below(run.getPath().toString()):
            name = run.getPath().getName(), s.getPath().getName()
            if name not in reachable and s.getModificationTime() <= before:
                files.delete(s.getPath(), True)
        if not below(run.getPath().toString()):
            files.delete(run.getPath(), True)


def with_actuals(ledger: DataFrame, h: DataFrame) -> DataFrame:
    """Fill actual values and errors (prediction minus actual) from a history."""
    known = h.select("series_id", F.col("ds").alias("prediction_date"), F.col("y").alias("_y"))
    x = ledger.join(known, ["series_id", "prediction_date"], "left")
    actual = F.coalesce("_y", "actual_value")
    error = F.col("final_prediction") - actual
    return x.withColumns(
        {"actual_value": actual, "error": error, "error_pct": F.try_divide(error, actual) * 100}
    ).select(*ledger.columns)
