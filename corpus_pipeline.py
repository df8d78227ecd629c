"""Raw documents to token ids: quality rules, near-duplicates, secrets, mixing, byte-level BPE.

Each stage takes (spark, docs, sf_dir), works on all rows that its predecessor kept and returns a DataFrame;
all but the last return the columns of documents; the last one's rows have their place in the mix.  ``run`` writes each stage's rows as Parquet to the folder
that the executors share and reads them again, so a lost executor costs a part of one stage only.

In every stage nulls are allowed in any column, repeated rows are rows of their own, more columns of ``documents`` are
carried as they are, and an empty table gives an empty one.
"""

from __future__ import annotations

import re
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidecast.llm import bpe, mixing, quality_rules, secret_scan, simhash
from tidecast.llm.queries import MIX, MIX_REST, VOCABULARY, trusted
from tidecast.session import ensure_checkpoint_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or resemble the raw corpus more than the trusted one go.  Null, empty and very
    short texts (under 10 words) fail; a document without id is judged by its text and trusted by nobody."""
    return quality_rules.good_documents(docs, trusted(spark, sf_dir))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates the smallest id stays; of equal rows, or rows of one id in a component, one.
    Texts without words have fingerprint zero and are duplicates of each other."""
    return simhash.one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by their kind.  A null text stays null, one without secrets as it is."""
    return secret_scan.redact(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays, once; the files and their rows stand in the order of the mix.  Null and unnamed sources share
    one weight; null and empty texts count as one character; ties go by the hash of the text."""
    return mixing.mixed(docs, MIX, MIX_REST)


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` and ``place``: a row's number, from 0, in the order of the files' names and of the rows in them, in
    which Spark does not read them; null if the table does not come from files."""
    if not docs.inputFiles():
        return docs.withColumn("place", F.lit(None).cast("long"))
    # One row per file; numbers within a name have no fixed width.
    files = docs.groupBy(F.col("_metadata.file_name").alias("file")).count().collect()
    files.sort(key=lambda r: [int(x) if x.isdigit() else x for x in re.split(r"(\d+)", r["file"])])
    before, first = 0, []
    for r in files:
        first.append((r["file"], before))
        before += r["count"]
    starts = F.broadcast(docs.sparkSession.createDataFrame(first, "place_file string, place_before long"))
    read = docs.select(*docs.columns, F.col("_metadata.file_name").alias("place_name"), F.col("_metadata.row_index").alias("place_row"))
    return read.join(starts, F.col("place_name") == F.col("place_file")).select(
        *docs.columns, (F.col("place_before") + F.col("place_row")).alias("place")
    )


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digests of the ids of each document and of the text that they decode to, and ``place``, its number in the mix.
    Null and empty texts have no ids and decode to the empty text."""
    return bpe.digests(placed(docs), public_tokenizers.path(VOCABULARY), {"place": "long"})


STAGES = [
    ("quality_rules", quality),
    ("simhash_dedup", near_duplicates),
    ("secret_scan", secrets),
    ("mixing", mix),
    ("bpe", tokens),
]

#: Fingerprints, components, linked spans, schedules and BPE are beyond SQL; tests hold the rows against
#: plain versions of the five stages.
ORACLE_SQL = None


def _remove(spark: SparkSession, folder: str) -> None:
    """Remove the rows of a stage that its successor has written anew."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            here = f"{folder}/{k}-{name}"
            docs.write.parquet(here)
            docs = spark.read.parquet(here)
            if before:
                _remove(spark, before)
            before = here
    return docs
