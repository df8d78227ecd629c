"""What the operators of this subpackage share: words, kept results, Arrow batches, column names."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidecast.session import ensure_checkpoint_dir

#: Between two words: blank and the control characters from tab to carriage return.
BREAKS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text in order; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BREAKS, -1), "")


def kept(df: DataFrame) -> DataFrame:
    """Computed once and cut off from its lineage, in the folder that all executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def free_name(df: DataFrame, base: str) -> str:
    """A column name that the table does not have yet."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def arrow_map(df: DataFrame, run: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with a function of this package, which the executors' Python can then import."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Hand the package to the executors, as ``--py-files`` would, once per application: they need no copy of
    their own, and keep what a module remembers from task to task."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp()) / f"{package.name}.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))  # copied from the driver by Spark itself
    _SHIPPED.add(context.applicationId)


def held_out(doc_id: Column) -> Column:
    """Rows of which no label may be learned: crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def per_document(
    docs: DataFrame, columns: dict[str, str], schema: str, work: Callable[[pa.RecordBatch], list[pa.Array]], most: int | None = None
) -> DataFrame:
    """Map the Arrow batches of the named columns (cast to the given types) to those of a schema, in portions of ``most``
    bytes (``PORTION_BYTES``)."""
    out = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, most or PORTION_BYTES):
                arrays = work(part)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(a, f.type) if not isinstance(a, pa.Array) else a.cast(f.type) for a, f in zip(arrays, out)],
                    schema=out,
                )
            # Python workers live on beyond a task: hand back what Arrow keeps for reuse.
            pa.default_memory_pool().release_unused()

    return arrow_map(docs.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()]), run, schema)


#: Texts are worked on in portions of about so many bytes, so that memory follows this and not the batch.
PORTION_BYTES = 12 << 20


def portions(batch: pa.RecordBatch, most: int = PORTION_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of rows of ``most`` bytes at the outside; one long row is a run of its own."""
    if batch.nbytes <= most or batch.num_rows <= 1:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    for part in (batch.slice(0, half), batch.slice(half)):
        size = sum(b.nbytes for b in pa.Table.from_batches([part]).combine_chunks().columns)
        if size <= most or part.num_rows <= 1:
            yield part
        else:
            yield from portions(part, most)


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of many runs, one after the other: start, start + 1, ... for each length."""
    total = int(lengths.sum())
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(total)
