"""Token ids in ORC files.

Documents are range-partitioned and sorted by id, encoded in that order with the ``tokenizers`` library, an
end id is appended to each, and a partition becomes one ORC file (doc_id, seq, ids).  ORC writes integers run-length
encoded (bit-packed to the width of the ids), keeps the least and largest id of every stripe and of every
``INDEX_ROWS`` rows in its indexes, and a Bloom filter on ``doc_id``; so readers take stripes in parallel, and
a lookup of ids skips files, stripes and row groups.

The library's model encodes each distinct pretoken of a portion once; the split into pretokens and special
tokens is the vocabulary's own, as in ``bpe``.

Defined cases: null and empty texts have the end id only; rows without an id come first; rows of one id are
ordered by the hash of their text; an empty table gives a folder without rows.
"""

from __future__ import annotations

import json
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidecast.session import ensure_checkpoint_dir

from .bpe import Vocabulary, byte_characters
from .common import arrow_map, kept, per_document, portions

#: Id after each document.
END_ID = 0
#: Rows of a row group of the index; a document has some hundreds of ids.
INDEX_ROWS = 1000
#: Texts that are encoded at once: a larger portion has fewer distinct pretokens for its size.
PORTION_BYTES = 24 << 20


class LibraryEncoder(Vocabulary):
    """Encodes the distinct pretokens with the library's model in place of own merges."""

    def __init__(self, path: str) -> None:
        super().__init__(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"]:
            raise ValueError("a byte-level vocabulary without normalizer or prefix space is needed")
        self.model = Tokenizer.from_file(path).model
        self.letters = dict(enumerate(byte_characters()))

    def merge(self, pieces: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        ids, counts, blank = array("i"), np.empty(len(pieces), np.int64), self.letters[ord(" ")]
        for k, piece in enumerate(pieces.to_pylist()):
            # Printable ASCII stands for itself in the vocabulary, but for the blank.
            if piece.isascii() and piece.isprintable():
                letters = piece.replace(" ", blank)
            else:
                letters = piece.encode().decode("latin-1").translate(self.letters)
            found = self.model.tokenize(letters)
            ids.extend([t.id for t in found])
            counts[k] = len(found)
        return np.array(ids, np.int32), counts


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_token_files(docs: DataFrame, path: str, folder: str, end_id: int = END_ID) -> None:
    """One ORC file per range of ids, rows in ascending order of doc_id, ``seq`` numbering them in the file."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tie"), F.col("text").cast("string"))
    ordered = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            for part in portions(batch, PORTION_BYTES):
                ids, counts = library_encoder(path).encode(text.as_py() for text in part.column("text"))
                ends = np.cumsum(counts)
                offsets = np.concatenate(([0], ends + np.arange(1, len(ends) + 1))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.insert(ids, ends, end_id).astype(np.int32)))
                seq = pa.array(np.arange(at, at + part.num_rows))
                at += part.num_rows
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), seq, lists], ["doc_id", "seq", "ids"])

    encoded = arrow_map(ordered, run, "doc_id long, seq long, ids array<int>")
    (
        encoded.write.option("compression", "zstd")
        .option("orc.create.index", "true").option("orc.row.index.stride", str(INDEX_ROWS))
        .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
        .orc(folder)
    )


def read_token_files(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, ids) of the files; ``doc_ids`` is pushed down to their statistics and Bloom filters."""
    rows = spark.read.schema("doc_id long, seq long, ids array<int>").orc(folder)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def positions(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files of a folder.

    A document's start is the sum of the files before its own and of the rows before it in its file."""

    def work(batch: pa.RecordBatch) -> list:
        ids = batch.column("ids")
        flat = ids.values.to_numpy(zero_copy_only=False).astype("<u4")
        bounds = ids.offsets.to_numpy()
        crc = [zlib.crc32(flat[a:b].tobytes()) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        sizes = pa.array(np.diff(bounds).astype(np.int64))
        return [*(batch.column(c) for c in ("file", "seq", "doc_id")), sizes, pa.array(crc, pa.int64())]

    rows = read_token_files(spark, folder).withColumn(
        "file", F.regexp_extract(F.col("_metadata.file_name"), "part-([0-9]+)", 1).cast("long")
    )
    columns = {"file": "long", "seq": "long", "doc_id": "long", "ids": "array<int>"}
    schema = "file long, seq long, doc_id long, n_tokens long, ids_crc32 long"
    each = kept(per_document(rows, columns, schema, work))
    files = each.groupBy("file").agg(F.sum("n_tokens").alias("of_file"))
    before = files.select("file", (F.sum("of_file").over(W.orderBy("file")) - F.col("of_file")).alias("before"))
    inside = W.partitionBy("file").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    return each.join(before, "file").select(
        "doc_id",
        (F.col("before") + F.sum("n_tokens").over(inside) - F.col("n_tokens")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Write the token files of ``docs`` to a new folder that all executors share, and read them back."""
    spark = docs.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, path, folder)
    return positions(spark, folder)
