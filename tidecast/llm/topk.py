"""Exact top-k inner products by a bit-sliced index.

Vectors are quantised to integers and dealt into blocks.  Of a block the index holds, for every attribute,
the values above the block's least one, without their ``DROP`` lowest bits, as bit slices: slice b of attribute
d has one bit per row, bit b of the row's value.  For a batch of queries the slices are added with bitmap
arithmetic: bit j of a query's weight adds the attribute's slices, shifted by j, to the slices of the sum; a
negative weight adds the complement.  Then, from the most significant slice of the sum downward, the rows
that are among the largest are split off, which gives the k-th largest sum of the block without sorting.  The
dropped bits bound how far a row's score can lie from its sum, so all rows that may still be among the k best
follow from one comparison of the slices with a constant; only these boundary rows are scored exactly.

Scale.  Blocks and batches have a set size, each pair of them is a row of an equi-join and a task holds one
pair at a time.  Of a pair at most k rows per query leave the task; a window limit keeps k per query before
and after the shuffle.  Blocks grow in number, not in size.

Vectors with a component of ``WIDE`` or more, for which slices would be deep, stand beside the index: they are
scored against all queries, and such queries against all rows, block by block in exact whole numbers.

Defined cases: vectors that are null or hold null, NaN or infinite components take no part; scores beyond a long are held
at its ends; rows that repeat an id and vector count once; rows of one id with other vectors are rows of their own,
and a query never meets rows of its id; vectors of another length than the query's take no part in its
result; ties go to the smaller id; null ids take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, kept
from .negatives import products

SCALE = 1024
#: Rows of a block of the index, and queries of a batch.
BLOCK, BATCH = 8192, 256
#: Low bits that the index leaves out.
DROP = 3
#: Queries that are added at once, which bounds the memory of the sums.
AT_ONCE = 64
#: From here on a component is scored beside the index.
WIDE = float(1 << 20)


class Block:
    """Bit slices of one block: ``slices[d][b]`` is a bitmap over its rows."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, drop: int = DROP) -> None:
        self.ids, self.values, self.drop = ids, values, drop
        n, dims = values.shape
        self.words = -(-n // 64)
        self.valid = self.bitmap(np.ones(n, bool))
        self.least = values.min(axis=0) if n else np.zeros(dims, np.int64)
        raised = (values - self.least) >> drop
        self.depth = int(raised.max()).bit_length() if raised.size else 0
        self.slices = [
            [self.bitmap((raised[:, d] >> b) & 1 == 1) for b in range(self.depth)] for d in range(dims)
        ]

    def bitmap(self, flags: np.ndarray) -> np.ndarray:
        full = np.zeros(self.words * 64, bool)
        full[: len(flags)] = flags
        return np.packbits(full, bitorder="little").view(np.uint64)

    def sums(self, queries: np.ndarray) -> list[np.ndarray]:
        """Slices of the sum of |weight| times raised value (its complement for negative weights); each is a
        bitmap per query."""
        weight = np.abs(queries)
        total: list[np.ndarray] = []
        none = np.zeros((len(queries), self.words), np.uint64)
        every = np.uint64(0xFFFFFFFFFFFFFFFF)
        for d, slices in enumerate(self.slices):
            flip = np.where(queries[:, d] < 0, every, np.uint64(0))[:, None]
            for j in range(int(weight[:, d].max(initial=0)).bit_length()):
                on = np.where((weight[:, d] >> j) & 1 == 1, every, np.uint64(0))[:, None]
                if not on.any():
                    continue
                while len(total) < j + self.depth:
                    total.append(none.copy())
                carry = none
                for b, one in enumerate(slices):
                    addend = (one ^ flip) & on
                    had = total[j + b]
                    half = had ^ addend
                    total[j + b] = half ^ carry
                    carry = (had & addend) | (carry & half)
                at = j + self.depth
                while carry.any():
                    if at == len(total):
                        total.append(none.copy())
                    total[at], carry = total[at] ^ carry, total[at] & carry
                    at += 1
        return total

    def boundary(self, total: list[np.ndarray], queries: np.ndarray, allowed: np.ndarray, k: int) -> np.ndarray:
        """Bitmap per query of the rows that can be among its k best of the allowed ones."""
        count = lambda bitmaps: np.bitwise_count(bitmaps).sum(axis=1, dtype=np.int64)
        inside, open_rows = np.zeros_like(allowed), allowed.copy()
        kth = np.zeros(len(queries), np.int64)
        for i in range(len(total) - 1, -1, -1):
            tried = inside | (open_rows & total[i])
            enough = count(tried) >= k
            open_rows = np.where(enough[:, None], open_rows & total[i], open_rows & ~total[i])
            inside = np.where(enough[:, None], inside, tried)
            kth += np.where(enough, np.int64(1) << i, 0)
        # A row's score lies less than ``slack`` above 2^drop times its sum (plus what the query's rows share).
        slack = np.abs(queries).sum(axis=1) * ((1 << self.drop) - 1)
        floor = kth - (-(-slack >> self.drop))
        floor = np.where(count(allowed) <= k, 0, np.maximum(floor, 0))
        above, equal = np.zeros_like(allowed), allowed.copy()
        for i in range(len(total) - 1, -1, -1):
            bit = ((floor >> i) & 1 == 1)[:, None]
            above |= np.where(bit, np.uint64(0), equal & total[i])
            equal &= np.where(bit, total[i], ~total[i])
        return above | equal

    def best(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(position of the query, ids, scores) of each query's k best rows of the block, best first."""
        own = [self.bitmap(self.ids == q) for q in query_ids]
        allowed = self.valid & ~np.array(own).reshape(len(query_ids), self.words)
        rows = self.boundary(self.sums(queries), queries, allowed, k)
        flags = np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little")
        for i in range(len(query_ids)):
            at = np.flatnonzero(flags[i])
            score = self.values[at] @ queries[i]
            order = np.lexsort((self.ids[at], -score))[:k]
            yield i, self.ids[at][order], score[order]


def sound(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """(id, v, wide, dims): the vectors that take part, with doubles, and whether they stand beside the index."""
    v = F.col(f"`{vector_column}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    taken = vectors.where(v.isNotNull() & finite & F.col(f"`{id_column}`").isNotNull())
    return taken.select(
        F.col(f"`{id_column}`").cast("long").alias("id"), v.alias("v"), F.exists(v, lambda x: F.abs(x) >= WIDE).alias("wide"),
        F.size(v).alias("dims"),
    )


def quantised(rows: DataFrame) -> DataFrame:
    """The rows of the index, as whole numbers; repeated ones once."""
    whole = F.transform("v", lambda x: F.floor(x * SCALE).cast("long"))
    return rows.where("not wide").select("id", whole.alias("v"), "dims").distinct()


def _dealt(rows: DataFrame, size: int, seed: int, name: str) -> DataFrame:
    """Rows gathered to one row per block of about ``size``: (dims, name, ids, values)."""
    parts = rows.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))
    # One row per length of vectors; a block's number is drawn from the id's hash.
    number = F.pmod(F.xxhash64(F.lit(seed), "id"), F.col("parts")).cast("int")
    gathered = rows.join(parts, "dims").withColumn(name, number).groupBy("dims", name, "parts")
    return gathered.agg(F.sort_array(F.collect_list(F.struct("id", "v"))).alias("rows")).select(
        "dims", name, "parts", F.col("rows.id").alias(f"{name}_ids"), F.flatten("rows.v").alias(f"{name}_values")
    )


FOUND = "query_id long, vec_id long, score long"


def _beside(every: DataFrame, asked: DataFrame, k: int, block: int, batch: int) -> list[DataFrame]:
    """The k best rows of each block for the pairs of which the index has one side or none: all queries against wide
    rows, and wide queries against the others."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for data in batches:
            for i in range(data.num_rows):
                def column(name: str) -> np.ndarray:
                    return data.column(name)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023

                ids, query_ids, dims = column("block_ids"), column("batch_ids"), data.column("dims")[i].as_py()
                values, weights = column("block_values").reshape(len(ids), dims), column("batch_values").reshape(len(query_ids), dims)
                for a in range(0, len(query_ids), AT_ONCE):
                    for q, score in zip(query_ids[a : a + AT_ONCE], products(weights[a : a + AT_ONCE], values, SCALE)):
                        at = np.flatnonzero(ids != q)
                        # ~ turns the order round, without overflow.
                        at = at[np.lexsort((ids[at], ~score[at]))][:k]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(at), q)), pa.array(ids[at]), pa.array(score[at])], ["query_id", "vec_id", "score"]
                        )

    wide = every.where("wide")
    if wide.isEmpty() and asked.where("wide").isEmpty():
        return []
    out = []
    for queries, rows in ((asked, wide), (asked.where("wide"), every.where("not wide"))):
        pick = ("id", "v", "dims")
        blocks = _dealt(rows.select(*pick).distinct(), block, 1, "block").drop("parts")
        pairs = _dealt(queries.select(*pick).distinct(), batch, 2, "batch").drop("parts").join(blocks, "dims")
        slim = pairs.select("dims", "block_ids", "block_values", "batch_ids", "batch_values")
        out.append(arrow_map(slim, work, FOUND))
    return out


def top_k(
    vectors: DataFrame, queries: DataFrame, k: int, id_column: str = "vec_id", vector_column: str = "embedding",
    block: int = BLOCK, batch: int = BATCH,
) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k rows of largest integer inner product."""
    every, all_asked = sound(vectors, id_column, vector_column), sound(queries, id_column, vector_column)
    rows = kept(quantised(every))
    asked = quantised(all_asked)
    index = kept(_dealt(rows, block, 1, "block"))
    blocks = rows.groupBy("dims").agg(F.ceil(F.count(F.lit(1)) / block).alias("blocks"))
    batches = _dealt(asked, batch, 2, "batch").drop("parts").join(blocks, "dims")
    pairs = batches.withColumn("block", F.explode(F.expr("sequence(0, cast(blocks as int) - 1)"))).join(
        index, ["dims", "block"]
    )

    def work(batches_in: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, None
        for data in batches_in:
            for i in range(data.num_rows):
                def column(name: str) -> np.ndarray:
                    return data.column(name)[i].values.to_numpy(zero_copy_only=False).astype(np.int64)  # noqa: B023

                dims = data.column("dims")[i].as_py()
                if key != (dims, data.column("block")[i].as_py()):
                    key = dims, data.column("block")[i].as_py()
                    ids = column("block_ids")
                    held = Block(ids, column("block_values").reshape(len(ids), dims))
                query_ids = column("batch_ids")
                weights = column("batch_values").reshape(len(query_ids), dims)
                out: list[list[np.ndarray]] = [[], [], []]
                for at in range(0, len(query_ids), AT_ONCE):
                    names = query_ids[at : at + AT_ONCE]
                    for q, ids, scores in held.best(names, weights[at : at + AT_ONCE], k):
                        for to, x in zip(out, (np.full(len(ids), names[q]), ids, scores)):
                            to.append(x)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in out], ["query_id", "vec_id", "score"])

    slim = pairs.select("dims", "block", "block_ids", "block_values", "batch_ids", "batch_values")
    found = arrow_map(slim, work, FOUND)
    for more in _beside(every, all_asked, k, block, batch):
        found = found.unionByName(more)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
