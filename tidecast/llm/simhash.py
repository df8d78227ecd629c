"""SimHash near-duplicates by a segment-popcount embedding and a grid range-join.

A text's fingerprint has the bits that are set in over half of its shingle hashes.  Two fingerprints are
linked if at most ``MOST_BITS`` bits differ, and linked ones form components.

Search.  Cut the 64 bits into 32 segments of two and map a fingerprint to the 32 counts of set bits.  Two
counts of a segment differ by no more than the bits that differ in it, so the Manhattan distance of the
embedded points is a lower bound of the Hamming distance.  The counts are written in unary (0, 1, 2 as 00,
01, 11), which turns the Manhattan distance into a bit count of an exclusive or.  The grid: the 32 axes are
dealt to ``GROUPS`` groups, and points at distance ``MOST_BITS`` or less agree on all axes of at least
``GROUPS - MOST_BITS`` groups, so every pair within range meets in a cell of one of the grids that these
choices of groups span.  Inside a cell the lower bound is tested first, then the exact distance.

Scale.  Equal fingerprints are one row before the search.  A cell with more than ``CELL`` points is dealt
into parts of about that size and each pair of parts is a cell of its own, so no task gets an unbounded cell
and no pair is lost.  Of the links inside a cell only a chain through each connected set leaves the task:
the output is linear in the points, never all pairs.

Defined cases: null texts and texts without a word have fingerprint 0, and link like any others; fewer
words than a shingle make one shingle; repeated rows each give a row; rows without an id get the
component of their text (null if no linked row has an id).
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, kept, per_document
from .components import connected

SHINGLE = 3
MOST_BITS = 3
SEED = 42
GROUPS = 6
#: Points of a cell that are compared in one task.
CELL = 4096
#: Cells of so many points are compared pair by pair in one vector operation.
FEW = 8

LOW_BITS = 0x5555555555555555


def axes_masks(groups: int = GROUPS, most_bits: int = MOST_BITS) -> list[int]:
    """One mask of the unary code for each choice of groups, as signed longs."""
    axes = np.array_split(np.arange(32), groups)
    masks = []
    for chosen in combinations(axes, groups - most_bits):
        mask = sum(3 << (2 * int(i)) for part in chosen for i in part)
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    return masks


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits; bytes.lower and bytes.split know the ASCII letters and the six breaks, nothing else."""
    parts = (text or "").encode().lower().split()
    if not parts:
        return 0
    whole = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(parts) - shingle + 1)
    last = ends[shingle - 1 :] if len(parts) >= shingle else ends[-1:]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(whole[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n
    )
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 1 << 15):
        part = hashes[k : k + (1 << 15)].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, fp): one row per document, hash of its text and fingerprint as signed longs."""

    def work(batch: pa.RecordBatch) -> list:
        texts = batch.column("text").to_pylist()
        fps = np.fromiter(map(fingerprint, texts), np.uint64, len(texts))
        ties = np.fromiter((xxhash.xxh64_intdigest((t or "").encode(), SEED) for t in texts), np.uint64, len(texts))
        return [batch.column("doc_id"), pa.array(ties.view(np.int64)), pa.array(fps.view(np.int64))]

    return per_document(docs, {"doc_id": "long", "text": "string"}, "doc_id long, tie long, fp long", work)


def unary(fp: np.ndarray) -> np.ndarray:
    """The embedded point of each fingerprint (unsigned), each count of two bits in unary."""
    low, high = fp & np.uint64(LOW_BITS), (fp >> np.uint64(1)) & np.uint64(LOW_BITS)
    return (low | high) | ((low & high) << np.uint64(1))


def _near(fp: np.ndarray, point: np.ndarray, f: np.uint64, p: np.uint64, most_bits: int) -> np.ndarray:
    """Indices within range of one fingerprint: the lower bound first, the exact distance of what is left."""
    maybe = np.flatnonzero(np.bitwise_count(point ^ p) <= most_bits)
    return maybe[np.bitwise_count(fp[maybe] ^ f) <= most_bits]


def _chains(fp: np.ndarray, most_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The connected sets of one cell, each as the links of a chain through its members."""
    point, new = unary(fp), np.ones(len(fp), bool)
    for first in range(len(fp)):
        if not new[first]:
            continue
        new[first], members, todo = False, [first], [first]
        while todo:
            i = todo.pop()
            found = _near(fp, point, fp[i], point[i], most_bits)
            found = found[new[found]]
            new[found] = False
            members.extend(found.tolist())
            todo.extend(found.tolist())
        if len(members) > 1:
            row = np.sort(fp[members])
            yield row[:-1], row[1:]


def _cell_links(keys: np.ndarray, fp: np.ndarray, most_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of all cells of sorted rows; ``keys`` numbers the cell of each row."""
    point, a, b = unary(fp), [], []
    edges = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
    sizes = np.diff(edges)
    small = np.repeat(sizes <= FEW, sizes)
    for step in range(1, FEW):
        i = np.flatnonzero(small[:-step] & (keys[:-step] == keys[step:])) if len(keys) > step else []
        if not len(i):
            break
        i = i[np.bitwise_count(point[i] ^ point[i + step]) <= most_bits]
        i = i[np.bitwise_count(fp[i] ^ fp[i + step]) <= most_bits]
        a.append(fp[i])
        b.append(fp[i + step])
    for k in np.flatnonzero(sizes > FEW):
        for x, y in _chains(np.unique(fp[edges[k] : edges[k + 1]]), most_bits):
            a.append(x)
            b.append(y)
    empty = [np.empty(0, np.uint64)]
    return np.concatenate(a or empty), np.concatenate(b or empty)


def links(points: DataFrame, most_bits: int = MOST_BITS, groups: int = GROUPS, cell: int = CELL) -> DataFrame:
    """(a, b) fingerprints that connect all pairs within range; ``points`` has distinct column fp."""
    low, high = F.col("fp").bitwiseAND(LOW_BITS), F.shiftrightunsigned("fp", 1).bitwiseAND(LOW_BITS)
    code = low.bitwiseOR(high).bitwiseOR(F.shiftleft(low.bitwiseAND(high), 1))
    cells = points.select("fp", code.alias("code")).select(
        "fp",
        F.posexplode(F.array(*[F.col("code").bitwiseAND(m) for m in axes_masks(groups, most_bits)])).alias("grid", "at"),
    )
    large = (
        cells.groupBy("grid", "at").count().where(F.col("count") > cell)
        .select("grid", "at", F.ceil(F.col("count") / cell).cast("int").alias("parts"))
    )
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    other = F.explode(F.expr("if(parts = 1, array(0), filter(sequence(0, parts - 1), x -> x <> part))"))
    dealt = (
        cells.join(large, ["grid", "at"], "left")
        .withColumn("parts", F.coalesce("parts", F.lit(1)))
        .withColumn("part", part).withColumn("other", other)
        .select("grid", "at", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "fp")
        .repartition("grid", "at", "i", "j").sortWithinPartitions("grid", "at", "i", "j")
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rest = batch if rest is None else pa.concat_batches([rest, batch])
            columns = [rest.column(c).to_numpy(zero_copy_only=False) for c in ("grid", "at", "i", "j")]
            change = np.zeros(max(rest.num_rows - 1, 0), bool)
            for c in columns:
                change |= c[1:] != c[:-1]
            if not change.any():  # one cell so far, which CELL bounds
                continue
            end = int(np.flatnonzero(change)[-1]) + 1
            keys = np.concatenate(([0], np.cumsum(change[: end - 1])))
            yield found(keys, rest.slice(0, end))
            rest = rest.slice(end)
        if rest is not None and rest.num_rows:
            yield found(np.zeros(rest.num_rows, np.int64), rest)

    def found(keys: np.ndarray, rows: pa.RecordBatch) -> pa.RecordBatch:
        a, b = _cell_links(keys, rows.column("fp").to_numpy().view(np.uint64), most_bits)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return arrow_map(dealt, work, "a long, b long")


def near_duplicates(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, tie (hash of the text), fp, root (fingerprint that stands for the component), component_id."""
    prints = kept(fingerprints(docs))
    points = kept(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = connected(links(points.select("fp"), most_bits))
    linked = kept(roots.join(points, F.col("node") == F.col("fp")).select("fp", "root", "first_id"))
    lowest = linked.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = linked.select("fp", "root").join(lowest, "root")
    classes = kept(
        points.join(named, "fp", "left").select(
            F.col("fp").alias("at"), F.coalesce("root", "fp").alias("root"),
            F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
    )
    # A fingerprint of very many copies is a hot key of the left side; both sides are stored rows.
    return prints.join(classes, F.col("fp") == F.col("at")).select(
        "doc_id", "tie", "fp", "root", "component_id"
    )


def components(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    return near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of ``docs``, all columns, that stand for their component: the smallest id, the text of the
    smallest hash where an id has several, and one row where rows repeat; without ids, by the hash alone."""
    first = near_duplicates(docs, most_bits).groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "tie")).alias("s")
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.col("doc_id").isNull().alias("none"),
        F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"),
        F.xxhash64(F.coalesce("text", F.lit(""))).alias("tie"),
    )
    keys = ["id", "none", "tie"]
    found = rows.join(first.select("s.*"), keys, "left_semi")
    place = F.row_number().over(W.partitionBy(*keys).orderBy(F.xxhash64("row")))
    return found.withColumn("place", place).where("place = 1").select("row.*")
