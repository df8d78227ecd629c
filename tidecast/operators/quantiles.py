"""Exact quantiles of all columns of a vector at once, by narrowing histograms.

A double is read as a 64-bit number in the same order.  Three passes over the rows fix its 22 highest, the next 21 and
the last 21 bits: each counts, per column, the values of the next bits among those that share the bits fixed so far
for a wanted rank, adds the counts up over the tasks, and picks the value at which the running count reaches the
rank.  A task sends at most one count per distinct value of its own; one row per column and rank goes on.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Ship what this module holds with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bits fixed by each pass.
PASSES = (22, 21, 21)
SIGN = np.uint64(1 << 63)


def ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned numbers in the same order (-0 as 0)."""
    bits = (np.ascontiguousarray(x) + 0.0).view(np.uint64)
    return np.where(bits & SIGN, ~bits, bits | SIGN)


def unordered(k: np.ndarray) -> np.ndarray:
    k = np.asarray(k, np.uint64)
    return np.where(k & SIGN, k & ~SIGN, ~k).view(float)


def _counts(rows: DataFrame, known: dict[int, list[int]], done: int, bits: int) -> DataFrame:
    """(fold, col, prefix, next, n): how often the next bits occur among values that start with a known prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold = b.column("fold").to_numpy()
            flat = b.column("x").flatten().to_numpy(zero_copy_only=False)
            if not len(flat):
                continue
            keys = ordered(flat).reshape(b.num_rows, -1)
            for col in range(keys.shape[1]):
                key, at = keys[:, col], fold.astype(np.int64)
                starts = np.array(known[col], np.uint64)
                which = np.zeros(len(key), np.int64)
                if done:
                    prefix = key >> np.uint64(64 - done)
                    which = np.minimum(np.searchsorted(starts, prefix), len(starts) - 1)
                    mine = starts[which] == prefix
                    key, at, which = key[mine], at[mine], which[mine]
                rest = ((key << np.uint64(done)) >> np.uint64(64 - bits)).astype(np.int64)
                # Fold (from -1), prefix and next bits in one number.
                each, n = np.unique((((at + 1) * len(starts) + which) << bits) | rest, return_counts=True)
                group = each >> bits
                yield pa.RecordBatch.from_arrays(
                    [pa.array((group // len(starts) - 1).astype(np.int32)), pa.array(np.full(len(n), col, np.int32)),
                     pa.array(starts[group % len(starts)].astype(np.int64)), pa.array(each & ((1 << bits) - 1)), pa.array(n.astype(np.int64))],
                    ["fold", "col", "prefix", "next", "n"],
                )

    found = rows.mapInArrow(run, "fold int, col int, prefix long, next long, n long")
    return found.groupBy("fold", "col", "prefix", "next").agg(F.sum("n").alias("n"))


def exact_quantiles(
    df: DataFrame, shares: Sequence[float], upto: Sequence[int] | None = None, between: bool = True
) -> dict[int, np.ndarray]:
    """Per fold of ``upto``, (shares, columns) quantiles of ``raw`` over the rows of earlier folds, with linear
    interpolation between neighbours; without folds, of all rows under 0.  Without ``between`` the least value that at
    least that share of the rows does not exceed."""

    def place(n: int, share: float) -> float:
        return (n - 1) * share if between else max(int(np.ceil(n * share)), 1) - 1

    fold = F.col("fold").cast("int") if upto is not None else F.lit(-1)
    rows = df.select(fold.alias("fold"), vector_to_array("raw").alias("x"))
    sizes = {r.fold: r.n for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n")).collect()}
    ends = list(upto) if upto is not None else [0]
    first = df.select("raw").first()
    if first is None:
        raise ValueError("no rows")
    width = len(first["raw"])
    ranks: dict[int, list[int]] = {}
    for e in ends:
        n = sum(v for k, v in sizes.items() if k < e)
        if not n:
            raise ValueError(f"no rows before fold {e}")
        ranks[e] = sorted({int(r) for s in shares for r in (np.floor(place(n, s)), np.ceil(place(n, s)))})
    # (end, col, rank among all) -> (prefix so far, rank within the prefix)
    state = {(e, c, r): (0, r) for e in ends for c in range(width) for r in ranks[e]}
    spark, done = df.sparkSession, 0
    for bits in PASSES:
        known: dict[int, list[int]] = {}
        for (_, c, _), (prefix, _) in state.items():
            known.setdefault(c, []).append(prefix)
        known = {c: sorted(set(v)) for c, v in known.items()}
        each = _counts(rows, known, done, bits).withColumn("end", F.explode(F.array(*[F.lit(e) for e in ends]))).where("fold < end")
        each = each.groupBy("end", "col", "prefix", "next").agg(F.sum("n").alias("n"))
        over = Window.partitionBy("end", "col", "prefix").orderBy("next")
        running = each.withColumn("upto", F.sum("n").over(over))
        wanted = spark.createDataFrame(
            [(e, c, p, r, w) for (e, c, r), (p, w) in state.items()], "end int, col int, prefix long, rank long, within long"
        )
        hit = running.join(wanted, ["end", "col", "prefix"]).where("within < upto and within >= upto - n")
        state = {
            (h["end"], h["col"], h["rank"]): ((h["prefix"] << bits) | h["next"], h["within"] - (h["upto"] - h["n"]))
            for h in hit.collect()  # one row per fold, column and rank
        }
        done += bits
    out = {}
    for e in ends:
        n = sum(v for k, v in sizes.items() if k < e)
        value = {(c, r): float(unordered(np.array([state[e, c, r][0]], np.uint64))[0]) for c in range(width) for r in ranks[e]}
        grid = np.empty((len(shares), width))
        for i, s in enumerate(shares):
            at = place(n, s)
            low, high = int(np.floor(at)), int(np.ceil(at))
            grid[i] = [value[c, low] + (value[c, high] - value[c, low]) * (at - low) for c in range(width)]
        out[e] = grid
    return out
