"""Mixing sources to target weights by Pfair scheduling.

A source's texts, in an order shuffled by a hash of the id, are laid end to end and cut into blocks of
``block`` characters; a text belongs to the block in which it begins.  Time is counted in slots of one block.
With target weight w, block k of a source has the release time floor(k / w) and the deadline
ceil((k + 1) / w); earliest deadline first fills every slot.  With weights that add up to one, no block misses
its deadline, so what a source has sent never deviates from its share of the slots by a whole block.

Weights count exactly, as the decimals they are written as.  Over their common denominator they are whole
shares of a cycle; after it every source is exactly on its share, so the plan of one period (whole cycles, of
``least`` slots together) repeats, and a block's slot follows from its number.  Weights whose cycle is longer than
the phase are planned up to the end of the phase.  When a source has sent its last block, a new phase shares
the slots among the others; so every row is kept, once.  The driver sees one size per named source and plans, for
each phase, one period or the blocks of the phase, whichever is less.

Scale.  The position of a text in its source is the sum of all sizes before it: a source is cut by its hash
order into ``RANGES`` ranges, their sums are added up per source, and running sums are taken within a range.
So no task holds a source, however large.

Defined cases: sources without a weight of their own, null among them, share the weight ``rest`` as one
source; null and empty texts have size 1; equal ids, and null ones, stand next to each other in the order of
their texts' hashes; repeated rows each have a place; an empty table gives an empty one; weights must be
positive and name fewer than ``MOST_SOURCES`` sources.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import kept

BLOCK = 1 << 16
#: Slots that the plan of a period has at least.
CYCLE = 1024
MOST_SOURCES = 256
#: log2 of the ranges that a source is cut into.
RANGE_BITS = 12
#: A deadline beyond all slots counts as this one.
LAST = 1 << 62


def shares(weights: list[float], cycle: int = CYCLE) -> list[int]:
    """Slots of a cycle for each weight: the nearest whole numbers that add up, one at least."""
    exact = [w / sum(weights) * cycle for w in weights]
    out = [max(1, int(x)) for x in exact]
    while sum(out) != cycle:
        step = 1 if sum(out) < cycle else -1
        able = [i for i in range(len(out)) if step > 0 or out[i] > 1]
        out[max(able, key=lambda i: (step * (exact[i] - out[i]), -i))] += step
    return out


def exact_shares(weights: list[float]) -> list[int]:
    """The weights, as decimals, over their common denominator: whole numbers without a common factor."""
    exact = [Fraction(str(w)) for w in weights]
    over = lcm(*[x.denominator for x in exact])
    whole = [int(x * over) for x in exact]
    return [n // gcd(*whole) for n in whole]


def cycle_slots(per_cycle: list[int], slots: int | None = None, left: list[int] | None = None) -> list[list[int]]:
    """The slots of each source's blocks, earliest deadline first: of one cycle, or of the first ``slots``
    slots, or until a source has sent the blocks it has ``left``."""
    cycle = sum(per_cycle)
    out: list[list[int]] = [[] for _ in per_cycle]
    ready = sorted((-(-cycle // q), s) for s, q in enumerate(per_cycle))
    waiting: list[tuple[int, int, int]] = []
    for t in range(cycle if slots is None else slots):
        while waiting and waiting[0][0] <= t:
            heapq.heappush(ready, heapq.heappop(waiting)[1:])
        s = heapq.heappop(ready)[1]
        out[s].append(t)
        k, q = len(out[s]), per_cycle[s]
        if left is not None and k == left[s]:
            break
        heapq.heappush(waiting, (k * cycle // q, -(-(k + 1) * cycle // q), s))
    return out


def plan(weights: dict[int, float], blocks: dict[int, int], least: int = CYCLE) -> list[tuple]:
    """(source, first block, end block, first slot, period, slots, releases, deadlines) for each source of each
    phase; the lists are those of one period, counted from its start."""
    left, done, start, out = {s: n for s, n in blocks.items() if n}, dict.fromkeys(blocks, 0), 0, []
    while left:
        active = sorted(left)
        q = dict(zip(active, exact_shares([weights[s] for s in active])))
        cycle = sum(q.values())
        period = -(-least // cycle) * cycle
        slots = dict(zip(active, cycle_slots([*q.values()], period, [left[s] for s in active])))
        if any(len(slots[s]) == left[s] for s in active):  # a source ends within the first period
            length = sum(map(len, slots.values()))
        else:
            length = min(
                (left[s] - 1) // len(slots[s]) * period + slots[s][(left[s] - 1) % len(slots[s])] + 1 for s in active
            )
        for s in active:
            sent = len(slots[s]) * (length // period) + bisect_left(slots[s], length % period) if length > period else len(slots[s])
            if sent:
                releases = [k * cycle // q[s] for k in range(len(slots[s]))]
                deadlines = [min(-(-(k + 1) * cycle // q[s]), LAST) for k in range(len(slots[s]))]
                out.append((s, done[s], done[s] + sent, start, period, slots[s], releases, deadlines))
            done[s] += sent
            left[s] -= sent
        left = {s: n for s, n in left.items() if n}
        start += length
    return [(*x[:4], min(x[4], LAST), *x[5:]) for x in out]


def phases(weights: dict[int, float], blocks: dict[int, int], cycle: int = CYCLE) -> list[tuple]:
    """(source, first block, end block, first slot, slots) for each source of each phase of ``plan``, with the
    slots of all its blocks written out."""
    return [
        (s, a, b, start, [k // len(slots) * period + slots[k % len(slots)] for k in range(b - a)])
        for s, a, b, start, period, slots, *_ in plan(weights, blocks, cycle)
    ]


def schedule(
    docs: DataFrame, carry: list[str], weights: dict[str, float], rest: float, block: int = BLOCK, least: int = CYCLE
) -> DataFrame:
    """(row, slot, start, block, release, deadline, size): the columns ``carry`` of ``docs`` as one struct, and
    the place of each row; start is its position in its source, in characters."""
    if not len(weights) < MOST_SOURCES or min([rest, *weights.values()]) <= 0:
        raise ValueError(f"positive weights of fewer than {MOST_SOURCES} sources are needed")
    spark = docs.sparkSession
    number = F.lit(len(weights))
    if weights:
        numbers = F.create_map(*[F.lit(x) for i, name in enumerate(weights) for x in (name, i)])
        number = F.coalesce(F.try_element_at(numbers, F.coalesce(F.col("source").cast("string"), F.lit(""))), number)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
        number.alias("number"),
        F.col("doc_id").cast("long").alias("id"),
        F.xxhash64(F.col("doc_id").cast("long")).alias("key"),
        F.xxhash64("text").alias("tie"),
        F.greatest(F.coalesce(F.char_length("text"), F.lit(0)), F.lit(1)).cast("long").alias("size"),
    ).withColumn("range", F.shiftrightunsigned("key", 64 - RANGE_BITS))
    sums = kept(rows.groupBy("number", "range").agg(F.sum("size").alias("sum")))
    total = {x[0]: x[1] for x in sums.groupBy("number").agg(F.sum("sum")).collect()}
    rows_of_plan = plan(dict(enumerate([*weights.values(), rest])), {i: -(-n // block) for i, n in total.items()}, least)
    before = sums.select(
        "number", "range", (F.sum("sum").over(W.partitionBy("number").orderBy("range")) - F.col("sum")).alias("before")
    )
    # Of bounded size both: MOST_SOURCES << RANGE_BITS sums at most, and one period of slots per phase.
    within = W.partitionBy("number", "range").orderBy("key", "id", "tie").rowsBetween(W.unboundedPreceding, 0)
    placed = (
        rows.join(F.broadcast(before), ["number", "range"])
        .withColumn("start", F.col("before") + F.sum("size").over(within) - F.col("size"))
        .withColumn("block", F.floor(F.col("start") / block))
    )
    planned = spark.createDataFrame(
        rows_of_plan,
        "number int, first_block long, end_block long, first_slot long, period long, slots array<long>, "
        "releases array<long>, deadlines array<long>",
    )
    during = (F.col("block") >= F.col("first_block")) & (F.col("block") < F.col("end_block"))
    local = F.col("block") - F.col("first_block")
    n = F.size("slots").cast("long")
    at = (local % n).cast("int")
    begins = F.col("first_slot") + F.floor(local / n) * F.col("period")
    return placed.join(F.broadcast(planned), "number").where(during).select(
        "row",
        (begins + F.get("slots", at)).alias("slot"),
        "start",
        "block",
        (begins + F.get("releases", at)).alias("release"),
        (begins + F.get("deadlines", at)).alias("deadline"),
        "size",
    )


def mix_order(docs: DataFrame, weights: dict[str, float], rest: float, block: int = BLOCK) -> DataFrame:
    """doc_id, source, slot, start, block, release, deadline, size of every row."""
    return schedule(docs, ["doc_id", "source"], weights, rest, block).select(
        "row.*", "slot", "start", "block", "release", "deadline", "size"
    )


def mixed(docs: DataFrame, weights: dict[str, float], rest: float, block: int = BLOCK) -> DataFrame:
    """The rows and columns of ``docs`` in the order of the mix: partitions, and so the files of a written
    table, follow each other, and rows stand in order within one."""
    placed = schedule(docs, docs.columns, weights, rest, block).select("row", "slot", "start")
    return placed.repartitionByRange("slot", "start").sortWithinPartitions("slot", "start").select("row.*")
