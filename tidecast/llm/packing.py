"""Best-fit packing of tokenised documents by swap-based local search.

Documents are encoded, get an end id and are cut only if they are longer than a sequence: into full pieces, of which
the first takes what is over.  Full pieces are sequences of their own; the others are packed by length.  A packing
starts as best fit of the longest first.  Then underfull sequences exchange pieces: from the fullest on, one of them
takes from less full ones the piece or two that fit its free room best, in return for nothing (a move), for one piece
(one for one, two for one) or for two (one for two).  A fuller sequence gains what a less full one loses, so the sum
of squared fills rises with each exchange and free room gathers in few sequences, until one of them is empty.

Scale.  Lengths, not tokens, are packed: pieces are dealt by hash into groups of about ``GROUP``, each packed in a
task.  Sequences that are left underfull go on, as they stand, to a next round with fewer groups, until one
group has held all of them or a round no longer saves a sequence; the driver sees counts.  Tokens are written once, to
the folder that all executors share, and get their places by one join on the piece's number.

Defined cases: null and empty texts have the end id only; documents without id or with a repeated one are
packed as any other; an empty table has no pieces.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidecast.session import ensure_checkpoint_dir

from .common import arrow_map, kept, per_document, portions
from .token_files import END_ID, PORTION_BYTES, library_encoder

#: Tokens of a sequence.
ROOM = 2048
#: Pieces that one task packs.
GROUP = 100_000


class Packing:
    """Sequences of one group: pieces in bins of a set room."""

    def __init__(self, room: int, bins: list[list[tuple[int, int]]]) -> None:
        """Each bin is a list of pieces (length, number)."""
        self.room = room
        self.bins = [sorted(b) for b in bins]
        self.fill = [sum(length for length, _ in b) for b in bins]

    @classmethod
    def best_fit(cls, room: int, pieces: list[tuple[int, int]]) -> Packing:
        """Longest first, each into the bin that it fills best."""
        bins: list[list[tuple[int, int]]] = []
        by_free: list[list[int]] = [[] for _ in range(room + 1)]
        open_rooms = 0  # bit f is set where a bin has f free
        for piece in sorted(pieces, reverse=True):
            length = piece[0]
            fitting = open_rooms >> length
            if fitting:
                free = length + (fitting & -fitting).bit_length() - 1
                at = by_free[free].pop()
                if not by_free[free]:
                    open_rooms ^= 1 << free
                bins[at].append(piece)
            else:
                free, at = room, len(bins)
                bins.append([piece])
            left = free - length
            if left:
                by_free[left].append(at)
                open_rooms |= 1 << left
        return cls(room, bins)

    def improve(self) -> None:
        """Exchange pieces between underfull bins until no exchange raises the sum of squared fills."""
        while self._round():
            pass
        kept_bins = [i for i, b in enumerate(self.bins) if b]
        self.bins, self.fill = [self.bins[i] for i in kept_bins], [self.fill[i] for i in kept_bins]

    def _round(self) -> bool:
        order = sorted((i for i, f in enumerate(self.fill) if 0 < f < self.room), key=lambda i: (-self.fill[i], i))
        stock = Stock(self.room)
        for i in order:
            for length, _ in self.bins[i]:
                stock.add(length, i)
            stock.add_pairs([length for length, _ in self.bins[i]], i)
        changed = False
        for i in order:
            # A bin takes from those after it.
            for length, _ in self.bins[i]:
                stock.remove(length, i)
            while 0 < self.fill[i] < self.room and self._exchange(i, stock):
                changed = True
        return changed

    def _exchange(self, i: int, stock: Stock) -> bool:
        """The exchange that fills bin i best, of those that raise the sum of squared fills; False if there is none."""
        free, offers = self.room - self.fill[i], []
        have = Counter(length for length, _ in self.bins[i])
        mine = sorted(have)
        two = stock.two_at_most(free)
        if two:
            offers.append((sum(two), (), two, None))
        for given in ((), *((a,) for a in mine), *((a, b) for a in mine for b in mine if a < b or a == b and have[a] > 1)):
            back = sum(given)
            one = stock.at_most(back + free)
            if one > back:
                offers.append((one - back, given, (one,), None))
            if len(given) == 1:
                pair = stock.pair_at_most(back + free)
                if pair and pair[0] > back:
                    offers.append((pair[0] - back, given, pair[2:], pair[1]))
        for _, given, taken, donor in sorted(offers, key=lambda o: (-o[0], len(o[1]) + len(o[2]))):
            donors: list[int] = [donor] * len(taken) if donor is not None else []
            if donor is None:
                # Each piece comes from the least full bin that has it.
                for length in taken:
                    owners = [j for j, n in stock.owners[length].items() if n > sum(x == (j, length) for x in zip(donors, taken))]
                    if owners:
                        donors.append(min(owners, key=lambda j: (self.fill[j], j)))
            if len(donors) == len(taken) and self._rises(i, given, taken, donors):
                for length, j in zip(taken, donors):
                    self._move(length, j, i)
                    stock.remove(length, j)
                for length in given:
                    self._move(length, i, donors[0])
                    stock.add(length, donors[0])
                return True
        return False

    def _rises(self, i: int, given: tuple[int, ...], taken: tuple[int, ...], donors: list[int]) -> bool:
        """Whether the first donor has room for what is given, and the sum of squared fills becomes larger."""
        change = Counter({i: sum(taken) - sum(given)})
        for length, j in zip(taken, donors):
            change[j] -= length
        change[donors[0]] += sum(given)
        if self.fill[donors[0]] + change[donors[0]] > self.room:
            return False
        return sum(d * (2 * self.fill[j] + d) for j, d in change.items()) > 0

    def _move(self, length: int, source: int, target: int) -> None:
        at = next(k for k, (x, _) in enumerate(self.bins[source]) if x == length)
        self.bins[target].append(self.bins[source].pop(at))
        self.fill[source] -= length
        self.fill[target] += length


class Stock:
    """Pieces at hand: for each length, the bins that have some."""

    def __init__(self, room: int) -> None:
        self.counts = np.zeros(room + 1, np.int64)
        self.owners: dict[int, dict[int, int]] = {}
        self.pairs: dict[int, list[tuple[int, int, int]]] = {}
        self.bits = self.pair_bits = 0

    def add(self, length: int, at: int) -> None:
        self.counts[length] += 1
        self.bits |= 1 << length
        owners = self.owners.setdefault(length, {})
        owners[at] = owners.get(at, 0) + 1

    def remove(self, length: int, at: int) -> None:
        self.counts[length] -= 1
        if not self.counts[length]:
            self.bits &= ~(1 << length)
        self.owners[length][at] -= 1
        if not self.owners[length][at]:
            del self.owners[length][at]

    def add_pairs(self, lengths: list[int], at: int) -> None:
        """Enter the pairs of pieces of one bin by their sums."""
        have = Counter(lengths)
        mine = sorted(have)
        for k, a in enumerate(mine):
            for b in mine[k:]:
                if a < b or have[a] > 1:
                    self.pairs.setdefault(a + b, []).append((at, a, b))
                    self.pair_bits |= 1 << (a + b)

    def pair_at_most(self, room: int) -> tuple[int, int, int, int] | None:
        """(sum, bin, length, length): the largest pair of one bin of at most this sum; pairs that have moved on go."""
        while fitting := self.pair_bits & ((2 << room) - 1):
            total = fitting.bit_length() - 1
            held = self.pairs[total]
            while held:
                at, a, b = held[-1]
                if self.owners.get(a, {}).get(at, 0) > (a == b) and self.owners.get(b, {}).get(at, 0):
                    return total, at, a, b
                held.pop()
            self.pair_bits ^= 1 << total
        return None

    def at_most(self, room: int) -> int:
        """The longest piece of at most this length, 0 if there is none."""
        fitting = self.bits & ((2 << room) - 1)
        return max(fitting.bit_length() - 1, 0)

    def two_at_most(self, room: int) -> tuple[int, ...]:
        """Two pieces that together come closest to this length from below."""
        lengths = np.flatnonzero(self.counts[: room + 1])
        if not len(lengths):
            return ()
        # The longest length up to room - x, for each length x.
        at = np.searchsorted(lengths, room - lengths, side="right") - 1
        other = np.where(at >= 0, lengths[at], 0)
        # A length of which there is one piece does not go with itself.
        single = (other == lengths) & (self.counts[lengths] < 2)
        at = np.where(single, at - 1, at)
        other = np.where(at >= 0, lengths[at], 0)
        total = np.where(other > 0, lengths + other, 0)
        k = int(total.argmax())
        return (int(lengths[k]), int(other[k])) if total[k] else ()


def unsigned(path: str) -> str:
    """The type that holds every id of a vocabulary: two bytes where they suffice."""
    return "<u2" if len(library_encoder(path).bytes) <= 1 << 16 else "<u4"


def pieces(docs: DataFrame, path: str, folder: str, room: int = ROOM, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs`` and cut them into pieces, written to ``folder``: (number, doc_id, piece, start, length, tokens),
    the tokens as bytes of ``unsigned`` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in portions(batch, PORTION_BYTES):
                ids, counts = library_encoder(path).encode(text.as_py() for text in part.column("text"))
                ends = np.cumsum(counts)
                flat = np.insert(ids, ends, end_id).astype(unsigned(path))
                sizes = counts + 1
                many = -(-sizes // room)
                row = np.repeat(np.arange(len(sizes)), many)
                piece = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
                # The first piece of a document is what full ones leave over.
                over = sizes - (many - 1) * room
                start = np.where(piece == 0, 0, over[row] + (piece - 1) * room)
                length = np.where(piece == 0, over[row], room)
                offsets = (np.concatenate(([0], np.cumsum(length))) * flat.itemsize).astype(np.int32)
                tokens = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(offsets), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), tokens],
                    ["doc_id", "piece", "start", "length", "tokens"],
                )
            pa.default_memory_pool().release_unused()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = arrow_map(texts, run, "doc_id long, piece int, start long, length long, tokens binary")
    # Numbers are fixed once they are written.
    numbered = cut.select(F.monotonically_increasing_id().alias("number"), "*")
    numbered.write.option("compression", "zstd").parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def _packed(rows: DataFrame, groups: int, first: bool, room: int) -> DataFrame:
    """One round: (number, length, bin, fill); ``rows`` are (number, length), after the first round with their bin."""
    unit = "number" if first else "bin"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        group = None

        def done() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            t = pa.Table.from_batches(held)
            of_piece = list(zip(t["length"].to_pylist(), t["number"].to_pylist()))
            if first:
                packing = Packing.best_fit(room, of_piece)
            else:
                bins: dict[int, list] = {}
                for where, piece in zip(t["bin"].to_pylist(), of_piece):
                    bins.setdefault(where, []).append(piece)
                packing = Packing(room, list(bins.values()))
            packing.improve()
            out = [(number, length, min(n for _, n in b), fill) for b, fill in zip(packing.bins, packing.fill) for length, number in b]
            # A bin is named by the least number of its pieces.
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["number", "length", "bin", "fill"])

        for batch in batches:
            ids = batch.column("group").to_numpy()
            cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if ids[a] != group:
                    yield from done()
                    held, group = [], ids[a]
                held.append(batch.slice(a, b - a))
        yield from done()

    number = F.pmod(F.xxhash64(F.lit(groups), unit), F.lit(groups)).alias("group")
    dealt = rows.select(number, *rows.columns).repartition(min(groups, 1 << 15), "group").sortWithinPartitions("group", "number")
    return arrow_map(dealt, run, "number long, length long, bin long, fill long")


def packed(lengths: DataFrame, room: int = ROOM, group: int = GROUP) -> DataFrame:
    """(number, length, bin): bins of the pieces (number, length), whose numbers differ and whose lengths are 1 to
    ``room``."""
    full = lengths.where(F.col("length") == room).select("number", "length", F.col("number").alias("bin"))
    open_rows, done, first = kept(lengths.where(F.col("length") < room).select("number", "length")), [full], True
    before = None
    while True:
        stats = open_rows.agg(F.count(F.lit(1)).alias("n"), F.lit(0).alias("bins") if first else F.count_distinct("bin").alias("bins")).first()
        groups = -(-stats["n"] // group)
        # What one task has packed to the end, and what a round did not improve, stays.
        if not groups or (not first and (before[0] == 1 or stats["bins"] >= before[1])):
            break
        after = kept(_packed(open_rows, groups, first, room))
        done.append(after.where(F.col("fill") == room).select("number", "length", "bin"))
        open_rows = after.where(F.col("fill") < room).select("number", "length", "bin")
        before, first = (groups, stats["bins"] if stats["bins"] else float("inf")), False
    if not first:
        done.append(open_rows.select("number", "length", "bin"))
    for more in done[1:]:
        done[0] = done[0].unionByName(more)
    return done[0]


def placed(docs: DataFrame, path: str, room: int = ROOM, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, tokens, sequence_id, offset: every piece with its tokens, as bytes, and its place."""
    folder = f"{ensure_checkpoint_dir(docs.sparkSession)}/pieces-{uuid.uuid4().hex}"
    rows = pieces(docs, path, folder, room)
    bins = packed(rows.select("number", "length"), room, group)
    places = bins.groupBy("bin").agg(F.sort_array(F.collect_list(F.struct("number", "length"))).alias("p")).select(
        F.col("bin").alias("sequence_id"),
        # At most ``room`` pieces: a piece starts where those before it end.
        F.explode(F.expr(
            "transform(p, (x, i) -> struct(x.number as number, aggregate(slice(p, 1, i), 0L, (s, y) -> s + y.length) as offset))"
        )).alias("at"),
    ).select("at.number", "sequence_id", "at.offset")
    return rows.join(places, "number").select("doc_id", "piece", "start", "length", "tokens", "sequence_id", "offset")


PIECE = {"doc_id": "long", "piece": "int", "start": "long", "length": "long"}
PLACE = {"sequence_id": "long", "offset": "long"}


def _tokens(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The ids of each piece."""
    for tokens, n in zip(batch.column("tokens").to_pylist(), batch.column("length").to_pylist()):
        yield np.frombuffer(tokens, f"<u{len(tokens) // n}")


def _derived(rows: DataFrame, column: str, kind: str, made: Callable[[pa.RecordBatch], pa.Array]) -> DataFrame:
    """The pieces with a column made from their tokens in the tokens' stead."""

    def work(batch: pa.RecordBatch) -> list:
        return [*(batch.column(c) for c in PIECE), made(batch), *(batch.column(c) for c in PLACE)]

    schema = ", ".join(f"{c} {t}" for c, t in (PIECE | {column: kind} | PLACE).items())
    return per_document(rows, PIECE | {"tokens": "binary"} | PLACE, schema, work)


def pack(docs: DataFrame, path: str, room: int = ROOM, group: int = GROUP) -> DataFrame:
    """doc_id, piece, start, length, ids, sequence_id, offset: every piece with its ids and its place."""

    def ids(batch: pa.RecordBatch) -> pa.Array:
        each = list(_tokens(batch))
        offsets = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(each).astype(np.int32)))

    return _derived(placed(docs, path, room, group), "ids", "array<int>", ids)


def sequences(packed_rows: DataFrame) -> DataFrame:
    """sequence_id, ids, doc_ids, offsets: the sequences of the rows of ``pack``, and what begins where in them."""
    order = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed_rows.groupBy("sequence_id").agg(order.alias("p")).select(
        "sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"), F.col("p.offset").alias("offsets")
    )


def checksums(docs: DataFrame, path: str, room: int = ROOM, group: int = GROUP) -> DataFrame:
    """The packed pieces with the CRC-32 of their ids, as little-endian unsigned 32-bit numbers."""

    def crc(batch: pa.RecordBatch) -> pa.Array:
        return pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in _tokens(batch)], pa.int64())

    return _derived(placed(docs, path, room, group), "ids_crc32", "long", crc)
