"""Spelling variants by a frequency-vector trie.

Words are arranged by how often they have each of ``GROUPS`` letter groups: level g of the trie branches on the
count of group g, so a leaf holds words of one vector (and one length).  One inserted, deleted or replaced
code point changes the vector by a surplus of one, a deficit of one, or one of each.  A depth-first search takes
a block of words down the trie together and spends that budget; a deficit may only follow a surplus, so every
pair of words is met once: a longer word from the shorter one, a replacement across groups from the side
whose surplus comes first, and one within a group from the lesser word.  Leaf words that share the first or
the last half with the searching word are verified letter by letter.

Scale.  The top of the trie is descended by joins, ``STEP`` levels at a time: a node with at most ``CELL`` words is
searched in a task, a larger one is split by its next levels, and searching words follow only into nodes that
exist.  A task holds one node and one batch of searching words at a time.  Words of one whole vector that are more
than ``CELL`` are dealt into parts, each met by all their searching words, so none is lost.

Defined cases: null and empty texts have no words; a document without id draws its misspellings as one with
the empty id; repeated rows count again; an empty table has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, kept, ragged

#: A letter group each, in the order of the levels; all other letters fall into ``REST`` more groups.
SINGLE = "enaitorhuscldg"
REST = 6
GROUPS = len(SINGLE) + REST
#: Levels that a join descends.
STEP = 4
#: Words of a node that one task searches, and searching words of a batch.
CELL, BATCH = 20_000, 20_000
#: Open branches of the search, and letters under verification, that are held at once.
AT_ONCE = 200_000

#: Letters of a word are a-z (from A-Z too) and the code points U+00C0 to U+00FF.
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OUTSIDE = "[^a-z\\u00C0-\\u00FF]+"
LETTERS = [*SMALL, *map(chr, range(0xC0, 0x100))]
SHORTEST, LEAST_COUNT, EVERY = 5, 3, 97


def group_of(letter: str) -> int:
    return SINGLE.index(letter) if letter in SINGLE else len(SINGLE) + ord(letter) % REST


GROUP_OF_CODE = np.array([group_of(chr(c)) for c in range(256)])
MEMBERS = ["".join(x for x in LETTERS if group_of(x) == g) for g in range(GROUPS)]


def words(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST_COUNT, every: int = EVERY) -> DataFrame:
    """(word, n): runs of letters, of which every ``every``-th by the hash of document and run loses a letter."""
    runs = F.split(F.translate(F.coalesce("text", F.lit("")), CAPITALS, SMALL), OUTSIDE, -1)
    each = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc_id"),
        F.explode(F.filter(runs, lambda r: F.length(r) >= shortest)).alias("run"),
    )
    hashed = each.select("run", F.crc32(F.concat_ws(":", "doc_id", "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % every == 0, shorter).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.col("n") >= least) & (F.length("word") >= shortest))


class Trie:
    """Words by their vectors: per level, the children of each node and the count each child stands for."""

    def __init__(self, held: np.ndarray) -> None:
        self.held = held
        codes, starts, lengths = letters(held)
        vectors = counts(codes, lengths)
        order = np.lexsort(vectors.T[::-1])
        self.order, vectors = order, vectors[order]
        self.levels, parents = [], np.zeros(1, np.int64)
        new = np.zeros(len(held), bool)
        new[:1] = True
        for g in range(GROUPS):
            new = new.copy()
            new[1:] |= vectors[1:, g] != vectors[:-1, g]
            nodes = np.flatnonzero(new)
            first = np.searchsorted(nodes, parents)
            self.levels.append((first, np.append(first[1:], len(nodes)) - first, vectors[nodes, g]))
            parents = nodes
        leaf = np.empty(len(held), np.int64)
        leaf[order] = np.cumsum(new) - 1
        # Halves by which leaf words are found: of a word as long as the searching one, and of one longer by 1.
        hashes = Halves(codes, starts, lengths)
        self.found_by = [
            [self._sorted(mixed(leaf, h)) for h in hashes.of(lengths - longer, longer)] for longer in (0, 1)
        ]

    @staticmethod
    def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(keys, kind="stable")
        return keys[order], order

    def search(self, asked: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(positions in ``asked``, positions in the trie's words, budget spent) of words that may be near: they are
        within the budget and share a half.  Spent is nothing (0), a surplus (1: one letter longer) or both (2)."""
        codes, starts, lengths = letters(asked)
        vectors = counts(codes, lengths)
        halves = Halves(codes, starts, lengths).of(lengths, 0)
        n = len(asked)
        stack = [(0, np.arange(n), np.zeros(n, np.int64), np.zeros(n, np.int64))]
        while stack:
            level, who, node, state = stack.pop()
            if level == GROUPS:
                for spent in (0, 1, 2):
                    now, seen = state == spent, None
                    for (keys, order), half in zip(self.found_by[spent == 1], halves):
                        key = mixed(node[now], half[who[now]])
                        a, b = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
                        pair = np.repeat(who[now], b - a), order[ragged(a, b - a)]
                        code = pair[0] * len(self.held) + pair[1]
                        new = np.ones(len(code), bool) if seen is None else ~np.isin(code, seen)
                        seen = code
                        yield pair[0][new], pair[1][new], np.full(int(new.sum()), spent)
                continue
            first, many, value = self.levels[level]
            many = many[node]
            total = int(many.sum())
            if total > AT_ONCE and len(who) > 1:
                half = len(who) // 2
                for part in (slice(half), slice(half, None)):
                    stack.append((level, who[part], node[part], state[part]))
                continue
            child = ragged(first[node], many)
            who, state = np.repeat(who, many), np.repeat(state, many)
            more = value[child] - vectors[who, level]
            fits = (more == 0) | ((more == 1) & (state == 0)) | ((more == -1) & (state == 1))
            if fits.any():
                stack.append((level + 1, who[fits], child[fits], (state + np.abs(more))[fits]))

    def near(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in ``asked``, positions in the trie's words) of all pairs one edit apart, each once."""
        out: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64),) * 2]
        mine, theirs = letters(asked), letters(self.held)
        for a, b, spent in self.search(asked):
            for part in np.array_split(np.arange(len(a)), 1 + int(mine[2][a].sum()) // AT_ONCE):
                ok = one_edit(mine, theirs, a[part], b[part], spent[part] == 1)
                # Words of one vector meet from both sides.
                ok &= (spent[part] > 0) | (asked[a[part]] < self.held[b[part]]).astype(bool)
                out.append((a[part][ok], b[part][ok]))
        a, b = (np.concatenate([x[k] for x in out]) for k in (0, 1))
        return a, b


def letters(held: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all words, one after the other; where each starts; their lengths.  All are below 256."""
    lengths = np.array([len(w) for w in held], np.int64)
    codes = np.frombuffer("".join(held).encode("latin-1"), np.uint8)
    return codes, np.cumsum(lengths) - lengths, lengths


def counts(codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    row = np.repeat(np.arange(len(lengths)), lengths)
    return np.bincount(row * GROUPS + GROUP_OF_CODE[codes], minlength=len(lengths) * GROUPS).reshape(-1, GROUPS)


def mixed(leaf: np.ndarray, half: np.ndarray) -> np.ndarray:
    x = (leaf.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ half
    return x * np.uint64(0xC2B2AE3D27D4EB4F)


class Halves:
    """Polynomial hashes of parts of words, modulo 2^64."""

    def __init__(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        base = 0x100000001B3
        inverse = pow(base, -1, 1 << 64)
        n = len(codes)
        self.starts, self.lengths = starts, lengths
        power = np.cumprod(np.full(n, base, np.uint64)) if n else np.zeros(0, np.uint64)
        self.back = np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n, inverse, np.uint64))))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power)))

    def part(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.back[a]

    def of(self, m: np.ndarray, skip: int) -> tuple[np.ndarray, np.ndarray]:
        """Of words as compared with one of length ``m``: the first m // 2 and the last m - m // 2 letters."""
        first = self.starts
        return self.part(first, first + m // 2), self.part(first + m // 2 + skip, first + self.lengths)


def one_edit(mine, theirs, a: np.ndarray, b: np.ndarray, longer: np.ndarray) -> np.ndarray:
    """Whether each pair differs by exactly one edit: a replaced letter, or one inserted where ``longer``."""
    (x, xs, m), (y, ys, _) = mine, theirs
    m, step = m[a], longer.astype(np.int64)
    if not len(m):
        return np.zeros(0, bool)
    left, at = ragged(xs[a], m), ragged(np.zeros(len(a), np.int64), m)
    right = ragged(ys[b], m)
    begins = np.cumsum(m) - m
    differs = x[left] != y[right]
    shifted = x[left] != y[right + np.repeat(step, m)]
    far = np.iinfo(np.int64).max
    earliest = np.minimum.reduceat(np.where(differs, at, far), begins)
    latest = np.maximum.reduceat(np.where(shifted, at, -1), begins)
    return np.where(longer, latest < earliest, np.add.reduceat(differs, begins, dtype=np.int64) == 1)


def count_of(group: int) -> Column:
    return F.length("word") - F.length(F.translate("word", MEMBERS[group], ""))


def path(depth: int) -> Column:
    """The way from the root to the node of a word at a depth."""
    return F.concat_ws(",", *[count_of(g).cast("string") for g in range(depth)])


def _ways(depth: int, to: int) -> Column:
    """All (path, spent) by which a searching word may go on from its node at ``depth`` to levels below ``to``."""
    levels = range(depth, to)

    def way(changes: dict[int, int], spent: int) -> Column:
        steps = [(count_of(g) + changes.get(g, 0)).cast("string") for g in levels]
        here = F.concat_ws(",", F.col("path"), *steps) if depth else F.concat_ws(",", *steps)
        return F.struct(here.alias("path"), F.lit(spent).alias("spent"))

    exact = way({}, 0), way({}, 1), way({}, 2)
    surplus = [way({g: 1}, 1) for g in levels]
    both = [way({g: 1, k: -1}, 2) for g in levels for k in levels if k > g]
    deficit = [way({g: -1}, 2) for g in levels]
    return (
        F.when(F.col("spent") == 0, F.array(exact[0], *surplus, *both))
        .when(F.col("spent") == 1, F.array(exact[1], *deficit)).otherwise(F.array(exact[2]))
    )


def _nodes(vocabulary: DataFrame, cell: int) -> tuple[DataFrame, DataFrame]:
    """Words by the node that holds them (path, size, word, n) and searching words by the nodes they go into
    (path, word, n): nodes of at most ``cell`` words, or whole leaves."""
    members = vocabulary
    asking = vocabulary.select("word", "n", F.lit("").alias("path"), F.lit(0).alias("spent"))
    held, asked, depth = [], [], 0
    while True:
        to = min(depth + STEP, GROUPS)
        members = members.select("word", "n", path(to).alias("path"))
        size = members.groupBy("path").agg(F.count(F.lit(1)).alias("size"))
        size = kept(size.withColumn("last", (F.col("size") <= cell) | F.lit(to == GROUPS)))
        members = members.join(size, "path")
        ways = asking.withColumn("way", F.explode(_ways(depth, to))).select("word", "n", "way.path", "way.spent")
        asking = kept(ways.join(size.drop("size"), "path"))
        held.append(members.where("last").select("path", "size", "word", "n"))
        asked.append(asking.where("last").select("path", "word", "n"))
        members, asking, depth = members.where("not last"), asking.where("not last"), to
        if depth == GROUPS or size.where("not last").isEmpty():
            break
    for more in held[1:]:
        held[0] = held[0].unionByName(more)
    for more in asked[1:]:
        asked[0] = asked[0].unionByName(more)
    return held[0], asked[0]


def near_pairs(vocabulary: DataFrame, cell: int = CELL, batch: int = BATCH) -> DataFrame:
    """(a, a_n, b, b_n): all pairs of words one edit apart, each once, of a table (word, n) of distinct words."""
    held, asked = _nodes(vocabulary, cell)
    part = F.pmod(F.xxhash64("word"), F.ceil(F.col("size") / cell)).cast("int")
    nodes = held.groupBy("path", part.alias("part")).agg(
        F.collect_list("word").alias("held"), F.collect_list("n").alias("held_n")
    )
    many = asked.groupBy("path").agg(F.ceil(F.count(F.lit(1)) / batch).alias("batches"))
    number = F.pmod(F.xxhash64("word"), F.col("batches")).cast("int")
    batches = asked.join(many, "path").groupBy("path", number.alias("batch")).agg(
        F.collect_list("word").alias("asked"), F.collect_list("n").alias("asked_n")
    )
    both = nodes.join(batches, "path").select("path", "part", "held", "held_n", "asked", "asked_n")

    def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, trie = None, None
        for data in rows:
            for i in range(data.num_rows):
                def numbers(name: str) -> np.ndarray:
                    return data.column(name)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023

                def names(name: str) -> np.ndarray:
                    return np.array(data.column(name)[i].as_py(), object)  # noqa: B023

                here = data.column("path")[i].as_py(), data.column("part")[i].as_py()
                if here != key:
                    key, trie = here, Trie(names("held"))
                searching = names("asked")
                a, b = trie.near(searching)
                yield pa.RecordBatch.from_arrays([
                    pa.array(searching[a], pa.string()), pa.array(numbers("asked_n")[a], pa.int64()),
                    pa.array(trie.held[b], pa.string()), pa.array(numbers("held_n")[b], pa.int64()),
                ], ["a", "a_n", "b", "b_n"])

    return arrow_map(both, work, "a string, a_n long, b string, b_n long")


def variants(vocabulary: DataFrame, ratio: int = 2, cell: int = CELL, batch: int = BATCH) -> DataFrame:
    """word, form, root, n, n_near, form_n of a table (word, n) of distinct words.

    A word's form is its near word of largest n, if that is at least ``ratio`` times its own; its root is where
    the forms lead.  n grows along the forms, so they end."""
    vocabulary = kept(vocabulary)
    pairs = near_pairs(vocabulary, cell, batch)
    sides = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("near"), F.col("a_n").alias("near_n")),
    )
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near")))
    near = pairs.select(F.explode(sides).alias("s")).select("s.*").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), best.alias("best")
    )
    known = -F.col("best.less") >= ratio * F.col("n")
    rows = kept(vocabulary.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(known, F.col("best.near")).alias("form"), F.when(known, -F.col("best.less")).alias("form_n"),
    ))
    labels = rows.select("word", F.coalesce("form", "word").alias("root"))
    while True:
        beyond = labels.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        step = kept(labels.join(beyond, "root").select("word", "root", "beyond"))
        labels = step.select("word", F.col("beyond").alias("root"))
        if step.where("root <> beyond").isEmpty():
            break
    return rows.join(labels, "word").select("word", "form", "root", "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame) -> DataFrame:
    """The variants among the words of ``docs``."""
    return variants(words(docs))
