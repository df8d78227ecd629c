"""Hard negatives by a multiway hyperplane tree with stored distance ranges (GNAT).

Vectors get one more component, so that all lie on a sphere: with M the largest length, the distance d of a
query q (with 0 there) and a row x has d^2 = |q|^2 + M^2 - 2 <q, x>.  A window of scores is thus an annulus about
the query.  A node has some split points far from each other; each row belongs to the nearest one, and every split
point stores the least and the largest distance to the rows of each subtree.  A query measures its distance to
the split points; by the triangle inequality a subtree's rows lie within an interval of distances, and a subtree is
eliminated where the interval misses the annulus.  Leaves are scored exactly, in whole numbers.  Once a window
has its k rows its lower end rises to the k-th score, which narrows the annulus.

Scale.  The root's split points come from a sample (``SAMPLE`` rows of each length of vectors); every row is dealt to
its subtree, and the ranges are an aggregate over all rows.  Only split points and ranges (``TOP`` x ``TOP`` numbers)
reach the driver and the tasks.  Queries are searched in their own subtree first, which narrows their windows, then
join the subtrees that are left.  A subtree is stored in blocks of ``BLOCK`` rows, each with a tree of its own that is
grown in the task; queries come in batches; a task holds one pair of them at a time and at most k rows per window
leave it.

Defined cases: rows without id, label or vector, or with a null or non-finite component, take no part; rows that
repeat id, label and vector count once; rows of one id with other contents are rows (and anchors) of their own and never
meet; vectors of another length than the anchor's are not compared with it; scores beyond a long are held at its
ends; an anchor without positives, or whose windows are empty, gives no row; empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, kept

SCALE = 256
#: Split points of the root and of an inner node; rows that a node tries as split points per one that it takes.
TOP, SPLITS, TRIED = 16, 8, 3
#: Rows of each length of vectors from which the root's split points are taken.
SAMPLE = 512
#: Rows of a leaf, rows of a block, queries of a batch.
LEAF, BLOCK, BATCH = 64, 4096, 256
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Part of the largest possible distance by which intervals are widened against rounding.
SLACK = 1e-6


def floors(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """scale * x rounded down: whole numbers, as doubles."""
    with np.errstate(over="ignore"):
        return np.floor(scale * x)


def products(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Inner products of the floors of all rows of a and of b, exact, held within a long."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = a.shape[1] * (scale * float(np.abs(a).max()) + 1) * (scale * float(np.abs(b).max()) + 1)
    if bound < 2**53:
        return (floors(a, scale) @ floors(b, scale).T).astype(np.int64)
    # From 2^53 on a double is a whole number.
    whole = np.vectorize(lambda x: int(x) * scale if abs(x) >= 2**53 else int(np.floor(scale * x)), otypes=[object])
    exact = whole(a) @ whole(b).T
    return np.vectorize(lambda x: min(max(x, LEAST), MOST), otypes=[np.int64])(exact)


class Sphere:
    """Distances after vectors of length up to ``radius`` were raised to a sphere."""

    def __init__(self, radius2: float) -> None:
        self.radius2 = radius2

    def raised(self, x: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            rest = self.radius2 - np.einsum("ij,ij->i", x, x)
            return np.concatenate((x, np.sqrt(np.maximum(rest, 0))[:, None]), axis=1)

    @staticmethod
    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            d2 = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * (a @ b.T)
            return np.sqrt(np.maximum(d2, 0))

    @staticmethod
    def query(q: np.ndarray) -> np.ndarray:
        return np.concatenate((q, np.zeros((len(q), 1))), axis=1)

    def annuli(self, squared: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance of rows whose score lies from low to high; a bit wider."""
        with np.errstate(all="ignore"):
            reach = squared + self.radius2
            slack = SLACK * (1 + np.sqrt(reach))
            inner = np.sqrt(np.maximum(reach - 2 * high.astype(float), 0)) - slack
            return inner, np.sqrt(np.maximum(reach - 2 * low.astype(float), 0)) + slack


def far_apart(points: np.ndarray, many: int) -> np.ndarray:
    """Positions of up to ``many`` different points, each as far as can be from those before it."""
    taken, least = [0], Sphere.distances(points, points[:1])[:, 0]
    while len(taken) < many:
        at = int(np.argmax(least))
        if not least[at] > 0:
            break
        taken.append(at)
        least = np.minimum(least, Sphere.distances(points, points[at : at + 1])[:, 0])
    return np.array(taken)


class Ranges:
    """Split points and their least and largest distance to the rows of each subtree."""

    def __init__(self, points: np.ndarray, least: np.ndarray, largest: np.ndarray) -> None:
        self.points, self.least, self.largest = points, least, largest

    def intervals(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Within which distances of each query (rows) the rows of each subtree (columns) lie."""
        d = Sphere.distances(asked, self.points)[:, :, None]
        with np.errstate(all="ignore"):
            nearest = np.maximum(d - self.largest, self.least - d).max(axis=1)
            return nearest, (d + self.largest).min(axis=1)


class Tree:
    """The tree of one block of rows."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.labels, self.rows = ids, labels, rows
        whole = floors(rows)
        with np.errstate(all="ignore"):
            self.sphere = Sphere(float(np.einsum("ij,ij->i", whole, whole).max(initial=0)))
        self.raised = self.sphere.raised(whole)
        self.root = self._grown(np.arange(len(ids)))

    def _grown(self, at: np.ndarray):
        """A leaf is the positions of its rows, a node its ranges and subtrees."""
        if len(at) <= LEAF:
            return at
        tried = at[:: max(1, len(at) // (SPLITS * TRIED))]
        points = self.raised[tried[far_apart(self.raised[tried], SPLITS)]]
        d = Sphere.distances(self.raised[at], points)
        nearest = d.argmin(axis=1)
        parts = [np.flatnonzero(nearest == j) for j in range(len(points))]
        parts = [p for p in parts if len(p)]
        if len(parts) < 2:
            return at
        least = np.stack([d[p].min(axis=0) for p in parts], axis=1)
        largest = np.stack([d[p].max(axis=0) for p in parts], axis=1)
        return Ranges(points, least, largest), [self._grown(at[p]) for p in parts]

    def search(self, found: Windows) -> None:
        """Add to the windows the rows of the block that are among their k best."""
        asked = Sphere.query(floors(found.queries))
        with np.errstate(all="ignore"):
            squared = np.einsum("ij,ij->i", asked, asked)
        everywhere = np.zeros(len(found.owner)), np.full(len(found.owner), np.inf)
        stack = [(self.root, np.arange(len(found.owner)), *everywhere)]
        while stack:
            node, alive, nearest, farthest = stack.pop()
            inner, outer = self.sphere.annuli(squared[found.owner[alive]], found.low[alive], found.high[alive])
            alive = alive[~((nearest > outer) | (farthest < inner))]
            if not len(alive):
                continue
            if isinstance(node, np.ndarray):
                found.offer(alive, self.ids[node], self.labels[node], self.rows[node])
                continue
            ranges, parts = node
            owners, back = np.unique(found.owner[alive], return_inverse=True)
            nearest, farthest = ranges.intervals(asked[owners])
            # The closest subtree is searched first: it narrows the windows for the others.
            for j in np.argsort(-nearest.sum(axis=0)):
                stack.append((parts[j], alive, nearest[back, j], farthest[back, j]))


class Windows:
    """Windows of scores of some queries, and the k best rows of each so far."""

    def __init__(self, ids, labels, queries, owner, low, high, k: int, same: bool) -> None:
        self.ids, self.labels, self.queries, self.owner = ids, labels, queries, owner
        self.low, self.high, self.k, self.same = low.copy(), high, k, same
        self.best = [np.zeros(0, np.int64)] * 3  # window, score, id

    def offer(self, alive: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        owners, back = np.unique(self.owner[alive], return_inverse=True)
        scores = products(self.queries[owners], rows)
        fits = (self.labels[owners][:, None] == labels) == self.same
        fits &= self.ids[owners][:, None] != ids
        of_window = scores[back]
        inside = fits[back] & (of_window >= self.low[alive][:, None]) & (of_window <= self.high[alive][:, None])
        w, r = np.nonzero(inside)
        if not len(w):
            return
        window, score, row = (np.concatenate(x) for x in zip(self.best, (alive[w], of_window[w, r], ids[r])))
        order = np.lexsort((row, ~score, window))
        window, score, row = window[order], score[order], row[order]
        first = np.concatenate(([True], window[1:] != window[:-1]))
        place = np.arange(len(window)) - np.maximum.accumulate(np.where(first, np.arange(len(window)), 0))
        self.best = [x[place < self.k] for x in (window, score, row)]
        full = place == self.k - 1
        self.low[window[full]] = np.maximum(self.low[window[full]], score[full])


def sound(vectors: DataFrame, id_column: str, label_column: str, vector_column: str) -> DataFrame:
    """(key, id, label, v, dims) of the rows that take part; repeated rows once."""
    v = F.col(f"`{vector_column}`").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(
        F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{label_column}`").cast("string").alias("label"),
        v.alias("v"), F.coalesce(finite, F.lit(False)).alias("fine"),
    ).where("fine and id is not null and label is not null").drop("fine")
    # The key is fixed once it is stored.
    return kept(rows.distinct().select(F.monotonically_increasing_id().alias("key"), "*", F.size("v").alias("dims")))


class Root:
    """The top of the tree: split points of each length of vectors, ranges over all rows."""

    def __init__(self, rows: DataFrame, block: int = BLOCK) -> None:
        squares = F.aggregate("v", F.lit(0.0), lambda s, x: s + F.pow(F.floor(F.lit(float(SCALE)) * x).cast("double"), 2))
        wide = F.exists("v", lambda x: F.abs(x) > 1e15)  # their squares need no exact value: such a radius prunes nothing
        longest = rows.groupBy("dims").agg(F.max(F.when(wide, F.lit(float("inf"))).otherwise(squares)).alias("radius2"))
        self.spheres = {r.dims: Sphere(r.radius2 * (1 + 1e-12)) for r in longest.collect()}  # one row per length
        # One row of each of SAMPLE buckets, picked before the shuffle and after it.
        drawn = rows.groupBy("dims", F.pmod(F.xxhash64("id"), F.lit(SAMPLE)).alias("bucket")).agg(
            F.min(F.struct(F.xxhash64("id", "label"), "id", "key", "v")).alias("one")
        )
        points: dict[int, list] = {}
        for r in sorted(drawn.select("dims", "bucket", "one.v").collect(), key=lambda r: (r.dims, r.bucket)):
            points.setdefault(r.dims, []).append(r.v)
        self.points = {}
        for dims, held in points.items():
            raised = self.spheres[dims].raised(floors(np.array(held).reshape(len(held), dims)))
            self.points[dims] = raised[far_apart(raised, TOP)]
        placed = kept(self._placed(rows))
        bounds = [f(F.get("d", F.lit(i))).alias(f"{n}{i}") for i in range(TOP) for n, f in (("least", F.min), ("largest", F.max))]
        self.ranges, at = {}, {}
        for r in placed.groupBy("dims", "subtree").agg(*bounds).collect():  # at most TOP rows per length
            at[r.dims, r.subtree] = [(r[f"least{i}"], r[f"largest{i}"]) for i in range(len(self.points[r.dims]))]
        for dims, split in self.points.items():
            # A subtree without rows lies nowhere.
            none = [(np.inf, -np.inf)] * len(split)
            sides = np.array([at.get((dims, j), none) for j in range(len(split))], float)
            self.ranges[dims] = Ranges(split, sides[:, :, 0].T, sides[:, :, 1].T)
        sizes = placed.groupBy("dims", "subtree").agg(F.ceil(F.count(F.lit(1)) / block).alias("parts"))
        part = F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part")
        gathered = placed.join(sizes, ["dims", "subtree"]).groupBy("dims", "subtree", part)
        self.blocks = kept(gathered.agg(F.sort_array(F.collect_list(F.struct("id", "key", "label", "v"))).alias("rows")).select(
            "dims", "subtree", "part", F.col("rows.id").alias("ids"), F.col("rows.label").alias("labels"),
            F.flatten("rows.v").alias("values"),
        ))

    def _placed(self, rows: DataFrame) -> DataFrame:
        """Each row with the nearest split point and its distances to all of them."""
        spheres, points = self.spheres, self.points

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                dims = batch.column("dims").to_numpy()
                subtree, distances = np.zeros(len(dims), np.int32), [None] * len(dims)
                for n in np.unique(dims).tolist():
                    at = np.flatnonzero(dims == n)
                    x = batch.column("v").take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), n)
                    d = Sphere.distances(spheres[n].raised(floors(x)), points[n])
                    subtree[at] = d.argmin(axis=1)
                    for i, each in zip(at.tolist(), d):
                        distances[i] = each
                out = [*batch.columns, pa.array(subtree), pa.array(distances, pa.list_(pa.float64()))]
                yield pa.RecordBatch.from_arrays(out, [*batch.schema.names, "subtree", "d"])

        schema = "key long, id long, label string, v array<double>, dims int, subtree int, d array<double>"
        return arrow_map(rows.select("key", "id", "label", "v", "dims"), work, schema)

    def routed(self, asked: DataFrame, home: bool) -> DataFrame:
        """Queries with the subtrees they have to search: the nearest, or all others that meet a window."""
        spheres, ranges = self.spheres, self.ranges

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                take, subtree = [], []
                for i in range(batch.num_rows):
                    n = batch.column("dims")[i].as_py()
                    q = Sphere.query(floors(batch.column("v")[i].values.to_numpy(zero_copy_only=False).reshape(1, n)))
                    nearest, farthest = ranges[n].intervals(q)
                    own = int(np.argmin(nearest[0]))
                    chosen = [own]
                    if not home:
                        low, high = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("low", "high"))
                        with np.errstate(all="ignore"):
                            inner, outer = spheres[n].annuli(np.full(len(low), float((q * q).sum())), low, high)
                        missed = ((nearest[0][:, None] > outer) | (farthest[0][:, None] < inner)).all(axis=1)
                        chosen = [j for j in np.flatnonzero(~missed).tolist() if j != own]
                    take += [i] * len(chosen)
                    subtree += chosen
                rows = batch.take(pa.array(take, pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(subtree, pa.int32())], [*rows.schema.names, "subtree"])

        schema = (
            "dims int, key long, id long, label string, v array<double>, window array<int>, low array<long>, "
            "high array<long>, subtree int"
        )
        return arrow_map(asked.select("dims", "key", "id", "label", "v", "window", "low", "high"), work, schema)

    def searched(self, asked: DataFrame, k: int, same: bool, home: bool, batch: int = BATCH) -> DataFrame:
        """(key, window, row_id, score): of every block searched the k best rows of each window."""
        routed = kept(self.routed(asked, home))
        many = routed.groupBy("dims", "subtree").agg(F.ceil(F.count(F.lit(1)) / batch).alias("batches"))
        number = F.pmod(F.xxhash64("key"), F.col("batches")).cast("int").alias("batch")
        batches = routed.join(many, ["dims", "subtree"]).groupBy("dims", "subtree", number).agg(
            F.collect_list(F.struct("key", "id", "label", "v", "window", "low", "high")).alias("q")
        ).select(
            "dims", "subtree", "batch", F.col("q.key").alias("keys"), F.col("q.id").alias("asked_ids"),
            F.col("q.label").alias("asked_labels"), F.flatten("q.v").alias("asked"),
            F.transform("q.window", F.size).alias("many"), *[F.flatten(f"q.{c}").alias(c) for c in ("window", "low", "high")],
        )
        pairs = self.blocks.join(batches, ["dims", "subtree"])

        def work(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            key, tree = None, None
            for data in rows:
                for i in range(data.num_rows):
                    def column(name: str) -> np.ndarray:
                        return data.column(name)[i].values.to_numpy(zero_copy_only=False)  # noqa: B023

                    here = tuple(data.column(c)[i].as_py() for c in ("dims", "subtree", "part"))
                    if here != key:
                        key, ids = here, column("ids")
                        tree = Tree(ids, column("labels"), column("values").reshape(len(ids), here[0]))
                    keys, many = column("keys"), column("many")
                    owner = np.repeat(np.arange(len(keys)), many)
                    found = Windows(
                        column("asked_ids"), column("asked_labels"), column("asked").reshape(len(keys), here[0]),
                        owner, column("low"), column("high"), k, same,
                    )
                    tree.search(found)
                    window, score, row = found.best
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(keys[owner[window]]), pa.array(column("window")[window].astype(np.int32)), pa.array(row), pa.array(score)],
                        ["key", "window", "row_id", "score"],
                    )

        return arrow_map(pairs.drop("batch"), work, "key long, window int, row_id long, score long")

    def best(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """(key, window, rank, row_id, score): the k best rows of each window of ``asked`` (dims, key, id, label, v,
        window, low, high; the last three are arrays), of the query's label or of all others."""
        place = F.row_number().over(W.partitionBy("key", "window").orderBy(F.desc("score"), "row_id"))

        def ranked(found: DataFrame) -> DataFrame:
            return found.withColumn("rank", place).where(F.col("rank") <= k)

        near = kept(ranked(self.searched(asked, k, same, home=True)))
        # A window that has its k rows asks the other subtrees only for better ones.
        floor = near.where(F.col("rank") == k).groupBy("key").agg(
            F.map_from_entries(F.collect_list(F.struct("window", "score"))).alias("floor")
        )
        raised = F.expr("transform(window, (w, i) -> greatest(low[i], coalesce(try_element_at(floor, w), low[i])))")
        narrowed = asked.join(floor, "key", "left").withColumn("low", raised)
        far = self.searched(narrowed, k, same, home=False)
        return ranked(near.drop("rank").unionByName(far))


def hard_negatives(
    vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 10, percent: tuple[int, int] = (30, 90),
    id_column: str = "vec_id", label_column: str = "label", vector_column: str = "embedding", block: int = BLOCK,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor and each of its best
    ``positives`` rows of its label, the best ``negatives`` rows of other labels that score from percent[0] to
    percent[1] hundredths of the positive.  ``anchors`` (any table with the id column) names them by id."""
    rows = sound(vectors, id_column, label_column, vector_column)
    root = Root(rows, block)
    named = anchors.select(F.col(f"`{id_column}`").cast("long").alias("id")).distinct()
    asked = rows.join(named, "id", "left_semi").withColumns({
        "window": F.array(F.lit(0)), "low": F.array(F.lit(LEAST).cast("long")), "high": F.array(F.lit(MOST).cast("long")),
    })
    asked = kept(asked)
    good = kept(root.best(asked, positives, True).select("key", F.col("rank").alias("window"), F.col("row_id").alias("positive_id"),
                                                        F.col("score").alias("positive_score")))
    # Bounds in decimals: products of a long by 100 may not fit one.
    p = F.col("positive_score").cast("decimal(20,0)")
    bounds = good.withColumns({
        "low": F.ceil(p * percent[0] / 100).cast("long"), "high": F.floor(p * percent[1] / 100).cast("long"),
    }).where("low <= high")
    windows = bounds.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("window", "low", "high"))).alias("w"))
    second = asked.drop("window", "low", "high").join(windows, "key").select(
        "dims", "key", "id", "label", "v", *[F.col(f"w.{c}").alias(c) for c in ("window", "low", "high")]
    )
    bad = root.best(kept(second), negatives, False)
    return bad.join(good, ["key", "window"]).join(asked.select("key", F.col("id").alias("anchor_id")), "key").select(
        "anchor_id", "positive_id", "rank", F.col("row_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"),
    )
