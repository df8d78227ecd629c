"""Boosting, forests and AdaBoost.R2 over one binned feature table, for all models and folds together.

Every column's cut points are exact quantiles, the same however the rows are dealt; then a value is a byte, and the table with
its folds is stored once.  What happens next depends on whether histograms have to be exchanged:

- A table of at most ``TASK_BYTES`` bytes would be one partition, whose histogram is the whole one.  Its fits (a model on
  the days before a fold, or on all; a forest in groups of trees) are dealt over tasks, which grow level by level
  without a Spark job in between.
- A larger table stays where it is.  All fits grow side by side: one job per level sums up histograms of the lesser
  children per partition, adds them up by (fit, node), takes the other child from the parent's histogram and finds
  the best splits; the driver sees splits only.  What the trees so far say of a row is a stored column,
  rewritten every ``STORE_EVERY`` rounds in the shared folder; the trees since then are evaluated on the way.

Both ways grow the same trees (up to the order of additions), as sampling is by hashes of rows and nodes.
"""

from __future__ import annotations

import pickle
import sys
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import trees as kernel
from ..functions.trees import BINS, Ensemble, Growth, Spec, Splits
from ..session import ensure_checkpoint_dir
from .quantiles import exact_quantiles

# Ship what this module holds with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of binned rows that one task may hold whole.
TASK_BYTES = 32 << 20
#: Trees of a forest that a task (or a job) grows.
GROUP = 20
#: Rounds after which the stored column is rewritten.
STORE_EVERY = 10


def cut_points(df: DataFrame) -> np.ndarray:
    """(columns, BINS) upper ends of the bins of the ``raw`` vector, by equal shares of the rows; the last is the
    largest value."""
    if df.select("raw").first() is None:
        raise ValueError("no rows to train on")
    return exact_quantiles(df, [i / BINS for i in range(1, BINS + 1)], between=False)[0].T


def held(df: DataFrame) -> DataFrame:
    """What a fit reads of its rows, worked out once."""
    fold = ["fold"] if "fold" in df.columns else []
    return df.select("series_id", "ds", *fold, "y", "raw").persist()


def to_bins(x: np.ndarray, edges: np.ndarray) -> np.ndarray:
    return np.stack([np.searchsorted(e[:-1], v, side="left") for e, v in zip(edges, x.T)], axis=1).astype(np.uint8)


def binned(df: DataFrame, edges: np.ndarray) -> DataFrame:
    """(id, fold, y, bins): a byte per column; ``id`` is a hash of series and day.  Without a fold, rows are of fold 0."""
    fold = F.col("fold").cast("int") if "fold" in df.columns else F.lit(0)
    rows = df.select(
        F.xxhash64("series_id", "ds").alias("id"), fold.alias("fold"), F.col("y").cast("double").alias("y"),
        vector_to_array("raw").alias("x"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(edges))
            bins = [row.tobytes() for row in to_bins(x, edges)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(bins, pa.binary())], ["id", "fold", "y", "bins"])

    return rows.mapInArrow(run, "id long, fold int, y double, bins binary")


class TreeModel:
    """A fitted ensemble; adds ``prediction`` to rows with a ``raw`` vector."""

    def __init__(self, ensemble: Ensemble, edges: np.ndarray) -> None:
        self.ensemble, self.edges = ensemble, edges

    def transform(self, df: DataFrame) -> DataFrame:
        ensemble, edges = self.ensemble, self.edges

        @pandas_udf("double")
        def predict(x):
            import pandas as pd

            return pd.Series(ensemble.predict(to_bins(np.stack(x.to_numpy()), edges)) if len(x) else [], dtype=float)

        return df.withColumn("prediction", predict(vector_to_array("raw")))


@dataclass
class Fit:
    """A model to be grown on the rows of folds before ``fold``; of a forest the trees ``first`` to ``last``."""

    model: str
    spec: Spec
    fold: int
    first: int
    last: int
    # Growing by levels: trees so far, those not yet in the stored column, the tree in work.
    trees: list = field(default_factory=list)
    votes: list = field(default_factory=list)
    pending: list = field(default_factory=list)
    growth: Growth | None = None
    start: float = 0.0
    over: bool = False

    def cost(self) -> float:
        return (self.last - self.first) * self.spec.depth * self.fold * (4 if self.spec.combine == "mean" else 1)


def planned(models: Mapping[str, Spec], folds: Sequence[int]) -> list[Fit]:
    """All fits, the longest first."""
    fits = []
    for name, spec in models.items():
        step = GROUP if spec.combine == "mean" else spec.rounds
        for fold in folds:
            fits += [Fit(name, spec, fold, a, min(a + step, spec.rounds)) for a in range(0, spec.rounds, step)]
    return sorted(fits, key=lambda f: -f.cost())


def arrays(b: pa.RecordBatch | pa.Table, width: int) -> tuple[np.ndarray, ...]:
    """ids, folds, y and bins of stored rows."""
    bins = np.frombuffer(b"".join(b.column("bins").to_pylist()), np.uint8).reshape(-1, width)
    return b.column("id").to_numpy(), b.column("fold").to_numpy(), b.column("y").to_numpy(), bins


# ---- fits dealt over tasks


def one_key_each(spark: SparkSession, parts: int) -> list[int]:
    """For each of so many partitions a number that Spark's hash puts there."""
    at = spark.range(64 * parts).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("part")).agg(F.min("id").alias("key"))
    keys = {r.part: r.key for r in at.collect()}
    return [keys.get(p, p) for p in range(parts)]


def dealt(rows: DataFrame, fits: Sequence[Fit]) -> tuple[DataFrame, dict[int, int]]:
    """Each row once per fit that it trains or tests, a partition per fit; and the fit of each key."""
    keys = one_key_each(rows.sparkSession, len(fits))
    last = max(f.fold for f in fits)
    wanted = F.array(*[
        F.array(*[F.lit(k).cast("long") for k, f in zip(keys, fits) if f.fold >= fold]) for fold in range(last + 1)
    ])
    copies = rows.withColumn("fit", F.explode(F.element_at(wanted, F.least(F.col("fold"), F.lit(last)) + 1)))
    return copies.repartition(len(fits), "fit"), {k: i for i, k in enumerate(keys)}


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    held = [b for b in batches if b.num_rows]
    if held:
        t = pa.Table.from_batches(held).combine_chunks()
        for key in np.unique(t["fit"].to_numpy()).tolist():
            # In the order of their ids, however they came.
            mine = t.filter(pc.equal(t["fit"], key))
            yield key, mine.take(np.argsort(mine["id"].to_numpy(), kind="stable"))


def _in_tasks(rows: DataFrame, fits: Sequence[Fit], edges: np.ndarray, tested: bool) -> DataFrame:
    """(model, part, blob) of each fit, or (model, fold, id, y, value, n): its forecasts of the fold."""
    copies, of_key = dealt(rows, fits)
    width = len(edges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, t in _held(batches):
            fit = fits[of_key[key]]
            ids, folds, y, bins = arrays(t, width)
            old = folds < fit.fold
            ensemble = kernel.train(bins[old], y[old], ids[old], edges, fit.spec, fit.first, fit.last)
            if tested:
                new = folds == fit.fold
                n = int(new.sum())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([fit.model] * n), pa.array([fit.fold] * n, pa.int32()), pa.array(ids[new]), pa.array(y[new]),
                     pa.array(ensemble.predict(bins[new])), pa.array([float(len(ensemble.trees))] * n)],
                    ["model", "fold", "id", "y", "value", "n"],
                )
            else:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([fit.model]), pa.array([fit.first], pa.int32()), pa.array([pickle.dumps(packed(ensemble))], pa.binary())],
                    ["model", "part", "blob"],
                )

    if tested:
        return copies.mapInArrow(run, "model string, fold int, id long, y double, value double, n double")
    return copies.mapInArrow(run, "model string, part int, blob binary")


def packed(e: Ensemble) -> tuple:
    """An ensemble as numbers and arrays only."""
    return e.start, e.votes, [(t.column, t.cut, t.left, t.value) for t in e.trees]


def unpacked(spec: Spec, blob: bytes) -> Ensemble:
    start, votes, trees = pickle.loads(blob)
    return Ensemble(spec, start, [kernel.Tree(*t) for t in trees], votes)


def joined(parts: Sequence[Ensemble]) -> Ensemble:
    """One ensemble of the groups of a forest."""
    first = parts[0]
    return Ensemble(first.spec, first.start, [t for p in parts for t in p.trees], [v for p in parts for v in p.votes])


# ---- one job per level


def _now(fit: Fit, ids, y, bins, state, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Weight and target of every row for the fit's next tree."""
    if fit.spec.combine == "median":
        weight = state
        for tree, beta, worst in fit.pending:
            weight = kernel.reweighted(weight, np.abs(y - tree.predict(bins)), worst, beta, fit.spec.rate)
        return weight, y
    left = y - fit.start
    if fit.spec.combine == "sum":
        left = left - state
        for tree in fit.pending:
            left = left - fit.spec.rate * tree.predict(bins)
    return kernel.row_weights(fit.spec, number, ids), left


def _level(rows: DataFrame, fits: list[Fit], wanted: dict[int, np.ndarray], edges: np.ndarray) -> DataFrame:
    """(fit, node, h): summed histograms of the wanted nodes of each fit."""
    width = len(edges)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            ids, folds, y, bins = arrays(b, width)
            states = np.array(b.column("state").to_pylist(), float).reshape(b.num_rows, len(fits))
            for i, nodes in wanted.items():
                fit = fits[i]
                number = fit.first + len(fit.trees)
                old = folds < fit.fold
                x = bins[old]
                weight, target = _now(fit, ids[old], y[old], x, states[old, i], number)
                slot = np.full(len(fit.growth.column) if fit.growth else 1, -1)
                slot[nodes] = np.arange(len(nodes))
                inside = slot[fit.growth.tree().leaves(x)] if fit.growth else np.zeros(len(x), np.int64)
                mine = (inside >= 0) & (weight > 0)
                taken = kernel.columns(fit.spec, number, width)
                h = kernel.sums(x[mine], inside[mine], weight[mine], target[mine], taken, len(nodes))
                held[i] = held[i] + h if i in held else h
        for i, h in held.items():
            nodes = wanted[i]
            yield pa.RecordBatch.from_arrays(
                [pa.array([i] * len(nodes), pa.int32()), pa.array(nodes.astype(np.int32)),
                 pa.array([h[:, k].tobytes() for k in range(len(nodes))], pa.binary())], ["fit", "node", "h"],
            )

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for b in batches:
            for fit, node, h in zip(*(b.column(c).to_pylist() for c in ("fit", "node", "h"))):
                h = np.frombuffer(h, float)
                if (fit, node) == key:
                    total = total + h
                    continue
                if key:
                    yield _row(key, total)
                key, total = (fit, node), h
        if key:
            yield _row(key, total)

    schema = "fit int, node int, h binary"
    parts = rows.mapInArrow(partial, schema)
    return parts.repartition("fit", "node").sortWithinPartitions("fit", "node").mapInArrow(merge, schema)


def _row(key: tuple[int, int], h: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([h.tobytes()], pa.binary())], ["fit", "node", "h"]
    )


def _split(lesser: DataFrame, before: DataFrame | None, fits: list[Fit], kin: dict, edges: np.ndarray) -> DataFrame:
    """The histograms of the next nodes with their totals and best splits.  ``kin``: per fit and lesser child its
    parent, the other child, and which of the two go on."""
    width = len(edges)
    if before is not None:
        spark = lesser.sparkSession
        pairs = spark.createDataFrame([(i, small, int(k[0])) for (i, small), k in kin.items()], "fit int, node int, parent int")
        above = before.select("fit", F.col("node").alias("parent"), F.col("h").alias("above"))
        lesser = lesser.join(pairs, ["fit", "node"]).join(above, ["fit", "parent"])
    else:
        lesser = lesser.withColumn("above", F.lit(None).cast("binary"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, node, h, above in zip(*(b.column(c).to_pylist() for c in ("fit", "node", "h", "above"))):
                fit = fits[i]
                number = fit.first + len(fit.trees)
                taken = kernel.columns(fit.spec, number, width)
                h = np.frombuffer(h, float).reshape(2, 1, len(taken), BINS)
                if above is None:
                    nodes = [(node, h)]
                else:
                    _, other, keep = kin[i, node]
                    rest = np.frombuffer(above, float).reshape(h.shape) - h
                    nodes = [x for x, k in (((node, h), keep[0]), ((other, rest), keep[1])) if k]
                for at, own in nodes:
                    s = kernel.best_splits(own, fit.spec, number, np.array([at]), taken, edges)
                    weight, total = own[:, 0, 0].sum(axis=1)
                    out = [i, at, own.tobytes(), weight, total, bool(s.found[0]), int(s.column[0]), int(s.cut[0]), s.weight[0], s.total[0]]
                    yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(out, kinds)], names)

    names = ["fit", "node", "h", "node_weight", "node_total", "found", "column", "cut", "weight", "total"]
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.bool_(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]
    schema = (
        "fit int, node int, h binary, node_weight double, node_total double, found boolean, column int, cut int, "
        "weight double, total double"
    )
    return lesser.select("fit", "node", "h", "above").mapInArrow(run, schema)


def _grow_all(rows: DataFrame, fits: list[Fit], edges: np.ndarray) -> None:
    """One more tree for every fit that is not over: a job per level."""
    going = [i for i, f in enumerate(fits) if not f.over]
    for i in going:
        fits[i].growth = None
    wanted, kin, before = {i: np.zeros(1, np.int64) for i in going}, {}, None
    while wanted:
        level = _split(_level(rows, fits, wanted, edges), before, fits, kin, edges).checkpoint()
        found: dict[int, dict[int, tuple]] = {}
        for r in level.drop("h").collect():  # one row per node
            found.setdefault(r.fit, {})[r.node] = r
        wanted, kin = {}, {}
        for i in going:
            fit, got = fits[i], found.get(i, {})
            if fit.growth is None:
                weight, total = (got[0].node_weight, got[0].node_total) if 0 in got else (0.0, 0.0)
                fit.growth = Growth(fit.spec, fit.first + len(fit.trees), weight, total)
            g = fit.growth
            if not len(g.active) or not got:
                g.active = g.active[:0]
                continue
            r = [got[n] for n in g.active.tolist()]
            parents_of = g.active
            s = Splits(*(np.array([x[c] for x in r]) for c in ("found", "column", "cut", "weight", "total")))
            at, small, large, keep = g.advance(s)
            if len(g.active):
                wanted[i] = small.astype(np.int64)
                for k in range(len(small)):
                    kin[i, int(small[k])] = (int(parents_of[at[k]]), int(large[k]), (bool(keep[0][k]), bool(keep[1][k])))
        before = level


def _by_levels(rows: DataFrame, fits: list[Fit], edges: np.ndarray) -> None:
    """Grow all fits side by side over the partitions of ``rows``."""
    width = len(edges)
    sums = {r.fold: (r.n, r.y) for r in rows.groupBy("fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y")).collect()}
    for f in fits:
        n, y = (sum(v[k] for fold, v in sums.items() if fold < f.fold) for k in (0, 1))
        f.start = 0.0 if f.spec.combine == "median" or not n else y / n
        f.over = not n
    begin = F.array(*[F.lit(1.0 if f.spec.combine == "median" else 0.0) for f in fits])
    rows = rows.withColumn("state", begin)

    def stored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, _, y, bins = arrays(b, width)
            state = np.array(b.column("state").to_pylist(), float).reshape(b.num_rows, len(fits))
            for i, f in enumerate(fits):
                if f.spec.combine == "sum":
                    state[:, i] += sum(f.spec.rate * t.predict(bins) for t in f.pending)
                elif f.spec.combine == "median":
                    state[:, i] = _now(f, ids, y, bins, state[:, i], 0)[0]
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * len(fits)), pa.array(state.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], lists], b.schema.names)

    def errors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, folds, y, bins = arrays(b, width)
            state = np.array(b.column("state").to_pylist(), float).reshape(b.num_rows, len(fits))
            for i, f in enumerate(fits):
                if f.spec.combine == "median" and not f.over:
                    old = folds < f.fold
                    if old.any():
                        weight, _ = _now(f, ids[old], y[old], bins[old], state[old, i], 0)
                        e = np.abs(y[old] - f.growth.tree().predict(bins[old]))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([v]) for v in (i, e.max(), (e * weight).sum(), weight.sum())], ["fit", "worst", "error", "weight"]
                        )

    while not all(f.over for f in fits):
        _grow_all(rows, fits, edges)
        voting = any(f.spec.combine == "median" and not f.over for f in fits)
        seen = {}
        if voting:
            e = rows.mapInArrow(errors, "fit long, worst double, error double, weight double").groupBy("fit")
            seen = {r.fit: r for r in e.agg(F.max("worst").alias("worst"), F.sum("error").alias("error"), F.sum("weight").alias("weight")).collect()}
        for i, f in enumerate(fits):
            if f.over:
                continue
            tree = f.growth.tree()
            if f.spec.combine == "median":
                r = seen[i]
                got = kernel.vote(f.spec, r.worst, r.error / r.weight, not f.trees)
                if got is None:
                    f.over = True
                    continue
                f.votes.append(got[1])
                f.pending.append((tree, got[0], r.worst))
                f.over = got[0] == 1.0
            elif f.spec.combine == "sum":
                f.pending.append(tree)
            f.trees.append(tree)
            f.over = f.over or f.first + len(f.trees) >= f.last
        if any(len(f.pending) >= STORE_EVERY for f in fits):
            rows = rows.mapInArrow(stored, rows.schema).checkpoint()
            for f in fits:
                f.pending = []


# ---- both


def fits_one_task(rows: DataFrame, width: int, task_bytes: int = TASK_BYTES) -> bool:
    return rows.count() * width <= task_bytes


def fit(df: DataFrame, models: Mapping[str, Spec], task_bytes: int = TASK_BYTES) -> dict[str, TreeModel]:
    """Models fitted to rows with ``series_id``, ``ds``, ``y`` and ``raw``."""
    if not models:
        return {}
    ensure_checkpoint_dir(df.sparkSession)
    table = held(df)
    edges = cut_points(table)
    rows = binned(table, edges).withColumn("fold", F.lit(0)).persist()
    try:
        fits = planned(models, [1])
        if fits_one_task(rows, len(edges), task_bytes):
            got = [(r.model, r.part, unpacked(models[r.model], r.blob)) for r in _in_tasks(rows, fits, edges, False).collect()]
        else:
            _by_levels(rows, fits, edges)
            got = [(f.model, f.first, Ensemble(f.spec, f.start, f.trees, f.votes)) for f in fits]
    finally:
        rows.unpersist()
        table.unpersist()
    return {m: TreeModel(joined([e for name, _, e in sorted(got, key=lambda g: g[1]) if name == m]), edges) for m in models}


def validate(df: DataFrame, models: Mapping[str, Spec], k: int, task_bytes: int = TASK_BYTES) -> DataFrame:
    """(model, fold, mae) on the folds 1 to ``k`` of rows with a ``fold``, each model trained on the folds before."""
    ensure_checkpoint_dir(df.sparkSession)
    table = held(df)
    edges = cut_points(table)
    width = len(edges)
    rows = binned(table, edges).persist()
    try:
        fits = planned(models, range(1, k + 1))
        if fits_one_task(rows, width, task_bytes):
            said = _in_tasks(rows, fits, edges, True)
        else:
            _by_levels(rows, fits, edges)

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    ids, folds, y, bins = arrays(b, width)
                    for f in fits:
                        new = folds == f.fold
                        n = int(new.sum())
                        value = Ensemble(f.spec, f.start, f.trees, f.votes).predict(bins[new])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([f.model] * n, pa.string()), pa.array([f.fold] * n, pa.int32()), pa.array(ids[new]),
                             pa.array(y[new]), pa.array(value), pa.array([float(len(f.trees))] * n)],
                            ["model", "fold", "id", "y", "value", "n"],
                        )

            said = rows.mapInArrow(run, "model string, fold int, id long, y double, value double, n double")
        # A forest's groups of trees are weighted by their number.
        each = said.groupBy("model", "fold", "id").agg(
            (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("prediction"), F.first("y").alias("y")
        )
        scores = each.groupBy("model", "fold").agg(F.avg(F.abs(F.col("prediction") - F.col("y"))).alias("mae")).collect()
    finally:
        rows.unpersist()
        table.unpersist()
    return df.sparkSession.createDataFrame(scores, "model string, fold int, mae double")
