"""Linear models from Gram sums: ridge, lasso, elastic net and Bayesian ridge, for all folds from one pass.

Every task adds up the products of (1, y, x) of its rows per fold, around the overall means; the matrices are added up
in a shuffle keyed by fold and entry, and (features + 2)^2 numbers per fold reach the driver.  Running sums over the
folds are the matrices of every expanding training set, and scaling a column only scales its row and column.  Lasso
and elastic net are solved by coordinate descent on the matrix.  One more pass scores all models on all folds.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from .quantiles import exact_quantiles

# Ship what this module holds with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KINDS = ("ridge", "lasso", "elastic_net", "bayesian_ridge")


class Scaler:
    """Adds ``features``: the ``raw`` vector less ``centre``, divided by ``scale`` (by one where that is zero)."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray) -> None:
        self.centre, self.scale = centre, np.where(scale == 0, 1.0, scale)

    def transform(self, df: DataFrame) -> DataFrame:
        literals = F.arrays_zip(
            F.array(*[F.lit(float(v)) for v in self.centre]).alias("c"), F.array(*[F.lit(float(v)) for v in self.scale]).alias("s")
        )
        scaled = F.zip_with(vector_to_array("raw"), literals, lambda x, p: (x - p["c"]) / p["s"])
        return df.withColumn("features", array_to_vector(scaled))


def robust_scalers(df: DataFrame, upto: Sequence[int] | None = None) -> dict[int, Scaler]:
    """Median and distance of the quartiles, exact, of the rows before each fold; of all rows under 0."""
    return {e: Scaler(q[1], q[2] - q[0]) for e, q in exact_quantiles(df, (0.25, 0.5, 0.75), upto).items()}


class Moments:
    """Sums of products of (1, y - a, x - b) over some rows."""

    def __init__(self, sums: np.ndarray, around: np.ndarray) -> None:
        self.sums, self.around = sums, around

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.sums + other.sums, self.around)

    def scaler(self) -> Scaler:
        """Mean and sample deviation."""
        n, x = self.sums[0, 0], self.sums[0, 2:]
        var = (np.diag(self.sums)[2:] - x * x / n) / max(n - 1, 1)
        return Scaler(self.around[1:] + x / n, np.sqrt(np.maximum(var, 0)))

    def centred(self, scaler: Scaler):
        """n, mean of y, means of the scaled columns, their Gram matrix, products with y, and the square of y, centred."""
        n, y, x = self.sums[0, 0], self.sums[0, 1], self.sums[0, 2:]
        gram = (self.sums[2:, 2:] - np.outer(x, x) / n) / np.outer(scaler.scale, scaler.scale)
        cross = (self.sums[2:, 1] - x * y / n) / scaler.scale
        mean = (self.around[1:] + x / n - scaler.centre) / scaler.scale
        return n, self.around[0] + y / n, mean, gram, cross, max(self.sums[1, 1] - y * y / n, 0.0)


def moments(df: DataFrame) -> dict[int, Moments]:
    """Of each ``fold`` of rows with ``raw`` and ``y``, around the overall means."""
    mean = df.select(F.avg("y").alias("y"), Summarizer.mean(F.col("raw")).alias("x")).first()
    if mean["y"] is None:
        raise ValueError("no rows to train on")
    around = np.concatenate(([mean["y"]], mean["x"].toArray()))
    rows = df.select(F.col("fold").cast("int").alias("fold"), F.concat(F.array(F.col("y")), vector_to_array("raw")).alias("z"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            fold = b.column("fold").to_numpy()
            z = b.column("z").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(around)) - around
            z = np.column_stack((np.ones(len(z)), z))
            for f in np.unique(fold).tolist():
                mine = z[fold == f]
                held[f] = held.get(f, 0) + mine.T @ mine
        for f, sums in held.items():
            i, j = np.triu_indices(len(sums))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(i), f, np.int32)), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(sums[i, j])],
                ["fold", "i", "j", "v"],
            )

    sums = rows.mapInArrow(run, "fold int, i int, j int, v double").groupBy("fold", "i", "j").agg(F.sum("v").alias("v"))
    out: dict[int, np.ndarray] = {}
    for r in sums.collect():  # (features + 2)^2 / 2 numbers per fold, whatever the number of rows
        m = out.setdefault(r.fold, np.zeros((len(around) + 1,) * 2))
        m[r.i, r.j] = m[r.j, r.i] = r.v
    return {f: Moments(m, around) for f, m in out.items()}


#: Rounds over the weights after which coordinate descent stops at the latest; nearly collinear columns move on
#: for ever without a change in what they say.
ROUNDS = 2000


def descend(gram: np.ndarray, cross: np.ndarray, n: float, l1: float, l2: float, tol: float = 1e-22) -> np.ndarray:
    """Weights with the least 1/(2n) |y - xw|^2 + l1 |w|_1 + l2/2 |w|^2, one coordinate after the other.

    Rounds over all coordinates alternate with rounds over those that are not zero, until one over all of them lowers
    the objective by less than ``tol`` of what the weights explain."""
    gram, cross = gram / n, cross / n
    w, pull = np.zeros(len(cross)), cross.copy()  # pull: cross - gram @ w
    every = np.flatnonzero(np.diag(gram) > 1e-12 * np.diag(gram).max(initial=0.0))
    active = every
    for _ in range(ROUNDS):
        moved = 0.0
        for j in active:
            rho = pull[j] + gram[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - l1, 0.0) / (gram[j, j] + l2)
            if new != w[j]:
                pull -= gram[:, j] * (new - w[j])
                moved += gram[j, j] * (new - w[j]) ** 2
                w[j] = new
        if moved <= tol * abs(w @ cross):
            if active is every:
                break
            active = every
        else:
            active = np.flatnonzero(w) if active is every else active
    return w


def solved(m: Moments, scaler: Scaler, kind: str, settings: Mapping):
    """(weights, intercept, and for Bayesian ridge covariance, noise and centre) on scaled columns."""
    n, y, mean, gram, cross, square = m.centred(scaler)
    cov, noise, centre = None, 0.0, None
    if kind == "ridge":
        w = np.linalg.solve(gram + settings.get("alpha", 1.0) * np.eye(len(gram)), cross)
    elif kind == "bayesian_ridge":
        w, cov, noise, settled = kernels.bayes_ridge(gram, cross, square, n)
        if not settled:
            raise RuntimeError("the evidence iteration did not settle")
        centre = mean
    else:
        alpha = settings.get("alpha", 0.1)
        share = settings.get("l1_ratio", 0.5) if kind == "elastic_net" else 1.0
        w = descend(gram, cross, n, alpha * share, alpha * (1 - share))
    return w, float(y - w @ mean), cov, float(noise), centre


def validate(df: DataFrame, models: Mapping[str, tuple[str, Mapping]], k: int, scale: str) -> DataFrame:
    """(model, fold, mae) on the folds 1 to ``k`` of rows with a ``fold``, each trained on the folds before."""
    of_fold = moments(df)
    robust = robust_scalers(df, range(1, k + 1)) if scale == "robust" else None
    rules = []
    for fold in range(1, k + 1):
        parts = [m for f, m in of_fold.items() if f < fold]
        if not parts or fold not in of_fold:
            raise ValueError(f"{k} folds need more than {k} days")
        m = sum(parts[1:], parts[0])
        scaler = robust[fold] if robust else m.scaler()
        for name, (kind, settings) in models.items():
            w, b, *_ = solved(m, scaler, kind, settings)
            raw = w / scaler.scale
            rules.append((name, fold, raw, b - raw @ scaler.centre))
    weights, starts = np.stack([r[2] for r in rules], axis=1), np.array([r[3] for r in rules])
    rows = df.where(F.col("fold") > 0).select(F.col("fold").cast("int").alias("fold"), F.col("y").cast("double").alias("y"), vector_to_array("raw").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fold, y = b.column("fold").to_numpy(), b.column("y").to_numpy()
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(weights))
            error = np.abs(x @ weights + starts - y[:, None])
            for i, (name, f, *_) in enumerate(rules):
                e = error[fold == f, i]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name]), pa.array([f], pa.int32()), pa.array([float(e.sum())]), pa.array([len(e)])], ["model", "fold", "e", "n"]
                )

    errors = rows.mapInArrow(run, "model string, fold int, e double, n long")
    return errors.groupBy("model", "fold").agg((F.sum("e") / F.sum("n")).alias("mae"))
