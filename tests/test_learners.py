"""Penalties, trees and scalers against closed forms and plain versions."""

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tidecast.functions import kernels
from tidecast.functions import trees as kernel
from tidecast.functions.trees import Spec
from tidecast.operators import learners as ml
from tidecast.operators import linear, quantiles, trees


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 4))
    x = (x - x.mean(axis=0)) / x.std(axis=0)
    y = x @ np.array([3.0, -2.0, 0.0, 0.5]) + 5 + rng.normal(0, 2, 400)
    rows = [(*map(float, r), float(v), f"s{i % 4}", i, i * 4 // 400) for i, (r, v) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, y double, series_id string, ds int, fold int").repartition(4)
    df = VectorAssembler(inputCols=list("abcd"), outputCol="raw").transform(df).withColumn("features", F.col("raw"))
    return df.persist(), x, y


def descend(x, y, l1, l2, rounds=5000):
    """Coordinate descent on 1/(2n)|y - xw|^2 + l1 |w|_1 + l2/2 |w|^2 (centred)."""
    n, w, yc = len(y), np.zeros(x.shape[1]), y - y.mean()
    for _ in range(rounds):
        for j in range(len(w)):
            r = yc - x @ w + x[:, j] * w[j]
            rho = x[:, j] @ r / n
            w[j] = np.sign(rho) * max(abs(rho) - l1, 0) / (x[:, j] @ x[:, j] / n + l2)
    return w


def test_ridge(data):
    df, x, y = data
    want = np.linalg.solve(x.T @ x + 10 * np.eye(4), x.T @ (y - y.mean()))
    np.testing.assert_allclose(ml.fit_model(df, "ridge", dict(alpha=10.0)).weights, want, rtol=1e-8)


def test_lasso(data):
    df, x, y = data
    got = ml.fit_model(df, "lasso", dict(alpha=0.3)).weights
    np.testing.assert_allclose(got, descend(x, y, 0.3, 0.0), atol=1e-9)
    assert got[2] == 0.0


def test_elastic_net(data):
    df, x, y = data
    got = ml.fit_model(df, "elastic_net", dict(alpha=0.4, l1_ratio=0.5)).weights
    np.testing.assert_allclose(got, descend(x, y, 0.2, 0.2), atol=1e-9)


def test_bayesian_ridge_from_partial_grams(data):
    df, x, y = data
    model = ml.fit_model(df, "bayesian_ridge", {})
    w, cov, noise, _ = kernels.bayes_ridge(x.T @ x, x.T @ (y - y.mean()), np.sum((y - y.mean()) ** 2), len(y))
    np.testing.assert_allclose(model.weights, w, rtol=1e-8)
    assert model.noise == pytest.approx(4.0, rel=0.2)
    got = model.transform(df).select("prediction", "prediction_sd", "a", "b", "c", "d").first()
    z = np.array(got[2:])
    assert got.prediction == pytest.approx(z @ w + y.mean())
    away = z - x.mean(axis=0)
    assert got.prediction_sd == pytest.approx(np.sqrt(away @ cov @ away + noise))


@pytest.mark.parametrize("scale", ["standard", "robust"])
def test_folds_of_linear_models_one_by_one(data, scale):
    df, x, y = data
    fold = np.arange(400) * 4 // 400
    models = {"r": ("ridge", dict(alpha=2.0)), "l": ("lasso", dict(alpha=0.2)), "e": ("elastic_net", {}), "b": ("bayesian_ridge", {})}
    got = {(r.model, r.fold): r.mae for r in linear.validate(df, models, 3, scale).collect()}
    assert len(got) == 12
    for k in (1, 2, 3):
        a, b = x[fold < k], x[fold == k]
        q = np.quantile(a, [0.25, 0.5, 0.75], axis=0)
        centre, spread = (a.mean(0), a.std(0, ddof=1)) if scale == "standard" else (q[1], q[2] - q[0])
        a, b, u, v = (a - centre) / spread, (b - centre) / spread, y[fold < k], y[fold == k]
        ac, uc = a - a.mean(0), u - u.mean()
        for name, w in (
            ("r", np.linalg.solve(ac.T @ ac + 2 * np.eye(4), ac.T @ uc)), ("l", descend(ac, u, 0.2, 0, 500)),
            ("e", descend(ac, u, 0.05, 0.05, 500)), ("b", kernels.bayes_ridge(ac.T @ ac, ac.T @ uc, uc @ uc, len(u))[0]),
        ):
            assert got[name, k] == pytest.approx(np.abs(v - (b - a.mean(0)) @ w - u.mean()).mean(), rel=1e-8), name


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    x = np.column_stack((rng.normal(0, 1e3, 300), rng.integers(-2, 3, 300), rng.lognormal(0, 40, 300), np.zeros(300), -rng.random(300)))
    x[:5, 3] = -0.0
    df = spark.createDataFrame([(*map(float, r), i * 3 // 300) for i, r in enumerate(x)], "a double, b double, c double, d double, e double, fold int")
    df = VectorAssembler(inputCols=list("abcde"), outputCol="raw").transform(df.repartition(5))
    shares = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]
    np.testing.assert_array_equal(quantiles.unordered(quantiles.ordered(x[:, 0])), x[:, 0])
    for k, got in quantiles.exact_quantiles(df, shares, [1, 2, 3]).items():
        np.testing.assert_allclose(got, np.quantile(x[: k * 100], shares, axis=0), rtol=1e-12)
    np.testing.assert_allclose(quantiles.exact_quantiles(df, shares)[0], np.quantile(x, shares, axis=0), rtol=1e-12)


TREES = {
    "boost": Spec("sum", 4, 3, 0.3, 2, 0.8, 0.8), "forest": Spec("mean", 3, 4, 1, 2, bootstrap=True),
    "extra": Spec("mean", 3, 4, 1, 2, random_cuts=True), "ada": Spec("median", 4, 3, 0.5, 0),
}


def test_trees_by_levels_equal_trees_in_tasks(data):
    df, _, _ = data
    one, many = trees.fit(df, TREES), trees.fit(df, TREES, task_bytes=0)
    for name in TREES:
        a, b = one[name].ensemble, many[name].ensemble
        assert len(a.trees) == len(b.trees) == TREES[name].rounds
        np.testing.assert_allclose(a.votes, b.votes)
        for t, u in zip(a.trees, b.trees):
            assert (t.column == u.column).all() and (t.cut == u.cut).all() and (t.left == u.left).all()
            np.testing.assert_allclose(t.value, u.value, atol=1e-9)


def test_folds_of_trees_one_by_one(data):
    df, x, y = data
    got = {(r.model, r.fold): r.mae for r in trees.validate(df, TREES, 2).collect()}
    again = {(r.model, r.fold): r.mae for r in trees.validate(df, {"boost": TREES["boost"]}, 1, task_bytes=0).collect()}
    assert again["boost", 1] == pytest.approx(got["boost", 1])
    edges = trees.cut_points(df)
    rows = trees.binned(df, edges).orderBy("id").collect()
    ids, fold, target = (np.array([r[c] for r in rows]) for c in ("id", "fold", "y"))
    bins = np.stack([np.frombuffer(r.bins, np.uint8) for r in rows])
    for name, spec in TREES.items():
        for k in (1, 2):
            old = fold < k
            e = kernel.train(bins[old], target[old], ids[old], edges, spec)
            assert got[name, k] == pytest.approx(np.abs(e.predict(bins[fold == k]) - target[fold == k]).mean())


def plain_best(bins, y, w, least):
    """(column, cut) of least squared error by trying all."""
    best, where = np.inf, None
    for c in range(bins.shape[1]):
        for cut in range(kernel.BINS - 1):
            left = bins[:, c] <= cut
            if w[left].sum() >= least and w[~left].sum() >= least:
                error = sum((w[s] * (y[s] - np.average(y[s], weights=w[s])) ** 2).sum() for s in (left, ~left))
                if error < best - 1e-9:
                    best, where = error, (c, cut)
    return where


def test_each_node_has_the_best_split():
    rng = np.random.default_rng(6)
    bins, y = rng.integers(0, 9, (200, 3)).astype(np.uint8), rng.normal(0, 1, 200)
    y += bins[:, 1] * (bins[:, 2] > 4)
    w = rng.integers(0, 3, 200).astype(float)
    spec = Spec("mean", 1, 4, min_rows=5)
    tree = kernel.grow(bins, w, y, spec, 0, np.tile(np.arange(32.0), (3, 1)))
    at = {0: w > 0}
    for node in range(len(tree.column)):
        mine = at[node]
        if tree.column[node] >= 0:
            assert plain_best(bins[mine], y[mine], w[mine], 5) == (tree.column[node], tree.cut[node])
            right = bins[:, tree.column[node]] > tree.cut[node]
            at[tree.left[node]], at[tree.left[node] + 1] = mine & ~right, mine & right
        assert tree.value[node] == pytest.approx(np.average(y[mine], weights=w[mine]))


def test_random_cuts_differ_with_all_columns_offered():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 2))
    edges = np.quantile(x, np.arange(1, 33) / 32, axis=0).T
    bins = trees.to_bins(x, edges)
    spec = Spec("mean", 30, 1, random_cuts=True)
    cuts = {(int(t.column[0]), int(t.cut[0])) for t in kernel.train(bins, x[:, 0] + x[:, 1], np.arange(300), edges, spec).trees}
    assert len(cuts) > 10


def test_adaboost_by_hand():
    """Weights, votes and the weighted median of the rounds."""
    rng = np.random.default_rng(8)
    bins = rng.integers(0, 20, (150, 3)).astype(np.uint8)
    y = bins[:, 0] * 2.0 + rng.normal(0, 3, 150)
    edges = np.tile(np.arange(32.0), (3, 1))
    spec = Spec("median", 5, 2, 0.7, 0)
    got = kernel.train(bins, y, np.arange(150), edges, spec)
    w, votes = np.ones(150), []
    for tree in got.trees:
        same = kernel.grow(bins, w / w.mean(), y, spec, len(votes), edges)
        assert (same.column == tree.column).all() and (same.cut == tree.cut).all()
        e = np.abs(y - tree.predict(bins))
        loss = (w * e / e.max()).sum() / w.sum()
        beta = loss / (1 - loss)
        votes.append(np.log(1 / beta) * 0.7)
        w = w * beta ** ((1 - e / e.max()) * 0.7)
    np.testing.assert_allclose(got.votes, votes)
    values = np.stack([t.predict(bins) for t in got.trees], axis=1)
    for row, said in zip(values, got.predict(bins)):
        run = 0.0
        for value, vote in sorted(zip(row, votes)):
            run += vote
            if run >= sum(votes) / 2 - 1e-12:
                break
        assert said == value


def test_constant_target_and_few_rows(spark):
    df = spark.createDataFrame([("a", i, 5.0, float(i)) for i in range(3)], "series_id string, ds int, y double, x double")
    df = VectorAssembler(inputCols=["x"], outputCol="raw").transform(df)
    for model in trees.fit(df, TREES).values():
        assert [r.prediction for r in model.transform(df).collect()] == [5.0] * 3


def test_weights_and_ensemble(spark):
    scores = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("b", 1, 3.0), ("b", 2, 3.0)], "model string, fold int, mae double")
    weights = ml.mae_weights(ml.summarise(scores))
    got = {r.model: r.weight for r in weights.collect()}
    assert got == {"a": pytest.approx(2 / 3), "b": pytest.approx(1 / 3)}
    p = spark.createDataFrame([("s", 1, "a", 30.0)], "series_id string, target_ds int, model string, yhat double")
    assert ml.weighted_ensemble(p, weights).first().yhat == pytest.approx(30.0)
    assert ml.weighted_ensemble(p, weights, renormalise=False).first().yhat == pytest.approx(20.0)
    assert [r.model for r in ml.leaderboard(ml.summarise(scores)).collect()] == ["a", "b"]
